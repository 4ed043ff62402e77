"""Vectors dealt to cells around pivots: exact nearest neighbours by triangle bounds, and approximate ones by quantised residuals.

A corpus vector belongs to the pivot nearest by angle. Angles between unit vectors are a metric, so for a query at angle ``a`` from a pivot, an item of its
cell, which lies between ``low`` and ``high`` from it, is at least max(a - high, low - a) away; it also is nearer to its own pivot than to
the query's, so it is at least half the difference of the query's two angles away. The cosine of that is the most a cell can give.

:func:`nearest` reads cells in two passes: first the most promising ones with k items, which give a kth score, then the others whose
bound reaches it. Both are joins of visits (query, cell) with the dealt corpus, by (cell, part, block): large cells are split into parts, popular ones
into blocks of queries, so a group is bounded whatever the data are. Nothing of a query passes the driver, and the plan is the same
for any number of queries. What is collected are the pivots (a bounded sample) and one row of counts a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranking import best
from lectern.session import cut, forget, ship

PIVOTS, PER_CELL, ROWS, BLOCK = 64, 1_024, 16_384, 2_048
SCORES = 250_000  # cosines a Python worker works out at once
EDGE = 1e-6  # what rounding can move an angle or a score
LEFT_OUT = 1 << 24  # after all scores in millionths
ZERO, ALONE = -2, -1  # cells of zero vectors, and of vectors of a length without pivots
PAIRS_DDL = "query_id long, item_id long, score double"
PAIRS = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])


def grouped(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of the vectors; null vectors and vectors with null or non-finite components are left out."""
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        ok = np.isfinite(m).all(1)
        yield dim, at[ok], m[ok]


def units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of the rows of ``m`` (any length but zero) with unit pivots."""
    return np.arccos(np.clip(units(m) @ pivots.T, -1, 1))


def sampled(corpus: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit vectors of a sample of ``n`` rows (the smallest hashes of their ids), by length."""
    rows = corpus.where(F.size("embedding") > 0).orderBy(F.xxhash64("item_id"), "item_id").limit(n).select("embedding").toArrow()
    column = rows.column("embedding").combine_chunks()
    out = {}
    for dim, _, m in grouped(column):
        m = np.unique(units(m[np.linalg.norm(m, axis=1) > 0]), axis=0)
        if len(m):
            out[dim] = m
    return out


@dataclass
class Cells:
    """The corpus in its cells: (item_id, embedding, dim, cell, part), and what is known of each (dim, cell)."""

    pivots: dict[int, np.ndarray]
    rows: DataFrame
    known: dict[tuple[int, int], tuple[int, float, float]]  # items, least and largest angle

    def parts(self, dim: int, cell: int, size: int = ROWS) -> int:
        return max(1, math.ceil(self.known[dim, cell][0] / size))


def deal(corpus: DataFrame, pivots: dict[int, np.ndarray], group: int = ROWS) -> Cells:
    """Write the (item_id, embedding) rows with their cells."""
    spark = corpus.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, m in grouped(batch.column(1)):
                cell, angle = np.full(len(at), ALONE), np.zeros(len(at))
                zero = ~m.any(1)
                if dim in shared.value:
                    a = angles(m, shared.value[dim])
                    cell = a.argmin(1)
                    angle = a[np.arange(len(at)), cell]
                cell[zero] = ZERO
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["item_id", "embedding", "dim", "cell", "angle"])

    kind = dict(corpus.dtypes)["embedding"]
    dealt = corpus.select(F.col("item_id").cast("long").alias("item_id"), "embedding").mapInArrow(run, f"item_id long, embedding {kind}, dim int, cell int, angle double")
    rows = cut(dealt, "cells")
    counts = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # a row a cell
    return Cells(pivots, rows, {(r.dim, r.cell): (r.n, r.low, r.high) for r in counts})


class Bounds:
    """What the cells can give a query at most, for tasks: no DataFrame inside."""

    def __init__(self, cells: Cells):
        self.pivots, self.by_dim = cells.pivots, {}
        for (dim, cell), (n, low, high) in sorted(cells.known.items()):
            self.by_dim.setdefault(dim, []).append((cell, n, low, high))

    def of(self, dim: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, items in them, queries x cells: the largest cosine possible)."""
        some = self.by_dim.get(dim, [])
        cell, n, low, high = (np.array(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.int64),) * 4
        top = np.ones((len(m), len(cell)))
        real = cell >= 0
        if real.any():
            a = angles(m, self.pivots[dim])
            nearest, a = a.min(1, keepdims=True), a[:, cell[real]]
            gap = np.maximum(np.maximum(a - high[real], low[real] - a), (a - nearest) / 2) - EDGE
            top[:, real] = np.cos(np.clip(gap, 0, np.pi)) + EDGE
        top[:, cell == ZERO] = 0
        top[~m.any(1)] = 0
        return cell, n, top


def visits(queries: DataFrame, cells: Cells, k: int | None, again: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, dim, cell) to visit.

    First pass: the best cells until they hold k items besides the query; with ``again`` (queries have ``least``), the others
    that can reach ``least``. With ``probes`` that many best cells; without ``k`` all cells.
    """
    shared = queries.sparkSession.sparkContext.broadcast(Bounds(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column(2).to_numpy(zero_copy_only=False) if again else None
            for dim, at, m in grouped(batch.column(1)):
                cell, n, top = shared.value.of(dim, m)
                if not len(cell):
                    continue
                order = np.argsort(-top, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(top.shape, bool)
                np.put_along_axis(first, order, before < (np.inf if k is None else k + 1), axis=1)
                if probes is not None:
                    np.put_along_axis(first, order, np.broadcast_to(np.arange(len(cell)) < probes, top.shape), axis=1)
                wanted = ~first & (top >= least[at][:, None]) if again else first
                q, c = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[q])), pa.array(np.full(len(q), dim, np.int32)), pa.array(cell[c].astype(np.int32))], names=["query_id", "dim", "cell"])

    some = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding", *(["least"] if again else []))
    return some.mapInArrow(run, "query_id long, dim int, cell int")


def met(asked: DataFrame, queries: DataFrame, cells: Cells, rows: DataFrame, block: int, group: int):
    """The two sides of the visits, to be cogrouped by (dim, cell, part, block): queries with their vectors, and the rows of the cells."""
    spark = asked.sparkSession
    popular = asked.groupBy("dim", "cell").count().collect()  # a row a cell
    plan = [(r.dim, r.cell, cells.parts(r.dim, r.cell, group), max(1, math.ceil(r["count"] / block))) for r in popular]
    plan = F.broadcast(spark.createDataFrame(plan, "dim int, cell int, parts int, blocks int"))
    some = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").distinct()
    left = asked.join(plan, ["dim", "cell"]).join(some, "query_id")
    left = left.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = rows.join(plan, ["dim", "cell"])
    right = right.withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["dim", "cell", "part", "block"]
    return left.select(*keys, "query_id", "embedding").groupBy(*keys), right.select(*keys, *[c for c in rows.columns if c not in (*keys, "angle")]).groupBy(*keys)


def leading(score: np.ndarray, k: int) -> np.ndarray:
    """Which are the k largest of each row; of equal ones the earlier columns."""
    if k >= score.shape[1]:
        return np.ones(score.shape, bool)
    edge = np.partition(score, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]]
    above, tie = score > edge, score == edge
    return above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))


def scored(k: int | None, threshold: float | None):
    """Cosines of a group's queries with its items, rounded to six digits; the k best of each query, ties to the smaller item."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("item_id")
        dim = asked.column("dim")[0].as_py() if asked.num_rows else 0
        parts = []
        if rows.num_rows and dim:
            flat = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            qid, item, m, c = asked.column("query_id").to_numpy(), rows.column("item_id").to_numpy(), flat(asked), flat(rows)
            norms, lengths = np.linalg.norm(m, axis=1), np.linalg.norm(c, axis=1)
            step = max(1, SCORES // len(item))
            for i in range(0, len(qid), step):
                scale = norms[i : i + step, None] * lengths[None, :]
                score = np.round(np.divide(m[i : i + step] @ c.T, scale, out=np.zeros_like(scale), where=scale > 0), 6)
                score[qid[i : i + step, None] == item[None, :]] = -np.inf
                if threshold is not None:
                    score[score < threshold] = -np.inf
                keep = np.isfinite(score)
                if k is not None:
                    keep &= leading(score, k)
                q, d = np.nonzero(keep)
                parts.append(pa.Table.from_arrays([pa.array(qid[i + q]), pa.array(item[d]), pa.array(score[q, d])], schema=PAIRS))
        return pa.concat_tables(parts) if parts else PAIRS.empty_table()

    return run


def pairs(asked: DataFrame, queries: DataFrame, cells: Cells, k: int | None, threshold: float | None, block: int = BLOCK, group: int = ROWS) -> DataFrame:
    left, right = met(asked, queries, cells, cells.rows, block, group)
    return left.cogroup(right).applyInArrow(scored(k, threshold), PAIRS_DDL)


def blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(dim, ids, flat): vectors in stored blocks of ``size`` at most, of one length each, a row a block; rows are dealt evenly, some eight blocks a task."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(dim: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel())) for x in (ids, m)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists], names=["dim", "ids", "flat"])

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # fewer than ``size`` of a length
        for batch in batches:
            for dim, at, m in grouped(batch.column(1)):
                ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
                if dim in held:
                    ids, m = np.concatenate((held[dim][0], ids)), np.concatenate((held[dim][1], m))
                full = len(ids) // size * size
                for i in range(0, full, size):
                    yield block(dim, ids[i : i + size], m[i : i + size])
                held[dim] = ids[full:], m[full:]
        for dim, (ids, m) in held.items():
            if len(ids):
                yield block(dim, ids, m)

    some = rows.select(F.col(key).cast("long").alias(key), "embedding")
    return cut(some.repartition(max(1, math.ceil(some.count() / size / 8))).mapInArrow(run, "dim int, ids array<long>, flat array<double>"), "blocks")


def every(asked: tuple[np.ndarray, np.ndarray], items: tuple[np.ndarray, np.ndarray], threshold: float | None = None) -> Iterator[pa.RecordBatch]:
    """The rounded cosines of all pairs of two blocks but an item with itself, from the largest down.

    In this order equal scores are neighbours and ids are few, so that files take about half the room that they have by query.
    """
    (qid, m), (item, c) = asked, items
    norms, lengths, n = np.linalg.norm(m, axis=1), np.linalg.norm(c, axis=1), len(item)
    key, bits = np.empty((len(qid), n), np.int64), (len(qid) * n).bit_length()  # the score in millionths downwards, and the pair's place below it
    step = max(1, SCORES // n)
    for i in range(0, len(qid), step):
        scale = norms[i : i + step, None] * lengths[None, :]
        score = np.rint(np.divide(m[i : i + step] @ c.T, scale, out=np.zeros_like(scale), where=scale > 0) * 1e6)
        least = -np.inf if threshold is None else threshold
        key[i : i + step] = np.where((qid[i : i + step, None] != item[None, :]) & (score / 1e6 >= least), -score, LEFT_OUT)
    key = (key.ravel() << bits) + np.arange(key.size)
    key.sort()
    key = key[: np.searchsorted(key, LEFT_OUT << bits)]
    for i in range(0, len(key), SCORES):
        at, score = key[i : i + SCORES] & ((1 << bits) - 1), -(key[i : i + SCORES] >> bits) / 1e6
        yield pa.RecordBatch.from_arrays([pa.array(qid[at // n]), pa.array(item[at % n]), pa.array(score)], schema=PAIRS)


def all_pairs(queries: DataFrame, corpus: DataFrame, threshold: float | None = None, block: int = BLOCK, group: int = ROWS) -> DataFrame:
    """(query_id, item_id, score) of all pairs: blocks of both sides are stored once and meet in a Cartesian product, so nothing of a pair is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (dim, qid, m), (other, item, c) = (((x := batch.slice(i, 1)).column(at)[0].as_py(), *(x.column(at + j).flatten().to_numpy() for j in (1, 2))) for at in (0, 3))
                if dim == other:
                    yield from every((qid, m.reshape(-1, dim)), (item, c.reshape(-1, dim)), threshold)

    items = blocks(corpus, "item_id", group).toDF("other", "item_ids", "item_flat")
    return blocks(queries, "query_id", block).crossJoin(items.hint("shuffle_replicate_nl")).mapInArrow(run, PAIRS_DDL)


def nearest(queries: DataFrame, corpus: DataFrame, k: int | None, threshold: float | None = None, pivots: int | None = None, block: int = BLOCK, group: int = ROWS) -> DataFrame:
    """(query_id, item_id, score): the k best of each query, itself excluded; all pairs without ``k``.

    Vectors of another length than the query's have no score; a zero vector scores 0 with all. There is a pivot for
    every ``PER_CELL`` rows, PIVOTS at most, unless their number is given.
    """
    if k is None:
        return all_pairs(queries, corpus, threshold, block, group)
    pivots = min(PIVOTS, max(1, corpus.count() // PER_CELL)) if pivots is None else pivots
    cells = deal(corpus, sampled(corpus, pivots), group)
    asked = queries.select("query_id", "embedding")
    first = cut(visits(asked, cells, k), "visits")
    found = pairs(first, asked, cells, k, threshold, block, group)
    if len(cells.known) <= 1:  # every cell is visited
        return found
    found = cut(best(found, k).drop("rank"), "first-pass")
    forget(first)
    kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bound = F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0) if threshold is None else F.greatest(F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0), F.lit(threshold))
    least = asked.join(kth, "query_id", "left").withColumn("least", F.coalesce(bound, F.lit(-2.0 if threshold is None else threshold)) - EDGE)
    second = cut(visits(least, cells, k, again=True), "visits")
    return found.unionByName(pairs(second, asked, cells, k, threshold, block, group))


# Approximate search: an inverted file of quantised residuals


def lloyd(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    """Centres of k-means on a bounded sample; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = (((centres * centres).sum(1)[None, :] - 2 * x @ centres.T)).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        some = n > 0
        centres[some] = sums[some] / n[some, None]
    return centres


@dataclass
class Quantiser:
    """For each length of vectors: coarse centres (unit vectors) and a codebook for each piece of the residual."""

    centres: dict[int, np.ndarray]
    books: dict[int, list[np.ndarray]]

    def codes(self, dim: int, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = units(m) - self.centres[dim][cell]
        out, at = [], 0
        for book in self.books[dim]:
            piece = rest[:, at : at + book.shape[1]]
            out.append(((book * book).sum(1)[None, :] - 2 * piece @ book.T).argmin(1))
            at += book.shape[1]
        return np.stack(out, 1).astype(np.uint8)


def fit(corpus: DataFrame, cells: int = 64, pieces: int = 32, sample: int = 20_000, steps: int = 8, seed: int = 42) -> Quantiser:
    """Fit on a sample of at most ``sample`` vectors, in the driver; every row is indexed later."""
    centres, books = {}, {}
    for dim, x in sampled(corpus, sample).items():
        c = units(lloyd(x, min(cells, len(x)), steps, seed))
        rest = x - c[(x @ c.T).argmax(1)]
        centres[dim] = c
        books[dim] = [lloyd(piece, min(256, len(x)), steps, seed) for piece in np.array_split(rest, min(pieces, dim), axis=1)]
    return Quantiser(centres, books)


@dataclass
class Inverted:
    """An index: cells, and a row an item with its codes (one byte a piece)."""

    quantiser: Quantiser
    cells: Cells
    codes: DataFrame


def invert(corpus: DataFrame, quantiser: Quantiser, group: int = ROWS) -> Inverted:
    cells = deal(corpus, quantiser.centres, group)
    shared = corpus.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(3).to_numpy()
            for dim, at, m in grouped(batch.column(1)):
                coded = [None] * len(at)
                real = np.flatnonzero(cell[at] >= 0)
                if len(real):
                    for i, row in zip(real.tolist(), shared.value.codes(dim, m[real], cell[at][real]), strict=True):
                        coded[i] = row.tobytes()
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), batch.column(3).take(rows), pa.array(coded, pa.binary())], names=["item_id", "dim", "cell", "code"])

    codes = cells.rows.select("item_id", "embedding", "dim", "cell").mapInArrow(run, "item_id long, dim int, cell int, code binary")
    return Inverted(quantiser, cells, cut(codes, "codes"))


def estimated(quantiser, keep: int):
    """The ``keep`` items of a group with the largest estimated cosine for each query, from the codes alone; of copies the smaller ids."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("item_id")
        parts = []
        if asked.num_rows and rows.num_rows:
            dim, cell = asked.column("dim")[0].as_py(), asked.column("cell")[0].as_py()
            qid, item = asked.column("query_id").to_numpy(), rows.column("item_id").to_numpy()
            q = units(asked.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
            score = np.zeros((len(qid), len(item)))
            if cell >= 0:
                books = quantiser.value.books[dim]
                code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
                near = np.concatenate([book[code[:, i]] for i, book in enumerate(books)], axis=1)
                near += quantiser.value.centres[dim][cell]
                score = q @ near.T
            score[qid[:, None] == item[None, :]] = -np.inf
            a, b = np.nonzero(leading(score, keep) & np.isfinite(score))
            parts.append(pa.Table.from_arrays([pa.array(qid[a]), pa.array(item[b]), pa.array(score[a, b])], schema=PAIRS))
        return pa.concat_tables(parts) if parts else PAIRS.empty_table()

    return run


def probe(queries: DataFrame, index: Inverted, k: int, probes: int = 40, keep: int = 100, block: int = 256, group: int = ROWS) -> DataFrame:
    """(query_id, item_id, score, seen): the best of the ``probes`` cells nearest to each query.

    Codes give the ``keep`` best, which are scored exactly from their vectors; ``seen`` is how many items the probed cells hold.
    """
    spark = queries.sparkSession
    asked = cut(visits(queries.select("query_id", "embedding"), index.cells, k, probes=probes), "probes")
    shared = spark.sparkContext.broadcast(index.quantiser)
    left, right = met(asked, queries, index.cells, index.codes, block, group)
    short = best(left.cogroup(right).applyInArrow(estimated(shared, keep), PAIRS_DDL), keep).select("query_id", "item_id")
    sizes = spark.createDataFrame([(d, c, n) for (d, c), (n, _, _) in index.cells.known.items()], "dim int, cell int, n long")
    seen = asked.join(F.broadcast(sizes), ["dim", "cell"]).groupBy("query_id").agg(F.sum("n").alias("seen"))
    from lectern.functions.vectors import cosine

    both = short.join(index.cells.rows.select("item_id", F.col("embedding").alias("d")), "item_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    exact = both.where(F.size("q") == F.size("d")).select("query_id", "item_id", F.round(cosine(F.col("q"), F.col("d")), 6).alias("score"))
    return best(exact, k).join(seen, "query_id")
