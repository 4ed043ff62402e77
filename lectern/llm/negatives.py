"""Hard-negative mining: for each anchor and each of its nearest positives, the best-scored rows of other labels inside a score window.

1. Rows are quantised to whole numbers and taken once each. Anchors and rows are dealt to groups: anchors to blocks, rows to blocks of
   their own by a hash of their content, so no label, id or vector makes a group large. A group scores its anchors with its rows as one matrix product
   and emits only what can be in the result.
2. First pass: the ``positives`` best rows of an anchor's label in each group; of those, the best in all are its positives.
   Second pass, with the anchors' positive scores known: the first ``negatives`` rows of other labels in each window and group.
3. What both passes kept goes through one secondary-sort shuffle: the key is (anchor, descending score, positives before negatives, id),
   dealt by anchor and sorted within partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
   repartitionAndSortWithinPartitions). A streaming iterator walks the sorted rows: a positive opens its window, a negative is emitted to every open
   window that takes it, a window closes when it is full or when scores have fallen below it. It holds at most ``positives`` windows, never an anchor's rows.

All numbers are whole, so results are exact and don't depend on the order of sums.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; an empty vector takes part with score 0; vectors
of different lengths have no score. A row is its id, label and quantised vector: rows that repeat count once, and rows that share an id without being equal are
rows of their own, but never partners of each other (the anchor's own id is excluded). Ties go to the smaller id. Components are clamped to
``LIMIT`` after quantising. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut, ship

LIMIT = 1 << 23  # of a component: 128 products of two such numbers still are exact as doubles
BLOCK, ROWS, CELLS = 4096, 16384, 2_000_000
FOUND = pa.schema([("anchor_id", pa.int64()), ("tag", pa.int64()), ("kind", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
FOUND_DDL = "anchor_id long, tag long, kind int, score long, id long"
MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])
MINED_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vector: Column, factor: int = 256) -> Column:
    """Whole numbers floor(factor * x), clamped; null if a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(factor * x.cast("double")).cast("long"))).cast("int"))
    return F.when(F.coalesce(ok, F.lit(False)), whole)


def items(rows: DataFrame, label: Column, vector: Column, key: Column, factor: int = 256) -> DataFrame:
    """(id, label, v, tag) of the rows that take part, each once; ``tag`` tells rows of one id apart."""
    some = rows.select(key.cast("long").alias("id"), label.cast("long").alias("label"), quantised(vector, factor).alias("v"))
    return some.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").distinct().withColumn("tag", F.xxhash64("id", "label", "v"))


def matrix(lists: pa.ChunkedArray, at: np.ndarray, size: int) -> np.ndarray:
    flat = pa.chunked_array(lists).combine_chunks() if isinstance(lists, list) else lists.combine_chunks()
    return flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact scores of the rows of two matrices of whole numbers."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


LOWEST = np.iinfo(np.int64).min


def first_of(score: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Which cells are among the ``k`` best of their row where ``ok``; columns are in the order that breaks ties."""
    masked = np.where(ok, score, LOWEST)
    if masked.shape[1] <= k:
        return ok
    edge = -np.partition(-np.maximum(masked, LOWEST + 1), k - 1, axis=1)[:, [k - 1]]
    above = masked > edge
    tie = ok & (masked == edge)
    return above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(1, keepdims=True)))


def _scored(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors' rows, their numbers, items' ids, labels, scores) for some anchors at a time against all of the group's items of their length."""
    rows = rows.sort_by("id")
    size_a, size_r = (t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) for t in (anchors, rows))
    ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
    for size in np.unique(size_a):
        mine, others = np.flatnonzero(size_a == size), np.flatnonzero(size_r == size)
        if not len(others):
            continue
        m = matrix(rows.column("v"), others, int(size))
        step = max(1, CELLS // len(others))
        for i in range(0, len(mine), step):
            at = mine[i : i + step]
            yield anchors.take(pa.array(at)), at, ids[others], labels[others], products(matrix(anchors.column("v"), at, int(size)), m)


def _found(some: pa.Table, kind: int, keep: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    a, r = np.nonzero(keep)
    return pa.Table.from_arrays([some.column("id").take(pa.array(a)), some.column("tag").take(pa.array(a)), pa.array(np.full(len(a), kind, np.int32)), pa.array(score[a, r]), pa.array(ids[r])], schema=FOUND)


def _together(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables([t.combine_chunks() for t in parts]) if parts else FOUND.empty_table()


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        for some, _, ids, labels, score in _scored(anchors, rows):
            ok = (labels[None, :] == some.column("label").to_numpy()[:, None]) & (ids[None, :] != some.column("id").to_numpy()[:, None])
            parts.append(_found(some, 0, first_of(score, ok, k), ids, score))
        return _together(parts)

    return run


def _negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        for some, _, ids, labels, score in _scored(anchors, rows):
            other = (labels[None, :] != some.column("label").to_numpy()[:, None]) & (ids[None, :] != some.column("id").to_numpy()[:, None])
            scores = some.column("scores").to_pylist()
            keep = np.zeros(score.shape, bool)
            for j in range(max(map(len, scores), default=0)):
                have = np.array([len(s) > j for s in scores])[:, None]
                p = np.array([s[j] if len(s) > j else 0 for s in scores], np.int64)[:, None]
                keep |= first_of(score, other & have & (100 * score >= low * p) & (100 * score <= high * p), k)
            parts.append(_found(some, 1, keep, ids, score))
        return _together(parts)

    return run


def windows(sorted_rows: Iterator[pa.RecordBatch], most: int, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The streaming iterator over rows (anchor, tag, kind, score, id) sorted by anchor, tag, descending score, kind and id."""
    anchor, opened, waiting = None, 0, []  # waiting: [positive id, its score, negatives emitted] of windows that may still take rows
    for batch in sorted_rows:
        out: list[tuple] = []
        for a, tag, kind, score, i in zip(*[c.to_pylist() for c in batch.columns[:5]], strict=True):
            if (a, tag) != anchor:
                anchor, opened, waiting = (a, tag), 0, []
            if kind == 0:
                if opened < most:
                    opened += 1
                    waiting.append([i, score, 0])
                continue
            full = False
            for w in waiting:
                if low * w[1] <= 100 * score <= high * w[1]:
                    w[2] += 1
                    out.append((a, w[0], w[2], i, w[1], score))
                    full |= w[2] == k
                full |= 100 * score < low * w[1]
            if full:
                waiting = [w for w in waiting if w[2] < k and 100 * score >= low * w[1]]
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(MINED.names, zip(*out, strict=True), strict=True)), MINED)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, group: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: :func:`items`; ``anchors``: a condition on ``id``. A negative's score lies between ``low`` and ``high`` percent of
    the positive's. Groups hold about ``block`` anchors and ``group`` rows.
    """
    ship(rows.sparkSession)
    rows = cut(rows, "items")
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(anchors, 1))).head()
    blocks, groups = max(1, math.ceil(n_anchors / block)), max(1, math.ceil(n / group))
    dealt = lambda n: F.pmod(F.xxhash64("tag", F.lit(3)), F.lit(n)).cast("int")
    fresh = rows.select([F.col(c).alias(c) for c in rows.columns])  # other columns for Spark, or the cogroups would be ambiguous
    every = fresh.withColumn("g", dealt(groups)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("b", "g")
    asked = rows.where(anchors).withColumn("b", dealt(blocks)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    near = asked.groupBy("b", "g").cogroup(every).applyInArrow(_positives(positives), FOUND_DDL)
    best = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "id")
    near = cut(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).drop("place"), "positives")
    scores = near.groupBy(F.col("anchor_id").alias("id"), "tag").agg(F.collect_set("score").alias("scores"))  # ``positives`` at most
    far = asked.join(scores, ["id", "tag"]).groupBy("b", "g").cogroup(every).applyInArrow(_negatives(negatives, low, high), FOUND_DDL)

    # the key: anchor and tag deal the rows; the score is packed with the kind so that equal scores have positives first
    packed = near.unionByName(far).withColumn("down", -2 * F.col("score") + F.col("kind"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = packed.repartition(parts, "anchor_id", "tag").sortWithinPartitions("anchor_id", "tag", "down", "id")
    return stream.mapInArrow(lambda batches: windows(batches, positives, negatives, low, high), MINED_DDL)


def brute_force(rows: list[tuple], is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, factor: int = 256) -> list[tuple]:
    """The same for (id, label, vector) rows by plain loops, for tests."""
    some = set()
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            some.add((i, label, tuple(max(-LIMIT, min(LIMIT, math.floor(factor * x))) for x in v)))
    out = []
    for i, label, v in some:
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, m, w in some if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)
