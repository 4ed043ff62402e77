"""Impact-ordered postings in Spark tables, and exact top-k search that reads only the blocks it has to.

A text is a sparse vector: the hash of each distinct term, and the term's impact (its share of a score at query weight 1; never negative).
:func:`build` writes three tables to the shared folder:

* ``forward``: a row a document with its terms and impacts, bucketed by document;
* ``blocks``: postings of a term and impact level, some documents a row, bucketed by cell. Levels are ranges of impact, four to an octave, so a
  term's levels are its postings in descending order of impact; a cell is a term, a level and one of ``SPREAD`` slots, so a term that
  every document holds is spread over all buckets;
* ``levels``: a row a term and level with the largest impact and the number of postings. It is what queries are planned on.

:func:`top_k` then works on all queries together, as joins, with nothing in the driver and a plan that doesn't depend on their number:

1. The levels of a query's terms are put in order, terms with most to give a posting first. What is unread after each is bounded by the
   sum of the largest impacts left.
2. A first few levels are read. The best documents of that partial sum are scored exactly; the kth score is a bound from below.
3. Only levels before the point where the unread rest is a fraction of that bound are read. Documents whose partial sum plus the rest can't
   reach it are dropped; the others are scored exactly from ``forward``.

No document that can be among the k best is left out, so results equal a full scan. :func:`work` reports what was read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import bucketed, cut, forget, ship

U = np.uint64
LEVELS, SPREAD = 64, 8
TOP = 4.0  # level 0 begins here
SLACK = 2e-4  # what rounding, to four digits at least, can move a score
REST = 0.3  # of a query's bound that may stay unread
FIRST = 1000  # postings a query reads at first, about
SLOTS, SLOT_ROW = 1 << 18, 1 << 12  # of hashes of terms, for bounds on their counts
PIECE = 250_000  # list elements a Python worker handles at once, unless one row has more


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes are hashes again."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(29))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The term of two neighbours, from the hashes of both."""
    return mixed(a.view(U) * U(3) + mixed(b.view(U))).view(np.int64)


def pieces(*lists: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows whose lists hold ``most`` elements at most together, or of one row that holds more."""
    ends = np.cumsum(sum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists))
    i, done = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield i, j - i
        i, done = j, int(ends[j - 1])


def counted(lists: pa.Array, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of each distinct term of each row, by row and term, and the rows' numbers of tokens."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    if pairs and len(flat) > 1:
        inside = row[1:] == row[:-1]
        both = pair_hash(flat[:-1][inside], flat[1:][inside])
        flat, row = np.concatenate((flat, both)), np.concatenate((row, row[1:][inside]))
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(flat), 1), bool), (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))))
    return row[new], flat[new], np.diff(new, append=len(flat)), sizes


def grams(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place of its first token) of all tokens of the rows, and of all pairs of neighbours after them."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    first = np.flatnonzero(row[1:] == row[:-1])
    return np.concatenate((flat, pair_hash(flat[first], flat[first + 1]))), np.concatenate((row, row[first])), np.concatenate((np.arange(len(flat)), first))


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(U) >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, sums): the 1- and 2-grams of a task's (hashes array) rows by slots of their hashes, SLOT_ROW slots a row."""
    sums = np.zeros(SLOTS, np.int64)
    for lists in (batch.column(0).slice(*piece) for batch in batches for piece in pieces(batch.column(0))):
        sums += np.bincount(slot_of(grams(lists)[0]), minlength=SLOTS)
    n = SLOTS // SLOT_ROW
    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, SLOTS + 1, SLOT_ROW), pa.int32()), pa.array(sums))], names=["part", "sums"])


def summed(rows: pa.Table) -> pa.Table:
    """(slot, total) of the slots in use of one part, from all tasks."""
    total = rows.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, SLOT_ROW).sum(0)
    held = np.flatnonzero(total)
    return pa.table({"slot": pa.array((held + rows.column("part")[0].as_py() * SLOT_ROW).astype(np.int32)), "total": pa.array(total[held])})


def counting(slots):
    """(term, total, df) of the 1- and 2-grams of (terms array, hashes array) rows that lie in ``slots``, a broadcast of packed bits; some rows a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(slots.value).astype(bool)
        for batch in (whole.slice(*piece) for whole in batches for piece in pieces(whole.column(0))):
            hashes, row, place = grams(batch.column(1))
            some = asked[slot_of(hashes)]
            single = np.arange(len(hashes)) < batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).sum()
            hashes, row, place, single = hashes[some], row[some], place[some], single[some]
            term, first, at, total = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            df = np.bincount(np.unique(row * max(len(term), 1) + at) % max(len(term), 1), minlength=len(term))
            words, place, single = batch.column(0).flatten(), place[first], single[first]
            one, two = words.take(pa.array(place[single])), pc.binary_join_element_wise(words.take(pa.array(place[~single])), words.take(pa.array(place[~single] + 1)), " ")
            order = np.concatenate((np.flatnonzero(single), np.flatnonzero(~single)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([one, two]), pa.array(total[order]), pa.array(df[order])], names=["term", "total", "df"])

    return run


@dataclass
class Bm25:
    """Impacts of BM25: the saturation of a term's occurrences in a text of some length."""

    mean: float
    k1: float = 1.5
    b: float = 0.75
    pairs: bool = False

    def of(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return row, term, tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[row] / self.mean))


@dataclass
class TfIdf:
    """Impacts of TF-IDF over a fixed vocabulary (ascending hashes): weights at unit length."""

    terms: np.ndarray
    idf: np.ndarray
    pairs: bool = True

    def of(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.terms):
            return row[:0], term[:0], tf[:0].astype(np.float64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        row, term, w = row[known], term[known], tf[known] * self.idf[at[known]]
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(length)))
        return row, term, w / np.maximum(norm[row], 1e-300)


def vectors(rows: DataFrame, weigh: Bm25 | TfIdf, key: str) -> DataFrame:
    """(key, terms, impacts) of (key, terms) rows, terms as hashes of the tokens in order."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(*piece) for whole in batches for piece in pieces(whole.column(1))):
            row, term, impact = weigh.of(*counted(batch.column(1), weigh.pairs))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (term, impact)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "terms", "impacts"])

    return rows.select(F.col(key).cast("long").alias(key), "terms").mapInArrow(run, f"{key} long, terms array<long>, impacts array<double>")


BLOCKS = pa.schema([("term", pa.int64()), ("level", pa.int32()), ("spread", pa.int32()), ("top", pa.float64()), ("n", pa.int64()), ("items", pa.list_(pa.int64())), ("impacts", pa.list_(pa.float64()))])
BLOCKS_DDL = "term long, level int, spread int, top double, n long, items array<long>, impacts array<double>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a batch of documents, by term and level."""
    part = TaskContext.get().partitionId()
    for batch in (whole.slice(*piece) for whole in batches for piece in pieces(whole.column(1), most=4 * PIECE)):
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        item = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        term, impact = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
        level = np.clip(np.floor(-4 * np.log2(np.maximum(impact, 1e-300) / TOP)), 0, LEVELS - 1).astype(np.int32)
        order = np.lexsort((level, term))
        term, level, impact, item = term[order], level[order], impact[order], item[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(len(term), 1), bool), (term[1:] != term[:-1]) | (level[1:] != level[:-1]))))
        at = np.append(start, len(term)).astype(np.int32)
        spread = ((mixed(term[start].view(U)) + U(part)) % U(SPREAD)).astype(np.int32)
        top = np.maximum.reduceat(impact, start) if len(start) else np.zeros(0)
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (item, impact)]
        yield pa.RecordBatch.from_arrays([pa.array(term[start]), pa.array(level[start]), pa.array(spread), pa.array(top), pa.array(np.diff(at).astype(np.int64)), *lists], schema=BLOCKS)


@dataclass
class Postings:
    forward: DataFrame | None
    blocks: DataFrame
    levels: DataFrame


def build(docs: DataFrame, weigh: Bm25 | TfIdf, more: DataFrame | None = None) -> Postings:
    """Postings of (item_id, terms) rows; ``more``: (item_id, terms, impacts) of terms that plans know but exact scores don't."""
    forward = bucketed(vectors(docs, weigh, "item_id"), "forward", "item_id")
    return indexed(forward if more is None else forward.unionByName(more), forward)


def indexed(rows: DataFrame, forward: DataFrame | None = None) -> Postings:
    """Blocks and levels of (item_id, terms, impacts) rows."""
    cell = F.xxhash64("term", "level", "spread")
    blocks = bucketed(rows.mapInArrow(_blocks, BLOCKS_DDL).withColumn("cell", cell), "blocks", "cell")
    levels = blocks.groupBy("term", "level").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.count("*").alias("blocks"), F.collect_set("spread").alias("spreads"))  # SPREAD at most
    return Postings(forward, blocks, cut(levels, "levels"))


def drop(index: Postings) -> None:
    """Delete an index that nothing reads any more."""
    for t in (index.forward, index.blocks, index.levels):
        if t is not None:
            forget(t)


def plan_of(asked: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels of each query's terms in reading order: postings before this one, and the bound on what is unread before it."""
    each = asked.join(levels, "term").withColumn("bound", F.col("weight") * F.col("top"))
    by_term = Window.partitionBy("query_id", "term")
    each = each.withColumn("worth", F.max("bound").over(by_term) / F.sum("n").over(by_term))
    each = each.withColumn("falls", F.col("bound") - F.coalesce(F.lead("bound").over(by_term.orderBy("level")), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("worth"), "term", "level")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return each.withColumn("read", zero("n")).withColumn("unread", F.sum("falls").over(Window.partitionBy("query_id")) - zero("falls"))


def partial(need: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, item_id, partial) over the planned levels."""
    cells = need.select("query_id", "weight", "term", "level", F.explode("spreads").alias("spread")).withColumn("cell", F.xxhash64("term", "level", "spread"))
    met = cells.join(blocks.select("cell", F.col("term").alias("t"), F.col("level").alias("l"), "items", "impacts"), "cell").where("term = t AND level = l")
    each = met.select("query_id", "weight", F.explode(F.arrays_zip("items", "impacts")).alias("p"))
    each = each.select("query_id", F.col("p.items").alias("item_id"), (F.col("weight") * F.col("p.impacts")).alias("part")).where("query_id <> item_id")
    return each.groupBy("query_id", "item_id").agg(F.sum("part").alias("partial"))


def exact(pairs: DataFrame, asked: DataFrame, forward: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of the pairs that share a term, from the whole vectors; pairs with an unknown item are left out."""
    lists = asked.groupBy("query_id").agg(F.collect_list("term").alias("q_terms"), F.collect_list("weight").alias("q_weights"))  # one query's terms
    both = pairs.select("query_id", "item_id").join(forward, "item_id").join(lists, "query_id").select("query_id", "item_id", "q_terms", "q_weights", "terms", "impacts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(*piece) for whole in batches for piece in pieces(whole.column(2), whole.column(4))):
            of = lambda i: batch.column(i).flatten().to_numpy(zero_copy_only=False)
            rows = lambda i: np.repeat(np.arange(batch.num_rows), batch.column(i).value_lengths().to_numpy(zero_copy_only=False))
            q_row, q_term, q_weight, d_row, d_term, d_impact = rows(2), of(2), of(3), rows(4), of(4), of(5)
            if not len(d_term):
                continue
            key = lambda row, term: mixed(mixed(row.view(U) + U(1)) ^ term.view(U))
            known = key(d_row, d_term)
            by = np.argsort(known, kind="stable")
            at = by[np.minimum(np.searchsorted(known[by], key(q_row, q_term)), len(by) - 1)]
            same = np.flatnonzero((d_row[at] == q_row) & (d_term[at] == q_term))
            hit = pa.array(np.flatnonzero(np.bincount(q_row[same], minlength=batch.num_rows)))
            score = pa.array(np.bincount(q_row[same], weights=q_weight[same] * d_impact[at[same]], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit), score.take(hit)], names=["query_id", "item_id", "score"])

    return both.mapInArrow(run, "query_id long, item_id long, score double").withColumn("score", F.round("score", 6))


def still(unread: Column, least: Column) -> Column:
    """Whether a level is read: until what is unread after it can't reach the query's bound, and then on down to ``REST`` of it, so that few documents have to be scored exactly."""
    return unread > REST * least


def needed(plan: DataFrame, bounds: DataFrame) -> DataFrame:
    """Planned levels that come before the unread rest is small enough."""
    return plan.join(bounds, "query_id").where(still(F.col("unread"), F.col("least")))


def bounds_of(index: Postings, asked: DataFrame, scored_by: DataFrame, plan: DataFrame, k: int, bonus: Column | None, first: int) -> DataFrame:
    """(query_id, least): what the kth best score is at least; 0 where fewer than k documents are known."""
    best = Window.partitionBy("query_id").orderBy(F.desc("partial"), "item_id")
    start = partial(plan.where(F.col("read") < first), index.blocks).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 2 * k)
    known = exact(start, scored_by, index.forward).withColumn("final", F.col("score") + (F.lit(0.0) if bonus is None else bonus))
    place = Window.partitionBy("query_id").orderBy(F.desc("final"))
    kth = known.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("query_id", (F.col("final") - SLACK).alias("least"))
    return asked.select("query_id").distinct().join(kth, "query_id", "left").select("query_id", F.coalesce("least", F.lit(0.0)).alias("least"))


def top_k(index: Postings, asked: DataFrame, k: int, bonus: Column | None = None, planned: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """(query_id, item_id, score): every pair that can be among the k best of its query, an item with itself excluded.

    ``asked``: (query_id, term, weight), a term once a query, weights positive. ``bonus``: a column of (query_id, item_id)
    that is added before ranking; ``planned`` then holds the same as weighted terms, so that plans know it.
    """
    every = asked if planned is None else asked.unionByName(planned)
    plan = cut(plan_of(every, index.levels), "plan")
    bounds = cut(bounds_of(index, every, asked, plan, k, bonus, first), "bounds")
    need = needed(plan, bounds)
    rest = need.groupBy("query_id").agg((F.max("unread") - F.sum("falls")).alias("rest"), F.first("least").alias("least"))
    found = partial(need, index.blocks).join(rest, "query_id").where(F.col("partial") + F.greatest("rest", F.lit(0.0)) >= F.col("least"))
    scored = exact(found, asked, index.forward).join(bounds, "query_id")
    return scored.where(F.col("score") + (F.lit(0.0) if bonus is None else bonus) >= F.col("least")).select("query_id", "item_id", "score")


def work(index: Postings, asked: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """(query_id, blocks, blocks_read, postings, postings_read): what a query's terms have, and what :func:`top_k` reads for its final pass."""
    plan = cut(plan_of(asked, index.levels), "plan")
    bounds = bounds_of(index, asked, asked, plan, k, None, first)
    read = still(F.col("unread"), F.col("least"))
    each = plan.join(bounds, "query_id").groupBy("query_id")
    return each.agg(*[f for c in ("blocks", "n") for f in (F.sum(c).alias("postings" if c == "n" else c), F.sum(F.when(read, F.col(c)).otherwise(0)).alias("postings_read" if c == "n" else f"{c}_read"))])
