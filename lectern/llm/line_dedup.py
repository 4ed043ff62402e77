"""Line deduplication with levelled sorted runs of line hashes.

The index of lines seen so far is a set of runs: tables of (key, owner), bucketed and sorted by key, with every
key in one run only. Documents come in batches of ascending ids. A batch's lines are reduced to the smallest
id of each key and merge-anti-joined with each run, and what is new becomes a run of level 0. When a level has
``fanout`` runs they are merged into one run of the next level, so n batches leave O(log n) runs. Runs have the same
buckets and are in order, so neither the anti-joins nor the merges shuffle or sort them.

A line stays in a document only if that document owns its key. Lines are dropped by their position, in time linear in a
document's lines.

Defined cases: null or empty text is one empty line; rows that share a doc_id are one document; rows with
null doc_id count as one document after all others; keys under ``min_chars`` are never dropped; extra columns
pass through :func:`dedup_lines` untouched. Its own columns start with ``_ld_``; input columns of those names
raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.text import BLANKS, ascii_lower, let, whole
from lectern.session import bucketed, cut, forget, scratch

MIN_CHARS = 10
LAST = 9223372036854775807
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.unhex(F.md5(key.cast("binary")))


@contextmanager
def in_order(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside rely on the order of sorted buckets (each is one file)."""
    before = spark.conf.get(IN_ORDER, "false")
    spark.conf.set(IN_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(IN_ORDER, before)


class LineRuns:
    """Levelled sorted runs of (key binary, owner long) in the shared folder."""

    SCHEMA = "_ld_key binary, _ld_owner long"

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def read(self) -> DataFrame:
        """All (_ld_key, _ld_owner) rows."""
        return reduce(DataFrame.unionByName, self.runs, self.spark.createDataFrame([], self.SCHEMA))

    def _keep(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(bucketed(run.select("_ld_key", "_ld_owner"), f"run-{level}", "_ld_key", dealt=True, ordered=True))

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of (_ld_key, _ld_owner) rows whose ids are above those of earlier batches."""
        with in_order(self.spark):
            fresh = batch.groupBy("_ld_key").agg(F.min("_ld_owner").alias("_ld_owner"))
            for run in self.runs:
                fresh = fresh.join(run.select("_ld_key").hint("merge"), "_ld_key", "left_anti")
            self._keep(fresh, 0)
            self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                # every key is in one run only, so a full join is a merge
                self._keep(reduce(lambda a, b: a.hint("merge").join(b.hint("merge"), "_ld_key", "full").select("_ld_key", F.coalesce(a["_ld_owner"], b["_ld_owner"]).alias("_ld_owner")), old), level + 1)
                for run in old:
                    forget(run)
            level += 1


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_chars: int = MIN_CHARS, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with its text deduplicated, plus _ld_lines (before) and _ld_dropped (long).

    ``runs`` may hold lines of an earlier corpus; those count as owned by that corpus.
    """
    spark = docs.sparkSession
    if clash := [c for c in docs.columns if c.startswith("_ld_")]:
        raise ValueError(f"columns {clash} have names that line deduplication uses")
    # a document's rows are told apart by their texts
    docs = docs.withColumns({"_ld_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_ld_row": F.xxhash64(whole("text"))})
    # At most `batches` - 1 numbers: the ids at which one batch ends.
    ends = docs.agg(F.percentile_approx("_ld_doc", [i / batches for i in range(1, batches)] or [1.0], 1000)).head()[0] or []
    ends = sorted(set(ends)) if batches > 1 else []
    split = F.split(whole("text"), "\n", -1)
    lines = docs.select("_ld_doc", "_ld_row", F.posexplode(split).alias("_ld_at", "_ld_line")).withColumn("_ld_line", line_key(F.col("_ld_line")))
    number = reduce(lambda n, end: n + (F.col("_ld_doc") > end).cast("int"), ends, F.lit(0))
    held = lines.where(F.length("_ld_line") >= min_chars).select(key_hash(F.col("_ld_line")).alias("_ld_key"), F.col("_ld_doc").alias("_ld_owner"), "_ld_row", "_ld_at", number.alias("_ld_batch"))
    path = scratch(spark, "lines")
    held.write.partitionBy("_ld_batch").parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    runs = runs or LineRuns(spark, fanout)
    for i in range(len(ends) + 1):
        runs.add(held.where(F.col("_ld_batch") == i).select("_ld_key", "_ld_owner"))
    # On key and document, so that a line that every document holds isn't one task's.
    drops = held.select("_ld_key", "_ld_owner", "_ld_row", "_ld_at").join(runs.read().hint("merge"), ["_ld_key", "_ld_owner"], "left_anti")
    drops = drops.groupBy(F.col("_ld_owner").alias("_ld_doc"), "_ld_row").agg(F.sort_array(F.collect_set("_ld_at")).alias("_ld_drops"))

    def marks(at: Column) -> Column:
        """Whether each line up to the last dropped one is dropped."""
        return F.flatten(F.transform(at, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))

    stay = let(marks(F.col("_ld_drops")), lambda m: F.filter(split, lambda x, i: ~F.coalesce(F.get(m, i), F.lit(False))))
    joined = docs.join(drops, ["_ld_doc", "_ld_row"], "left").withColumn("_ld_kept", F.when(F.col("_ld_drops").isNull(), split).otherwise(stay))
    return joined.select(
        *[docs[c] for c in docs.columns if c not in ("text", "_ld_doc", "_ld_row")],
        F.array_join("_ld_kept", "\n").alias("text"),
        F.size(split).cast("long").alias("_ld_lines"),
        (F.size(split) - F.size("_ld_kept")).cast("long").alias("_ld_dropped"),
    )


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = MIN_CHARS) -> dict[int, tuple[int, int, str]]:
    """The contract on (doc_id, text) rows with distinct ids, for tests."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(BLANKS).translate(table)
    owner: dict[str, int] = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), d)
    out = {}
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < min_chars or owner[key(x)] == d]
        out[d] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out
