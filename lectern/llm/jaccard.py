"""N-gram Jaccard join: documents whose sets of word 5-grams have Jaccard similarity >= 0.75, as components.

1. Documents with equal sets are one class (a 128-bit sum of the set's hashes); its smallest id stands for it.
2. Every 5-gram gets its document frequency through the packed exchange (``exchange.py``): chunks of documents send their
   grams to buckets of keys, which send back those that occur in two documents or more.
3. In a document's global order (rare first: frequency, then hash) the grams of frequency 1 come first and match
   nothing. Only the rest of the prefix, n - ceil(0.75 n) + 1 places, is indexed; a document whose prefix holds
   unmatched grams alone is done. The others are written once, bucketed by document.
4. Candidates share a prefix gram and pass the length filter and the positional filter there. The suffix filter divides both
   sets at the same pivots, which are fixed (equal parts of the hash range) so that a document's counts are computed once and
   not for each pair, and adds up the smaller counts; what passes is verified by the exact overlap of the sets.
5. Groups of near copies aren't expanded into all pairs. In some rounds each document meets a few leaders of its lists in
   other components, those that share most prefix grams with it, and components are merged. Then all remaining candidate
   pairs between different components are verified, so no link between components is missed. A pair is verified once: one that was a
   link is inside one component, and one that was refused is remembered.

Defined cases: null, empty and word-free texts have no grams and link with nothing; with fewer than ``k`` words
the whole sequence is the only gram; rows with null doc_id have a null component and link with nothing; rows that share a doc_id get the
smallest of their components; repeated rows come out as often as they come in; extra columns are dropped by :func:`components_of` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.exchange import messages, pack_counts, pack_longs, pack_sorted, scale, unpack_counts, unpack_longs, unpack_sorted
from lectern.llm.packed import SOLID, grams, mix, slices, words_of
from lectern.session import bucketed, cut, forget, ship

U = np.uint64
K, PERCENT = 5, 75
PARTS = 128  # pieces of a set for the suffix filter
LEADERS, TRIED, ROUNDS = 8, 4, 3
BLOCK = 256  # components of a list that meet in one task
WORD_BYTES = 6  # about, with the blank after it


def shingles(buf: np.ndarray, at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-grams of a slice, in that order."""
    w = words_of(buf, at, SOLID)
    h, n = w.hashes(), np.diff(w.first)
    g, place = grams(h, w.first, k)
    doc = np.searchsorted(w.first, place, "right") - 1
    parts_d, parts_g = [doc], [g]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            every, places = grams(h, w.first, size)
            mine = np.searchsorted(places, w.first[short])
            parts_d.append(short)
            parts_g.append(mix(every[mine] ^ U(size)))
    doc, g = np.concatenate(parts_d), np.concatenate(parts_g)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, a, b): each document's number of grams and the 128-bit sum of its set."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = ([np.zeros(0, t)] for t in (np.int64, U, U))
            for i, j, buf, at in slices(batch.column(1)):
                doc, g = shingles(buf, at, k)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for out, x in ((a, g), (b, mix(g ^ U(0x2545F4914F6CDD1D)))):
                    sums = np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U)))
                    out.append(sums[edge[1:]] - sums[edge[:-1]])
                n.append(np.diff(edge))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (n, a, b)]], names=["doc_id", "n", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n long, a long, b long")


ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("home", pa.list_(pa.binary()))])
ASKED_DDL = "chunk long, bucket long, keys binary, counts binary, docs binary, home array<binary>"


def _ask(buckets: int, chunk_bytes: int, k: int):
    """Messages of chunks of documents: distinct grams, in how many of the chunk's documents each is, and in which if in one.

    The documents of repeated grams stay with the chunk: they travel, with the ids and set sizes, in its home message.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, buf, at in slices(batch.column(1), chunk_bytes):
                doc, g = shingles(buf, at, k)
                sizes = np.bincount(doc, minlength=j - i)
                order = np.argsort(g, kind="stable")
                doc, g = doc[order], g[order]
                start = np.flatnonzero(np.concatenate((np.ones(min(len(g), 1), bool), g[1:] != g[:-1])))
                keys, counts = g[start], np.diff(start, append=len(g))
                single = np.where(counts == 1, doc[start], 0)
                repeated = np.repeat(counts > 1, counts)
                home = [pack_longs(ids[i:j]), pack_counts(sizes), pack_sorted(g[repeated]), pack_counts(doc[repeated])]
                out = [(serial, b, pack_sorted(keys[a:e]), pack_counts(counts[a:e]), pack_counts(single[a:e]), None) for b, a, e in messages(keys, buckets)]
                out.append((serial, serial % buckets, pack_sorted(keys[:0]), pack_counts(counts[:0]), pack_counts(single[:0]), home))
                serial += 1
                yield pa.RecordBatch.from_pydict(dict(zip(ASKED.names, zip(*out, strict=True), strict=True)), ASKED)
        pa.default_memory_pool().release_unused()

    return run


ANSWERED = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("df", pa.binary()), ("home", pa.list_(pa.binary()))])
ANSWERED_DDL = "chunk long, keys binary, counts binary, docs binary, df binary, home array<binary>"


def _answer(asked: pa.Table) -> pa.Table:
    """Of each chunk's grams in this bucket, those that two documents or more hold, with that number."""
    keys = [unpack_sorted(x.as_py()) for x in asked.column("keys")]
    counts = [unpack_counts(x.as_py()) for x in asked.column("counts")]
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate(counts)).astype(np.int64)
    rows, a = [], 0
    for i, (x, c) in enumerate(zip(keys, counts, strict=True)):
        df = n[of[a : a + len(x)]]
        a += len(x)
        many = df > 1
        home = asked.column("home")[i].as_py()
        if home is not None or many.any():
            docs = unpack_counts(asked.column("docs")[i].as_py())
            rows.append((asked.column("chunk")[i].as_py(), pack_sorted(x[many]), pack_counts(c[many]), pack_counts(docs[many]), pack_counts(df[many]), home))
    return pa.Table.from_pydict(dict(zip(ANSWERED.names, zip(*rows, strict=True), strict=True)), ANSWERED) if rows else ANSWERED.empty_table()


ALIVE = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("lone", pa.int32()), ("keys", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])
ALIVE_DDL = "doc_id long, n int, lone int, keys array<long>, parts array<int>"


def _alive(percent: int):
    """Documents of a chunk that can have a partner: set size, grams in front that match nothing, the others rare first."""

    def run(answers: pa.Table) -> pa.Table:
        get = lambda c, f: np.concatenate([f(x.as_py()) for x in answers.column(c)])
        ids, sizes, again, again_in = next(x for x in answers.column("home").to_pylist() if x is not None)
        ids, sizes = unpack_longs(ids), unpack_counts(sizes).astype(np.int64)
        again, again_in = unpack_sorted(again), unpack_counts(again_in).astype(np.int64)
        keys, counts, docs, df = get("keys", unpack_sorted), get("counts", unpack_counts), get("docs", unpack_counts).astype(np.int64), get("df", unpack_counts).astype(np.int64)
        one, order = counts == 1, np.argsort(keys, kind="stable")
        # every repeated gram is in two documents or more, so all of them came back
        again_df = df[order][np.searchsorted(keys, again, sorter=order)] if len(again) else np.zeros(0, np.int64)
        keys, docs, df = np.concatenate((keys[one], again)), np.concatenate((docs[one], again_in)), np.concatenate((df[one], again_df))
        order = np.lexsort((keys, df, docs))
        keys, docs = keys[order], docs[order]
        edge = np.searchsorted(docs, np.arange(len(ids) + 1))
        many = np.diff(edge)
        prefix = sizes - (percent * sizes + 99) // 100 + 1
        ok = np.flatnonzero((sizes > 0) & (sizes - many < prefix))
        take = np.repeat(edge[ok] - (np.cumsum(many[ok]) - many[ok]), many[ok]) + np.arange(many[ok].sum())
        keys, of = keys[take], np.repeat(np.arange(len(ok)), many[ok])
        parts = np.bincount(of * PARTS + (mix(keys) % U(PARTS)).astype(np.int64), minlength=len(ok) * PARTS)
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(many[ok]))).astype(np.int32), pa.array(keys.view(np.int64)))
        cells = pa.ListArray.from_arrays((np.arange(len(ok) + 1) * PARTS).astype(np.int32), pa.array(parts.astype(np.int32)))
        return pa.Table.from_arrays([pa.array(ids[ok]), pa.array(sizes[ok].astype(np.int32)), pa.array((sizes - many)[ok].astype(np.int32)), lists, cells], schema=ALIVE)

    return run


def candidates_table(docs: DataFrame, k: int = K, percent: int = PERCENT, chunk_keys: int = 350_000, bucket_keys: int = 1_000_000) -> DataFrame:
    """Steps 2 and 3: (doc_id, n, lone, keys, parts) of the documents that can have a partner."""
    ship(docs.sparkSession)
    some = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    chunk, buckets = scale(math.ceil(size / WORD_BYTES), chunk_keys, bucket_keys)
    asked = some.mapInArrow(_ask(buckets, chunk * WORD_BYTES, k), ASKED_DDL)
    answered = asked.groupBy("bucket").applyInArrow(_answer, ANSWERED_DDL)
    return answered.groupBy("chunk").applyInArrow(_alive(percent), ALIVE_DDL)


def shared_at_most(a: Column, b: Column) -> Column:
    """The suffix filter's bound on the overlap of two sets, from their counts in the same pieces."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, v: s + v)


def verified(pairs: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that reach the similarity: the suffix filter first, then the exact overlap of the sets.

    ``alive`` is bucketed by document, so its rows stay where they are: only pairs are shuffled, and the sets of those
    that passed the suffix filter.
    """
    left = alive.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("parts").alias("px"))
    right = alive.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("parts").alias("py"), F.col("keys").alias("ky"))
    sets = alive.select(F.col("doc_id").alias("x"), F.col("keys").alias("kx"))
    enough = lambda overlap: (100 + percent) * overlap >= percent * (F.col("nx") + F.col("ny"))
    some = pairs.join(left, "x").join(right, "y").where(enough(shared_at_most(F.col("px"), F.col("py")))).select("x", "y", "nx", "ny", "ky")
    return some.join(sets, "x").where(enough(F.size(F.array_intersect("kx", "ky")))).select("x", "y").distinct()


def postings(alive: DataFrame, percent: int) -> DataFrame:
    """(key, doc, n, pos) of the indexed prefixes."""
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100).cast("int") + 1 - F.col("lone")
    each = alive.select(F.col("doc_id").alias("doc"), "n", "lone", F.posexplode(F.slice("keys", 1, length)).alias("place", "key"))
    return each.select("key", "doc", "n", (F.col("lone") + F.col("place")).cast("int").alias("pos"))


def renamed(post: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings with their documents' present components."""
    return post.drop("comp").join(comps.select(F.col("doc_id").alias("doc"), "comp"), "doc")


def mixed(post: DataFrame) -> DataFrame:
    """Postings of the grams that more than one component holds. Components only grow, so the others are never needed again."""
    open_ = post.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return post.join(open_, "key", "left_semi").select("key", "doc", "n", "pos", "comp")


def fits(percent: int, nx, px, ny, py):
    """The length filter, and the positional filter at the first gram two documents share."""
    length = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return length & ((100 + percent) * F.least(nx - px, ny - py) >= percent * (nx + ny))


def led(post: DataFrame, seed: int, percent: int) -> DataFrame:
    """For each document a few pairs (x, y) with leaders of its lists: the smallest hashes in a list and size class."""
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    post = post.withColumn("size", size)
    leaders = [F.min(F.struct(F.xxhash64("doc", F.lit(seed * LEADERS + i)).alias("h"), "doc", "comp", "n", "pos")).alias(f"l{i}") for i in range(LEADERS)]
    lists = post.groupBy("key", "size").agg(*leaders, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    lists = lists.select("key", "size", F.array_distinct(F.transform(F.array(*[f"l{i}" for i in range(LEADERS)]), lambda s: F.struct(s["doc"].alias("doc"), s["comp"].alias("comp"), s["n"].alias("n"), s["pos"].alias("pos")))).alias("leaders"))
    met = post.join(lists, ["key", "size"])
    ok = F.filter("leaders", lambda s: (s["comp"] != F.col("comp")) & fits(percent, F.col("n"), F.col("pos"), s["n"], s["pos"]))
    met = met.select("doc", F.explode(F.transform(ok, lambda s: s["doc"])).alias("leader")).groupBy("doc", "leader").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("doc").orderBy(F.desc("shared"), "leader")
    met = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TRIED)
    return met.select(F.least("doc", "leader").alias("x"), F.greatest("doc", "leader").alias("y")).distinct()


def head_pairs(heads: DataFrame, fit: Column, block: int = BLOCK) -> DataFrame:
    """(key, ca, cb, few) of the components of a list that may hold a pair, each two once; ``few``: ca has no more documents there than cb.

    A list with more than ``block`` components is dealt to blocks, and each two blocks meet under a key of their own, so a
    long list is many tasks of bounded size.
    """
    many = heads.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = heads.join(many, "key").withColumn("mine", F.pmod(F.xxhash64("comp", F.lit(11)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*heads.columns, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "i", "j")]
    once = (F.col("a.i") == F.col("a.j")) | (F.col("a.mine") != F.col("b.mine"))  # two of one block meet where both blocks are theirs
    met = dealt.alias("a").join(dealt.alias("b"), same[0] & same[1] & same[2] & once & (F.col("a.comp") < F.col("b.comp")) & fit)
    return met.select(F.col("a.key").alias("key"), F.col("a.comp").alias("ca"), F.col("b.comp").alias("cb"), (F.col("a.docs") <= F.col("b.docs")).alias("few"))


def across(post: DataFrame, alive: DataFrame, percent: int, marks: DataFrame | None = None) -> DataFrame:
    """All candidate pairs (x, y) of different components: lists are joined by component first, documents then.

    Documents meet under the length, positional and suffix filters at once. Counts that don't fit a byte (of long texts)
    are left out here, so that their pairs are filtered by :func:`verified` alone. With ``marks`` (doc, marks: all keys of
    the document) two documents meet in the smallest of their common keys only.
    """
    facts = alive.select(F.col("doc_id").alias("doc"), F.when(F.array_max("parts") < 128, F.col("parts").cast("array<tinyint>")).alias("pieces"))
    facts = facts.withColumn("marks", F.lit(None).cast("array<long>")) if marks is None else facts.join(marks, "doc")
    post = post.join(facts, "doc")
    heads = post.groupBy("key", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.count("*").alias("docs"), *([] if marks is None else [F.first("marks").alias("marks"), F.first("pieces").alias("pieces")]))
    # what the filters of some pair of documents need, so that components without such a pair don't meet
    length = F.expr(f"100 * a.high >= {percent} * b.low AND 100 * b.high >= {percent} * a.low")
    position = F.expr(f"{100 + percent} * least(a.rest, b.rest) >= {percent} * (a.low + b.low)")
    fit = length & position
    if marks is not None:  # two components of one document each here meet in one list only, and under all filters of their documents
        suffix_of = F.coalesce((100 + percent) * shared_at_most(F.col("a.pieces"), F.col("b.pieces")) >= F.lit(percent) * (F.col("a.low") + F.col("b.low")), F.lit(True))
        fit = fit & F.expr("a.docs > 1 OR b.docs > 1 OR a.key = array_min(array_intersect(a.marks, b.marks))") & (F.expr("a.docs > 1 OR b.docs > 1") | suffix_of)
    # the component with fewer documents in the list comes first, so that nothing is expanded before the filters can act
    pairs = head_pairs(heads, fit).select("key", *[F.when(F.col("few"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("ca", "cb"), ("cb", "ca"))])
    side = lambda s: post.select("key", F.col("comp").alias(f"c{s}"), F.col("doc").alias(f"d{s}"), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("pieces").alias(f"s{s}"), F.col("marks").alias(f"m{s}"))
    suffix = F.coalesce((100 + percent) * shared_at_most(F.col("sa"), F.col("sb")) >= percent * (F.col("na") + F.col("nb")), F.lit(True))
    ok = fits(percent, F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")) & suffix
    if marks is not None:
        ok = (F.col("key") == F.array_min(F.array_intersect("ma", "mb"))) & ok
    met = pairs.join(side("a"), ["key", "ca"]).join(side("b"), ["key", "cb"]).where(ok)
    return met.select(F.least("da", "db").alias("x"), F.greatest("da", "db").alias("y")).distinct()


def between(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of different components that an edge joins."""
    of = lambda side: comps.select(F.col("doc_id").alias(side), F.col("comp").alias(f"c{side}"))
    both = edges.join(of("x"), "x").join(of("y"), "y").where("cx <> cy")
    return both.select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).distinct()


def merged(comps: DataFrame, roots: DataFrame) -> DataFrame:
    """``comps`` with the components of ``roots`` (node, root) renamed to their roots."""
    new = roots.select(F.col("node").alias("comp"), "root")
    return comps.join(new, "comp", "left").select("doc_id", F.coalesce("root", "comp").alias("comp"))


def connected(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of each node with an edge that isn't the smallest of its component; ``edges``: (x, y) with x < y.

    Large-star and small-star steps in turn until the edges stay the same; each step is written to the shared folder.
    """
    now, mark = cut(edges.select("x", "y").distinct(), name), None
    while not now.isEmpty():
        both = now.union(now.select("y", "x"))
        low = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        large = both.where("y > x").join(low, "x").select(F.col("low").alias("x"), "y").where("x < y").distinct()
        down = large.select(F.col("y").alias("u"), F.col("x").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(least, "u").select(F.col("low").alias("x"), F.explode(F.array("u", "v")).alias("y")).where("x < y").distinct()
        new = cut(small, name)
        seen = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).head())
        forget(now)
        if seen == mark:
            return new.select(F.col("y").alias("node"), F.col("x").alias("root"))
        now, mark = new, seen
    return now.select(F.col("y").alias("node"), F.col("x").alias("root"))


def grown(post: DataFrame, alive: DataFrame, comps: DataFrame, percent: int, rounds: int, marks: DataFrame | None = None) -> DataFrame:
    """(doc_id, comp) once every candidate pair across components is verified; ``post``, ``alive`` and ``comps`` are used up.

    Rounds of leaders end as soon as one merges nothing or no list has two components left. A pair is asked once: those asked before are
    left out of later rounds.
    """
    asked: list[DataFrame] = []
    last = False
    while not last and not post.isEmpty():
        last = len(asked) == rounds
        pairs = across(post, alive, percent, marks) if last else led(post, len(asked), percent)
        if asked:
            pairs = pairs.join(reduce(DataFrame.unionByName, asked), ["x", "y"], "left_anti")
        asked.append(cut(pairs, "pairs"))
        edges = cut(verified(asked[-1], alive, percent), "edges")
        roots = connected(between(edges, comps))
        if roots.isEmpty() and not last:
            rounds = len(asked)  # the next is the last one
        old, comps = comps, cut(merged(comps, roots), "components")
        for done in (old, edges, roots):
            forget(done)
        if not last:
            old, post = post, cut(mixed(renamed(post, comps)), "postings")
            forget(old)
    for done in (post, alive, *asked):
        forget(done)
    return comps


def class_roots(docs: DataFrame, classes: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    """(rep, root) of the classes whose component has a smaller member: steps 2 to 5."""
    found = candidates_table(docs, k, percent).join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    alive = bucketed(found, "alive", "doc_id")
    comps = cut(alive.select("doc_id", F.col("doc_id").alias("comp")).distinct(), "components")
    post = cut(mixed(postings(alive, percent).withColumn("comp", F.col("doc"))), "postings")
    comps = grown(post, alive, comps, percent, rounds)
    return comps.where("comp < doc_id").select(F.col("doc_id").alias("rep"), F.col("comp").alias("root"))


def components_of(docs: DataFrame, k: int = K, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    signed = cut(signatures(docs, k), "signatures")
    classes = cut(signed.where("doc_id IS NOT NULL AND n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")), "classes")
    roots = class_roots(docs, classes, k, percent, rounds)
    # Written, so that the join back is one of two plain tables: Spark then splits the rows of a very large class.
    known = cut(classes.join(roots, "rep", "left").select("n", "a", "b", F.coalesce("root", "rep").alias("root")), "class-roots")
    of = signed.where("doc_id IS NOT NULL AND n > 0").join(known, ["n", "a", "b"]).where("root < doc_id").groupBy(F.col("doc_id").alias("node")).agg(F.min("root").alias("root"))
    return signed.join(of, signed["doc_id"] == of["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component; rows with null doc_id stay."""
    gone = components_of(docs, k, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def brute_force(rows: list[tuple[int, str | None]], k: int = K, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """(set size, component) by comparing all pairs that share a gram, for tests."""
    import re
    from collections import defaultdict

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, where, root = {}, defaultdict(list), {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        root[d] = d
        for g in sets[d]:
            where[g].append(d)

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for e in where[g]:
                if e < d:
                    shared[e] += 1
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = top(d), top(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}
