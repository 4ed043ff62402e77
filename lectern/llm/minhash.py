"""Near duplicates by SuperMinHash: documents whose sets of word 2-grams have Jaccard similarity >= 0.8, as components.

1. One narrow pass over the texts gives each document the 128-bit sum of its set, by which equal sets are one class (its smallest id stands
   for it), and its SuperMinHash signature. Each element of a set draws a random permutation of the signature's places, by Fisher-Yates
   steps, and one random number a step; a place holds the least (step + number) of all elements that visited it. The ranks of one element at different places are
   correlated (no place is visited twice), which is what makes estimates from these signatures vary less than from independent hashes.
   All elements of a slice take a step together. A document stops as soon as every place holds a number of the steps taken so far: no later
   step can change it, so a text of a thousand words takes one or two steps instead of ``PLACES``.
2. Banding: ``PLACES`` places are 32 bands of 5. Classes that agree in a band are in one bucket. A pair at the very threshold shares no
   band with a chance of about (1 - 0.8**5)**32 = 3e-6; above it, with less. That is the only way a link can be missed.
3. Verification and union-find: the machinery of ``jaccard`` on buckets in place of prefix lists. In some rounds each document is verified
   against a few leaders of its buckets in other components, and components are merged (large-star, small-star); then every pair
   that still shares a bucket across components is verified on the full sets, in the first bucket it shares. Large groups are never expanded into all pairs.
   The sets are made from the texts again, of documents with a bucket mate only, and written once in buckets by document.

Defined cases: null, empty and word-free texts have no set and link with nothing; with fewer than ``k`` words the whole sequence is the
only element; rows with null doc_id have a null component and link with nothing; rows that share a doc_id get the smallest of their components; repeated
rows come out as often as they come in; extra columns are dropped by :func:`groups` and kept by :func:`keep_one`, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.jaccard import PARTS, grown, mixed, shingles
from lectern.llm.packed import mix, slices
from lectern.session import bucketed, cut, forget, ship

U = np.uint64
K, PERCENT = 2, 80
PLACES, BAND, ROUNDS = 160, 5, 3
STEP = U(0x9E3779B97F4A7C15)
FULL = U(np.iinfo(np.uint64).max)


def superminhash(doc: np.ndarray, g: np.ndarray, docs: int, places: int = PLACES) -> np.ndarray:
    """Signatures (documents x places) of sets given as (document, hash) with documents ascending; of an empty set, all places are ``FULL``.

    The upper 32 bits of a place are the step, the lower ones the random number drawn there.
    """
    if not 1 < places <= 256:
        raise ValueError("a place is a byte")
    out = np.full(docs * places, FULL, U)
    if not len(g):
        return out.reshape(docs, places)
    mine, seed, state = doc.astype(np.int64), g, None
    for step in range(places):
        drawn = mix(seed + U((step + 1) * int(STEP) & int(FULL)))
        swap = step + ((drawn & U(0xFFFFFFFF)) * U(places - step) >> U(32)).astype(np.int64)
        if state is None:
            place = swap  # of the identity
        else:
            row = np.arange(len(mine)) * places
            place = state[row + swap].astype(np.int64)
            state[row + swap] = state[row + step]
        np.minimum.at(out, mine * places + place, (drawn >> U(32)) | U(step << 32))
        open_ = np.flatnonzero(np.bincount(mine, minlength=docs))
        done = np.zeros(docs, bool)
        done[open_] = (out.reshape(docs, places)[open_].max(1) >> U(32)) <= U(step)
        stay = ~done[mine]
        if not stay.any():
            break
        if state is None or stay.mean() < 0.75:
            if state is None:
                mine, seed, swap = mine[stay], seed[stay], swap[stay]
                state = np.tile(np.arange(places, dtype=np.uint8), len(mine))
                state[np.arange(len(mine)) * places + swap] = 0  # the first swap: place 0 went there
            else:
                state = state.reshape(-1, places)[stay].ravel()
                mine, seed = mine[stay], seed[stay]
    return out.reshape(docs, places)


def bands_of(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """A hash of each band and its number (documents x bands)."""
    docs, places = signature.shape
    cells = mix(signature).reshape(docs, places // band, band)
    h = np.zeros(cells.shape[:2], U)
    for i in range(band):
        h = mix(h * STEP + cells[:, :, i])
    return mix(h + np.arange(places // band, dtype=U)[None, :] * STEP)


SIGNED = "doc_id long, n long, a long, b long, bands array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def signed(docs: DataFrame, k: int = K, places: int = PLACES, band: int = BAND) -> DataFrame:
    """(doc_id, n, a, b, bands): the size of each document's set, its 128-bit sum and the hashes of its bands (none for an empty set)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, at in slices(batch.column(1)):
                doc, g = shingles(buf, at, k)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U))) for x in (g, mix(g ^ U(0x2545F4914F6CDD1D)))]
                n, some = np.diff(edge), np.diff(edge) > 0
                keys = bands_of(superminhash(doc, g, j - i, places)[some], band).view(np.int64)
                starts = np.concatenate(([0], np.cumsum(some * (places // band)))).astype(np.int32)
                columns = [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *[pa.array((s[edge[1:]] - s[edge[:-1]]).view(np.int64)) for s in sums]]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(starts, pa.array(keys.ravel()))], names=["doc_id", "n", "a", "b", "bands"])
        pa.default_memory_pool().release_unused()

    return _texts(docs).mapInArrow(run, SIGNED)


def sets(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, keys, parts): the whole set of each document and its counts in ``PARTS`` parts, for the verification."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, at in slices(batch.column(1)):
                doc, g = shingles(buf, at, k)
                edge = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                parts = np.bincount(doc * PARTS + (mix(g) % U(PARTS)).astype(np.int64), minlength=(j - i) * PARTS).astype(np.int32)
                lists = pa.ListArray.from_arrays(edge, pa.array(g.view(np.int64)))
                cells = pa.ListArray.from_arrays((np.arange(j - i + 1) * PARTS).astype(np.int32), pa.array(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(edge)), lists, cells], names=["doc_id", "n", "keys", "parts"])
        pa.default_memory_pool().release_unused()

    return _texts(docs).mapInArrow(run, "doc_id long, n int, keys array<long>, parts array<int>")


def buckets_of(classes: DataFrame) -> DataFrame:
    """(key, doc, n, pos, comp) of the buckets that several classes share."""
    each = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("doc"), F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"), F.col("rep").alias("comp"))
    return mixed(each)


def class_roots(docs: DataFrame, classes: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    """(rep, root) of the classes whose component has a smaller member."""
    post = cut(buckets_of(classes), "buckets")
    mates = post.select(F.col("doc").alias("doc_id")).distinct()
    texts = _texts(docs).join(mates, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    alive = bucketed(sets(texts, k).where("n > 0"), "sets", "doc_id")
    comps = cut(mates.select("doc_id", F.col("doc_id").alias("comp")), "components")
    marks = cut(classes.join(mates.select(F.col("doc_id").alias("rep")), "rep", "left_semi").select(F.col("rep").alias("doc"), F.col("bands").alias("marks")), "bands")
    comps = grown(post, alive, comps, percent, rounds, marks)
    forget(marks)
    return comps.where("comp < doc_id").select(F.col("doc_id").alias("rep"), F.col("comp").alias("root"))


def groups(docs: DataFrame, k: int = K, percent: int = PERCENT, places: int = PLACES, band: int = BAND, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    every = cut(signed(docs, k, places, band), "signatures")
    some = every.where("doc_id IS NOT NULL AND n > 0")
    classes = cut(some.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    roots = class_roots(docs, classes, k, percent, rounds)
    known = cut(classes.join(roots, "rep", "left").select("n", "a", "b", F.coalesce("root", "rep").alias("root")), "class-roots")
    forget(classes)
    of = some.select("doc_id", "n", "a", "b").join(known, ["n", "a", "b"]).where("root < doc_id").groupBy(F.col("doc_id").alias("node")).agg(F.min("root").alias("root"))
    out = every.join(of, every["doc_id"] == of["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component; rows with null doc_id stay."""
    gone = groups(docs, k, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
