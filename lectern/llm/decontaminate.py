"""Benchmark decontamination by winnowing.

Words are hashed into k-grams (k = 5); of each window of 6 neighbouring k-grams the minimum hash is kept as
a fingerprint. A document and a benchmark item that share any 10 consecutive words share a whole window, so
they share its fingerprint: no shared span of 10 words is missed. A document's fingerprints that the benchmark may hold are
extended to the 10-word windows around them, and those windows are joined with the benchmark's by their words, so a
hash collision never counts.

Both sides are DataFrames. Two narrow passes turn texts into fingerprints and windows. What a document's pass knows of
the benchmark is a bitmap of its fingerprints and windows, of at most 2**``most_bits`` bits (64 MB) whatever the benchmark's size; it is the only
thing that is broadcast, and it only leaves out what can't match. Documents without a window that may match, nearly
all of them, are never shuffled; the others' windows, a row each, are joined with the benchmark's (a window that very many documents
hold is a hot key there, which Spark's adaptive join may split), and the hits come back to their documents by a row number.

Items of fewer than 10 words are one window of their own length and are looked up at every position.

Defined cases: null or empty texts have no words, hit nothing and are never hit; repeated items with one id
count once, items with equal texts count each; null item ids are ignored; an empty benchmark hits nothing;
repeated documents get a row each; extra columns pass through :func:`mark` untouched. Its own columns start with ``_dc_``;
input columns of those names raise an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.packed import ALNUM, grams, mix, slices, words_of
from lectern.llm.text import whole
from lectern.session import cut, ship

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
U = np.uint64
WINDOWS = "array<struct<at:int,size:int,words:string>>"


def winnow(h: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in ``h`` (k-gram hashes at words ``at``) that are the minimum of a window of WINDOW neighbours.

    All equal minima are kept. Windows do not cross documents.
    """
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = h[:n].copy()
    for i in range(1, WINDOW):
        np.minimum(low, h[i : i + n], out=low)
    whole_ = at[WINDOW - 1 :] - at[:n] == WINDOW - 1  # the first words follow each other
    end = np.searchsorted(first, at, "right")
    whole_ &= end[:n] == end[WINDOW - 1 :]
    keep = np.zeros(len(h), bool)
    for i in range(WINDOW):
        keep[i : i + n] |= whole_ & (h[i : i + n] == low)
    return np.flatnonzero(keep)


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(item, size, words, prints) of every distinct window of the items: its words, its fingerprint hashes and its own hash.

    A window's fingerprints are those of its first GRAM-grams; only whole windows have any.
    """
    ship(benchmark.sparkSession)
    schema = "item string, size int, words string, prints array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for i, _, buf, at in slices(batch.column(1)):
                w = words_of(buf, at, ALNUM)
                h, n = w.hashes(), np.diff(w.first)
                k, k_at = grams(h, w.first, GRAM)
                low = np.full(len(h) + 1, -1, np.int64)
                low[k_at] = np.arange(len(k))
                out: list[tuple] = []
                for size in sorted({min(SPAN, int(x)) for x in n if x}):
                    g, places = grams(h, w.first, size)
                    of = np.searchsorted(w.first, places, "right") - 1
                    own = tagged(g, size).view(np.int64)
                    for x, p, d in zip(own.tolist(), places.tolist(), of.tolist(), strict=True):
                        if size < SPAN and n[d] != size:
                            continue
                        prints = [x]
                        if size == SPAN:  # the fingerprint that any document with this window keeps
                            prints.append(int(tagged(k[low[p] : low[p] + WINDOW].min(keepdims=True), 0).view(np.int64)[0]))
                        out.append((names[i + d].as_py(), size, w.text(p, p + size).decode("utf-8", "surrogateescape"), prints))
                yield pa.RecordBatch.from_pydict(dict(zip(("item", "size", "words", "prints"), zip(*out, strict=True) if out else ([],) * 4, strict=True)), pa.schema([("item", pa.string()), ("size", pa.int32()), ("words", pa.string()), ("prints", pa.list_(pa.int64()))]))

    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), whole("text").alias("text"))
    return items.mapInArrow(run, schema)


def tagged(g: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of one size (0: fingerprints), apart from those of other sizes."""
    return mix(g ^ U(size + 1))


def bitmap(windows: DataFrame, most_bits: int) -> np.ndarray:
    """A bit for the top bits of every hash of ``prints``: about 32 bits a window, 2**most_bits at most. Spark adds up its words."""
    bits = min(most_bits, max(16, (32 * windows.count()).bit_length()))
    place = f"shiftrightunsigned(p, {64 - bits})"
    cells = windows.select(F.explode("prints").alias("p")).groupBy(F.expr(f"shiftright({place}, 5)").alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 31 AS INT)))").alias("v"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for batch in cells.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return out


def known(g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    place = (g >> U(64 - 5 - (len(bits).bit_length() - 1))).astype(np.int64)
    return (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1


def candidates(w, bits: np.ndarray, sizes: list[int]) -> dict[int, list[dict]]:
    """Windows of each document of a slice that the benchmark may hold."""
    h, found = w.hashes(), defaultdict(list)
    for size in sizes:
        g, places = grams(h, w.first, size)
        if size == SPAN:
            k, at = grams(h, w.first, GRAM)
            f = winnow(k, at, w.first)
            anchors = at[f[known(tagged(k[f], 0), bits)]]
            if not len(anchors):
                continue
            near = np.zeros(len(h) + SPAN, bool)
            for back in range(WINDOW):  # windows that hold the anchor's k-gram
                near[np.maximum(anchors - back, 0)] = True
            look = near[places]
            g, places = g[look], places[look]
        places = places[known(tagged(g, size), bits)]
        of = np.searchsorted(w.first, places, "right") - 1
        for p, d in zip(places.tolist(), of.tolist(), strict=True):
            found[d].append({"at": p - int(w.first[d]), "size": size, "words": w.text(p, p + size).decode("utf-8", "surrogateescape")})
    return found


def _pass(shared, sizes: list[int], text: str, kept: list[str], schema: T.StructType):
    """Documents with their number of words and the windows that may match, as _dc_words and _dc_windows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["_dc_windows"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, windows = [], [[]] * batch.num_rows
            for i, _, buf, at in slices(batch.column(batch.schema.get_field_index(text))):
                w = words_of(buf, at, ALNUM)
                n_words.extend(np.diff(w.first).tolist())
                for d, some in candidates(w, shared.value, sizes).items():
                    windows[i + d] = some
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(windows, kind)], names=[*kept, "_dc_words", "_dc_windows"])

    return run


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_bits: int = 29, keep_text: bool = True) -> DataFrame:
    """``docs``, without the text if asked, plus _dc_words (long), _dc_spans (hit runs of words: start, end, start, end ...) and _dc_items (sorted ids)."""
    spark = docs.sparkSession
    ship(spark)
    if clash := [c for c in docs.columns if c.startswith("_dc_")]:
        raise ValueError(f"columns {clash} have names that decontamination uses")
    windows = cut(windows_of(benchmark), "windows")
    sizes = [r.size for r in windows.select("size").distinct().orderBy("size").collect()]  # at most SPAN numbers
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType, True) for c in kept], T.StructField("_dc_words", T.LongType()), T.StructField("_dc_windows", T._parse_datatype_string(WINDOWS))])
    passed = docs.mapInArrow(_pass(spark.sparkContext.broadcast(bitmap(windows, most_bits)), sizes, text, kept, schema), schema)
    few = cut(passed.where(F.size("_dc_windows") > 0).withColumn("_dc_row", F.monotonically_increasing_id()), "candidates")
    each = few.select("_dc_row", F.explode("_dc_windows").alias("w")).select("_dc_row", "w.*")
    held = windows.groupBy("size", "words").agg(F.collect_set("item").alias("items"))
    hits = each.join(held, ["size", "words"]).groupBy("_dc_row").agg(
        runs(F.sort_array(F.collect_list(F.struct(F.col("at").cast("long").alias("a"), (F.col("at") + F.col("size")).cast("long").alias("b"))))).alias("_dc_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_dc_items"),
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    hit = few.join(hits, "_dc_row", "left").select(*kept, "_dc_words", F.coalesce("_dc_spans", none("long")).alias("_dc_spans"), F.coalesce("_dc_items", none("string")).alias("_dc_items"))
    rest = passed.where(F.size("_dc_windows") == 0).select(*kept, "_dc_words", none("long").alias("_dc_spans"), none("string").alias("_dc_items"))
    return rest.unionByName(hit)


def runs(windows: Column) -> Column:
    """Sorted (a, b) windows as flat runs: start, end, start, end ..."""
    start = F.transform(windows, lambda w, i: F.struct(w["a"].alias("a"), w["b"].alias("b"), i.alias("i")))
    # Windows are sorted by start; of one start the longest is last. The furthest end so far decides where a run ends.
    merged = F.aggregate(
        start,
        F.struct(none_long().alias("done"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")),
        lambda s, w: F.when(s["a"] < 0, F.struct(s["done"].alias("done"), w["a"].alias("a"), w["b"].alias("b")))
        .when(w["a"] <= s["b"], F.struct(s["done"].alias("done"), s["a"].alias("a"), F.greatest(s["b"], w["b"]).alias("b")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["a"], s["b"])).alias("done"), w["a"].alias("a"), w["b"].alias("b"))),
        lambda s: F.concat(s["done"], F.array(s["a"], s["b"])),
    )
    return merged


def none_long() -> Column:
    return F.array().cast("array<long>")


def n_hit(spans: Column) -> Column:
    """Hit words of flat (start, end) runs."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, list[str]]]:
    """(words, hit words, items) by comparing every window with every item, for tests."""
    import re

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(table))
    owners = defaultdict(set)
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - SPAN + 1) if w else 0):
            owners[tuple(w[i : i + SPAN])].add(str(name))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in owners}:
            for i in range(len(w) - size + 1):
                if names := owners.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= names
        out[d] = (len(w), len(hit), sorted(found))
    return out
