"""Quality rules by distribution divergence, as Spark column expressions.

Every language's reference is two histograms summed over all its documents: character classes, and its
``common`` most frequent words with one bin for the rest. A document is rejected where the Jensen-Shannon
distance (base 2, 0 to 1) of either histogram to its language's reference is above a bound, given enough
characters or words; two plain rules (too few words, too much repetition) go first. Bounds come from the
distances of all documents of the language: a Tukey fence by octave of words, and a multiple of the median
for characters.

Defined cases: null or empty text has no words and fails the plain rules; a document with null lang, or with
a lang whose reference has fewer than ``min_reference`` words, is judged by the plain rules alone; documents
under the minimum lengths are not judged by the distances; ties among common words go by the word; repeated
rows are judged one by one; extra columns pass through untouched. Its own columns start with ``_qr``; input
columns of those names raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.text import let, whole, words
from lectern.session import cut

CLASSES = ["lower", "upper", "digit", "blank", "mark", "symbol", "other"]
SPAN = 8
# Fixed values of the plain rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
# Slots of a language's common words, bins of a distance, and kinds of bounds besides the octaves.
SLOTS, BINS, WORDS, CHARS = 2048, 1000, -1, -2


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def char_counts(text: Column) -> Column:
    """Code points of each of CLASSES, as a struct with ``n_symbols`` and ``blanks``.

    One pass takes out a-z and the space; the other classes are counted in the short rest.
    """

    def of(rest: Column) -> Column:
        left = F.length(rest)
        spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
        upper, digit = left - _without(rest, "[A-Z]+"), left - _without(rest, "[0-9]+")
        blank = left - _without(rest, "[\\x09-\\x0D]+")
        mark = left - _without(rest, "[.,;:!?'\"()-]+")
        symbol = left - _without(rest, "[\\x00-\\x08\\x0E-\\x1F#$%&*+/<=>@\\[\\\\\\]^_`{|}~\\x7F]+")
        return F.struct(
            (F.length(text) - left - spaces).cast("long").alias("lower"),
            upper.cast("long").alias("upper"),
            digit.cast("long").alias("digit"),
            (spaces + blank).cast("long").alias("blank"),
            mark.cast("long").alias("mark"),
            symbol.cast("long").alias("symbol"),
            (left - upper - digit - blank - mark - symbol).cast("long").alias("other"),
            (left - _without(rest, "[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        )

    return let(F.regexp_replace(text, "[a-z ]+", ""), of)


def repeated_words(ws: Column, span: int = SPAN) -> Column:
    """Words inside windows of ``span`` words that the text holds at least twice (the first included).

    Windows are hashed; only a text with equal hashes is sorted by hash to find where those windows start,
    and the covered words are the gaps between the starts, each cut at ``span``.
    """

    def covered(marks: Column) -> Column:
        ranked = F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(r: Column) -> Column:
            same = lambda x, k: (k >= 0) & (k < F.size(r)) & (F.get(r, k)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(r, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(span), F.coalesce(F.get(at, k + 1) - p, F.lit(span))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return let(let(ranked, starts), total)

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (span - 1)), lambda i: F.xxhash64(F.slice(ws, i, span)))
    many = let(hashes, lambda m: F.when(F.size(F.array_distinct(m)) == F.size(m), F.lit(0)).otherwise(covered(m)))
    return F.when(F.size(ws) <= span, F.lit(0)).otherwise(many).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null where either has no mass."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def distance(a: Column, b: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: F.struct((x / a).alias("x"), (y / b).alias("y")))
        both = F.transform(terms, lambda t: part(t["x"], (t["x"] + t["y"]) / 2) + part(t["y"], (t["x"] + t["y"]) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), total(both) / 2))

    return let(total(p), lambda a: let(total(q), lambda b: F.when((a > 0) & (b > 0), distance(a, b))))


def references(docs: DataFrame, common: int = 64, min_reference: int = 2000) -> DataFrame:
    """One row a language: (_qr_lang, _qr_char_ref, _qr_top_words, _qr_slots, _qr_word_ref), from all of ``docs``.

    ``_qr_slots`` finds a word in ``_qr_top_words`` without a search: at the word's hash it holds its place
    from 1, or 0. Of common words with one slot the most frequent is taken and the others count as the rest.
    """
    text = docs.where(F.col("lang").isNotNull()).select(F.col("lang").alias("_qr_lang"), whole("text").alias("text"))
    chars = text.select("_qr_lang", char_counts(F.col("text")).alias("c")).groupBy("_qr_lang")
    chars = chars.agg(F.array(*[F.sum(f"c.{c}") for c in CLASSES]).alias("_qr_char_ref"))
    counts = text.select("_qr_lang", F.explode(words(F.col("text"))).alias("word")).groupBy("_qr_lang", "word").agg(F.count("*").alias("n"))
    sums = counts.groupBy("_qr_lang").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("_qr_lang").orderBy(F.desc("n"), "word")
    same = Window.partitionBy("_qr_lang", "slot").orderBy("rank")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common).withColumn("slot", slot_of(F.col("word")))
    top = top.withColumn("place", F.row_number().over(same)).where("place = 1")
    top = top.groupBy("_qr_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n", "slot"))).alias("top"))
    joined = chars.join(sums, "_qr_lang").join(top, "_qr_lang").where(F.col("total") >= min_reference)
    rest = F.col("total") - F.aggregate("top.n", F.lit(0).cast("long"), lambda a, n: a + n)
    shares = F.transform(F.concat(F.col("top.n"), F.array(rest)), lambda n: n / F.col("total"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.array_position(F.col("top.slot"), s).cast("int"))
    return joined.select("_qr_lang", "_qr_char_ref", F.col("top.word").alias("_qr_top_words"), slots.alias("_qr_slots"), shares.alias("_qr_word_ref"))


def slot_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def word_distance(ws: Column, top: Column, slots: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of the counts of each word of ``top`` in ``ws`` and of all others to ``shares``.

    Only words that the text holds are visited; each word that it doesn't hold adds its whole share.
    """
    place = lambda w: F.get(slots, slot_of(w))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def runs(p: Column) -> Column:
        at = F.filter(F.transform(p, lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(p, x["i"] - 1) != x["r"]))
        held = let(at, lambda a: F.transform(a, lambda x, k: F.struct(x["r"].alias("r"), (F.coalesce(F.get(a, k + 1)["i"], F.size(p)) - x["i"]).alias("n"))))
        return F.concat(held, F.array(F.struct(F.size(shares).alias("r"), (F.size(ws) - F.size(p)).alias("n"))))

    def distance(found: Column) -> Column:
        terms = F.transform(found, lambda t: F.struct((t["n"] / F.size(ws)).alias("x"), F.get(shares, t["r"] - 1).alias("y")))
        each = F.transform(terms, lambda t: part(t["x"], (t["x"] + t["y"]) / 2) + part(t["y"], (t["x"] + t["y"]) / 2) - t["y"])
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(1.0), lambda s, x: s + x) / 2))

    known = F.filter(ws, lambda w: (place(w) > 0) & (F.get(top, place(w) - 1) == w))
    found = let(F.sort_array(F.transform(known, place)), runs)
    return F.when((F.size(ws) > 0) & shares.isNotNull(), let(found, distance))


def octave(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def bounds(figures: DataFrame, words_fence: float, chars_factor: float, min_band: int) -> DataFrame:
    """One row a language: (_qr_bound_lang, _qr_bounds), a map from the kind of bound to its value.

    ``figures`` has (_qr_lang, n_words, words_distance, chars_distance) of every document. Short texts are
    further from any reference, so kinds from 0 are word bounds by octave of words (``min_band`` documents
    at least); WORDS is the word bound of all lengths and CHARS the character bound. Quartiles are exact to
    1/2000: distances are counted in bins that add up in any order.
    """
    value = lambda kind, d: F.when(d.isNotNull(), F.struct(kind.cast("int").alias("kind"), F.floor(d * BINS).alias("bin")))
    w, c = F.col("words_distance"), F.col("chars_distance")
    each = figures.select("_qr_lang", F.explode(F.array_compact(F.array(value(octave(F.col("n_words")), w), value(F.lit(WORDS), w), value(F.lit(CHARS), c)))).alias("v"))
    counts = each.groupBy("_qr_lang", "v.kind", "v.bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("_qr_lang", "kind")
    so_far = counts.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("bin"))})
    share = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), (F.col("bin") + 0.5) / BINS))
    q = so_far.groupBy("_qr_lang", "kind").agg(F.max("total").alias("n"), share(0.25).alias("low"), share(0.5).alias("middle"), share(0.75).alias("high"))
    q = q.where((F.col("kind") < 0) | (F.col("n") >= min_band))
    bound = F.when(F.col("kind") == CHARS, chars_factor * F.col("middle")).otherwise(F.col("high") + words_fence * (F.col("high") - F.col("low")))
    return q.groupBy(F.col("_qr_lang").alias("_qr_bound_lang")).agg(F.map_from_entries(F.collect_list(F.struct("kind", bound))).alias("_qr_bounds"))


def judge(
    docs: DataFrame, common: int = 64, min_reference: int = 2000, min_chars: int = 200, min_words: int = 50,
    words_fence: float = 2.0, chars_factor: float = 2.5, min_band: int = 20, max_broadcast_languages: int = 2000, keep_text: bool = True,
) -> DataFrame:
    """``docs``, without the text if asked, plus _qr (struct of every figure), _qr_failed and _qr_kept (boolean).

    The references and bounds are written once. They are broadcast only if there are at most
    ``max_broadcast_languages`` of them (about 10 kB each); otherwise Spark joins them by language. Bounds need the
    distances of all documents before any is judged: without the text all figures are written and read again, with it
    the two distances are computed twice, so that texts needn't be written.
    """
    if clash := [c for c in docs.columns if c.startswith("_qr")]:
        raise ValueError(f"columns {clash} have names that the quality rules use")
    few = lambda df, n: F.broadcast(df) if n <= max_broadcast_languages else df
    refs = cut(references(docs, common, min_reference), "references")
    n_refs = refs.count()
    text = whole("text")

    def words_distance(w: Column) -> Column:
        return F.when(F.size(w) >= min_words, word_distance(w, F.col("_qr_top_words"), F.col("_qr_slots"), F.col("_qr_word_ref")))

    def chars_distance(c: Column) -> Column:
        return F.when(F.length(text) >= min_chars, js_distance(F.array(*[c[x] for x in CLASSES]), F.col("_qr_char_ref")))

    figures = let(
        words(text),
        lambda w: let(
            char_counts(text),
            lambda c: F.struct(
                F.size(w).cast("long").alias("n_words"),
                (F.length(text) - c["blank"]).cast("long").alias("word_chars"),
                c["n_symbols"].alias("n_symbols"),
                duplicate_lines(text).alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.length(text).cast("long").alias("n_chars"),
                chars_distance(c).alias("chars_distance"),
                words_distance(w).alias("words_distance"),
            ),
        ),
    )
    kept = [c for c in docs.columns if keep_text or c != "text"]
    joined = docs.join(few(refs, n_refs), docs["lang"] == refs["_qr_lang"], "left")
    measured = joined.select(*[docs[c] for c in kept], "_qr_lang", figures.alias("_qr"))
    if keep_text:
        long = F.when(F.length(text) >= min_chars, let(char_counts(text), chars_distance)).alias("chars_distance")
        spread = joined.where("_qr_lang IS NOT NULL").select("_qr_lang", let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), words_distance(w).alias("words_distance"), long)).alias("f")).select("_qr_lang", "f.*")
    else:
        measured = cut(measured, "figures")
        spread = measured.where("_qr_lang IS NOT NULL").select("_qr_lang", "_qr.n_words", "_qr.words_distance", "_qr.chars_distance")
    limits = cut(bounds(spread, words_fence, chars_factor, min_band), "bounds")
    limited = measured.join(few(limits, n_refs), measured["_qr_lang"] == limits["_qr_bound_lang"], "left")
    q = F.col("_qr")
    words_bound = F.coalesce(F.try_element_at("_qr_bounds", octave(q["n_words"])), F.try_element_at("_qr_bounds", F.lit(WORDS)))
    out = limited.select(*kept, q.withField("chars_bound", F.try_element_at("_qr_bounds", F.lit(CHARS))).withField("words_bound", words_bound).alias("_qr"))
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    odd_chars = F.coalesce(q["chars_distance"] > q["chars_bound"], F.lit(False))
    odd_words = F.coalesce(q["words_distance"] > q["words_bound"], F.lit(False))
    return out.withColumns({"_qr_failed": failed, "_qr_kept": ~failed & ~odd_chars & ~odd_words})
