"""Nearest-neighbour and lexical search over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import cells, postings, substrings, textpairs
from lectern.operators.ranking import best
from lectern.session import cut, forget, ship

def cosine_pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of all pairs but an item with itself: every query's row of the cosine matrix."""
    return cells.nearest(queries, corpus, None, group=cells.BLOCK)  # all pairs of a group come out at once


def knn(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, **sizes: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k most similar items of each query, itself excluded.

    Exact: see :func:`lectern.operators.cells.nearest`. Scores are rounded to 6 digits before they are ranked; ties go to the
    smaller item. Vectors of another length than the query's have no score; a zero vector scores 0.
    """
    return best(cells.nearest(queries, corpus, k, threshold, **sizes), k)


def approximate_knn(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, probes: int = 40, keep: int = 100) -> DataFrame:
    """(query_id, item_id, score, rank, seen) from an inverted file of quantised residuals; scores are exact, hits may be missed."""
    index = cells.invert(corpus, cells.fit(corpus))
    found = cells.probe(queries, index, k, probes, keep)
    return found if threshold is None else found.where(F.col("score") >= threshold)


def word_tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, longer than one character."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), lambda t: F.length(t) > 1)


def bm25_idf(n_docs: Column, df: Column) -> Column:
    """ln((N - df + .5) / (df + .5) + 1)."""
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25_saturation(tf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """The share of a term that occurs ``tf`` times in a text of ``length`` tokens."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def most_frequent(rows: DataFrame, n: int) -> DataFrame:
    """(term, total, df) of the ``n`` most frequent 1- and 2-grams of (terms array) rows, ties by term: occurrences, and rows with the term.

    As a row each, the 2-grams would be several times the texts to shuffle. So each task first adds up its terms by hash in SLOTS slots; a slot's sum is at least the total of
    each of its terms. Then only the terms of slots that reach a bound are counted by themselves. If ``n`` of those have the bound as their total, no other term
    can be among the ``n``; else the bound falls, at last to 1, which is all terms.
    """
    ship(rows.sparkSession)
    each = rows.toDF("terms").select("terms", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"))
    found = each.select("hashes").mapInArrow(postings.slot_sums, "part int, sums array<long>").groupBy("part").applyInArrow(postings.summed, "slot int, total long").toArrow()  # SLOTS rows at most
    slot, total = (found.column(c).to_numpy() for c in ("slot", "total"))
    bound = max(1, int(np.partition(total, len(total) - n)[-n]) // 2) if len(total) >= n else 1
    while True:
        asked = np.zeros(postings.SLOTS, bool)
        asked[slot[total >= bound]] = True
        shared = rows.sparkSession.sparkContext.broadcast(np.packbits(asked))
        counts = cut(each.mapInArrow(postings.counting(shared), "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")), "counts")
        if bound == 1 or counts.where(F.col("total") >= bound).count() >= n:
            return counts.orderBy(F.desc("total"), "term").limit(n)
        forget(counts)
        bound = max(1, bound // 4)


def _hashed(rows: DataFrame, key: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(key, terms) of (key, text) rows, terms as hashes of the tokens in order."""
    return rows.select(F.col(key).cast("long").alias(key), F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("terms"))


def bm25_index(corpus: DataFrame, k1: float = 1.5, b: float = 0.75, tokens: Callable[[Column], Column] = word_tokens) -> tuple[postings.Postings, int]:
    """Postings of (item_id, text) rows with BM25 impacts, and the number of rows. The tokens are written once."""
    docs = cut(_hashed(corpus, "item_id", tokens), "tokens")
    n_docs, mean = docs.agg(F.count("*"), F.avg(F.size("terms"))).head()
    index = postings.build(docs, postings.Bm25(mean or 1.0, k1, b))
    forget(docs)
    return index, n_docs


def bm25_asked(queries: DataFrame, index: postings.Postings, n_docs: int, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """(query_id, term, weight): idf times occurrences, of the queries' terms that the corpus has. Repeated tokens count each time."""
    return _weighted(queries, index.levels.groupBy("term").agg(F.sum("n").alias("df")), n_docs, tokens)


def _weighted(queries: DataFrame, df: DataFrame, n_docs: int, tokens: Callable[[Column], Column]) -> DataFrame:
    each = _hashed(queries, "query_id", tokens).select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return cut(each.join(df, "term").select("query_id", "term", (F.col("times") * bm25_idf(F.lit(n_docs), F.col("df"))).alias("weight")), "asked")


def _ranked(index: postings.Postings, asked: DataFrame, k: int | None) -> DataFrame:
    if k is not None:
        return postings.top_k(index, asked, k)
    every = postings.partial(asked.join(index.levels, "term"), index.blocks)
    return every.select("query_id", "item_id", F.round("partial", 6).alias("score"))


def bm25(queries: DataFrame, corpus: DataFrame, k: int | None = None, wanted: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """(query_id, item_id, score) of the pairs that share a token, an item with itself excluded.

    With ``k`` only what can be among the k best of a query. See :mod:`lectern.operators.postings` for how postings are stored and read.
    With ``wanted`` (query_id, item_id) only those pairs and each query's best, by :mod:`lectern.operators.textpairs`.
    """
    if wanted is not None:
        docs = cut(_hashed(corpus, "item_id", tokens), "tokens")
        n_docs, mean = docs.agg(F.count("*"), F.avg(F.size("terms"))).head()
        groups = cut(textpairs.item_groups(docs, postings.Bm25(mean or 1.0, k1, b)), "items")
        forget(docs)
        asked = _weighted(queries, textpairs.frequencies(groups), n_docs, tokens)
        return textpairs.wanted_and_best(groups, cut(textpairs.query_groups(asked, wanted), "queries"))
    index, n_docs = bm25_index(corpus, k1, b, tokens)
    return _ranked(index, bm25_asked(queries, index, n_docs, tokens), k)


def tfidf_weights(docs: DataFrame, n_docs: int, max_features: int) -> postings.TfIdf:
    """The vocabulary of (item_id, terms as strings) rows: the ``max_features`` most frequent 1- and 2-grams (ties by term), with smoothed idf.

    Its size is that bound, so it is collected and broadcast.
    """
    top = most_frequent(docs.select("terms"), max_features)
    parts = F.split("term", " ")
    rows = top.select(F.size(parts).alias("size"), F.xxhash64(parts[0]).alias("a"), F.xxhash64(F.get(parts, F.lit(1))).alias("b"), (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")).toPandas()
    a, b = (rows[c].to_numpy(np.int64) for c in "ab")
    terms = np.where(rows["size"] == 2, postings.pair_hash(a, b), a)
    order = np.argsort(terms)
    return postings.TfIdf(terms[order], rows["idf"].to_numpy(np.float64)[order])


def tfidf(queries: DataFrame, corpus: DataFrame, max_features: int = 5000, k: int | None = None, units: tuple[Column, Column, float] | None = None) -> DataFrame:
    """(query_id, item_id, score): cosine of smoothed TF-IDF weights of 1- and 2-grams.

    Only pairs that share a term appear; with ``k`` only those that can be among the k best of a query. ``units``: a column
    of the queries, one of the corpus, and what is added to a pair's score for ranking where both are equal; it isn't part of
    the score that comes out. With ``k`` texts meet group by group (:mod:`lectern.operators.textpairs`): the vocabulary is of frequent terms, so a query
    shares some with nearly every text, and postings would be a row to shuffle for nearly each pair and term.
    """
    stored = cut(corpus.select(F.col("item_id").cast("long").alias("item_id"), F.array_join(word_tokens(F.col("text")), " ").alias("words"), *_unit(units, 1)), "tokens")  # a string a text: readers hold thousands of rows of lists
    docs = stored.withColumn("terms", F.filter(F.split("words", " "), lambda t: t != "")).drop("words")
    weigh = tfidf_weights(docs, docs.count(), max_features)
    hashed = docs.withColumn("terms", F.transform("terms", lambda t: F.xxhash64(t)))
    vectors = postings.vectors(_hashed(queries, "query_id", word_tokens), weigh, "query_id")
    if k is None:
        index = postings.build(hashed.select("item_id", "terms"), weigh)
        forget(stored)
        asked = cut(vectors.select("query_id", F.explode(F.arrays_zip("terms", "impacts")).alias("t")).select("query_id", F.col("t.terms").alias("term"), F.col("t.impacts").alias("weight")), "asked")
        return _ranked(index, asked, None)
    groups = cut(textpairs.item_groups(hashed, weigh), "items")
    forget(stored)
    if units is not None:
        vectors = vectors.join(queries.select(F.col("query_id").cast("long").alias("query_id"), *_unit(units, 0)), "query_id")
    asked = cut(vectors, "asked")
    return textpairs.leading(groups, cut(textpairs.asked_groups(asked), "queries"), k, 0.0 if units is None else float(units[2]))


def _unit(units: tuple[Column, Column, float] | None, side: int) -> list[Column]:
    """The column ``unit`` of a side, if there are units: a hash, null where there is none."""
    return [] if units is None else [F.when(units[side].isNotNull(), F.xxhash64(units[side].cast("string"))).alias("unit")]


def minmax(scored: DataFrame, score: str = "score", out: str = "scaled") -> DataFrame:
    """Scores scaled to 0..1 within each query; .5 where they are all equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn(out, F.when(high == low, 0.5).otherwise((F.col(score) - low) / (high - low)))


def fuse(dense: DataFrame, lexical: DataFrame, alphas: list[float], k: int = 20) -> DataFrame:
    """(alpha, query_id, item_id, score, rank): alpha x scaled dense score + (1 - alpha) x lexical score over its maximum."""
    top = lexical.groupBy("query_id").agg(F.max(F.when(F.col("score") > 0, F.col("score"))).alias("top"))
    lex = lexical.join(top, "query_id").select("query_id", "item_id", (F.col("score") / F.coalesce("top", F.lit(1.0))).alias("lex"))
    both = minmax(dense).select("query_id", "item_id", "scaled").join(lex, ["query_id", "item_id"], "left")
    both = both.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    fused = both.withColumn("score", F.round(F.col("alpha") * F.col("scaled") + (1 - F.col("alpha")) * F.coalesce("lex", F.lit(0.0)), 6))
    order = Window.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "item_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("alpha", "query_id", "item_id", "score", "rank")


def keyword(items: DataFrame, word: str, columns: list[str], k: int, item: str = "item_id", score: float = 0.8) -> DataFrame:
    """Items that hold ``word`` in one of ``columns`` (case-insensitive; % and _ are wildcards), a constant score, by id."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False))
    return items.where(hit).withColumn("score", F.lit(score)).orderBy(item).limit(k)


def keywords(items: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """(word, item_id): the first k items, by id, whose text holds each word; see :mod:`lectern.operators.substrings`."""
    return substrings.first_matches(items, words, k)


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def two_stage(first: DataFrame, queries: DataFrame, items: DataFrame, k: int, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """(query_id, item_id, first_score, score, rank): first-stage hits scored again; k is at most 20.

    Without ``scorer`` the score is the share of the query's distinct words that the item holds. ``scorer(query text, item text)`` gets the
    hits of one query at a time, as many as the first stage gives; where it fails, that query's hits have score 0 and so keep their first-stage order.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("first_score"), "item_id")
    hits = first.select("query_id", "item_id", F.col("score").alias("first_score"))
    text = lambda df, key, name, of: df.select(key, of(F.col("text")).alias(name))
    of = _words if scorer is None else lambda c: F.coalesce(c, F.lit(""))
    both = hits.join(text(queries, "query_id", "q", of), "query_id", "left").join(text(items, "item_id", "d", of), "item_id", "left")
    if scorer is None:
        share = F.when(F.size("q") > 0, F.coalesce(F.size(F.array_intersect("q", "d")), F.lit(0)) / F.size("q")).otherwise(0.0)
        scored = both.withColumn("score", share)
    else:
        ship(first.sparkSession)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            try:
                score = np.asarray(scorer(rows["q"].fillna(""), rows["d"].fillna("")), dtype=np.float64)
                if score.shape != (len(rows),):
                    raise ValueError("a score for each hit is needed")
            except Exception:  # noqa: BLE001  whatever a model raises, the first stage's order is the answer
                score = np.zeros(len(rows))
            return rows[["query_id", "item_id", "first_score"]].assign(score=score)

        scored = both.groupBy("query_id").applyInPandas(run, "query_id long, item_id long, first_score double, score double")
    scored = scored.select("query_id", "item_id", "first_score", F.round("score", 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(k, 20))
