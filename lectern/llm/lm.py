"""Language-model scoring: a trigram model by deleted interpolation.

P(w | g h) = a c(g, h, w) / c(g, h) + b c(h, w) / c(h) + d c(w) / N + e / (V + 1), where the weights depend on the bucket
of the context: log2 c(g, h), or log2 c(h) where the pair g h is unknown, or neither. They are learned by
expectation-maximisation on held-out counts: chunks of documents in one of ``folds`` folds are left out of the counts, and
their training documents supply the events. The final counts are those of all training documents. A document's score is the
sum of log10 P over its tokens, the end included; its first token follows an end, which for the longest context counts
as a pair of ends.

Counts of all n-grams, of all training documents and without any cap, go through the packed exchange
(``exchange.py``): chunks ask for the n-grams they hold, so every task sees the counts of its own documents only.
What the driver gets are N, V and a histogram of bounded size (buckets x quantised probabilities).

Defined cases: null or empty texts are one end token; without training documents N = V = 0 and all mass is
uniform; a null doc_id counts as the empty text when documents are dealt and held out; repeated rows are scored one by one; columns other than those asked
for by ``keep`` are dropped. A chunk is a run of rows of one partition, so ``docs`` has to be a stored table, which gives the same rows
in the same order whenever it is read; a chunk that comes back otherwise raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.exchange import messages, pack_counts, pack_sorted, scale, unpack_counts, unpack_sorted
from lectern.llm.packed import PLACES, SOLID, mix, slices, words_of
from lectern.session import cut, forget, ship

U = np.uint64
END = U(0x5851F42D4C957F2D)
STEPS = 2  # quantisation of probabilities: steps an octave
LEVELS = 64  # buckets of one kind of context: none, then those of h alone (1 to 63), then those of g h (64 to 127)
START_WEIGHTS = (0.3, 0.3, 0.3, 0.1)
WORD_BYTES = 6
LEAST_WEIGHT = 1e-4


class Tokens:
    """Token hashes of some documents, an end after each, and their distinct n-grams of one to three tokens.

    ``grams`` and ``of`` hold the distinct hashes of each order and which of them each place is; ``context`` is the place
    in ``grams[0]`` of the token before, ``pair_context`` that of the two tokens before in ``grams[1]``.
    """

    def __init__(self, texts):
        tokens, sizes = [], []
        for _, _, buf, at in slices(texts):
            w = words_of(buf, at, SOLID)
            n = np.diff(w.first)
            out = np.full(len(w.start) + len(n), END, U)
            out[np.arange(len(w.start)) + w.doc] = w.hashes()
            tokens.append(out)
            sizes.append(n + 1)
        token = np.concatenate(tokens) if tokens else np.zeros(0, U)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size) - self.size
        before = np.concatenate(([END], token[:-1])) if len(token) else token
        earlier = np.concatenate(([END], before[:-1])) if len(token) else token
        earlier[self.first] = END  # documents are apart: a first token follows two ends
        self.grams, self.of = [], []
        for keys in (token, mix(before * PLACES[0] + token * PLACES[1]), mix(earlier * PLACES[0] + before * PLACES[1] + token * PLACES[2])):
            every, of = np.unique(keys, return_inverse=True)
            self.grams.append(every)
            self.of.append(of.astype(np.int32))
        self.end = int(np.searchsorted(self.grams[0], END))
        shifted = lambda x: np.concatenate((x[:1], x[:-1])) if len(x) else x
        self.context, self.pair_context = shifted(self.of[0]), shifted(self.of[1])
        self.context[self.first] = self.end

    def per_token(self, flag: np.ndarray) -> np.ndarray:
        return np.repeat(flag, self.size)

    def counts(self, n: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """At each place the counts of the pair before, the token before, and the trigram, bigram and unigram that end there."""
        pair = n[1][self.pair_context]
        pair[self.first] = n[0][self.end] if len(n[0]) else 0  # two ends: as often as there are documents
        return pair, n[0][self.context], n[2][self.of[2]], n[1][self.of[1]], n[0][self.of[0]]


ASKED = "chunk long, bucket long, keys binary, counts binary"
ASKED_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def chunks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows): runs of rows of a partition with about ``size`` bytes of text; their numbers are unique."""
    serial = TaskContext.get().partitionId() << 24
    for batch in batches:
        for i, j, _, _ in slices(batch.column(batch.schema.get_field_index("text")), size):
            yield serial, batch.slice(i, j - i)
            serial += 1


def _ask(buckets: int, size: int):
    """Messages of the chunks of a partition: distinct n-grams and how often training documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in chunks_of(batches, size):
            t = Tokens(rows.column("text"))
            train = t.per_token(rows.column("train").to_numpy(zero_copy_only=False))
            out = []
            for kind, (keys, of) in enumerate(zip(t.grams, t.of, strict=True)):
                n = np.bincount(of[train], minlength=len(keys))
                out.extend((chunk, kind * buckets + b, pack_sorted(keys[a:e]), pack_counts(n[a:e])) for b, a, e in messages(keys, buckets))
            yield pa.RecordBatch.from_pydict(dict(zip(ASKED_SCHEMA.names, zip(*out, strict=True), strict=True)), ASKED_SCHEMA)
        pa.default_memory_pool().release_unused()

    return run


def numbered(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with the number of each row's chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in chunks_of(batches, size):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, chunk, np.int64))], names=[*rows.schema.names, "chunk"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("chunk", T.LongType())]))


def _answer(buckets: int, folds: int):
    def run(asked: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in asked.column("keys")]
        counts = [unpack_counts(x.as_py()) for x in asked.column("counts")]
        chunks = asked.column("chunk").to_pylist()
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        out_fold = np.repeat([c % folds == 0 for c in chunks], [len(k) for k in keys])
        n = np.concatenate(counts).astype(np.int64)
        total = np.bincount(of, weights=n, minlength=len(every))
        fitted = np.bincount(of[~out_fold], weights=n[~out_fold], minlength=len(every))
        rows, a = [], 0
        bucket = asked.column("bucket")[0].as_py()
        for c, k in zip(chunks, keys, strict=True):
            mine = of[a : a + len(k)]
            rows.append((c, bucket, pack_counts(total[mine]), pack_counts(fitted[mine]) if c % folds == 0 else None, 0, 0, 0))
            a += len(k)
        if bucket < buckets:  # unigrams: their part of V, N and the fitted N
            rows.append((-1, bucket, None, None, int((total > 0).sum()), int(total.sum()), int(fitted.sum())))
        return pa.Table.from_pydict(dict(zip(("chunk", "bucket", "total", "fitted", "types", "tokens", "fitted_tokens"), zip(*rows, strict=True), strict=True)), pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("total", pa.binary()), ("fitted", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("fitted_tokens", pa.int64())]))

    return run


ANSWERED = "chunk long, bucket long, total binary, fitted binary, types long, tokens long, fitted_tokens long"


def _counts(t: Tokens, answers: pa.Table, column: str, buckets: int) -> list[np.ndarray]:
    """Counts of the chunk's n-grams, in their order."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column(column), strict=True), key=lambda r: r[0])
    parts: list[list] = [[], [], []]
    for b, x in rows:
        parts[b // buckets].append(unpack_counts(x.as_py()).astype(np.float64))
    out = [np.concatenate(p) if p else np.zeros(0) for p in parts]
    if [len(n) for n in out] != [len(g) for g in t.grams]:
        raise ValueError("a chunk of documents was not read again as it was; store the documents first")
    return out


def bucket_of(pair: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The bucket of a context by the counts of its two tokens and of the last one."""
    level = lambda c: 1 + np.floor(np.log2(np.maximum(c, 1)))
    return np.where(pair > 0, LEVELS - 1 + level(pair), np.where(context > 0, level(context), 0)).astype(np.int64)


def _events(buckets: int, fitted_tokens: int):
    """Held-out events of a chunk as a histogram over (bucket, quantised probabilities of the three orders)."""
    names = ("level", "q3", "q2", "q1", "n")

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([(x, pa.int64()) for x in names])
        if not docs.num_rows or not answers.num_rows:
            return schema.empty_table()
        t = Tokens(docs.column("text"))
        train = t.per_token(docs.column("train").to_numpy())
        pair, context, three, two, one = (x[train] for x in t.counts(_counts(t, answers, "fitted", buckets)))
        q = lambda n, d: np.where(n > 0, np.round(-STEPS * np.log2(np.maximum(n, 1) / np.maximum(d, 1))), -1).astype(np.int64)
        cells = np.stack([bucket_of(pair, context), q(three, pair), q(two, context), q(one, fitted_tokens)], 1)
        if not len(cells):
            return schema.empty_table()
        cells, n = np.unique(cells, axis=0, return_counts=True)
        return pa.Table.from_arrays([*[pa.array(np.ascontiguousarray(cells[:, i])) for i in range(4)], pa.array(n)], schema=schema)

    return run


def expectation_maximisation(cells: np.ndarray, types: int, rounds: int = 100) -> dict[int, tuple[float, ...]]:
    """Weights (trigram, bigram, unigram, uniform) of each bucket, from (bucket, q3, q2, q1, n) cells."""
    weights = {}
    p = np.where(cells[:, 1:4] < 0, 0.0, 2.0 ** (-np.maximum(cells[:, 1:4], 0) / STEPS))
    p = np.column_stack([p, np.full(len(p), 1 / (types + 1))])
    for bucket in np.unique(cells[:, 0]).tolist():
        mine = cells[:, 0] == bucket
        each, n = p[mine], cells[mine, 4].astype(np.float64)
        least = LEAST_WEIGHT * np.array([bucket >= LEVELS, bucket > 0, True, True])
        w = start_weights(bucket)
        for _ in range(rounds):
            part = each * w
            part /= part.sum(1, keepdims=True)
            w = np.maximum((part * n[:, None]).sum(0) / n.sum(), least)
            w /= w.sum()
        weights[bucket] = tuple(w.tolist())
    return weights


def start_weights(bucket: int) -> np.ndarray:
    """Weights before any event: nothing for the orders whose context is unknown."""
    w = np.array(START_WEIGHTS) * [bucket >= LEVELS, bucket > 0, 1, 1]
    return w / w.sum()


def weight_table(weights: dict[int, tuple[float, ...]]) -> np.ndarray:
    """One row a bucket; one without events takes the weights of the nearest lower one of its kind that has some."""
    out = np.zeros((2 * LEVELS, 4))
    for k in range(2 * LEVELS):
        if k in weights:
            out[k] = weights[k]
        else:
            out[k] = start_weights(k) if k in (0, 1, LEVELS) else out[k - 1]
    return out


def _score(buckets: int, table: np.ndarray, tokens: int, types: int, names: list[str], schema: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(docs.column("text"))
        pair, context, three, two, one = t.counts(_counts(t, answers, "total", buckets))
        w = table[bucket_of(pair, context)]
        p = w[:, 0] * three / np.maximum(pair, 1) + w[:, 1] * two / np.maximum(context, 1) + w[:, 2] * one / max(tokens, 1) + w[:, 3] / (types + 1)
        add = lambda x: np.add.reduceat(x, t.first) if len(t.first) else np.zeros(0)
        out = {c: docs.column(c) for c in names}
        out |= {"n_tokens": t.size, "n_known": add((one > 0).astype(np.int64)), "base_score": add(np.log10((one + 1) / (tokens + types + 1))), "score": add(np.log10(p))}
        return pa.Table.from_pydict(out, schema)

    return run


def score(docs: DataFrame, train: Column, keep: tuple[str, ...] = ("doc_id",), chunk_keys: int = 1_000_000, bucket_keys: int = 2_000_000, folds: int = 6) -> DataFrame:
    """Per row of ``docs``: the columns of ``keep``, n_tokens, n_known, train_tokens, train_types, base_score and score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0]
    tokens = math.ceil(size / WORD_BYTES)
    chunk, buckets = scale(tokens, chunk_keys, bucket_keys)
    limit = max(1, min(chunk * WORD_BYTES, size // (2 * folds)))  # some chunks for each fold, however small the input
    asked = rows.select("text", "train").mapInArrow(_ask(buckets, limit), ASKED)
    answers = cut(asked.groupBy("bucket").applyInArrow(_answer(buckets, folds), ANSWERED), "answers")
    types, tokens, fitted_tokens = (x or 0 for x in answers.where("chunk = -1").agg(F.sum("types"), F.sum("tokens"), F.sum("fitted_tokens")).head())
    held = F.col("chunk") % folds == 0
    events = numbered(rows.select("text", "train"), limit).where(held).groupBy("chunk").cogroup(answers.where(held & (F.col("chunk") >= 0)).select("chunk", "bucket", "fitted").groupBy("chunk"))
    cells = events.applyInArrow(_events(buckets, fitted_tokens), "level long, q3 long, q2 long, q1 long, n long").groupBy("level", "q3", "q2", "q1").agg(F.sum("n").alias("n")).toArrow()
    table = weight_table(expectation_maximisation(np.column_stack([c.to_numpy() for c in cells.columns]), types))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    run = _score(buckets, table, tokens, types, list(keep), to_arrow_schema(schema))
    scored = numbered(rows.select(*keep, "text"), limit).groupBy("chunk").cogroup(answers.where("chunk >= 0").select("chunk", "bucket", "total").groupBy("chunk")).applyInArrow(run, schema)
    scored = cut(scored, "scores")
    forget(answers)
    return scored.withColumns({"train_tokens": F.lit(tokens).cast("long"), "train_types": F.lit(types).cast("long")})


def brute_force(rows: list[tuple[str, bool]], held: list[bool]) -> list[float]:
    """Scores of (text, train) rows by plain dictionaries, for tests; ``held``: whose training documents are left out of the fitted counts."""
    from collections import Counter

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    docs = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for t, _ in rows]

    def count(which):
        n = [Counter(), Counter(), Counter()]
        for d, use in zip(docs, which, strict=True):
            if use:
                for i, w in enumerate(d):
                    h, g = (d[i - 1] if i else None), (d[i - 2] if i > 1 else None)
                    n[0][w] += 1
                    n[1][h, w] += 1
                    n[2][g, h, w] += 1
        return n

    def places(d, n):
        for i, w in enumerate(d):
            h, g = (d[i - 1] if i else None), (d[i - 2] if i > 1 else None)
            yield (n[0][None] if not i else n[1][g, h]), n[0][h], n[2][g, h, w], n[1][h, w], n[0][w]

    level = lambda c: 1 + math.floor(math.log2(c))
    bucket = lambda pair, one: LEVELS - 1 + level(pair) if pair else level(one) if one else 0
    train = [t for _, t in rows]
    fitted, total = count([t and not h for t, h in zip(train, held, strict=True)]), count(train)
    n_fitted, n_total, types = sum(fitted[0].values()), sum(total[0].values()), len(total[0])
    q = lambda n, d: int(np.round(-STEPS * math.log2(n / d))) if n else -1
    cells: Counter = Counter()
    for d, t, h in zip(docs, train, held, strict=True):
        if t and h:
            for pair, one, n3, n2, n1 in places(d, fitted):
                cells[bucket(pair, one), q(n3, pair), q(n2, one), q(n1, n_fitted)] += 1
    table = weight_table(expectation_maximisation(np.array([[*k, n] for k, n in cells.items()]).reshape(-1, 5), types))
    out = []
    for d in docs:
        s = 0.0
        for pair, one, n3, n2, n1 in places(d, total):
            w = table[bucket(pair, one)]
            s += math.log10(w[0] * n3 / max(pair, 1) + w[1] * n2 / max(one, 1) + w[2] * n1 / max(n_total, 1) + w[3] / (types + 1))
        out.append(s)
    return out
