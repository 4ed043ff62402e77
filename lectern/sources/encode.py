"""Batch vectorisation with resume: rows that aren't done yet go through an encoder, errors stay with their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lectern.operators.relational import pending
from lectern.session import ship


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def trigram_crcs(text: str) -> np.ndarray:
    """zlib.crc32 of the UTF-8 bytes of each run of three characters (of the whole text, if it is shorter), all runs at once."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    # bytes of each character, from the first on: the lead byte, then six bits each
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size] | (code >> (6 * (size - 1)).astype(np.uint32))
    n = max(1, len(code) - 2)
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(min(3, len(code))):
        state = CRC[(state ^ lead[i : i + n]) & 0xFF] ^ (state >> 8)
        wide = np.flatnonzero(size[i : i + n] > 1)
        for j in (2, 3, 4):
            if not len(wide):
                break
            byte = 0x80 | ((code[i + wide] >> (6 * (size[i + wide] - j)).astype(np.uint32)) & 0x3F)
            state[wide] = CRC[(state[wide] ^ byte) & 0xFF] ^ (state[wide] >> 8)
            wide = wide[size[i + wide] > j]
    return state ^ np.uint32(0xFFFFFFFF)


def hashed_trigrams(texts: list[str], dim: int = 64) -> list[list[float]]:
    """The default encoder: counts of hashed character trigrams at unit length. Empty text is an error."""
    out = []
    for t in texts:
        if not t:
            raise ValueError("empty text")
        v = np.bincount(trigram_crcs(t) % dim, minlength=dim).astype(np.float64)
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def encoded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is committed below ``path``, one row a key; no rows if there is nothing yet."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    rows = spark.read.schema(schema).option("pathGlobFilter", "part-*").parquet(path) if there else spark.createDataFrame([], schema)
    return rows.dropDuplicates([rows.columns[0]])


def vectorise_to(path: str, items: DataFrame, key: str = "id", text: str = "text", encoder: Callable[[list[str]], list[list[float]]] = hashed_trigrams, batch: int = 64, commit: int = 500) -> DataFrame:
    """Encode what ``path`` doesn't hold yet, committing about ``commit`` rows at a time, and return all that is there: (key, embedding, error).

    A task encodes ``commit`` rows and its file is put in place when it ends, not when the job ends (the second version of the
    committer), so a job that is killed keeps what its finished tasks made and the next call goes on with the rest. A task that was
    lost between writing and reporting may leave its rows twice; they are read once.
    """
    spark = items.sparkSession
    schema = f"{key} {dict(items.dtypes)[key]}, embedding array<float>, error string"
    todo = pending(items.select(key, text), encoded(spark, path, schema), key)
    left = todo.count()
    if left:
        dealt = todo.repartition(-(-left // commit), key)
        dealt = vectorise(dealt, None, key, text, encoder, batch)
        dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return encoded(spark, path, schema)


def vectorise(items: DataFrame, done: DataFrame | None, key: str = "id", text: str = "text", encoder: Callable[[list[str]], list[list[float]]] = hashed_trigrams, batch: int = 64) -> DataFrame:
    """(key, embedding, error) of the items not in ``done``. A failing batch is encoded again one by one."""
    ship(items.sparkSession)
    todo = items if done is None else pending(items, done, key)
    kind = dict(items.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                texts = part[text].fillna("").tolist()
                try:
                    vectors, errors = encoder(texts), [None] * len(texts)
                except Exception:  # noqa: BLE001  any encoder error is recorded with its row
                    vectors, errors = [], []
                    for t in texts:
                        try:
                            vectors.append(encoder([t])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}"[:200])
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors, "error": errors})

    return todo.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>, error string")
