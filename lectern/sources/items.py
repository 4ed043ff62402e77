"""Item files: scan, parse, part files, standards, report sinks and exports."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.items import metadata
from lectern.operators.relational import running
from lectern.session import ship

# Element and attribute names of item files.
ITEM, QUESTION, STEM, OPTION, ANSWER, EXPLANATION = "문항", "문제", "물음", "답항", "정답", "해설"
TEXT, MATH, PICTURE = "문자열", "수식", "그림"
ENCODINGS = ("euc-kr", "cp949", "utf-8")
FILES, BYTES = 256, 1 << 20  # files, and bytes of them, that a Python worker parses at once

BLOCK = "array<struct<type: string, content: string>>"
PARSED = f"source_file string, id string, attributes map<string,string>, question {BLOCK}, choices array<{BLOCK}>, answer_raw string, explanation {BLOCK}, images array<string>, parse_errors array<string>"


def files(spark: SparkSession, path: str, glob: str = "*.[iI][mM][lL]") -> DataFrame:
    """(path, modificationTime, length) of all item files below ``path``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "modificationTime", "length")


def decoded(raw: bytes) -> str:
    """UTF-8 first if the prolog names it, else the Korean encodings first; undecodable bytes are replaced."""
    utf8 = re.search(rb"encoding\s*=\s*[\"']utf-?8", raw[:200], re.I) is not None
    for name in ("utf-8", *ENCODINGS) if utf8 else ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="replace")


def _direct(node: ET.Element) -> str:
    """A node's own text, and what follows each of its children inside it."""
    return (node.text or "") + "".join(child.tail or "" for child in node)


def _blocks(node: ET.Element | None) -> list[dict]:
    """Text, formula and picture blocks in document order; a nested node is a block of its own, blank ones are none."""
    out = []
    for e in node.iter() if node is not None else ():
        if e.tag == TEXT:
            kind, content = "text", _direct(e)
        elif e.tag == MATH:
            kind, content = "latex", (e.text or "").strip()
        elif e.tag == PICTURE:
            kind, content = "image", (e.text or "").strip().replace("\\", "/")
        else:
            continue
        if content.strip():
            out.append({"type": kind, "content": content})
    return out


def _root(raw: bytes) -> ET.Element:
    return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", decoded(raw)))


def parse_item(path: str, raw: bytes) -> dict:
    """One parsed item; a malformed file is a row with parse_errors."""
    row = {"source_file": path, "id": "", "attributes": {}, "question": [], "choices": [], "answer_raw": "", "explanation": [], "images": [], "parse_errors": []}
    try:
        root = _root(raw)
    except ET.ParseError as e:
        return row | {"parse_errors": [f"malformed: {e}"[:200]]}
    item = root if root.tag == ITEM else root.find(f".//{ITEM}")
    if item is None:
        return row | {"parse_errors": ["no item element"]}
    question = item.find(QUESTION)
    stem = question.find(STEM) if question is not None else None
    row |= {"id": item.get("id", ""), "attributes": dict(item.attrib), "question": _blocks(stem), "explanation": _blocks(item.find(EXPLANATION))}
    row["choices"] = [_blocks(o) for o in (question.findall(OPTION) if question is not None else [])]
    answer = item.find(ANSWER)
    row["answer_raw"] = "".join(answer.itertext()).strip() if answer is not None else ""
    row["images"] = [b["content"] for part in (row["question"], *row["choices"], row["explanation"]) for b in part if b["type"] == "image"]
    missing = [name for name, bad in (("missing id", not row["id"]), ("missing qt", not item.get("qt")), ("missing question", question is None)) if bad]
    return row | {"parse_errors": missing}


def pieces(contents: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of at most FILES files that hold BYTES bytes together, or of one file that holds more."""
    ends = np.cumsum(pc.binary_length(contents).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, done = 0, 0
    while i < len(ends):
        j = min(i + FILES, max(i + 1, int(np.searchsorted(ends, done + BYTES, side="right"))))
        yield i, j - i
        i, done = j, int(ends[j - 1])


def raw_files(spark: SparkSession, path: str, glob: str = "*.[iI][mM][lL]", wanted: str | None = None) -> DataFrame:
    """(path, content) of all files. ``wanted``: a pattern that the first 4,000 bytes must hold; other files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    return raw if wanted is None else raw.where(F.decode(F.substring("content", 1, 4000), "ISO-8859-1").rlike(wanted))


def parsed(raw: DataFrame) -> DataFrame:
    """Parsed items of (path, content) rows, with their 17 metadata columns as one struct."""
    ship(raw.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (whole.iloc[i : i + FILES] for whole in frames for i in range(0, len(whole), FILES)):
            yield pd.DataFrame([parse_item(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=[x.split(" ")[0] for x in PARSED.split(", ") if not x.startswith("content")])

    return raw.select("path", "content").mapInPandas(run, PARSED).withColumn("metadata", metadata(F.col("attributes")))


def parse(spark: SparkSession, path: str, glob: str = "*.[iI][mM][lL]", wanted: str | None = None) -> DataFrame:
    """Parsed items of all files of ``path``; see :func:`raw_files` and :func:`parsed`."""
    return parsed(raw_files(spark, path, glob, wanted))


def edges(raw: DataFrame, per_file: int = 10, longest: int = 100) -> DataFrame:
    """(tag, parent, attribute, value) of the elements of (path, content) rows; the parent of a file's top element is ROOT.

    Each file gives its distinct (tag, parent) pairs and up to ``per_file`` distinct values of each attribute of a
    tag, in document order, longer ones cut and marked; a malformed file gives nothing.
    """
    ship(raw.sparkSession)

    def of(content: bytes) -> list[tuple]:
        try:
            todo = [(_root(content), "ROOT")]
        except ET.ParseError:
            return []
        pairs, values = {}, {}
        while todo:
            node, parent = todo.pop()
            pairs[node.tag, parent] = True
            for name, value in node.attrib.items():
                some = values.setdefault((node.tag, name), {})
                if len(some) < per_file:
                    some[value if len(value) <= longest else value[:longest] + "..."] = True
            todo.extend((child, node.tag) for child in reversed(node))
        return [(t, p, None, None) for t, p in pairs] + [(t, None, a, v) for (t, a), some in values.items() for v in some]

    schema = pa.schema([(c, pa.string()) for c in ("tag", "parent", "attribute", "value")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contents in (batch.column(0).slice(*piece) for batch in batches for piece in pieces(batch.column(0))):
            found = [x for c in contents for x in of(c.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(4)], schema=schema)

    return raw.select("content").where("content IS NOT NULL").mapInArrow(run, "tag string, parent string, attribute string, value string")


def tag_schema(found: DataFrame) -> DataFrame:
    """(tag, parents, children), sorted, of :func:`edges`. Names of elements are few, whatever the number of files."""
    pairs = found.where("parent IS NOT NULL").select("tag", "parent").distinct()
    parents = pairs.groupBy("tag").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    children = pairs.groupBy(F.col("parent").alias("tag")).agg(F.array_sort(F.collect_set("tag")).alias("children"))
    return parents.join(children, "tag", "left").select("tag", "parents", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def attribute_samples(found: DataFrame, shown: int = 20) -> DataFrame:
    """(tag, attribute, value): the first ``shown`` distinct values of each attribute of a tag, in their order."""
    values = found.where("attribute IS NOT NULL").select("tag", "attribute", "value").distinct()
    order = Window.partitionBy("tag", "attribute").orderBy("value")
    return values.withColumn("n", F.row_number().over(order)).where(F.col("n") <= shown).drop("n")


def parts(spark: SparkSession, glob: str) -> DataFrame:
    """Items of part files, each either {"items": [...]} or a bare list; in the order of the file names."""
    raw = spark.read.option("wholetext", True).text(glob).withColumn("file", F.input_file_name())
    return lists_of(raw, "file")


def lists_of(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, position, item) of JSON texts, each a list of items or an object that holds one."""
    listed = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.items"))
    return rows.select(*keep, F.posexplode(F.from_json(listed, "array<string>")).alias("position", "item"))


def standards(spark: SparkSession, path: str) -> DataFrame:
    """(code, description, domain) of a CSV file with a header, trimmed."""
    rows = spark.read.schema("code string, description string, domain string").csv(path, header=True)
    return rows.select(*[F.trim(c).alias(c) for c in rows.columns])


def write_reports(report: DataFrame, path: str) -> None:
    """The same rows as JSON, quoted CSV and Parquet below ``path``."""
    report.write.json(f"{path}/json")
    report.write.csv(f"{path}/csv", header=True, quoteAll=True)
    report.write.parquet(f"{path}/parquet")


def write_star(textbooks: DataFrame, standards: DataFrame, mappings: DataFrame, path: str) -> None:
    """The mapping result below ``path``: ``star``, three tables with keys that join, a mapping once a pair and only of known ends;
    ``csv``, the mappings with what their ends say, all values quoted; ``unmapped``, JSON of the standards without a mapping; ``meta``, JSON of the counts.

    textbooks: (textbook_id, subject, full_path, is_leaf); standards: (standard_code, description, domain);
    mappings: (textbook_id, standard_code, confidence, reasoning), of a repeated pair the most confident.
    """
    best = Window.partitionBy("textbook_id", "standard_code").orderBy(F.desc("confidence"), "reasoning")
    known = mappings.join(textbooks.select("textbook_id"), "textbook_id", "left_semi").join(standards.select("standard_code"), "standard_code", "left_semi")
    once = known.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("textbook_id", "standard_code", "confidence", "reasoning")
    for name, rows in (("textbooks", textbooks.dropDuplicates(["textbook_id"])), ("standards", standards.dropDuplicates(["standard_code"])), ("mappings", once)):
        rows.write.parquet(f"{path}/star/{name}")
    t, s, m = (textbooks.sparkSession.read.parquet(f"{path}/star/{x}") for x in ("textbooks", "standards", "mappings"))
    full = m.join(t, "textbook_id").join(s, "standard_code")
    full.select("textbook_id", "subject", "full_path", "is_leaf", "standard_code", "description", "domain", "confidence", "reasoning").write.csv(f"{path}/csv", header=True, quoteAll=True)
    unmapped = s.join(m, "standard_code", "left_anti")
    unmapped.write.json(f"{path}/unmapped")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    meta = count(t, "textbooks").unionByName(count(s, "standards")).unionByName(count(m, "mappings")).unionByName(count(unmapped, "unmapped_standards"))
    meta.coalesce(1).write.json(f"{path}/meta")  # four rows


def export_partitioned(rows: DataFrame, path: str, by: list[str], rows_per_file: int = 1_000_000) -> None:
    """One folder for each combination of ``by``. A folder's rows are brought together in files of about ``rows_per_file`` rows, each
    by a task of its own, so a large folder is many tasks and a small one a single file."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files")).alias("s")
    same = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by])
    dealt = rows.alias("r").join(sizes, same).select("r.*", F.pmod(F.xxhash64(*[F.col(f"r.{c}") for c in rows.columns]), F.col("_files")).alias("_file"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or small partitions would be brought together
    dealt.repartition(parts, *by, "_file").drop("_file").write.partitionBy(*by).parquet(path)


IDS, VECTORS = ("ids", "id", "item_ids"), ("embeddings", "embedding")


def _named(columns: dict[str, bool]) -> tuple[str | None, str]:
    """The names of the ids and of the vectors among columns (name, whether it holds lists)."""
    lists = [c for c, is_list in columns.items() if is_list]
    vector = next((c for c in VECTORS if c in lists), lists[0] if lists else None)
    if vector is None:
        raise ValueError(f"no vectors among {list(columns)}")
    return next((c for c in IDS if c in columns), None), vector


def vectors_of(rows: DataFrame, order: str | None = None) -> DataFrame:
    """(id, embedding) of rows whose columns are named in one of several ways; without ids a row's place by ``order`` is its id."""
    key, vector = _named({f.name: f.dataType.typeName() == "array" for f in rows.schema})
    if key is not None:
        return rows.select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    if order is None:
        raise ValueError("without ids, the order of the rows has to be named")
    placed = running(rows.select(order, vector), [], [order], F.lit(1))
    return placed.select((F.col("_upto") - 1).cast("long").alias("id"), F.col(vector).alias("embedding"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, embedding) of NumPy archives (.npz) below ``path``, a file a task's row: arrays are found by their names, ids as text;
    without ids a row's place in its file is its id. A file that can't be read, or whose arrays don't fit, gives one row with ``error``."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as data:
                        key, vector = _named({k: data[k].ndim == 2 for k in data.files})
                        m = data[vector].astype(np.float32)
                        ids = [str(x) for x in (data[key].tolist() if key else range(len(m)))]
                    if len(ids) != len(m):
                        raise ValueError(f"{len(ids)} ids for {len(m)} vectors")
                    error = None
                except Exception as e:  # noqa: BLE001  the file's row says what is wrong
                    m, ids, error = np.zeros((0, 0), np.float32), [], f"{type(e).__name__}: {e}"[:200]
                n = max(len(ids), 1)
                for i in range(0, n, 4096):
                    part = m[i : i + 4096]
                    lists = pa.ListArray.from_arrays((np.arange(len(part) + 1) * part.shape[1]).astype(np.int32), pa.array(part.ravel())) if error is None else pa.array([None], pa.list_(pa.float32()))
                    rows = len(lists)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * rows), pa.array(ids[i : i + 4096] if error is None else [None], pa.string()), lists, pa.array([error] * rows, pa.string())], names=["file", "id", "embedding", "error"])

    return raw.mapInArrow(run, "file string, id string, embedding array<float>, error string")


def load_vectors(vectors: DataFrame, path: str, routes: dict[int, str], fallback: str) -> None:
    """Write (id, embedding) rows into the table of their length below ``path`` (``model=`` folders), the last of rows that share an id
    being any one of them. A table that is loaded is replaced; tables without rows in this load stay as they are."""
    model = F.lit(fallback)
    for size, name in routes.items():
        model = F.when(F.size("embedding") == size, name).otherwise(model)
    rows = vectors.where(F.col("embedding").isNotNull()).withColumn("model", model).dropDuplicates(["model", "id"])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
