"""Fill-in-middle transformation by displacement scatter, and its inverse.

A text is cut at two token ends into prefix, middle and suffix, which are put in another order behind markers. No text is
cut into Python strings: in a slice of about a megabyte of documents the cuts are scanned from the bytes, a difference array
gets the change of displacement at each cut, its cumulative sum is the displacement of every byte, and one scatter builds all
outputs of the slice. :func:`restore` finds the markers in an output and gathers the bytes back by the inverse displacements;
it sees the output and its form only.

A text's form depends on its id, its own bytes and the parameters, so a task that runs again makes the same rows. There is no
shuffle: each document is one row in and one row out, and a worker holds one slice at a time.

Defined cases: null is the empty text; an empty text, and one that holds a marker, stays plain; repeated rows, and rows of one id, are
transformed each for itself (a null id has the empty text as its decimal form); an empty table gives an empty table; bytes that aren't UTF-8
are moved like others, each one that starts no code point counts with the one before; an input column with the name of a new one is renamed
(``aside``). :func:`restore` gives null for a null output or form, for an unknown form, and for an output without exactly one marker of each kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.packed import SOLID, slices, words_of
from lectern.llm.text import aside, whole
from lectern.session import ship

PREFIX, SUFFIX, MIDDLE = "P", "S", "M"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = np.array([PLAIN, PSM, SPM], dtype=object)
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
MARK = 3  # bytes of a marker: <, its letter, >


def draws(key: Column, seed: int) -> Column:
    """Four numbers of 32 bits: the first digits of the sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def markers(buf: np.ndarray, at: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each marker, the places where it starts and the documents they are in."""
    angle = np.flatnonzero((buf[:-2] == ord("<")) & (buf[2:] == ord(">"))) if len(buf) >= MARK else np.zeros(0, np.int64)
    doc = np.searchsorted(at, angle, "right") - 1
    inside = angle + MARK <= at[doc + 1]  # not from one document into the next
    angle, doc = angle[inside], doc[inside]
    return {x: (angle[of], doc[of]) for x in (PREFIX, SUFFIX, MIDDLE) for of in [buf[angle + 1] == ord(x)]}


def displacements(size: int, start: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The shift of each of ``size`` bytes, from ascending starts of runs (empty ones too) and the shift of each run."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start, np.diff(shift, prepend=0))
    return np.cumsum(change)[:size]


def strings(data: np.ndarray, at: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A string column of bytes that are taken as they are."""
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [valid, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def cuts(buf: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each document, and the places where its prefix and its middle end.

    A token ends where a word ends; blanks after the last word are one more.
    """
    w = words_of(buf, at, SOLID, lower=False)
    words = np.diff(w.first)
    some = np.diff(at) > 0
    trailing = np.zeros(len(words), bool)
    trailing[some] = ~SOLID[buf[at[1:][some] - 1]]
    n = words + trailing
    ends = np.append(w.end, 0)  # for texts without words; never used as a cut

    def place(units: np.ndarray) -> np.ndarray:
        word_end = ends[np.clip(w.first[:-1] + units - 1, 0, len(ends) - 1)]
        return np.where(units == 0, at[:-1], np.where(units <= words, word_end, at[1:]))

    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    return n, place(np.minimum(one, two)), place(np.maximum(one, two))


def scattered(buf: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all outputs, and where each starts. ``form``: 0 plain, 1 prefix first, 2 suffix first."""
    moved = form > 0
    out_at = np.concatenate(([0], np.cumsum(np.diff(at) + 3 * MARK * moved)))
    start = np.stack((at[:-1], first, second), 1)  # of prefix, middle and suffix
    size = np.diff(np.column_stack((start, at[1:])), axis=1)
    o = out_at[:-1]
    head, tail = np.where(form == 2, size[:, 2], size[:, 0]), np.where(form == 2, size[:, 0], size[:, 2])
    a, b, c = o, o + MARK + head, o + 2 * MARK + head + tail  # where the three markers stand
    to = np.stack((np.where(form == 2, b, a), c, np.where(form == 2, a, b)), 1) + MARK
    to = np.where(moved[:, None], to, start - (at[:-1] - o)[:, None])
    shift = displacements(len(buf), start.ravel(), (to - start).ravel())
    out = np.empty(int(out_at[-1]), np.uint8)
    out[np.arange(len(buf)) + shift] = buf
    letter = {1: (PREFIX, SUFFIX, MIDDLE), 2: (SUFFIX, PREFIX, MIDDLE)}
    for kind, three in letter.items():
        for where, x in zip((a, b, c), three, strict=True):
            p = where[form == kind]
            out[p], out[p + 1], out[p + 2] = ord("<"), ord(x), ord(">")
    return out, out_at


def gathered(buf: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts behind outputs, where each starts, and which outputs can't be restored (they are empty here)."""
    n = len(form)
    place, single = {}, np.ones(n, bool)
    for x, (p, d) in markers(buf, at).items():
        single &= np.bincount(d, minlength=n) == 1
        place[x] = np.zeros(n, np.int64)
        place[x][d] = p
    p, s, m = (place[x] for x in (PREFIX, SUFFIX, MIDDLE))
    spm = form == 2
    ordered = np.where(spm, (s < p) & (p < m), (p < s) & (s < m)) & (np.where(spm, s, p) == at[:-1])
    moved = form > 0
    bad = (form < 0) | (moved & ~(single & ordered))
    a, e = at[:-1], at[1:]
    source = np.stack((p, m, s), 1) + MARK  # of prefix, middle and suffix
    end = np.stack((np.where(spm, m, s), e, np.where(spm, p, m)), 1)
    whole_text = np.stack((a, e, e), 1)
    source = np.where(moved[:, None], source, whole_text)
    size = np.where(moved[:, None], end - source, np.stack((e - a, 0 * a, 0 * a), 1))
    source, size = np.where(bad[:, None], 0, source), np.where(bad[:, None], 0, size)
    out_at = np.concatenate(([0], np.cumsum(size.sum(1))))
    start = np.concatenate(([0], np.cumsum(size.ravel())))[:-1]
    back = displacements(int(out_at[-1]), start, source.ravel() - start)
    return buf[np.arange(int(out_at[-1])) + back], out_at, bad


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``docs`` plus n (tokens), form, prefix_chars and middle_chars (code points, null if plain) and output.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of those have the suffix first.
    """
    ship(docs.sparkSession)
    drawn = "_fim_draws"
    while drawn in docs.columns:
        drawn += "_"
    asked = docs.withColumn(drawn, draws(F.col(key), seed))
    kept = [f.name for f in aside(docs, ADDED).schema]
    text_at, types = docs.columns.index(text), [f.dataType for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, h = batch.columns[:-1], batch.column(batch.num_columns - 1)
            for i, j, buf, at in slices(old[text_at]):
                mine = h.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                n, first, second = cuts(buf, at, mine)
                form = np.where(mine[:, 2] % 100 >= rate, 0, np.where(mine[:, 3] % 100 < spm_rate, 2, 1))
                form[n == 0] = 0
                for _, doc in markers(buf, at).values():
                    form[doc] = 0
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                plain = form == 0
                out, out_at = scattered(buf, at, first, second, form)
                new = [pa.array(n), pa.array(FORMS[form], pa.string()), pa.array(chars[first] - chars[at[:-1]], mask=plain), pa.array(chars[second] - chars[first], mask=plain), strings(out, out_at)]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in old], *new], names=[*kept, *ADDED])
        pa.default_memory_pool().release_unused()

    schema = [*[T.StructField(c, t) for c, t in zip(kept, types, strict=True)], T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    schema += [T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return asked.mapInArrow(run, T.StructType(schema))


def restore(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` plus the text that each output was made of, from the output and the form alone."""
    ship(rows.sparkSession)
    kept = [f.name for f in aside(rows, (name,)).schema]
    out_at_, form_at = rows.columns.index(output), rows.columns.index(form)
    code = {PLAIN: 0, PSM: 1, SPM: 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs = batch.column(out_at_)
            forms = np.array([code.get(x, -1) for x in batch.column(form_at).to_pylist()], np.int64)
            forms[outputs.is_null().to_numpy(zero_copy_only=False)] = -1
            for i, j, buf, at in slices(outputs):
                data, starts, bad = gathered(buf, at, forms[i:j])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], strings(data, starts, bad)], names=[*kept, name])
        pa.default_memory_pool().release_unused()

    schema = [T.StructField(c, f.dataType) for c, f in zip(kept, rows.schema, strict=True)]
    return rows.mapInArrow(run, T.StructType([*schema, T.StructField(name, T.StringType())]))


def brute_force(doc_id: int | None, text: str | None, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> dict:
    """The same for one text, with a regular expression and string slices; for tests."""
    import hashlib
    import re

    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:i], tokens[i:j], tokens[j:]))
    if not text or any(f"<{x}>" in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return {"n": n, "form": PLAIN, "prefix_chars": None, "middle_chars": None, "output": text}
    form = SPM if h[3] % 100 < spm_rate else PSM
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == SPM else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return {"n": n, "form": form, "prefix_chars": len(prefix), "middle_chars": len(middle), "output": output}
