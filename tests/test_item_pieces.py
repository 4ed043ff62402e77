"""Item files are parsed in small pieces, whatever a batch holds."""

import pyarrow as pa

from lectern.sources import items


def taken(monkeypatch, method):
    """The function that a job gives to ``method``, to be run here."""
    held = {}

    class Rows:
        sparkSession = None
        select = where = lambda self, *_: self

        def withColumn(self, *_):  # noqa: N802
            return self

    setattr(Rows, method, lambda self, run, _: held.setdefault("run", run) and self)
    monkeypatch.setattr(items, "ship", lambda _: None)
    monkeypatch.setattr(items, "metadata", lambda _: None)
    return Rows(), held


def test_attributes_of_a_large_batch_come_in_pieces(monkeypatch):
    docs = [f'<문항 id="D{i}" kw="{"x" * (i % 7) * 400}"/>'.encode() for i in range(3_000)] + [b"<broken"]
    rows, held = taken(monkeypatch, "mapInArrow")
    items.edges(rows)
    got = list(held["run"](iter([pa.RecordBatch.from_arrays([pa.array(docs, pa.binary())], names=["content"])])))
    assert max(b.num_rows for b in got) <= 3 * items.FILES and len(got) > 5
    assert sorted(x for b in got for x in b.column(3).to_pylist() if x and x.startswith("D")) == sorted(f"D{i}" for i in range(3_000))


def test_pieces_hold_all_rows(monkeypatch):
    monkeypatch.setattr(items, "BYTES", 10)
    contents = pa.array([b"x" * n for n in (3, 3, 3, 50, 0, 0, 9, 2)] + [None], pa.binary())
    assert list(items.pieces(contents)) == [(0, 3), (3, 1), (4, 3), (7, 2)]


def test_parsed_rows_come_in_pieces(monkeypatch):
    import pandas as pd

    rows, held = taken(monkeypatch, "mapInPandas")
    monkeypatch.setattr(items.F, "col", lambda _: None)
    items.parsed(rows)
    frame = pd.DataFrame({"path": [str(i) for i in range(1_000)], "content": [b"<broken"] * 1_000})
    got = list(held["run"](iter([frame])))
    assert max(map(len, got)) <= items.FILES and [p for g in got for p in g["source_file"]] == [str(i) for i in range(1_000)]
