"""Texts are read a few at a time, whatever an Arrow batch holds."""

import pyarrow as pa

from quillgraph.operators import text


def test_batches_are_read_in_pieces():
    rows = [{"work_id": f"D{i}", "pages": ["x" * 1_000_000, None]} for i in range(40)] + [{"work_id": "E", "pages": []}, {"work_id": None, "pages": ["y" * 9_000_000]}]
    runs = list(text.pieces(iter([pa.RecordBatch.from_pylist(rows[:40]), pa.RecordBatch.from_pylist(rows[40:]), pa.RecordBatch.from_pylist(rows[:0], pa.schema([("work_id", pa.string())]))])))
    assert [r for run in runs for r in run] == rows
    assert max(sum(len(p or "") for r in run for p in r["pages"]) for run in runs[:-1]) <= text.PIECE


def test_reading_keeps_nulls_and_empty_texts(spark):
    works = spark.createDataFrame([("A", [None, "a  b"]), ("B", []), ("C", None)], "work_id string, pages array<string>").filter("pages is not null")
    assert {r["work_id"]: r["pages"] for r in text.cleaned(works).collect()} == {"A": ["", "a b"], "B": []}
    assert {(r["work_id"], r["pages"], r["chars"], r["status"], len(r["passages"])) for r in text.read(works).collect()} == {("A", 2, 3, "no-text", 0), ("B", 0, 0, "no-text", 0)}


def test_judging_and_cutting_look_at_little(monkeypatch):
    from quillgraph.functions import pagetext

    kinds, starts = [], []
    kind = pagetext._kind
    monkeypatch.setattr(pagetext, "_kind", lambda c: kinds.append(c) or kind(c))
    pagetext._good.cache_clear()
    assert pagetext.judged("x-ray's zzz 12 (state) a,b " * 40) == "ok"
    assert len(kinds) <= 40  # distinct characters alone; before, the characters of each distinct token too
    assert [pagetext._good(t) for t in ("zzz", "12", "(state)", "a,b", "x-ray's", "é1", "--", "a,,,,b", "")] == [False, None, True, False, True, False, None, False, None]
    text = " ".join(f"w{i}{'.' if i % 240 == 0 else ''} X" for i in range(700))
    want = [len(p.text.split()) for p in pagetext.passages([text])]
    assert want == [400, 81, 400, 80, 439]  # the last holds a rest of fewer than 60 words
