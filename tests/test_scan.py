"""Scans of a library folder: each case on tables small enough to read."""

import glob
import os

from quillgraph.operators.graph import shared_folder
from quillgraph.operators.scan import _pairs, numbered, scan

KNOWN = [("F1", "w1"), ("F2", "w2"), ("F3", "w3")]


def scanned(spark, folders, files, disk, extra_folders=()):
    """disk is {path: content}; folders on disk are those of its files and `extra_folders`."""
    there = {p[:i] for p in disk for i in range(len(p)) if p[i] == "/"} | set(extra_folders)
    out = scan(
        spark.createDataFrame(folders, "path string, work_id string"),
        spark.createDataFrame([(p, w, c, len(c) if c else None) for p, w, c in files], "path string, work_id string, sha256 string, size int"),
        spark.createDataFrame(KNOWN, "ref string, work_id string"),
        spark.createDataFrame([(p,) for p in there], "path string"),
        spark.createDataFrame([(p, c, len(c) if c else None) for p, c in disk.items()], "path string, sha256 string, size int"),
    )
    return tuple(sorted((tuple(r) for r in t.collect()), key=str) for t in out)


def test_numbers_are_gapless_within_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, f"x{i}") for i in range(500)], "g int, v string")
    out = numbered(rows, ["g"], "v").collect()
    for g in range(3):
        assert sorted(r["k"] for r in out if r["g"] == g) == list(range(1, sum(i % 3 == g and i % 7 > 0 for i in range(500)) + 1))
    assert not any(r["g"] is None for r in out)


def test_a_moved_folder_takes_its_files_along(spark):
    folders, files = scanned(spark, [("papers/a--F1", "w1")], [("papers/a--F1/x.pdf", "w1", "c1"), ("papers/a--F1/sub/y.pdf", "w1", "c2"), ("papers/a--F1/z.pdf", "w1", "c3")], {"papers/ch/a--f1/x.pdf": "c1", "papers/ch/a--f1/sub/y.pdf": "edited", "papers/ch/a--f1/new.txt": "c9"})
    assert folders == [("papers/ch/a--f1", "w1", "moved", "papers/a--F1")]
    assert files == [("papers/ch/a--f1/new.txt", "w1", "new", None), ("papers/ch/a--f1/sub/y.pdf", "w1", "changed", "papers/a--F1/sub/y.pdf"), ("papers/ch/a--f1/x.pdf", "w1", "same", "papers/a--F1/x.pdf"), ("papers/ch/a--f1/z.pdf", "w1", "missing", "papers/a--F1/z.pdf")]


def test_a_folder_without_its_id_is_found_by_its_files(spark):
    recorded = [("papers/a--F1/x.pdf", "w1", "c1"), ("papers/a--F1/y.txt", "w1", "c2"), ("papers/a--F1/z.pdf", "w1", "c3")]
    disk = {"papers/mine/x.pdf": "C1", "papers/mine/other name.txt": "c2"}  # one file was not found at all
    folders, files = scanned(spark, [("papers/a--F1", "w1")], recorded, disk)
    assert folders == [("papers/mine", "w1", "renamed", "papers/a--F1")]
    assert files == [("papers/mine/other name.txt", "w1", "moved", "papers/a--F1/y.txt"), ("papers/mine/x.pdf", "w1", "moved", "papers/a--F1/x.pdf"), ("papers/mine/z.pdf", "w1", "missing", "papers/a--F1/z.pdf")]
    # Recorded there, it stays there; the second scan changes nothing.
    folders, files = scanned(spark, [("papers/mine", "w1")], [("papers/mine/x.pdf", "w1", "c1")], {"papers/mine/x.pdf": "c1"})
    assert folders == [("papers/mine", "w1", "same", None)] and files == [("papers/mine/x.pdf", "w1", "same", None)]


def test_spread_files_are_followed_one_by_one(spark):
    recorded = [("papers/a--F1/x.pdf", "w1", "c1"), ("papers/a--F1/y.pdf", "w1", "c2")]
    folders, files = scanned(spark, [("papers/a--F1", "w1")], recorded, {"papers/p/x.pdf": "c1", "papers/q/y.pdf": "c2", "papers/q/l.PDF": "c7", "papers/q/l.txt": "c8"})
    assert folders == [("papers/a--F1", "w1", "missing", None)]
    assert files == [("papers/p/x.pdf", "w1", "moved", "papers/a--F1/x.pdf"), ("papers/q/l.PDF", None, "loose", None), ("papers/q/y.pdf", "w1", "moved", "papers/a--F1/y.pdf")]
    # At the top no folder can be a work's.
    folders, files = scanned(spark, [("papers/a--F1", "w1")], recorded[:1], {"papers/x.pdf": "c1"})
    assert folders == [("papers/a--F1", "w1", "missing", None)] and files == [("papers/x.pdf", "w1", "moved", "papers/a--F1/x.pdf")]


def test_swaps_and_second_folders(spark):
    recorded = [("papers/1/a--F1/x.pdf", "w1", "c"), ("papers/2/b--F2/x.pdf", "w2", "c")]  # equal contents
    folders, files = scanned(spark, [("papers/1/a--F1", "w1"), ("papers/2/b--F2", "w2")], recorded, {"papers/2/a--F1/x.pdf": "c", "papers/1/b--F2/x.pdf": "c", "papers/3/copy--F2/x.pdf": "c"})
    assert {f[2] for f in folders if f[1] == "w1"} == {"moved"} and sorted(f[2] for f in folders if f[1] == "w2") == ["moved", "second"]
    assert {(f[0], f[1]) for f in files} == {("papers/2/a--F1/x.pdf", "w1"), ("papers/1/b--F2/x.pdf", "w2"), ("papers/3/copy--F2/x.pdf", "w2")}


def test_two_gone_folders_of_equal_files(spark):
    recorded = [(f"papers/{n}--{i}/{f}.pdf", w, f) for n, i, w in (("a", "F1", "w1"), ("b", "F2", "w2")) for f in ("c1", "c22")]
    folders, files = scanned(spark, [("papers/a--F1", "w1"), ("papers/b--F2", "w2")], recorded, {"papers/p/1.pdf": "c1", "papers/p/2.pdf": "c22", "papers/q/1.pdf": "c1", "papers/q/2.pdf": "c22"})
    assert {f[2] for f in folders} == {"renamed"} and {f[0] for f in folders} == {"papers/p", "papers/q"}
    assert {f[2] for f in files} == {"moved"} and len(files) == 4
    of = {f[1]: f[0] for f in folders}
    assert all(f[0].startswith(of[f[1]] + "/") for f in files)
    # Where there is one place only, the first by path gets it.
    folders, files = scanned(spark, [("papers/a--F1", "w1"), ("papers/b--F2", "w2")], recorded, {"papers/p/1.pdf": "c1", "papers/p/2.pdf": "c22"})
    assert sorted(f[2] for f in folders) == ["missing", "renamed"] and sorted(f[2] for f in files) == ["missing", "missing", "moved", "moved"]


def test_unknown_hidden_and_nested_folders(spark):
    disk = {"papers/else--F9/p.pdf": "c1", "papers/.trash/x.pdf": "c2", "papers/a--F1/.part": "c3", "papers/a--F1/b--F2/x.pdf": "c4", "papers/Chapter 3/d.pdf": "c5"}
    folders, files = scanned(spark, [], [], disk)
    assert folders == [("papers/a--F1", "w1", "second", None), ("papers/else--F9", None, "unknown", None)]
    assert files == [("papers/Chapter 3/d.pdf", None, "loose", None), ("papers/a--F1/b--F2/x.pdf", "w1", "new", None)]


def test_nulls_repeats_and_nothing(spark):
    folders, files = scanned(spark, [(None, "w1"), ("papers/p", None), ("papers/p", None)], [(None, "w1", "c"), ("papers/p/x.pdf", None, None), ("papers/p/x.pdf", None, None)], {"papers/q/x.pdf": None})
    assert folders == [("papers/p", None, "missing", None)]
    assert files == [("papers/p/x.pdf", None, "missing", None), ("papers/q/x.pdf", None, "loose", None)]
    assert scanned(spark, [], [], {}) == ([], [])
    assert scanned(spark, [("papers/a--F1", "w1")], [("papers/a--F1/x.pdf", "w1", "c")], {}) == ([("papers/a--F1", "w1", "missing", None)], [("papers/a--F1/x.pdf", "w1", "missing", None)])


def _written(spark):
    return sum(os.path.getsize(f) for f in glob.glob(f"{shared_folder(spark).removeprefix('file:')}/cut/**/*.parquet", recursive=True))


def test_a_scan_writes_little_more_than_what_it_read(spark, tmp_path):
    rows = spark.range(20000).selectExpr("concat('papers/', id % 7, '/', id % 50, '--S', id % 50) as old", "id", "sha2(string(id), 256) as sha256", "id as size", "id % 50 as s")
    files = rows.selectExpr("concat(old, '/part ', id, '.pdf') as path", "concat('S', s) as work_id", "sha256", "size")
    disk = rows.selectExpr("concat(if(s % 2 = 0, old, concat('papers/moved/', s)), '/part ', id, '.pdf') as path", "sha256", "size")
    files.write.parquet(f"{tmp_path}/files")
    disk.write.parquet(f"{tmp_path}/disk")
    read = sum(f.stat().st_size for t in ("files", "disk") for f in (tmp_path / t).glob("*.parquet"))
    files, disk = spark.read.parquet(f"{tmp_path}/files"), spark.read.parquet(f"{tmp_path}/disk")
    folder = lambda t: t.selectExpr("regexp_replace(path, '/[^/]*$', '') as path").distinct()
    folders = rows.selectExpr("old as path", "concat('S', s) as work_id").distinct()
    before = _written(spark)
    found = scan(folders, files, folders.selectExpr("work_id as ref", "work_id").distinct(), folder(disk), disk)[1].collect()
    states = {k: sum(r["state"] == k for r in found) for k in ("same", "moved", "missing", "loose")}
    assert states == {"same": 10000, "moved": 10000, "missing": 0, "loose": 0}
    assert _written(spark) - before < read


def test_contents_of_many_rows_pair_one_to_one(spark, monkeypatch):
    monkeypatch.setattr("quillgraph.operators.scan.MANY", 5)
    lost = spark.range(100).selectExpr("concat('l', id) as path", "encode(if(id < 90, 'a', string(id)), 'UTF-8') as sha256", "1L as size")
    found = spark.range(100).selectExpr("concat('f', id) as path", "encode(if(id < 50, 'a', string(id)), 'UTF-8') as sha256", "1L as size")
    pairs = _pairs(lost, found).collect()
    assert len(pairs) == 60 == len({r["path"] for r in pairs}) == len({r["to"] for r in pairs})
