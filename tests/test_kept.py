"""Versioned tables, the index that follows its papers, and the bounded search against the full one."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import search
from quillgraph.operators.kept import KeptIndex
from quillgraph.sources.versions import Conflict, VersionedTable


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_merge_writes_the_touched_buckets_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int"
    made = VersionedTable.create(spark.createDataFrame([(f"k{i}", i) for i in range(50)] + [(None, -1)], schema), path, ["k"], 8, {"note": 1})
    first = made.read()
    new = made.merge(spark.createDataFrame([("k3", 33), ("new", 99)], schema), spark.createDataFrame([("k4",), (None,), ("absent",)], "k string"))
    want = sorted([(f"k{i}", 33 if i == 3 else i) for i in range(50) if i != 4] + [("new", 99)])
    assert rows_of(new.read()) == want and new.version == 1 and new.extra == {"note": 1}
    touched = set(made.buckets_of(spark.createDataFrame([("k3",), ("new",), ("k4",), (None,), ("absent",)], "k string")))
    assert {b for b in range(8) if made.files.get(b) != new.files.get(b)} <= touched and len(touched) < 8
    assert rows_of(first) == rows_of(VersionedTable(spark, path, 0).read()) and len(rows_of(first)) == 51
    with pytest.raises(Conflict):
        made.append(spark.createDataFrame([("late", 1)], schema))
    with pytest.raises(Conflict):
        VersionedTable.create(first, path, ["k"])
    more = new.append(spark.createDataFrame([("k3", 34)], schema))
    more.vacuum()
    assert more.versions() == [2] and rows_of(VersionedTable(spark, path).read()) == sorted([*want, ("k3", 34)], key=str)
    empty = VersionedTable.create(first.limit(0), str(tmp_path / "e"), ["k"])
    assert empty.read().columns == ["k", "v"] and empty.read().count() == 0 and rows_of(empty.merge(spark.createDataFrame([("a", 1)], schema)).read()) == [("a", 1)]


def passages_of(spark, papers):
    return spark.createDataFrame([(p * 100 + i, p, line.split()) for p, lines in papers.items() for i, line in enumerate(lines)], "passage_id long, paper_id long, words array<string>")


def plain_postings(papers):
    return sorted(((w, p * 100 + i, p, len(line.split()), line.split().count(w)) for p, lines in papers.items() for i, line in enumerate(lines) for w in set(line.split())), key=str)


def test_an_index_follows_its_papers(spark, tmp_path):
    papers = {1: ["cold lakes freeze", "lakes"], 2: ["cold cold rain", ""], 3: ["rain"]}
    index = KeptIndex.build(passages_of(spark, papers), str(tmp_path / "i"), 4, 2)
    assert rows_of(index.postings()) == plain_postings(papers)
    before = {b: list(f) for b, f in index.postings_table.files.items()}
    old = index.postings()
    for change in ({2: ["warm rain falls"], 4: ["new lakes"]}, {1: None, 2: ["cold again"]}, {1: ["back again"], 5: None}):
        papers = {p: lines for p, lines in (papers | change).items() if lines is not None}
        index = index.apply(spark.createDataFrame([(p,) for p in change], "paper_id long"), passages_of(spark, {p: lines for p, lines in change.items() if lines is not None}))
        assert rows_of(index.postings()) == plain_postings(papers)
        assert rows_of(index.lengths()) == sorted(((p * 100 + i, p, len(line.split())) for p, lines in papers.items() for i, line in enumerate(lines)), key=str)
        asked = spark.createDataFrame([("lakes",), ("cold",), ("nowhere",)], "word string")
        assert rows_of(index.postings(asked)) == [r for r in plain_postings(papers) if r[0] in ("lakes", "cold")]
        assert all(set(f) <= set(index.postings_table.files[b]) for b, f in before.items())  # only files more
    assert len(rows_of(old)) == 7  # a reader of the first state still has it
    assert rows_of(KeptIndex(spark, str(tmp_path / "i")).compact().postings()) == plain_postings(papers)


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_bounded_search_is_the_full_one(spark, tmp_path, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(40)]
    papers = {p: [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 12))) for _ in range(3)] for p in range(60)}
    papers[60] = ["w3 w20 w39 together", "w3 w20 w39 w39 together"]
    index = KeptIndex.build(passages_of(spark, papers), str(tmp_path / "i"), 4, 8)
    index = index.apply(spark.createDataFrame([(5,), (6,)], "paper_id long"), passages_of(spark, {5: ["w0 w1 w2 w3"]}))
    questions = {1: ["w0", "w1", "w2", "w30", "w35"], 2: ["w3", "w20", "w39"], 3: ["w7"], 4: ["nowhere"], 5: ["nowhere", "w0", "w38"], 6: ["w0", "w1"], 7: vocabulary}
    asked = spark.createDataFrame([(q, w) for q, words in questions.items() for w in words], "question int, word string")
    full = search.bounded(search.rank_many(index.postings(), index.lengths(), asked), k)
    found = search.top_many(index, asked, k)
    columns = ["question", "passage_id", "score", "partial", "place"]
    assert rows_of(found.select(columns)) == rows_of(full.select(columns)) and found.filter(F.col("question") == 4).count() == 0
