"""Changes, listings, sources, sinks and the stream; and the registered queries against their SQL."""

import json

import duckdb
import pytest

import __spark_entry__ as contract
from quillgraph.operators import listing, merge, stats, vectors
from quillgraph.queries import ORACLE_SQL, QUERIES
from quillgraph.sources import exports, readers
from quillgraph.streaming.ingest import ingest
from tests.test_graph import cites_of, works_of


def test_fold(spark):
    works = works_of(spark, {"W1": {"hydrated": True}, "W2": {"hydrated": True}, "W5": {"is_seed": True, "depth": 0}, "W6": {"depth": 2}})
    cites = cites_of(spark, [("W1", "W5"), ("W2", "W5"), ("W2", "W6"), ("W5", "W6")])
    kept, edges, _ = merge.fold(works, cites, spark.createDataFrame([("W5", "W6")], "alias string, work_id string"))
    assert {(r["work_id"], r["is_seed"], r["depth"]) for r in kept.collect()} == {("W1", False, None), ("W2", False, None), ("W6", True, 0)}
    assert {(r["from_work"], r["to_work"]) for r in edges.collect()} == {("W1", "W6"), ("W2", "W6")}


def test_mentions_refuse_unknown_edges(spark):
    cites = cites_of(spark, [("W1", "W2")])
    schema = "from_work string, to_work string, page int, start int, sentence string, confidence double"
    new = spark.createDataFrame([("W1", "W2", 2, 0, "later", 0.9), ("W1", "W2", 1, 5, "first", 0.95)], schema)
    _, edges = merge.put_mentions(new.limit(0), cites, new)
    assert tuple(edges.first()) == ("W1", "W2", "first", 0.95)
    with pytest.raises(ValueError, match="edge"):
        merge.put_mentions(new, cites, spark.createDataFrame([("W1", "W9", 1, 0, "x", 0.5)], schema))


def test_references(spark):
    works = works_of(spark, {"W1": {"hydrated": True, "depth": 1}, "W2": {"depth": 5}})
    lists = spark.createDataFrame([("W1", ["W2", "W1", "W3", "W2", None, "W4"])], "work_id string, references array<string>")
    after, cites = merge.record_references(works, cites_of(spark, [("W9", "W9")]).limit(0), lists, spark.createDataFrame([("W4",)], "work_id string"))
    assert {(r["work_id"], r["depth"]) for r in after.collect()} == {("W1", 1), ("W2", 2), ("W3", 2)}
    assert sorted(r["to_work"] for r in cites.collect()) == ["W2", "W3"]
    with pytest.raises(ValueError, match="itself"):
        merge.upsert_edges(cites, cites_of(spark, [("W1", "W1")]))


def test_orders_and_subtree(spark):
    with pytest.raises(ValueError, match="no order"):
        listing.order_of("size")
    tree = spark.createDataFrame([(1, "b", None), (2, "A", None), (3, "x", 1), (4, "y", 3)], "id int, name string, parent_id int")
    assert {r["id"] for r in listing.subtree(tree, 1).collect()} == {1, 3, 4}
    assert [r["id"] for r in listing.tree(tree).orderBy("path").collect()] == [2, 1, 3, 4]
    filed = spark.createDataFrame([(3, "W1"), (4, "W1"), (4, "W2")], "collection_id int, work_id string")
    assert {r["id"]: r["works"] for r in stats.collection_counts(tree, filed).collect()} == {1: 2, 2: 0, 3: 2, 4: 2}


def test_graphml(spark, tmp_path):
    import xml.etree.ElementTree as ET

    works = works_of(spark, {"W1": {"hydrated": True, "title": 'A <b> & "c"\x01', "cited_by_count": 3}, "W2": {"title": "stub"}, "W3": {"hydrated": True}})
    cites = cites_of(spark, [("W1", "W2"), ("W1", "W3")])
    for stubs, nodes, edges in ((False, 2, 1), (True, 3, 2)):
        lines = [r["line"] for r in exports.graphml(works, cites, stubs).orderBy("part", "id").collect()]
        root = ET.fromstring("\n".join(lines).encode())
        ns = "{http://graphml.graphdrawing.org/xmlns}"
        assert (len(root.findall(f".//{ns}node")), len(root.findall(f".//{ns}edge"))) == (nodes, edges)
    assert exports.checked_copy(works, str(tmp_path / "copy")) == 3


def test_sources(spark, tmp_path):
    record = {"id": "https://openalex.org/W5", "doi": "https://doi.org/10.48550/arXiv.2101.00001", "title": "T", "publication_year": 2021, "abstract_inverted_index": {"b": [1], "a": [0]}, "referenced_works": ["https://openalex.org/W7", "bad"], "authorships": [{"author": {"id": "https://openalex.org/A1", "display_name": "Ann"}}]}
    path = tmp_path / "answer.json"
    path.write_text(json.dumps({"results": [record]}))
    records = readers.read_works(spark, str(path))
    row = readers.works_of(records).first()
    assert (row["index_id"], row["arxiv_id"], row["abstract"], row["references"]) == ("W5", "2101.00001", "a b", ["W7"])
    assert readers.authorship_of(records).first()["author_id"] == "A1"
    items = spark.createDataFrame([("k1", None, "book", "B", False, [("x", 0), ("auto", 1)], None), ("k2", "k1", "attachment", None, False, [], "b.pdf"), ("k3", None, "book", "gone", True, [], None)], "key string, parent string, type string, title string, deleted boolean, tags array<struct<tag:string,type:int>>, path string")
    assert [tuple(r) for r in readers.items_of(items).select("key", "tags", "files").collect()] == [("k1", ["x"], ["b.pdf"])]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF")
    assert readers.read_folder(spark, str(tmp_path)).first()["size"] == 4


def test_stream(spark, tmp_path):
    works = works_of(spark, {"W1": {"depth": 0, "is_seed": True}})
    works.write.parquet(str(tmp_path / "lib/works-0"))
    cites_of(spark, [("X", "Y")]).limit(0).write.parquet(str(tmp_path / "lib/cites-0"))
    new = works_of(spark, {"W1": {"title": "now", "depth": 0}}).selectExpr("*", "array('W2', 'W3') AS references")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "lib"), spark.createDataFrame([("W3",)], "work_id string")).awaitTermination(60)
    after = spark.read.parquet(str(tmp_path / "lib/works-1"))
    assert {(r["work_id"], r["hydrated"], r["depth"]) for r in after.collect()} == {("W1", True, 0), ("W2", False, 1)}


def test_nearest(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, embedding array<float>")
    found = vectors.nearest(rows.filter("id = 3"), rows, 2).orderBy("place").collect()
    assert [r["id"] for r in found] == [2, 4]


CHOSEN = ["gr3_frontier", "gr1_cited", "gr2_levels", "gr14_surroundings", "agg1_summary", "agg4_facets", "agg13_collections", "api1_list", "flt7_labels", "flt12_title", "srt1_title", "win2_chosen_pdf", "fts4_bm25", "fts8_fusion", "fts14_evaluation", "txt2_quality", "dml5_fold", "dml20_scan", "snk4_whole_graph", "exp1_nearest", "rec3_tree", "jn12_resolve"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = QUERIES[name](spark, data), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    value = lambda x: round(float(x), 5) if isinstance(x, float) else x
    flat = lambda rows: sorted(tuple(str(value(v)) for v in r) for r in rows)
    assert flat(got.select(*columns).collect()) == flat(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
