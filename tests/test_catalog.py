"""The index and the user's own layer, on small tables; distributed clusters against plain ones."""

import pytest

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import catalog, graph, listing, search, shelf
from quillgraph.sources import readers

WORKS = "work_id string, index_id string, title string, year int, venue string, type string, cited_by_count long, hydrated boolean, is_seed boolean, depth int, unresolved boolean, arrival long"


def works_of(spark, rows):
    return spark.createDataFrame([(w, x.get("index_id", w), x.get("title"), x.get("year"), None, "article", x.get("cited", 0), x.get("hydrated", False), False, x.get("depth", 1), False, n) for n, (w, x) in enumerate(rows.items())], WORKS)


def cites_of(spark, pairs):
    return spark.createDataFrame([(a, b, n + 1) for n, (a, b) in enumerate(pairs)], "from_work string, to_work string, ref_seq int")


def modularity(pairs, cluster):
    pairs = {tuple(sorted(p)) for p in pairs}
    degree = {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    m = len(pairs)
    inside = sum(cluster[a] == cluster[b] for a, b in pairs) / m
    total = {}
    for x, d in degree.items():
        total[cluster[x]] = total.get(cluster[x], 0) + d
    return inside - sum((d / (2 * m)) ** 2 for d in total.values())


def louvain(pairs: list[tuple[str, str]], resolution: float = 1.0) -> list[list[str]]:
    """Modularity clusters by one process, in id order: what the joins are measured against."""
    ids = sorted({x for p in pairs for x in p})
    number = {x: i for i, x in enumerate(ids)}
    graph: list[dict[int, float]] = [{} for _ in ids]
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        graph[number[a]][number[b]] = graph[number[b]][number[a]] = 1.0
    member = list(range(len(ids)))
    while True:
        degree = np.array([sum(w for w in g.values()) for g in graph])
        m2 = degree.sum()
        home, total, moved = list(range(len(graph))), degree.copy(), True
        while moved and m2:
            moved = False
            for i, g in enumerate(graph):
                links: dict[int, float] = {}
                for j, w in g.items():
                    if j != i:
                        links[home[j]] = links.get(home[j], 0.0) + w
                total[home[i]] -= degree[i]
                gain = lambda c, links=links, i=i: links.get(c, 0.0) - resolution * total[c] * degree[i] / m2
                best = home[i]
                for c in sorted(links):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                moved |= best != home[i]
                home[i] = best
                total[best] += degree[i]
        names = {c: k for k, c in enumerate(dict.fromkeys(home))}
        if len(names) == len(graph):
            break
        smaller: list[dict[int, float]] = [{} for _ in names]
        for i, g in enumerate(graph):
            for j, w in g.items():
                a, b = names[home[i]], names[home[j]]
                smaller[a][b] = smaller[a].get(b, 0.0) + w
        member = [names[home[x]] for x in member]
        graph = smaller
    clusters: dict[int, list[str]] = {}
    for x, c in zip(ids, member, strict=True):
        clusters.setdefault(c, []).append(x)
    return list(clusters.values())


def test_clusters_without_a_driver(spark):
    import random

    rng = random.Random(3)
    pairs = [(f"g{g}n{i}", f"g{g}n{j}") for g in range(6) for i in range(12) for j in range(i) if rng.random() < 0.6]
    pairs += [(f"g{g}n{rng.randrange(12)}", f"g{(g + 1) % 6}n{rng.randrange(12)}") for g in range(6) for _ in range(2)]
    table = spark.createDataFrame(sorted({tuple(sorted(p)) for p in pairs}), "a string, b string")
    found = {r["work_id"]: r["cluster"] for r in graph.clustered(table).collect()}
    assert found == {r["work_id"]: r["cluster"] for r in graph.clustered(table.orderBy(F.rand(1)).repartition(7)).collect()}
    plain = {x: n for n, c in enumerate(louvain(pairs)) for x in c}
    assert set(found) == set(plain) and modularity(pairs, found) >= 0.98 * modularity(pairs, plain)
    many = graph.groups(cites_of(spark, pairs))
    assert many.filter("not fringe").count() >= 60 and many.filter("place = 1").count() == many.select("anchor").distinct().count()


def test_expansion_folds_what_the_index_sends_elsewhere(spark):
    works = works_of(spark, {"S": {"hydrated": True, "depth": 0}, "A": {}, "B": {"depth": 3}, "gone": {}})
    cites = cites_of(spark, [("S", "A"), ("S", "B"), ("S", "gone")])
    index = works_of(spark, {"T": {"title": "target"}, "B": {"title": "b"}})
    refs = cites_of(spark, [("T", "X"), ("B", "A"), ("T", "A")])
    aliases = spark.createDataFrame([("A", "T")], "alias string, work_id string")
    grown, edges, counts = graph.expand(works, cites, index, refs, 3, 3, aliases=aliases)
    rows = {r["work_id"]: r for r in grown.collect()}
    assert set(rows) == {"S", "T", "B", "X", "gone"} and rows["T"]["hydrated"] and rows["T"]["depth"] == 1 and rows["gone"]["unresolved"]
    assert {(r["from_work"], r["to_work"]) for r in edges.collect()} == {("S", "T"), ("S", "B"), ("S", "gone"), ("T", "X"), ("B", "T")}
    assert (counts["tried"], counts["fetched"], counts["merged"], counts["missing"]) == (3, 2, 1, 1)


def test_bring_around(spark):
    works = works_of(spark, {"P": {"hydrated": True, "depth": 1}, "R": {"depth": 2}, "own": {"index_id": None, "hydrated": True}})
    index = works_of(spark, {"P": {"title": "p"}, "R": {"title": "r"}, "C1": {"title": "c1", "cited": 5}, "C2": {"title": "c2", "cited": 9}, "C3": {"title": "c3", "cited": 1}})
    cites, refs = cites_of(spark, [("P", "R")]), cites_of(spark, [("P", "R"), ("C1", "P"), ("C2", "P"), ("C3", "P"), ("C1", "R"), ("R", "Z")])
    gone = spark.createDataFrame([("C2",)], "work_id string")
    grown, edges, came = catalog.bring_around(works, cites, index, refs, gone, "P", citing=2)
    rows = {r["work_id"]: r for r in grown.collect()}
    assert set(rows) == {"P", "R", "own", "C1"} and rows["R"]["title"] == "r" and not rows["R"]["hydrated"]
    assert (rows["C1"]["depth"], rows["C1"]["hydrated"], rows["C1"]["title"]) == (2, False, "c1")
    assert {(r["from_work"], r["to_work"]) for r in edges.collect()} == {("P", "R"), ("C1", "P")} and [tuple(r) for r in came.collect()] == [("C1", True)]
    grown, edges, _ = catalog.bring_around(works, cites, index, refs, gone, "P", follow=True, citing=1)
    assert {r["work_id"] for r in grown.filter("hydrated").collect()} == {"P", "R", "own"} and edges.filter("from_work = 'R'").count() == 1  # C2, the most cited, stays deleted
    with pytest.raises(ValueError):
        catalog.bring_around(works, cites, index, refs, gone, "own")


def test_titles_and_identifiers(spark):
    index = works_of(spark, {"W1": {"title": "Red lakes?", "cited": 1}, "W2": {"title": "The red lakes of old", "cited": 9}, "W3": {"title": "Redder lakes"}})
    assert [r["work_id"] for r in catalog.title_candidates(index, "red, lakes*").collect()] == ["W1", "W2"]
    with pytest.raises(ValueError):
        catalog.title_candidates(index, " ,|*? ")
    asked = spark.createDataFrame([("W2",), ("openalex:W9",), ("10.1/",), ("red lakes",)], "typed string")
    assert {r["typed"]: (r["kind"], r["found"]) for r in catalog.resolved(asked, index).collect()} == {"W2": ("index", "W2"), "openalex:W9": ("index", None), "10.1/": ("bad", None), "red lakes": ("title", None)}


def test_links_and_text(spark):
    works = works_of(spark, {"L1": {"index_id": None}, "L2": {"index_id": None}, "W1": {}})
    links = spark.createDataFrame([("L1", "W1"), ("L2", "W7")], "work_id string, index_id string")
    grown, edges, _, aliases = shelf.link_local(works, cites_of(spark, [("L1", "X")]), links)
    assert {(r["work_id"], r["index_id"]) for r in grown.collect()} == {("W1", "W1"), ("L2", "W7")} and edges.first()["from_work"] == "W1" and aliases.first()["alias"] == "L1"
    with pytest.raises(ValueError):
        shelf.link_local(works, cites_of(spark, [("L1", "X")]), spark.createDataFrame([("W1", "W2")], "work_id string, index_id string"))


def test_views_notes_and_files(spark):
    views = spark.createDataFrame([], "name string, filters string")
    for bad in (("", {"seeds": True}), ("x", {}), ("x", {"title": "", "labels": []})):
        with pytest.raises(ValueError):
            shelf.put_view(views, *bad)
    views = shelf.put_view(shelf.put_view(views, "Mine", {"seeds": True}), " MINE ", {"venues": ["a"]})
    assert [r["name"] for r in views.collect()] == ["MINE"] and shelf.asked_by(views.first()["filters"]) == listing.Query(venues=("a",))
    files = spark.createDataFrame([("a/b/x.pdf",), ("a/bc/x.pdf",), ("a/b",)], "path string")
    assert [r["path"] for r in shelf.moved_files(files, "a/b/", "c$1").collect()] == ["c$1/x.pdf", "a/bc/x.pdf", "c$1"]
    tree = spark.createDataFrame([("1", None, "One"), ("2", "1", ""), ("3", "9", "Three"), ("4", "2", "Four")], "key string, parent string, name string")
    assert {(r["key"], r["name"], r["level"]) for r in shelf.mirrored(tree, tree.limit(0)).collect()} == {("1", "One", 0), ("2", "Untitled collection", 1), ("3", "Three", 0), ("4", "Four", 2)}
    assert {r["key"] for r in shelf.mirrored(tree, spark.createDataFrame([("2",)], "key string")).collect()} == {"1", "3"}


def test_inbox_and_folders(spark, tmp_path):
    for name in ("Inbox/a b.PDF", "Inbox/sub/c.pdf", "Inbox/.hidden/d.pdf", "Inbox/Thumbs.db", "Inbox/e.txt", "other/f.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    assert {r["path"] for r in readers.inbox(spark, str(tmp_path)).collect()} == {"Inbox/a b.PDF", "Inbox/sub/c.pdf"}
    files = spark.createDataFrame([("papers/Lee 2001 Things F1234567A/x.pdf",), ("papers/loose.pdf",)], "path string")
    assert [r["work_id"] for r in readers.work_folders(files).collect()] == ["F1234567A", None]


def test_holding(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "short one"), (3, "never there at all in any text")], "question int, item string")
    docs = spark.createDataFrame([("a", "xone two three four five six sevenx and"), ("b", "one two three four five six eight"), ("c", "a short one")], "paper_id string, text string")
    assert {(r["question"], r["paper_id"]) for r in search.holding(docs, items).collect()} == {(1, "a"), (2, "c")}


def test_client(tmp_path):
    from quillgraph.sources.fetch import Answer, Client

    asked, slept, now = [], [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = [Answer(503, {}, b""), Answer(429, {"retry-after": "7"}, b""), Answer(200, {}, b"body")]
    make = lambda opener, **more: Client(rate=5, cache=str(tmp_path / "c"), opener=opener, clock=lambda: now[0], sleep=sleep, jitter=lambda: 0.5, **more)
    client = make(lambda url: asked.append(url) or answers.pop(0))
    assert client.get("u").body == b"body" and len(asked) == 3 and 7.0 in slept and slept[0] >= 1.0
    assert client.get("u").body == b"body" and len(asked) == 3  # from the cache
    impatient = make(lambda url: asked.append(url) or Answer(429, {"retry-after": "90"}, b""))
    assert impatient.get("v").status == 429 and asked.count("v") == 1
    assert make(lambda url: asked.append(url) or Answer(404, {}, b"")).get("w").status == 404 and asked.count("w") == 1

    def broken(url):
        asked.append(url)
        raise OSError("gone")

    with pytest.raises(OSError):
        make(broken).get("x")
    assert asked.count("x") == 4


def test_outcomes():
    from urllib.error import URLError

    from quillgraph.sources.fetch import OUTCOMES, Answer, Loop, outcome_of

    cases = {"ok": Answer(200, {}, b"junk %PDF-1.7"), "refused": Answer(401, {}, b""), "not-found": Answer(410, {}, b""), "http-error": Answer(302, {}, b""), "not-a-pdf": Answer(200, {}, b"x" * 2000 + b"%PDF-"), "timeout": URLError(TimeoutError()), "network": OSError(), "redirect-loop": Loop(), "cancelled": KeyboardInterrupt()}
    assert {k: outcome_of(v) for k, v in cases.items()} == {k: k for k in cases} and set(cases) | {"too-large"} == set(OUTCOMES)
    assert outcome_of(cases["ok"], most=3) == "too-large"


def test_manager_exports(spark):
    raw = spark.createDataFrame([("A", "Top", "false"), ("B", "In", '"A"'), ("C", "Out", None)], "key string, name string, parentCollection string")
    assert [tuple(r) for r in readers.collections_of(raw).orderBy("key").collect()] == [("A", None, "Top"), ("B", "A", "In"), ("C", None, "Out")]
    items = spark.createDataFrame([("i1", "One", ["DOI 10.1/x", "https://doi.org/10.1234/Y"], ["f1", "f2"]), ("i2", "Two", [], [])], "about string, title string, identifiers array<string>, links array<string>")
    tree = spark.createDataFrame([("c1", "Top", ["c2", "i1"]), ("c2", "In", ["i1", "gone"])], "about string, title string, parts array<string>")
    found, made = readers.rdf_library(items, tree, spark.createDataFrame([("f1", "a.pdf", "application/pdf"), ("f2", "b.html", "text/html")], "about string, path string, type string"))
    assert {r["about"]: (r["doi"], r["collections"], r["files"]) for r in found.collect()} == {"i1": ("10.1234/y", ["c1", "c2"], ["a.pdf"]), "i2": (None, None, None)}
    assert {tuple(r) for r in made.collect()} == {("c1", None, "Top"), ("c2", "c1", "In")}


def test_command_line(spark, tmp_path):
    import io
    import json

    from quillgraph.__main__ import main

    works_of(spark, {"A": {"title": "Cold lakes", "hydrated": True}, "B": {"title": "Warm seas", "hydrated": True}, "C": {}}).write.parquet(str(tmp_path / "works.parquet"))
    cites_of(spark, [("A", "B"), ("B", "C"), ("A", "C")]).withColumn("ref_seq", __import__("pyspark").sql.functions.col("ref_seq").cast("long")).write.parquet(str(tmp_path / "cites.parquet"))
    spark.createDataFrame([("A", 1, 0, "lakes freeze in winter"), ("B", 1, 0, "the sea is warm")], "work_id string, page int, ordinal int, text string").write.parquet(str(tmp_path / "passages.parquet"))
    spark.createDataFrame([("A", "ok", 1), ("B", "ok", 1)], "work_id string, status string, pages int").write.parquet(str(tmp_path / "read_state.parquet"))

    def said(*words):
        out = io.StringIO()
        assert main(["--library", str(tmp_path), *words], spark, out) == 0
        return [json.loads(x) for x in out.getvalue().splitlines()] if words[0] != "version" else out.getvalue()

    assert said("version") == "quillgraph\n" and said("stats")[0]["works"] == 3
    assert [r["work_id"] for r in said("neighbours", "A")] == ["B", "C"] and [r["work_id"] for r in said("path", "A", "C")] == ["A", "C"]
    assert [r["paper_id"] for r in said("search", "frozen", "lake")] == ["A"] and "[[lakes]]" in said("search", "lake")[0]["snippet"]
    assert [r["work_id"] for r in said("list", "--title", "lakes")] == ["A"] and said("show", "B")[0]["cited"] == 1
    assert [r["work_id"] for r in said("expand")] == ["C"] and [r["work_id"] for r in said("match", "cold", "lakes")] == ["A"] and said("groups") == []
    assert said("export", str(tmp_path / "out")) and said("fetch")[0]["work_id"]


def test_server(spark, tmp_path):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from quillgraph.server import serve

    works_of(spark, {"A": {"title": "Cold lakes", "hydrated": True, "year": 2001}, "B": {"title": "Warm seas", "hydrated": True}}).write.parquet(str(tmp_path / "works.parquet"))
    server = serve(spark, str(tmp_path), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.load(urlopen(f"http://127.0.0.1:{server.server_port}/{path}", timeout=120))
    assert "list" in get("")["commands"] and get("stats")["rows"][0]["works"] == 2
    assert [r["work_id"] for r in get("list?year_from=2000&title=lakes")["rows"]] == ["A"] and [r["work_id"] for r in get("match?words=warm&words=seas")["rows"]] == ["B"]
    for bad in ("nothing", "list?sort=odd", "list?x=1", "export?to=/tmp/x", "show"):
        with pytest.raises(HTTPError) as e:
            get(bad)
        assert e.value.code == 400
    server.shutdown()


def pdf(compress=True, objstm=False):
    import zlib

    def stream(data, more=b""):
        packed = zlib.compress(data) if compress else data
        return b"<< " + more + (b"/Filter /FlateDecode " if compress else b"") + b"/Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)

    cmap = b"beginbfchar <0001> <0043> <0002> <00660066> endbfchar beginbfrange <0010> <0012> <0061> endbfrange"
    one = b"BT /F1 20 Tf 72 700 Td (Cold \\(deep\\)) Tj 0 -22 Td [(La) -50 (kes) -300 (freeze)] TJ ET BT /F1 10 Tf 1 0 0 1 72 600 Tm (Jos\\351 wrote) Tj 100 0 Td (this.) Tj T* ET"
    two = b"BT /F2 12 Tf 72 700 Td <0001 0010 0002> Tj ET"
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>", 5: b"<< /Type /Font /Subtype /Type1 >>", 6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>"}
    streams = {7: stream(one), 8: stream(two), 9: stream(cmap)}
    if objstm:
        parts, places, at = b"", b"", 0
        for n, body in bodies.items():
            places += b"%d %d " % (n, at)
            parts += body + b" "
            at = len(parts)
        streams[20] = stream(places + parts, b"/Type /ObjStm /N %d /First %d " % (len(bodies), len(places)))
        bodies = {}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (bodies | streams).items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("kind", [{}, {"compress": False}, {"objstm": True}])
def test_pdf_text(kind):
    from quillgraph.sources.pdf import pages_of, text_of

    pages = pages_of(pdf(**kind))
    assert [text_of(p) for p in pages] == ["Cold (deep)\nLakes freeze\nJosé wrote this.", "Caff"]
    assert [(r.size, r.top, r.left) for r in pages[0][:2]] == [(20.0, 700.0, 72.0), (20.0, 678.0, 72.0)]


def test_pdf_files(spark, tmp_path):
    from quillgraph.operators.text import front_titles
    from quillgraph.sources.pdf import front_runs, pages_of, read_pdfs

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.PDF").write_bytes(pdf())
    (tmp_path / "b.pdf").write_bytes(b"no pdf at all")
    (tmp_path / "c.pdf").write_bytes(pdf()[:300])
    read = read_pdfs(spark, str(tmp_path))
    assert {(r["path"].rsplit("/", 1)[-1], r["page"]) for r in read.collect()} >= {("a.PDF", 1), ("a.PDF", 2)}
    assert [r["title"] for r in front_titles(front_runs(read.filter("path like '%a.PDF'"))).collect()] == ["Cold (deep) Lakes freeze"]
    assert pages_of(b"") == pages_of(b"%PDF-1.4 junk") == pages_of(pdf() + b" trailer << /Encrypt 3 0 R >>") == []
