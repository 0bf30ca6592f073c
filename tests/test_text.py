"""Identifiers, pages, passages, citation contexts and search terms by hand-written cases."""

import pytest

from quillgraph.functions import identity, pagetext
from quillgraph.functions.contexts import Ref, contexts
from quillgraph.functions.porter import stem
from quillgraph.functions.textnorm import similarity, title_key, tokens
from quillgraph.operators import search


@pytest.mark.parametrize(
    ("typed", "kind", "value"),
    [
        ("W2741809807", "index", "W2741809807"),
        ("https://openalex.org/works/w12?x#y", "index", "W12"),
        ("https://doi.org/10.7717/PeerJ.4375", "doi", "10.7717/peerj.4375"),
        ("doi: 10.1000/a(b)c).", "doi", "10.1000/a(b)c"),
        ("2101.00001v2", "arxiv", "2101.00001"),
        ("https://arxiv.org/pdf/hep-th/9901001v1.pdf", "arxiv", "hep-th/9901001"),
        ("https://www.biorxiv.org/content/10.1101/2020.01.01v2.full.pdf", "doi", "10.1101/2020.01.01"),
        ("https://pubmed.ncbi.nlm.nih.gov/12345/", "pmid", "12345"),
        ("29456894", "pmid", "29456894"),
        ("The state of things", "title", "The state of things"),
    ],
)
def test_parse(typed, kind, value):
    assert identity.parse(typed) == (kind, value)


@pytest.mark.parametrize("typed", ["", "W0", "https://doi.org/xyz", "doi:10.1", "10.12/x y".replace(" ", "")[:5] + "/"])
def test_malformed_is_no_title(typed):
    with pytest.raises(identity.BadIdentity):
        identity.parse(typed)


def test_ranges():
    assert identity.expand_ranges("1, 3–5") == [1, 3, 4, 5]
    assert identity.expand_ranges("5-3") == identity.expand_ranges("1-99") == identity.expand_ranges("x") == []


@pytest.mark.parametrize(
    ("raw", "out"),
    [("a\r\nb", "a\nb"), ("a   b", "a b"), ("ex\x02ample", "example"), ("1 \x02 2", "1 2"), ("co­op", "co-op"), ("1992-\n2003", "1992-2003"), ("well-\nknown", "well-\nknown"), ("ﬁne", "fine"), ("a\x07b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("é", "é")],
)
def test_clean(raw, out):
    assert pagetext.clean(raw) == out


def test_quality(spark):
    word = "The reading of long and plain sentences tells a person what a text may hold. "
    cases = {word * 5: "ok", "Der Satz ist lang genug und hat Wörter, die man lesen kann. " * 5: "ok", "": "no-text", "short": "no-text", "#%&$ 12 34 ** " * 40: "gibberish", "tbc rcsnlts wrtn hr shwd tht nn " * 20: "gibberish", "��a " * 80: "gibberish", "研究結果表明這個方法是有效的" * 20: "ok"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    got = rows.select("want", pagetext.quality(rows.t).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_passages():
    sentence = "One two three four five six seven eight nine ten. "
    pages = [sentence * 54, "Short page here.", "Discussion goes on. " * 20 + "\nReferences\n" + "[1] Someone. A title. 2001.\n" * 30, "[2] More. 2002.\nAppendix A\n" + sentence * 10]
    found = pagetext.passages(pages)
    for p in found:
        raw = pages[p.page - 1].encode()[p.start : p.end]
        assert raw.decode() == p.text and len(p.text.split()) <= 400 + 60
    assert [p.ordinal for p in found] == list(range(len(found)))
    assert {(p.page, p.section) for p in found} == {(1, None), (2, None), (3, None), (3, "references"), (4, "references"), (4, None)}
    run_on = pagetext.passages(["word " * 1000])
    assert [len(p.text.split()) for p in run_on] == [400, 400, 200]
    assert pagetext.passages([]) == [] == pagetext.passages(["", "  "])


def test_clues():
    page = "arXiv:2101.00001v2 [cs.CL] 3 Jan 2021\nTitle\ndoi: 10.1234/own;\n" + "x\n" * 20 + "see 10.9999/cited)\nend\n\n\n\n\n\n"
    found = pagetext.clues("10.5555_name.pdf", [page], ("https://doi.org/10.4444/meta",))
    assert found[0] == ("arxiv", "2101.00001") and found[1] == ("doi", "10.1234/own")
    assert ("doi", "10.4444/meta") in found and ("doi", "10.5555/name") in found and found[-1] == ("doi", "10.9999/cited")
    assert pagetext.clues("x.pdf", [""]) == []
    assert pagetext.dois("10.1000/ab-\ncd")[0][0] == "10.1000/ab-cd"


def test_mentions_and_resembles():
    page = "The Évolution of Plain Things\nby Ann Lee\n\nAbstract"
    assert pagetext.mentions_title([page], "The evolution of plain things", "Lee")
    assert not pagetext.mentions_title([page], "The evolution of plain things", "Leed")
    assert pagetext.resembles(page, "Evolution of very plain things", "Lee")
    assert not pagetext.resembles(page, "Something else entirely here", "Lee")


REFS = [Ref("a", "Deep studies of shallow lakes", 2001, None, "Smith", 2), Ref("b", "On rivers and their banks", 2002, "10.1000/rb", "Jones", 1), Ref("c", "Mountains seen from below", 2003, None, "Lopez", 3), Ref("d", "Clouds above the northern sea", 2004, None, "Stone", 1), Ref("e", "Winds that never stop blowing", 2005, None, "Weber", 2), Ref("f", "Rain on dry land", 2005, None, "Weber", 1)]
LIST = "References\n[1] A. Smith. Deep studies of shallow lakes. 2001.\n[2] B. Jones, doi:10.1000/rb.\n[3] C. Lopez. Mountains seen from below. 2003.\n[4] D. Stone. Clouds above the northern sea. 2004.\n[5] E. Weber. Winds that never stop blowing. 2005."


def test_numbered_contexts():
    page = "1. Introduction\nLakes are shallow [1]. Others disagree, e.g. Fig. 2 shows so [2, 3–5]. Nothing here [9].\n" + LIST
    found = contexts([page], REFS)
    assert [(m.ref, m.confidence) for m in found if m.method == "bracket"] == [("a", 0.9), ("b", 0.95), ("c", 0.9), ("d", 0.9), ("e", 0.9)]
    assert found[0].sentence == "Lakes are shallow [1]." and found[1].sentence.startswith("Others disagree, e.g. Fig. 2")
    assert {m.section for m in found} == {"introduction"}
    assert page.encode()[found[0].start : found[0].end].decode() == found[0].sentence


def test_author_year_contexts():
    page = "Lakes are deep (Smith and Brown, 2001). In 2002 Jones wrote much. As Lopez (2003) claims alone. Lopez et al. (2003) differ. Weber (2005) is unclear."
    assert [(m.ref, m.method) for m in contexts([page], REFS)] == [("a", "author-year"), ("c", "author-year")]
    assert contexts(["nothing at all"], REFS) == [] == contexts([], REFS)


def test_titles(spark):
    rows = spark.createDataFrame([("The STATE of things!", "the state of things"), ("", "x"), ("one thing", "quite another matter")], "a string, b string")
    got = rows.select(title_key(rows.a).alias("k"), similarity(rows.a, rows.b).alias("s")).collect()
    assert got[0]["k"] == "thestateofthings" and got[0]["s"] == 1.0 and got[1]["s"] == 0.0 and got[2]["s"] < 0.5
    assert tokens("The Évolution of ox-carts") == ["evolution", "carts"]


def test_abstract(spark):
    index = spark.createDataFrame([({"of": [1], "state": [0, 3], "the": [2]},)], "i map<string,array<int>>")
    assert index.select(identity.abstract_of(index.i)).first()[0] == "state of the state"


@pytest.mark.parametrize(("word", "out"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("electriciti", "electr"), ("adoption", "adopt"), ("controll", "control"), ("citing", "cite"), ("cited", "cite"), ("by", "by")])
def test_porter(word, out):
    assert stem(word) == out


def test_query_terms():
    terms = search.parse('how does "open access" spread* - & \x00')
    assert [(t.words, t.prefix) for t in terms] == [(("how",), False), (("does",), False), (("open", "access"), False), (("spread",), True)]
    assert [t.words[0] for t in search.subject(terms)] == ["open", "spread"]
    assert [t.words for t in search.subject(search.parse("how does the"))] == [("how",), ("does",), ("the",)]
    with pytest.raises(search.EmptyQuery):
        search.parse(" - & ")


def test_search(spark):
    rows = spark.createDataFrame([(1, 1, "open access is free"), (2, 1, "access to open things"), (3, 2, "closed doors"), (4, 3, "open access opens accessible access")], "passage_id long, paper_id long, text string")
    rows = rows.withColumn("words", search.stems("text")).cache()
    index, corpus = search.postings(rows), search.corpus(rows)
    phrase = search.bm25(search.matching(index, [search.Term(("open", "access"))]), corpus)
    assert {r["passage_id"] for r in phrase.collect()} == {1, 4}
    both = [search.Term(("open",)), search.Term(("door",))]
    scored = search.bm25(search.matching(index, both), corpus)
    partial = search.all_or_any(scored, 2)
    assert partial.count() == 4 and partial.first()["partial"]
    every = search.all_or_any(search.bm25(search.matching(index, [search.Term(("open",)), search.Term(("acc",), True)]), corpus), 2)
    assert {r["passage_id"] for r in every.collect()} == {1, 2, 4} and not every.first()["partial"]
    ranks = search.fused(search.papers(every, rows), search.papers(every, rows))
    assert search.selected(every, rows, ranks, 2, 1).count() == 2
    assert "[[open]]" in search.snippet("all open [[doors]]", {"open"}) and "\\[[doors" in search.snippet("all open [[doors]]", {"open"})


def test_an_affiliation_mark_hides_no_name():
    page = "Plain Things in Cold Water\nAnna Berg1, Li Wu2 and Jo Marsh-Hill*b"
    assert all(pagetext.mentions_title([page], "Plain things in cold water", name) for name in ("Berg", "Wu", "Marsh-Hill"))
    assert not pagetext.mentions_title([page], "Plain things in cold water", "Marsh-Hall") and not pagetext.mentions_title([page], "Plain", "Berg")
    assert pagetext.resembles("Plain things in very cold water\n", "Plain things in cold waters", "Berg", further=("by Berg1",))
    assert pagetext.identity_matches([page, "more"], "Plain things in cold water", "Berg") and not pagetext.identity_matches(["x", "y", page], "Plain things in cold water", "Berg")


def test_entries_read_across_columns_are_dropped():
    from quillgraph.functions.contexts import _entries

    listed = _entries("1. A. One. 2001.\n2. B. Two. 2002.\n3. 6. C. Three. 2003.\n4. D. Four. 2004.\n5. E. Five. 2005.\n")
    assert sorted(listed) == [1, 2, 4, 5]


def test_parentheses_count_only_without_brackets():
    equation = "A lake is deep [9], see equation (2) for it.\n" + LIST
    assert contexts([equation], REFS) == []
    rounds = "A lake is deep (2). So y = (3) holds, and others (1, 4-5) agree.\n" + LIST.replace("[", "").replace("]", ".")
    assert [(m.ref, m.confidence, m.method) for m in contexts([rounds], REFS)] == [("b", 0.6, "parenthesis"), ("a", 0.6, "parenthesis"), ("d", 0.6, "parenthesis"), ("e", 0.6, "parenthesis")]


def test_who_is_cited():
    refs = [Ref("a", "Lakes", 2001, None, "Smith", 2), Ref("b", "Rivers", 2001, None, "Van Dam", 1), Ref("c", "Hills", 1999, None, "Óre-Li", 3), Ref("d", "Seas", 2004, None, "X", 1)]
    found = lambda text: [m.ref for m in contexts([text], refs)]
    assert found("Lakes freeze (Smith & Vandam 2001). So do seas (Vandam & Van Dam 2001).") == ["a"] and found("As Van Dam (2001b) says.") == ["b"]
    assert found("So say Óre-Li et al., 1999; others don't.") == ["c"] and found("So says Óre-Li (1999).") == []
    assert found("In 2001 Smith wrote. Smith 2001 wrote. Smithson (2001) too, X (2004).") == [] and found("It is known (see for this Smith 2001 and more).") == ["a"]
    assert found("Smith (2001, p. 23) put it so. Then more.") == ["a"]


def test_a_numbered_marker_comes_before_a_name():
    from quillgraph.functions.contexts import Ref, contexts

    listed = [f"[{n}] Bell, A. Words that make title {w} of a paper, 200{n}." for n, w in enumerate(("one", "two", "three", "four", "five", "six"), 1)]
    page = "As Bell et al. (2002) showed before [2]. Nothing else stands here.\n\nReferences\n" + "\n".join(listed)
    refs = [Ref(f"R{n}", f"Words that make title {w} of a paper", 2000 + n, None, "Bell", 3) for n, w in enumerate(("one", "two", "three", "four", "five", "six"), 1)]
    (found,) = contexts([page], refs)
    assert (found.ref, found.marker, found.method) == ("R2", "[2]", "bracket") and found.confidence > 0.85


def test_titles_in_any_script():
    from quillgraph.functions.pagetext import mentions_title

    page = "PLoS Medicine | Essay\nWhy Most Published Research\nFi ndings Are False\nJohn P. A. Ioannidis\nSummary. There is increasing concern that most current published research findings are false."
    title = "Why Most Published Research Findings Are False"
    for asked, surname, want in [(title, "Ioannidis", True), (title, "", True), (title, None, True), (title, "Piwowar", False), (title, "Ma", False), (title + ": an essay on bias", "Ioannidis", True), (title + ": a reply", "", False), ("Why", "Ioannidis", False)]:
        assert mentions_title([page], asked, surname) is want, (asked, surname)
    assert mentions_title(["新型材料研究\n王伟 李明"], "新型材料研究", "王伟") and not mentions_title(["新型材料研究\n王伟"], "新型材料研究", "李明") and not mentions_title(["新型"], "新型", None)
    assert mentions_title(["Alán Aspuru-Guzik*a\nSimulated Quantum Computation"], "Simulated Quantum Computation", "Aspuru Guzik") and not mentions_title(["Simulated Quantum Computation by Aspuru", "Guzik"], "Simulated Quantum Computation", "Aspuru-Guzik")
