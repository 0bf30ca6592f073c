"""Queries that SQL can't state, against plain Python over the same tables."""

from collections import Counter

from quillgraph.functions import pagetext
from quillgraph.functions.porter import stem
from quillgraph.operators import search
from quillgraph.queries import QUERIES
from quillgraph.views import view


def lines_of(spark, data):
    for r in view(spark, data, "documents").select("doc_id", "lang", "text").collect():
        for n, line in enumerate((r["text"] or "").split("\n")):
            if line.strip(" "):
                yield r["doc_id"], r["lang"], n, line


def test_stemmed_postings(spark, data):
    passages, occurrences = Counter(), Counter()
    for _, _, _, line in lines_of(spark, data):
        words = [stem(w) for w in search.folded_words(line)]
        passages.update(set(words))
        occurrences.update(words)
    assert {r["word"]: (r["passages"], r["occurrences"]) for r in QUERIES["fts3_stemmed_postings"](spark, data).collect()} == {w: (n, occurrences[w]) for w, n in passages.items()}


def test_reading(spark, data):
    docs = {f"D{r['doc_id']}": r["text"] or "" for r in view(spark, data, "documents").collect()}
    clean = {k: pagetext.clean(t) for k, t in docs.items()}
    status = {k: pagetext.judged(t) for k, t in clean.items()}
    assert {r["work_id"]: (r["pages"], r["chars"], r["status"]) for r in QUERIES["txt10_read"](spark, data).collect()} == {k: (1, len(t), status[k]) for k, t in clean.items()}
    found: dict[str, list] = {}
    for r in QUERIES["txt3_passages"](spark, data).collect():
        found.setdefault(r["work_id"], []).append(r)
    assert set(found) == {k for k, t in clean.items() if status[k] == "ok" and t.split()}
    for k, rows in found.items():
        rows.sort(key=lambda r: r["ordinal"])
        raw = clean[k].encode()
        assert all(raw[r["start"] : r["end"]].decode() == r["text"] for r in rows)
        assert " ".join(r["text"] for r in rows).split() == clean[k].split()
    for r in QUERIES["fts13_page_text"](spark, data).collect():
        assert r["text"].split() == clean[r["work_id"]].split()


def test_expansion(spark, data):
    every = {r["work_id"]: r.asDict() for r in view(spark, data, "works").collect()}
    refs: dict[str, list] = {}
    for r in view(spark, data, "cites").collect():
        refs.setdefault(r["from_work"], []).append((r["ref_seq"], r["to_work"]))
    works = {k: dict(w) for k, w in every.items() if w["depth"] <= 2}
    cites = {(a, b): n for a, listed in refs.items() if a[0] in "CO" for n, b in listed}
    tried = 0
    while tried < 300:
        degree, best = Counter(b for _, b in cites), {}
        for (_, b), n in cites.items():
            best[b] = min(best.get(b, n), n)
        stubs = [w for w in works.values() if not w["hydrated"] and not w["unresolved"] and w["index_id"] and w["depth"] <= 3 and best.get(w["work_id"], 999) <= 100]
        batch = sorted(stubs, key=lambda w: (-degree[w["work_id"]], w["depth"], w["index_id"]))[: min(100, 300 - tried)]
        if not batch:
            break
        tried += len(batch)
        for w in batch:
            w["hydrated"] = True
            for n, b in refs.get(w["work_id"], ()):
                cites.setdefault((w["work_id"], b), n)
                new = works.setdefault(b, {"work_id": b, "index_id": b, "hydrated": False, "unresolved": False, "depth": 99})
                if not (new["hydrated"]):
                    new["depth"] = min(new["depth"], w["depth"] + 1)
    got = QUERIES["gr5_expand"](spark, data).first()
    assert (got["works"], got["fetched"], got["edges"], got["tried"]) == (len(works), sum(w["hydrated"] for w in works.values()), len(cites), tried)


def test_typed_search(spark, data):
    rows = QUERIES["fts6_search"](spark, data).collect()
    ranks = [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert ranks == list(range(1, len(rows) + 1))
    wanted = [search.stem("heed"), "thing"]
    english = {d for d, lang, _, line in lines_of(spark, data) if lang == "en" and any(w == wanted[0] or w.startswith(wanted[1]) for w in map(stem, search.folded_words(line)))}
    phrase = {d for d, lang, _, line in lines_of(spark, data) if lang == "en" and " and the " in f" {' '.join(search.folded_words(line))} "}
    assert {r["paper_id"] for r in rows} <= english | phrase
