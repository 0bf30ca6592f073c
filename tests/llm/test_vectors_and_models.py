"""Whitening, clustering and language-model scores against plain versions, on odd tables too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quillgraph.llm import clusters, ngrams, vectors, whiten

VECTORS = "vec_id long, embedding array<float>, label int, id int, code string, component int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(5)
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(60)]
    rows = list(enumerate(base)) + [(i + 100, base[3]) for i in range(80)]  # many copies of one
    rows += [(3, base[3]), (3, base[4]), (None, base[5]), (900, None), (901, []), (902, [0.5] * 5 + [float("nan")]), (903, [0.5] * 5 + [float("inf")]), (904, [0.1, 0.2]), (905, [300.0] * 6), (906, [None] + [0.1] * 5)]
    return vectors_of(spark, rows).repartition(5), rows


def kept_rows(rows, scale, dims):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in fine]


def test_codes():
    x = np.array([[0, 1, -32767], [5, -6, 70000], [0, 0, 0], [2**62, -(2**62), 1]], np.int64)
    codes = vectors.encoded(x).to_pylist()
    assert [len(c) for c in codes] == [6, 24, 6, 24]
    assert (vectors.decoded(codes, 3) == x).all()
    assert vectors.floored(np.array([-0.001, 0.0, 1e30, -1e30]), 256.0).tolist() == [-1, 0, 2**63 - 1, -(2**63)]


def test_whitening(odd_vectors):
    table, rows = odd_vectors
    model = whiten.fit(table)
    kept = kept_rows(rows, 256, 6)
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3) for b in range(6)] for a in range(6)]
    values, _ = np.linalg.eigh(np.array(exact, float))
    got = whiten.whiten(table, model).collect()
    assert len(got) == 4 * len(kept)
    assert Counter(r["id"] for r in got) == Counter({i: 4 * c for i, c in Counter(i for i, _ in kept).items()})
    assert {r["n"] for r in got} == {n}
    assert {r["component"]: r["explained"] for r in got} == pytest.approx({k + 1: values[-1 - k] / float(sum(exact[a][a] for a in range(6))) for k in range(4)}, rel=1e-9)
    deviation = defaultdict(set)
    for i, x in kept:
        deviation[i].add(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
    assert all(r["deviation"] in deviation[r["id"]] for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by_vector = {}
    for (i, x), k in ((row, k) for row in kept for k in range(4)):
        want = float(np.dot(np.array(x) - np.array(sums) / n, model.vectors[:, k]) / math.sqrt(model.values[k]))
        by_vector.setdefault((i, k + 1), []).append(want)
    for r in got:
        assert min(abs(r["whitened"] - w) for w in by_vector[r["id"], r["component"]]) < 1e-9
    w = np.array([[by_vector[i, k + 1][0] for k in range(4)] for i, x in {tuple(x): (i, x) for i, x in kept if i not in (3, None)}.values()])
    assert abs(w.T @ w / len(w) - np.outer(w.mean(0), w.mean(0)) - np.eye(4)).max() < 0.2  # nearly all of the fit list
    assert abs(np.array(exact, float) @ model.vectors - model.vectors * model.values).max() < 1e-6 * model.values[0]


def test_whitening_of_little(spark):
    one = vectors_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [0.5, 0.25])])
    got = whiten.whiten(one, whiten.fit(one)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in got if r["id"] == 1] == [(1, None, 0.0, 0.0, 0), (2, None, 0.0, 0.0, 0)]
    none = one.limit(0)
    assert whiten.fit(none) is None and whiten.whiten(none, None).collect() == []
    flat = vectors_of(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])  # a line: one component has variance
    got = {(r["id"], r["component"]): r["whitened"] for r in whiten.whiten(flat, whiten.fit(flat)).collect()}
    assert [got[i, 1] for i in range(5)] == pytest.approx([(i - 2) / math.sqrt(2) for i in range(5)]) and got[0, 2] is None and (0, 4) not in got


def test_whitening_is_exact_far_from_zero(spark):
    """Large values that differ by little; a covariance without centring first would be noise."""
    rows = spark.createDataFrame([(i, [1e9 + i % 7, 2e9 - (i % 5) * 3]) for i in range(35)], "vec_id long, embedding array<double>")
    model = whiten.fit(rows, 2, 1.0)
    x = np.array([[i % 7, -(i % 5) * 3] for i in range(35)], float)
    assert model.values == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1], rel=1e-9)
    huge = spark.createDataFrame([(0, [2e18]), (1, [-2e18]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whiten.whiten(huge, whiten.fit(huge, 1, 1.0), 1.0).collect()} == {None, 0}


def plain_clusters(kept, k, rounds):
    seeds = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), vectors.encoded(np.array([x])).to_pylist()[0], x) for i, x in kept)[:k]
    centres = [x for _, _, x in seeds]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        homes = [j for _, j in assigned()]
        centres = [[sum(x[d] for (_, x), h in zip(kept, homes, strict=True) if h == j) // homes.count(j) for d in range(len(c))] if j in homes else c for j, c in enumerate(centres)]
    return assigned(), centres


@pytest.mark.parametrize("scale", [64.0, 2.0, 1e9])
def test_clusters(odd_vectors, scale):
    """Coarse scales give many equal distances; the largest is beyond a long's square."""
    table, rows = odd_vectors
    kept = kept_rows(rows, scale, 6)
    want, centres = plain_clusters(kept, 7, 3)
    got = clusters.cluster(table, 7, 3, scale, 6).collect()
    key = lambda t: (t[0] is None, *t)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got), key=lambda t: (t[0] is None, t[0] or 0, t[1])) == sorted(((i, c, d if d < 2**63 else None) for (i, _), (d, c) in zip(kept, want, strict=True)), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    inertia = defaultdict(int)
    for d, c in want:
        inertia[c] += d
    long = lambda v: v if v < 2**63 else None
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in got} == {(c, long(v), long(sum(inertia.values()))) for c, v in inertia.items()}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest() for r in got)


def test_bounds_skip_and_never_lie():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-4, 5, (500, 3)) + c for c in ([0, 0, 0], [40, 0, 0], [0, 60, 5], [9, 9, 9])])
    centres, bounds, measured = x[[3, 600, 1200, 1800, 4]], (None, None, None), 0
    moves = np.zeros(5)
    for turn in range(4):
        near = clusters.Centroids(centres, moves)
        home, distance, known, upper, lower, done = near.assign(x, *bounds)
        exact = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (home == exact.argmin(1)).all()
        assert (near.distances(x, home, distance, known) == exact.min(1)).all()
        assert (upper >= np.sqrt(exact.min(1))).all() and (lower <= np.sqrt(exact)).all()
        measured += done if turn else 0
        new = np.array([x[home == c].sum(0) // max(1, (home == c).sum()) if (home == c).any() else centres[c] for c in range(5)])
        moves = np.sqrt(((new - centres) ** 2).sum(1))
        centres, bounds = new, (home, upper, lower)
    assert measured < 3 * len(x) * 5 / 3


def test_clusters_of_little(spark):
    few = vectors_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert {(r["id"], r["cluster"], r["distance"], r["inertia"]) for r in clusters.cluster(few, 16, 3, 64.0, 2).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}
    assert clusters.cluster(few, dims=64).collect() == [] and clusters.cluster(few.limit(0)).collect() == []


# Language models


def plain_tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[ \t\n\v\f\r]+", low) if w]


def plain_model(texts, order):
    """p(word | words before), by dictionaries of words."""
    pad, grams = ["<s>"] * (order - 1), [Counter() for _ in range(order + 1)]
    raw = Counter()
    for t in texts:
        seq = [*pad, *plain_tokens(t), "</s>"]
        raw.update(seq[len(pad) :])
        for i in range(len(pad), len(seq)):
            grams[order][tuple(seq[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut, context = {}, {}
    for k in range(1, order + 1):
        t = [sum(1 for v in grams[k].values() if v == c) for c in (1, 2, 3, 4)]
        if min(t[:3]) == 0:
            cut[k] = [0, 0.5, 1.0, 1.5]
        else:
            y = t[0] / (t[0] + 2 * t[1])
            cut[k] = [0, *(min(max(c - (c + 1) * y * t[c] / t[c - 1], 0), c) for c in (1, 2, 3))]
        context[k] = defaultdict(list)
        for g, v in grams[k].items():
            context[k][g[:-1]].append(v)

    def p(before, word):
        out = 1 / (len(raw) + 1)
        for k in range(1, order + 1):
            h = tuple(before[len(before) - k + 1 :])
            if values := context[k].get(h):
                left = sum(cut[k][min(v, 3)] for v in values) / sum(values)
                a = grams[k].get((*h, word), 0)
                out = max(a - cut[k][min(a, 3)], 0) / sum(values) + left * out
        return out

    return raw, p


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(spark, monkeypatch, order):
    monkeypatch.setattr(ngrams, "SHARD", 300)
    monkeypatch.setattr(ngrams, "GATHER", 50)
    rng = random.Random(order)
    words = ["the", "The", "cat", "sat", "émile", "漢字", "a b", "x" * 300, "mat", "on", "ran", "A", "I"]
    texts = [(i, rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(words, range(13, 0, -1), k=rng.randint(0, 25)))) for i in range(120)]
    texts += [(7, texts[7][1]), (7, "another text"), (None, "the cat"), (500, None), (501, ""), (502, " \n "), (503, "never seen before the cat")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n int, id string").repartition(3)
    train = [t for i, t in texts if not held(i)]
    raw, p = plain_model(train, order)
    total, pad = sum(raw.values()), ["<s>"] * (order - 1)
    want = []
    for i, t in texts:
        seq = [*pad, *plain_tokens(t), "</s>"]
        own = seq[len(pad) :]
        score = sum(math.log10(p(seq[: len(pad) + k], w)) for k, w in enumerate(own))
        want.append((i, held(i), len(own), sum(w in raw for w in own), sum(math.log10((raw[w] + 1) / (total + len(raw) + 1)) for w in own), score))
    model = ngrams.fit(table, order)
    assert (model.tokens, model.words) == (total, len(raw))
    got = [(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in ngrams.score(table, model).collect()]
    order_of = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    for a, b in zip(order_of(got), order_of(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-9), (a, b)
    some = random.Random(1).sample(sorted(raw), 5)
    for before in [some[:1] * (order - 1), some[: order - 1], pad, ["unknown"] * (order - 1)]:
        assert sum(p([*pad, *before], w) for w in [*raw, "unknown word"]) == pytest.approx(1.0)


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngrams.score(none, ngrams.fit(none)).collect() == []
    i = next(i for i in range(100) if held(i))
    alone = spark.createDataFrame([(i, "only held out")], "doc_id long, text string")
    (r,) = ngrams.score(alone, ngrams.fit(alone)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (4, 0, 0, 0.0, 0.0)


def test_long_texts_are_hashed_in_windows(monkeypatch):
    text = ("word " * 50 + "x" * 700 + "\n").encode() * 20
    whole = ngrams.Hasher().tokens([text, b"b", None])
    monkeypatch.setattr(ngrams, "WINDOW", 256)
    parts = ngrams.Hasher().tokens([text, b"b", None])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(set(whole[0].tolist())) == 3


def test_counts_beyond_a_byte(spark):
    many = spark.createDataFrame([(i, "again " * 400 + f"w{i}") for i in range(40)], "doc_id long, text string")
    raw, p = plain_model([r["text"] for r in many.collect() if not held(r["doc_id"])], 2)
    model = ngrams.fit(many, 2)
    assert max(raw.values()) > 10_000 and model.tokens == sum(raw.values())
    got = {r["id"]: r["score"] for r in ngrams.score(many, model).collect()}
    seq = ["<s>", *plain_tokens("again " * 400 + "w5"), "</s>"]
    assert got[5] == pytest.approx(sum(math.log10(p(seq[: k + 1], w)) for k, w in enumerate(seq[1:])), abs=1e-8)


def test_a_folder_that_workers_cannot_map_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "place_for", lambda spark, name: f"hdfs://store/{name}")
    with pytest.raises(RuntimeError, match="mounted"):
        ngrams._folder(spark, "words")


def test_held_out_text_is_likelier_than_under_the_base(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [r for r in ngrams.score(docs, ngrams.fit(docs)).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
