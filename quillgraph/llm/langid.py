"""Language of texts and of their words by a linear-chain conditional random field.

A word's score for a language adds the weights of its affixes, its character n-grams and
itself (the lexicon feature), all hashed; transitions between the languages of
neighbouring words are learned too.  Training maximises the conditional likelihood with
forward-backward on sequences that are put together from stretches of sampled documents
of different languages, so transitions see code-switching.  Marginals of all words
of a text come from an exact forward-backward over the whole text; the document's
language is the one with the largest sum of marginals, the score its mean marginal.

Long texts cost no long loops: chunks of `CHUNK` words first give their transfer
matrices, all at once, these are chained along each text, and a second pass
inside the chunks starts from the exact messages.

The model is fitted on a bounded sample of the labelled documents of the folds that aren't held
out: at most about `SAMPLE` distinct texts, in equal shares of the languages, chosen by a hash of the
text; each gives one stretch of its words from a hashed place on, so that together they are about
`TRAIN_WORDS`.  Copies teach once, and no long text and no frequent language takes the others'
share.  The model's size is fixed (2^17 weights a language).

Defined results: `und` with score 0 for a null text, a text without a letter (a character of
Unicode's letter categories), and where nothing could be learned; ties go to the alphabetically first language; repeated rows
return a row each; null languages teach nothing; an empty table returns no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_map, batch, pieces
from quillgraph.llm.folds import fold

SAMPLE = 3000
BUCKETS = 1 << 17
CHUNK = 128
#: Words of a training stretch at most, of one text, and of all of them (about); letters of a training word.
STRETCH, LONGEST, TRAIN_WORDS, WORD = 96, 4000, 400_000, 64
_OUT = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(codes: np.ndarray, at: np.ndarray, width: int, kind: int, size: int) -> np.ndarray:
    """Buckets of the `width` characters from each position on; `kind` keeps the kinds of features apart."""
    h = np.full(len(at), kind, np.uint64)
    for k in range(width):
        h = (h ^ codes[at + k]) * _MIX
        h ^= h >> np.uint64(29)
    return (h % np.uint64(size - 1)).astype(np.int64) + 1


def features(words: list[str], size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of the hashed features of lower-case tokens: the letters of a token as a whole, its first one to
    three and last one to four letters, and its pairs and triples of letters, edges included.  A token without a letter has none."""
    cores = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
    length = np.array([len(c) for c in cores], np.int64)
    codes = np.frombuffer("".join(f"^{c}$" for c in cores).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    end = np.cumsum(length + 2)
    start = end - length - 1  # the first letter; the edge stands before it
    some = np.flatnonzero(length)
    found = [(np.array([crc32(cores[i].encode("utf-8", "replace")) % (size - 1) + 1 for i in some], np.int64), some)]
    for k in (1, 2, 3, 4):
        own = np.flatnonzero(length >= k)
        if k < 4:
            found.append((_hashed(codes, start[own], k, 10 + k, size), own))
        found.append((_hashed(codes, end[own] - 1 - k, k, 20 + k, size), own))
    owner = np.repeat(np.arange(len(words)), length + 2)
    for k in (2, 3):
        at = np.arange(max(0, len(codes) - k + 1))
        at = at[(owner[at] == owner[at + k - 1]) & (length[owner[at]] > 0)]
        found.append((_hashed(codes, at, k, 30 + k, size), owner[at]))
    return np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found])


class Lexicon:
    """Tokens to rows of the emission matrix; at most `keep` are remembered between batches."""

    def __init__(self, weights: np.ndarray, keep: int = 250_000):
        self.weights, self.keep = weights, keep
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, self.weights.shape[1]), np.float32)
        self.lettered = np.zeros(0, bool)

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self.row) > self.keep:
            self.clear()
        new = list(set(tokens).difference(self.row))
        feature, owner = features(new) if new else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sizes = np.bincount(owner, minlength=len(new))
        sums = np.stack([np.bincount(owner, self.weights[feature, k], len(new)) for k in range(self.weights.shape[1])], 1)
        scores = (sums / np.maximum(1, sizes)[:, None] ** 0.5).astype(np.float32)
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.scores, self.lettered = np.vstack([self.scores, scores]), np.append(self.lettered, sizes > 0)
        return np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each word of concatenated sequences; scores is (words, labels), transitions exp-weights (labels, labels).

    The posteriors of neighbouring words' label pairs are added to `pairs`.
    """
    n, labels = scores.shape
    chunks_of = -(-lengths // CHUNK)
    first_chunk = np.cumsum(chunks_of) - chunks_of
    total = int(chunks_of.sum())
    if not total:
        return np.zeros((0, labels), np.float32)
    seq = np.repeat(np.arange(len(lengths)), chunks_of)
    rank = np.arange(total) - first_chunk[seq]
    begin = (np.cumsum(lengths) - lengths)[seq] + rank * CHUNK
    size = np.minimum(CHUNK, lengths[seq] - rank * CHUNK)
    step = np.arange(CHUNK)
    inside = step[:, None] < size
    at = np.where(inside, begin + step[:, None], 0)
    word = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32)[at]  # (CHUNK, chunks, labels)
    t = transitions.astype(np.float32)
    matrix = np.broadcast_to(np.eye(labels, dtype=np.float32), (total, labels, labels)).copy()
    for k in range(CHUNK):
        live = np.flatnonzero(inside[k])
        if not len(live):
            break
        new = matrix[live] @ t * word[k, live][:, None, :]
        matrix[live] = new / np.maximum(new.sum((1, 2), keepdims=True), 1e-30)
    ahead = np.full((total, labels), 1 / labels, np.float32)
    after = np.full((total, labels), 1 / labels, np.float32)
    for r in range(1, int(chunks_of.max())):
        c = np.flatnonzero(rank == r)
        ahead[c] = _unit((ahead[c - 1][:, None, :] @ matrix[c - 1])[:, 0])
    for r in range(int(chunks_of.max()) - 2, -1, -1):
        c = np.flatnonzero((rank == r) & (rank + 1 < chunks_of[seq]))
        after[c] = _unit((matrix[c + 1] @ after[c + 1][:, :, None])[:, :, 0])
    alpha = np.empty_like(word)
    state = ahead
    for k in range(CHUNK):
        state = np.where(inside[k][:, None], _unit(state @ t * word[k]), state)
        alpha[k] = state
    out = np.zeros((n, labels), np.float32)
    state = after
    for k in range(CHUNK - 1, -1, -1):
        live = np.flatnonzero(inside[k])
        if len(live):
            out[at[k, live]] = _unit(alpha[k, live] * state[live])
            if pairs is not None:
                inner = live if k else live[rank[live] > 0]
                before = alpha[k - 1, inner] if k else ahead[inner]
                both = before[:, :, None] * t * (word[k, inner] * state[inner])[:, None, :]
                pairs += (both / np.maximum(both.sum((1, 2), keepdims=True), 1e-30)).sum(0, dtype=np.float64)
            state = state.copy()
            state[live] = _unit((word[k, live] * state[live]) @ t.T)
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray  # exp-weights

    def judge(self, lexicon: Lexicon, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        tokens = [(t or "").lower().split() for t in texts]
        lengths = np.array([len(x) for x in tokens], np.int64)
        rows = lexicon.rows([x for one in tokens for x in one])
        post = marginals(lexicon.scores[rows], lengths, self.transitions) * lexicon.lettered[rows][:, None]
        sums = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(post, axis=0, dtype=np.float64)])
        lettered = np.append(0, np.cumsum(lexicon.lettered[rows]))
        ends = np.cumsum(lengths)
        mass, words = sums[ends] - sums[ends - lengths], lettered[ends] - lettered[ends - lengths]
        for row, some in zip(mass, words, strict=True):
            if not some:  # no letter in the whole text
                yield "und", 0.0
            else:
                best = int(row.argmax())
                yield self.langs[best], float(min(1.0, row[best] / row.sum()))


def train(texts: list[list[str]], langs: list[str], rounds: int = 6, rate: float = 0.5, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Fit on the words of documents of known language, cut into stretches that are dealt into mixed sequences."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    rng = np.random.default_rng(seed)
    cut: list[tuple[list[str], int]] = []
    for i in rng.permutation(len(texts)):
        tokens, y = texts[i], names.index(langs[i])
        at = 0
        while at < len(tokens):
            n = int(rng.integers(8, STRETCH))
            cut.append((tokens[at : at + n], y))
            at += n
    order = rng.permutation(len(cut))
    flat = [x for i in order for x in cut[i][0]]
    gold = np.concatenate([np.full(len(cut[i][0]), cut[i][1]) for i in order]) if cut else np.zeros(0, np.int64)
    labels = len(names)
    weights, transitions = np.zeros((BUCKETS, labels)), np.zeros((labels, labels))
    distinct = list(dict.fromkeys(flat))
    number = {x: i for i, x in enumerate(distinct)}
    word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    feature, owner = features(distinct) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    sizes = np.bincount(owner, minlength=len(distinct))
    scale = 1 / np.maximum(1, sizes) ** 0.5
    sums_w, sums_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    span = 4 * STRETCH
    parts = np.array_split(np.arange(len(flat)), max(1, len(flat) // 20_000))
    for _ in range(rounds):
        for part in parts:
            w, y = word[part], gold[part]
            used, where = np.unique(w, return_inverse=True)
            rows = np.flatnonzero(np.isin(owner, used))
            f, o = feature[rows], np.searchsorted(used, owner[rows])
            emit = np.stack([np.bincount(o, weights[f, k], len(used)) for k in range(labels)], 1) * scale[used][:, None]
            lengths = np.array([min(span, len(part) - a) for a in range(0, len(part), span)], np.int64)
            gt = np.zeros_like(transitions)
            post = marginals(emit[where], lengths, np.exp(transitions), gt)
            error = post.astype(np.float64)
            error[np.arange(len(y)), y] -= 1
            by_word = np.stack([np.bincount(where, error[:, k], len(used)) for k in range(labels)], 1) * scale[used][:, None]
            g = np.stack([np.bincount(f, by_word[o, k], BUCKETS) for k in range(labels)], 1) / len(part) * 50
            touched = np.flatnonzero(np.abs(g).sum(1))
            step = g[touched] + ridge * weights[touched]
            sums_w[touched] += step**2
            weights[touched] -= rate * step / sums_w[touched] ** 0.5
            inner = np.ones(len(part), bool)
            inner[np.cumsum(lengths) - lengths] = False
            b = np.flatnonzero(inner)
            np.add.at(gt, (y[b - 1], y[b]), -1)
            gt = gt / len(part) * 50 + ridge * transitions
            sums_t += gt**2
            transitions -= rate * gt / sums_t**0.5
    return Model(names, weights.astype(np.float32), np.exp(transitions).astype(np.float32))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE) -> Model:
    """Each language teaches by an equal share of `bound` distinct texts, each text by a stretch of its words: see above."""
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y"), F.xxhash64(text_col).alias("h")).filter(F.col("t").isNotNull() & F.col("y").isNotNull() & (fold(F.col(id_col)) != 2))
    texts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # a row for each language
    if not texts:
        return train([], [])
    share = max(1, bound // len(texts))
    least = sum(min(share, n) for n in texts.values())
    taken = min(LONGEST, max(STRETCH, TRAIN_WORDS // least))
    below = F.create_map(*[F.lit(x) for y, n in sorted(texts.items()) for x in (y, int(min(1.0, share / max(n, 1)) * (1 << 30)))])
    rows = rows.filter(F.pmod(F.xxhash64("h", F.lit("language")), F.lit(1 << 30)) < below[F.col("y")])
    words = F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != "")
    start = F.pmod(F.xxhash64("h", F.lit("start")), F.greatest(F.size("w") - taken, F.lit(0)) + 1).cast("int") + 1
    stretch = F.transform(F.slice("w", start, taken), lambda w: F.substr(w, F.lit(1), F.lit(WORD)))
    known = rows.withColumn("w", words).filter(F.size("w") > 0).select("y", "h", stretch.alias("w")).groupBy("y", "h").agg(F.min("w").alias("w")).orderBy("y", "h").collect()  # at most about TRAIN_WORDS words
    return train([r["w"] for r in known], [r["y"] for r in known])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score): one row for each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for rows in pieces(batches, 3_000_000):
            texts = rows.column(2).to_pylist()
            found = list(model.judge(lexicon, texts)) if model.langs else [("und", 0.0)] * len(texts)
            yield batch(_OUT, id=rows.column(0), held_out=rows.column(1), lang_pred=[x for x, _ in found], score=[x for _, x in found])

    source = docs.select(F.col(id_col).cast("long").alias("id"), (fold(F.col(id_col)) == 2).alias("held_out"), F.col(text_col).alias("t"))
    return arrow_map(source, make, "id long, held_out boolean, lang_pred string, score double")
