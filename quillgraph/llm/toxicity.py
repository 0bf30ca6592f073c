"""Toxicity scores of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all texts of the table: every partition
   adds up its trigrams, and the sums (at most 64^3 codes) reach the driver.
2. A token that may be disguised (a letter with digits or marks beside it, a letter three times in
   a row, single letters in a row) becomes a lattice: each character stands for itself, for the letters it
   may replace (leetspeak), or for nothing (a separator, a repeated letter), each at a
   price.  Viterbi search under the trigram model finds the restored word.  Chunks of one or two characters in
   a row may be a spaced-out word beside short words: all words that neighbouring chunks make are read, and chunks
   with digits or marks are decoded with an option of a space between them.  Once evidence is known, a word with a doubled letter is
   decoded too if it may hold some without it, and pieces of any length that make a word of evidence are put together.
3. Evidence is a restored word or a prefix of one.  Labelled training documents give counts of
   toxic and other documents for each; a greedy cover picks evidence by the lower confidence bound of
   its toxic share among documents that stronger evidence doesn't explain yet, so words that
   merely occur beside it a few times are not picked.  Near copies teach once: training documents with the
   same smallest hash of three tokens in a row count as one.
4. A document's score is a logistic function, calibrated on a fold that the counted evidence hasn't seen, of its two
   strongest evidences.

Labels come from at most about `SAMPLE` labelled documents of the folds that aren't held out; the
language model and everything else cover all rows.

Defined results: a null or empty text holds no evidence and gets the score of none; repeated rows
return a row each; copies of a text teach once, with the largest of their labels, and most near copies once, with one of theirs; a null label teaches nothing, a document
with several labels counts with the largest; without training labels every score is 0; an empty table returns
no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_map, batch, pieces, written
from quillgraph.llm.folds import fold, sampled

SAMPLE = 20_000
THRESHOLD = 0.3
#: Symbols of the language model; the last one stands between texts.
SYMBOLS = 64
BETWEEN = SYMBOLS - 1
PREFIXES = range(3, 9)
#: Least strength of evidence that only a repaired word (a doubled letter, a word in pieces) gives: ordinary words are near other words too.
REPAIRED = 0.75
#: Letters of the longest word read from chunks.
LONGEST = 24
_OUT = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
#: Letters that a character may replace.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+")
#: Repeated marks at the ends of a token that stand for no letter, and characters that leave the lattice a choice.
_EDGE = re.compile(r"^([^\w\s@$!|+€(])\1+|([^\w\s@$!|+€(])\2+$")
_ODD = re.compile(r"[\W\d_]|([^\W\d_])\1\1")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"([^\W\d_])\1+")
_PLAIN = ".,;:?\"')"
_AROUND = ".,;:?\"')-*~/_[]{}<>=&#%^`"
_CHOICE = re.compile(r"[\d@$!|+€(]|([^\W\d_])\1")


def _code(char: str) -> int:
    """A symbol of the language model: 0 between words, 1-26 a-z, 27-59 Latin-1 letters, 60 any other letter."""
    if "a" <= char <= "z":
        return ord(char) - 96
    if "ß" <= char <= "ÿ" and char != "÷":
        return ord(char) - 223 + 27
    return 60 if char.isalpha() else 0


_TABLE = bytes(_code(chr(b)) for b in range(256))


def trigram_sums(texts: list[str | None], most: int = 1_000_000) -> np.ndarray:
    """Trigram counts, added up over about `most` characters at a time; no trigram goes from one text into the next."""
    sums, parts, size = np.zeros(SYMBOLS**3, np.int64), [], 0

    def add() -> None:
        raw = np.frombuffer(bytes([BETWEEN]).join(parts), np.uint8).astype(np.int32)
        if len(raw) > 2:
            sums[:] += np.bincount((raw[:-2] * SYMBOLS + raw[1:-1]) * SYMBOLS + raw[2:], minlength=SYMBOLS**3)

    for text in texts:
        if text:
            parts.append((" " + text.lower() + " ").encode("latin-1", "replace").translate(_TABLE))
            size += len(parts[-1])
            if size > most:
                add()
                parts, size = [], 0
    add()
    cube = sums.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    cube[BETWEEN] = cube[:, BETWEEN] = cube[:, :, BETWEEN] = 0
    return sums


class CharModel:
    """Log-probabilities of a trigram model, with the bigram and the unigram behind it."""

    def __init__(self, sums: np.ndarray):
        tri = sums.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        bi, uni = tri.sum(0), tri.sum((0, 1)) + 1.0
        p1 = uni / uni.sum()
        p2 = (bi + 5.0 * p1) / (bi.sum(1, keepdims=True) + 5.0)
        self.log = np.log((tri + 5.0 * p2[None]) / (tri.sum(2, keepdims=True) + 5.0)).astype(np.float32).tolist()

    def decode(self, token: str, wide: int = 24) -> str:
        """The best reading of a lower-case token: Viterbi over (last two symbols), `wide` states kept; a space may stay or go."""
        states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        before = ""
        for char in token:
            options: list[tuple[str, float]] = []
            if char.isalpha():
                options.append((char, 0.0))
                if char == before:
                    options.append(("", 1.0))  # repetition
            else:
                options += [(x, 1.2) for x in LEET.get(char, "")]
                if char == " ":
                    options.append((" ", 1.5))
                options.append(("", 2.0 if char in "@$€" and char == before else 4.0 if char.isdigit() or char in "@$€" else 1.5))
            new: dict[tuple[int, int, str], tuple[float, str]] = {}
            for (a, b, _), (cost, done) in states.items():
                for letter, price in options:
                    if letter:
                        c = _code(letter)
                        key, value = (b, c, letter), (cost + price - self.log[a][b][c], done + letter)
                    else:
                        key, value = (a, b, ""), (cost + price, done)
                    if key not in new or value < new[key]:
                        new[key] = value
            states = dict(heapq.nsmallest(wide, new.items(), key=lambda x: x[1])) if len(new) > wide else new
            before = char
        return min((cost - self.log[a][b][0], done) for (a, b, _), (cost, done) in states.items())[1]

    def restore(self, token: str) -> list[str]:
        """The readings of a whitespace token: its letters as they stand, and the decoded word if it looks disguised."""
        if token[0] == " ":
            return self.rejoined(token.split())
        plain = _WORDS.findall(token)
        core = _EDGE.sub("", token).strip(_PLAIN)
        if plain and _ODD.search(core) and 4 * sum(c.isdigit() for c in core) <= 3 * len(core):
            decoded = self.decode(core) if _CHOICE.search(core) else "".join(plain)
            return [*plain, decoded] if decoded else plain
        return plain

    def rejoined(self, chunks: list[str]) -> list[str]:
        """The words that neighbouring chunks make; if there are digits or marks, those of the decoded chunks."""
        if all(map(str.isalpha, chunks)):
            words = set()
            for i in range(len(chunks)):
                word = chunks[i]
                for chunk in chunks[i + 1 :]:
                    word += chunk
                    if len(word) > LONGEST:
                        break
                    if len(word) > 2:
                        words.add(word)
            return sorted(words)
        text = "".join(chunks)
        if 4 * sum(c.isdigit() for c in text) > 3 * len(text):
            return []
        words = set(self.decode(" ".join(chunks)).split())
        for skip in (0, 1, 2):  # whole, and without short words before it
            if len(chunks) > skip + 1:
                words.add(self.decode("".join(chunks[skip:])))
        return sorted(w for w in words if len(w) > 2)


def evidence(word: str, least: int = 0) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k >= least)]


def evidence_of(chars: CharModel, token: str) -> list[str]:
    """Evidence of all readings; short prefixes of words made of chunks say little, as any short words in a row make them."""
    return [x for w in chars.restore(token) for x in evidence(w, 5 if token[0] == " " else 0)]


def tokens_of(text: str | None) -> list[str]:
    """Lower-case tokens; two or more chunks in a row are one token more, which starts with a space.

    A chunk has one or two characters within its punctuation and is no number of two digits; single marks between chunks are passed over.
    """
    tokens = (text or "").lower().split()
    chunk_of = CHUNKS.__getitem__
    kinds = [chunk_of(t) if len(t) < 5 else None for t in tokens]
    extra: list[str] = []
    run: list[str] = []
    last = -2
    for i in [i for i, k in enumerate(kinds) if k is not None]:
        if i != last + 1:
            if len(run) > 1:
                _close(run, extra)
            run = []
        last = i
        if kinds[i]:
            run.append(kinds[i])
    _close(run, extra)
    return tokens + extra


def _close(run: list[str], extra: list[str]) -> None:
    if len(run) > 1 and any(map(str.isalpha, run)) and len("".join(run)) > 2:
        extra.append(" " + " ".join(run))


class _Chunks(dict):
    """Short tokens: the chunk that one is, "" for a single mark, None for neither; a bounded memory of them."""

    def __missing__(self, token: str) -> str | None:
        chunk = token.strip(_AROUND)
        if not chunk:
            kind = "" if len(token) == 1 else None
        else:
            kind = chunk if len(chunk) < 3 and not (len(chunk) == 2 and chunk.isdigit()) else None
        if len(self) < 200_000:
            self[token] = kind
        return kind


CHUNKS = _Chunks()


class _Scores(dict):
    """Tokens' strongest evidence, worked out when a token is first asked for; at most `keep` are remembered."""

    def __init__(self, chars: CharModel, strength: dict[str, float], keep: int = 400_000):
        super().__init__()
        self.chars, self.strength, self.keep = chars, strength, keep
        self.heads = {x[:3] for x in strength if x[0] != "="}
        self.sure = {x: v for x, v in strength.items() if v >= REPAIRED and (x[0] == "=" or len(x) >= 5)}
        self.single = {_TWICE.sub(r"\1", x.lstrip("="))[:3] for x in self.sure}
        whole = [x.lstrip("=") for x in self.sure]
        self.lefts = {x[:k] for x in whole for k in range(1, len(x))}

    def __missing__(self, token: str) -> float:
        strength = self.strength
        word = token.strip(_PLAIN)
        if word.isalpha() and not _THRICE.search(word):  # as it stands: most tokens, without any evidence
            held = word[:3] in self.heads or "=" + word in strength
            score = max(strength.get(x, 0.0) for x in evidence(word)) if held else 0.0
            once = _TWICE.sub(r"\1", word)
            if once != word and once[:3] in self.single:  # a doubled letter, in a word that may hold evidence without it
                score = max([score, *(self.sure.get(x, 0.0) for x in evidence(self.chars.decode(word)))])
        else:
            score = max((strength.get(x, 0.0) for x in evidence_of(self.chars, token)), default=0.0)
        if len(self) >= self.keep:
            self.clear()
        self[token] = score
        return score

    def split(self, tokens: list[str]) -> list[float]:
        """Evidence of words that stand in pieces of any length: a piece that begins one is followed as long as the next ones go on with it."""
        lefts, sure, found = self.lefts, self.sure, []
        for i in [i for i, t in enumerate(tokens) if t in lefts]:
            word = tokens[i]
            for t in tokens[i + 1 : i + LONGEST]:
                word += t.strip(_PLAIN)
                if score := max(sure.get("=" + word, 0.0), sure.get(word, 0.0)):
                    found.append(score)
                if word not in lefts:
                    break
        return found


@dataclass
class Model:
    sums: np.ndarray
    strength: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-1e9, 0.0, 0.0)

    def scorer(self):
        scores = _Scores(CharModel(self.sums), self.strength)
        score_of = scores.__getitem__

        def strongest(text: str | None) -> tuple[float, float]:
            tokens = tokens_of(text)
            top = sorted([*filter(None, map(score_of, tokens)), *scores.split(tokens)], reverse=True)[:2]
            return (top + [0.0, 0.0])[0], (top + [0.0, 0.0])[1]

        return strongest


def trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS**3, np.int64)
        for rows in batches:
            for part in pieces([rows]):
                sums += trigram_sums(part.column(0).to_pylist())
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(sums[codes], pa.int64())], names=["code", "n"])

    found = arrow_map(docs.select(F.col(text_col).alias("t")), make, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**3, np.int64)
    for x in found.collect():  # at most SYMBOLS^3 codes
        out[x["code"]] = x["n"]
    return out


def lower_bound(hits: float, n: float, z: float = 3.0) -> float:
    """Wilson's lower confidence bound of a share."""
    if n <= 0:
        return 0.0
    p = hits / n
    return max(0.0, (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n))


def cover(toxic_docs: list[list[str]], negatives: dict[str, int], least: float = 0.22, certain: float = 0.5) -> dict[str, float]:
    """Greedy cover: evidence by the bound of (unexplained toxic documents, other documents), or of all its toxic
    documents where that is at least `certain`."""
    where: dict[str, set[int]] = defaultdict(set)
    for i, items in enumerate(toxic_docs):
        for x in items:
            where[x].add(i)
    order = lambda x, n: (-lower_bound(n, n + negatives.get(x, 0)), -n, len(x), x)
    heap = [(*order(x, len(d)), len(d)) for x, d in where.items() if len(d) > 1]
    heapq.heapify(heap)
    explained: set[int] = set()
    picked: dict[str, float] = {}
    while heap:
        minus, _, _, x, n = heapq.heappop(heap)
        if -minus < least:
            break
        left = len(where[x] - explained)
        if left == n or (whole := lower_bound(len(where[x]), len(where[x]) + negatives.get(x, 0))) >= certain:
            picked[x] = -minus if left == n else whole
            explained |= where[x]
        elif left > 1:
            heapq.heappush(heap, (*order(x, left), left))
    return picked


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Newton's method with a ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ beta)
        beta += np.clip(step, -5, 5)
    return tuple(beta.tolist())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = SAMPLE) -> Model:
    """The language model of all texts, and the evidence and curve of the labelled ones outside the held-out fold."""
    sums = trigrams(docs, text_col)
    marks = labels.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y")).filter("i is not null and y is not null").withColumn("fold", fold(F.col("i"))).filter("fold <> 2")
    marks = sampled(marks, "i", bound, "toxicity")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(marks), "i").select("t", "y", "fold", F.xxhash64("t").alias("h"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, seen = CharModel(sums), {}
        for rows in batches:
            for part in pieces([rows], 2_000_000):
                out = []
                for t in part.column(0).to_pylist():
                    items: set[str] = set()
                    for token in set(tokens_of(t)):
                        if token not in seen:
                            seen[token] = evidence_of(chars, token)
                        items.update(seen[token])
                    out.append(sorted(items))
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([_sketch(t) for t in part.column(0).to_pylist()], pa.int64()), part.column(3), pa.array(out, pa.list_(pa.string()))], names=["y", "fold", "sketch", "h", "items"])

    read = arrow_map(rows, make, "y int, fold long, sketch long, h long, items array<string>")
    # Of near copies the text with the smallest hash teaches; of copies of it, one with the largest label.
    first = read.groupBy("sketch").agg(F.min(F.struct("h", (-F.col("y")).alias("minus"), "fold", "items")).alias("x"))
    seen = written(first.select((-F.col("x.minus")).alias("y"), "x.fold", "x.items"), "evidence")
    curve_fold = 3
    first = _evidence(seen.filter(F.col("fold") != curve_fold))
    shown = seen.filter(F.col("fold") == curve_fold).select("y", _strongest(first)).toPandas() if first else None
    every = _evidence(seen)
    if not every:
        total = seen.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
        return Model(sums, {}, (-1e9 if not total["n"] else float(np.log((total["y"] + 0.5) / (total["n"] - total["y"] + 0.5))), 0.0, 0.0))
    if shown is None or shown["y"].nunique() < 2:
        return Model(sums, every, (-3.0, 6.0, 1.0))
    x = np.array([(list(v) + [0.0, 0.0])[:2] for v in shown["top"]], np.float64)
    return Model(sums, every, logistic(x, shown["y"].to_numpy(np.float64)))


def _sketch(text: str | None) -> int:
    """The smallest hash of three tokens in a row: near copies mostly share it, other texts don't."""
    import xxhash

    words = (text or "").lower().encode("utf-8", "replace").split()
    digest = xxhash.xxh64_intdigest
    return min((digest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def _evidence(seen: DataFrame) -> dict[str, float]:
    counted = seen.select("y", F.explode("items").alias("x")).groupBy("x").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    p, z = F.col("pos") / F.col("n"), 3.0
    bound = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    strong = counted.filter("pos > 1").filter(bound >= 0.15).select("x", (F.col("n") - F.col("pos")).alias("neg"))
    kept = {r["x"]: r["neg"] for r in strong.collect()}  # of a bounded sample of documents
    toxic = seen.filter("y > 0").select("items")
    docs = [[x for x in r["items"] if x in kept] for r in toxic.toLocalIterator()]
    return cover(docs, kept)


def _strongest(strength: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in strength.items() for v in pair])
    found = F.transform("items", lambda x: F.coalesce(F.try_element_at(table, x), F.lit(0.0)))
    return F.slice(F.sort_array(F.filter(found, lambda v: v > 0), asc=False), 1, 2).alias("top")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted): one row for each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strongest = model.scorer()
        for rows in batches:
            for part in pieces([rows]):
                x = np.array([strongest(t) for t in part.column(2).to_pylist()], np.float64).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(model.curve[0] + x @ np.array(model.curve[1:]), -700, 700)))
                yield batch(_OUT, id=part.column(0), held_out=part.column(1), score=p, predicted=(p >= threshold).astype(np.int32))

    source = docs.select(F.col(id_col).cast("long").alias("id"), (fold(F.col(id_col)) == 2).alias("held_out"), F.col(text_col).alias("t"))
    return arrow_map(source, make, "id long, held_out boolean, score double, predicted int")
