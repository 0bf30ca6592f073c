"""Quality rules with risk-controlled cutoffs.

One pass over the texts gives counts; a rule is a ratio of them, high for junk.  The
cutoff of a rule in a stratum (by default the language) comes from labelled documents:

* a hash of the text splits them, each distinct text counting once: a third proposes a cutoff
  for each rule (most junk rejected, each good document rejected costing `weight` times as
  much), the rest, the holdout, certifies all rules of a stratum together;
* the rules of a stratum tighten along one path from no rejection to the proposals: at grid step t
  a rule's cutoff is the larger of t and its proposal.  The holdout's good documents that any rule rejects
  follow a binomial law, so the exact (Clopper-Pearson) upper bound on the stratum's false rejection
  rate is known at each step; the walk stops at the first step whose bound exceeds `limit`
  (the path doesn't depend on the holdout, so fixed-sequence testing needs no correction along it);
* the error level is divided by the number of strata (Bonferroni), so with probability
  1 - `level` the rules together reject at most `limit` of the good documents that pass the base rule,
  in every stratum.  A stratum with too few labels certifies nothing and loses no documents.

All labelled rows count; they are added up on the executors to (stratum, rule, grid
step) and (stratum, grid step), and only these sums reach the driver.

Defined results: a null text has no words and fails the base rule; texts of any length
are read whole; repeated rows return a row each; a document with several labels, and a text
with several documents, counts with the worst; null labels, and labels without a document, count
nowhere; a null stratum is a stratum of its own; an empty table returns no rows and empty labels certify
nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import BROADCAST_IDS, arrow_map, batch, kept_rows, pieces, written

GRID = 400
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_COUNTS = pa.schema([("id", pa.int64()), ("stratum", pa.string()), ("h", pa.int64())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")])
_COUNTS_DDL = "id long, stratum string, h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"

#: Rule: numerator and denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of `width` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code, size = ids[:n], len(number)
    for k in range(1, width):
        if size * len(number) >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        code, size = code * len(number) + ids[k : n + k], size * len(number)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(len(words), bool)
    for k in range(width):
        again[order[1:][same] + k] = True
        again[order[:-1][same] + k] = True
    return int(again.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks of one text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    solid = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words), len(solid.decode("utf-8")), len(solid) - len(solid.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(solid) - len(solid.translate(None, _UPPER)), len(solid) - len(solid.translate(None, _MARKS)),
    )


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """(id, stratum, h, the counts): one row for each document; h is a hash of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            cols = list(zip(*map(counts_of, rows.column(3).to_pylist()), strict=True))
            yield batch(_COUNTS, id=rows.column(0), stratum=rows.column(1), h=rows.column(2), **dict(zip(_COUNTS.names[3:], cols, strict=True)))

    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t")), make, _COUNTS_DDL)


def ratio(rule: str) -> Column:
    over, under = RULES[rule]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def upper_bound(bad: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a binomial rate: the p with P(X <= bad) = level; 1 for n = 0."""
    if bad >= n:
        return 1.0
    low, high = bad / n, 1.0

    def tail(p: float) -> float:
        a, b = log(p), log1p(-p)
        return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * a + (n - k) * b) for k in range(bad + 1))

    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > level else (low, mid)
    return high


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def propose(sums: dict[int, tuple[int, int]], weight: float) -> int:
    """The grid step of the best cutoff of a rule, GRID + 2 if none gains; sums: grid step -> (good, junk), a ratio in step g lies above (g - 1) / GRID."""
    good, junk = (max(1, sum(x[i] for x in sums.values())) for i in (0, 1))
    gain, a, b = {}, 0, 0
    for g in range(GRID + 1, 0, -1):
        a, b = a + sums.get(g, (0, 0))[0], b + sums.get(g, (0, 0))[1]
        gain[g] = b / junk - weight * a / good
    best = max(gain.values())
    if best <= 0:
        return GRID + 2
    equal = [g for g in gain if gain[g] == best]  # a gap between junk and good: its middle
    return equal[len(equal) // 2]


def certify(entered: dict[int, int], least: int, limit: float, level: float) -> int:
    """The last step t of the path whose bound is within `limit`, GRID + 2 if none is; entered: step -> good documents rejected from that step on, 0 for never."""
    n, wrong, passed = sum(entered.values()), 0, GRID + 2
    bounds: dict[int, float] = {}
    for t in range(GRID + 1, least - 1, -1):
        wrong += entered.get(t, 0)
        if wrong not in bounds:
            bounds[wrong] = upper_bound(wrong, n, level)
        if bounds[wrong] > limit:
            break
        passed = t
    return passed


def _marks(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.groupBy(F.col(id_col).cast("long").alias("mark")).agg(F.min(label_col).cast("int").alias("good")).filter("mark is not null and good is not null")


def fit(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", limit: float = 0.02, level: float = 0.05, weight: float = 20.0) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> certified cutoff, where there is one; a document is rejected if its ratio exceeds it."""
    marks = _marks(labels, id_col, label_col)
    step = {r: F.ceil(F.least(ratio(r), F.lit(1.0)) * GRID).cast("int") for r in RULES}
    half = F.when(F.pmod(F.xxhash64(F.col("h"), F.lit("holdout")), F.lit(3)) == 0, 0).otherwise(1)
    texts = counted.filter(~base_failed()).join(marks, F.col("id") == F.col("mark")).groupBy("stratum", "h").agg(F.min("good").alias("good"), *[F.max(c).alias(r) for r, c in step.items()])
    texts = written(texts.withColumn("half", half), "labelled")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES]))
    sums = texts.filter("half = 0").select("stratum", "good", rules.alias("x")).groupBy("stratum", "x.rule", "x.step").agg(F.count_if(F.col("good") > 0).alias("g"), F.count_if(F.col("good") <= 0).alias("b"))
    proposals: dict[str, dict[str, dict]] = {}
    for x in sums.collect():  # strata x rules x grid steps
        proposals.setdefault(x["stratum"], {}).setdefault(x["rule"], {})[x["step"]] = (x["g"], x["b"])
    target = {s: {r: propose(found.get(r, {}), weight) for r in RULES} for s, found in proposals.items()}
    target = {s: t for s, t in target.items() if min(t.values()) <= GRID + 1}
    if not target:
        return {}
    wanted = counted.sparkSession.createDataFrame([(s, *(t[r] for r in RULES)) for s, t in target.items()], "stratum string, " + ", ".join(f"target_{r} int" for r in RULES))
    wanted = F.broadcast(wanted) if len(target) <= BROADCAST_IDS else wanted  # a row for each stratum
    entry = F.greatest(*[F.when(F.col(r) >= F.col(f"target_{r}"), F.col(r)).otherwise(0) for r in RULES])
    held = texts.filter("half = 1 and good > 0").join(wanted, "stratum").groupBy("stratum", entry.alias("entry")).count()
    entered: dict[str, dict[int, int]] = {}
    for x in held.collect():  # strata x grid steps
        entered.setdefault(x["stratum"], {})[x["entry"]] = x["count"]
    found = {}
    for s, goals in target.items():
        t = certify(entered.get(s, {}), min(goals.values()), limit, level / len(target))
        found |= {(s, r): (max(t, g) - 1) / GRID for r, g in goals.items() if max(t, g) <= GRID + 1}
    return dict(sorted(found.items()))


def verdicts(counted: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """The counts with `base_failed`, `failed` (the rules beyond their cutoffs) and `kept`."""
    tests = [F.when((F.col("stratum") == s) & (ratio(r) > c), F.lit(r)) for (s, r), c in cutoffs.items()]
    failed = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return counted.withColumns({"base_failed": base_failed(), "failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", **risk) -> DataFrame:
    """Count, fit and apply: one row for each document."""
    counted = written(counts(docs, id_col, text_col, stratum_col), "quality")
    return verdicts(counted, fit(counted, labels, id_col, **risk))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality", **risk) -> DataFrame:
    """The documents that `judge` keeps, with their columns.

    The cutoffs need the labelled documents alone, which are found by a broadcast of the labels' ids if these number at
    most `BROADCAST_IDS`; beyond it all texts are counted first, so that no text is shuffled.
    """
    ids = _marks(labels, id_col, label_col).select("mark")
    marked = docs.join(F.broadcast(ids), docs[id_col].cast("long") == ids["mark"], "left_semi") if ids.count() <= BROADCAST_IDS else docs
    cutoffs = fit(written(counts(marked, id_col, text_col, stratum_col), "quality"), labels, id_col, label_col, **risk)
    text_at, stratum_at = docs.columns.index(text_col), docs.columns.index(stratum_col) if stratum_col else None
    place = {n: i for i, n in enumerate(_COUNTS.names[3:])}

    def verdict(rows: pa.RecordBatch) -> list[bool]:
        strata = rows.column(stratum_at).cast(pa.string()).to_pylist() if stratum_at is not None else [""] * rows.num_rows
        out = []
        for text, stratum in zip(rows.column(text_at).to_pylist(), strata, strict=True):
            c = counts_of(text)
            base = c[place["n_words"]] < 50 or 100 * c[place["n_repeat_words"]] > 50 * c[place["n_words"]]
            out.append(not base and not any(c[place[a]] / max(c[place[b]], 1) > cutoffs.get((stratum or "", r), inf) for r, (a, b) in RULES.items()))
        return out

    return kept_rows(docs, verdict)
