"""Text of pages: cleaning, quality, references, passages, clues to a work's identity."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgraph.functions.identity import balanced, normal_arxiv, normal_doi
from quillgraph.functions.textnorm import fold_text

# Ligatures and what they spell, spacing accents and the marks they stand for, a letter with such an accent.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
ACCENTS = {"¨": "̈", "´": "́", "`": "̀", "ˆ": "̂", "˜": "̃", "¸": "̧", "ˇ": "̌", "˚": "̊"}
_ACCENT = re.compile(r"([^\W\d_])([¨´`ˆ˜¸ˇ˚]) ?([^\W\d_])")


def _compose(m: re.Match) -> str:
    """The accent belongs to the letter with which it makes one character; the following one first."""
    mark = ACCENTS[m[2]]
    for a, b in ((m[1], m[3] + mark), (m[1] + mark, m[3])):
        both = unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b)
        if len(both[0]) == len(both[1]) == 1:
            return both[0] + both[1]
    return m[0]


class _Plain(dict):
    """What each character becomes, found once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = plain = LIGATURES.get(c, c if c == "\n" or unicodedata.category(c) not in ("Cc", "Co", "Zs") else " ")
        return plain


_PLAIN = _Plain()


def clean(page: str) -> str:
    """A page as plain text: NFC, one space between words, at most one blank line, hyphens of line ends resolved."""
    text = page.replace("\r\n", "\n").replace("\r", "\n")
    if any(c in text for c in ACCENTS):
        text = _ACCENT.sub(_compose, text)
    text = unicodedata.normalize("NFC", text)
    if "\x02" in text:
        text = re.sub(r"(?<=[^\W\d_])\x02\s*(?=[^\W\d_])", "", text).replace("\x02", " ")
    text = re.sub("\u00ad(?!\n)", "-", text)  # at a line end a soft hyphen stays one
    text = re.sub(r"-\n(?=\d)", "-", text)
    text = text.translate(_PLAIN)
    text = re.sub(r"\n[ ]+", "\n", re.sub(r" {2,}", " ", text)).lstrip(" ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +\n", "\n", text)).strip("\n")


# --- Quality -------------------------------------------------------------------------------------------------------

# Vowels with and without marks.
VOWELS = "aeiouyàáâãäåāăąǎèéêëēĕėęěìíîïĩīĭįıòóôõöøōŏőœùúûüũūŭůűųýÿæ"
_VOWEL = f"[{VOWELS}{VOWELS.upper()}]"


_SPACE = " \t\n\x0b\f\r"


@lru_cache(maxsize=65536)
def _kind(c: str) -> tuple[bool, bool, bool]:
    """Whether a character is a letter, one of the Latin script, a vowel."""
    letter = unicodedata.category(c)[0] == "L"
    latin = letter and (c in "ªº" or unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN", "MODIFIER LETTER SMALL", "MODIFIER LETTER CAPITAL")))
    return letter, latin, c.lower() in VOWELS


# ASCII characters that are no letter or digit; those that are no letter, to be left out.
_EDGES = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
_NO_LETTER = {i: None for i in range(128) if not chr(i).isalpha()}
_ASCII_VOWEL = re.compile("[aeiouyAEIOUY]")


@lru_cache(maxsize=200_000)
def _good(token: str) -> bool | None:
    """Whether a token is like a word: mostly letters, and with a vowel if it has three or more letters, all Latin; None for one without a letter."""
    if token.isascii():
        core = token.strip(_EDGES)
        only = core.translate(_NO_LETTER)
        if not only:
            return None
        other = len(core) - len(only) - core.count("-") - core.count("'")
        return 4 * other <= len(only) and (len(only) < 3 or bool(_ASCII_VOWEL.search(only)))
    kinds = [_kind(c) for c in token]
    if not any(k[0] for k in kinds):
        return None
    solid = [i for i, (c, k) in enumerate(zip(token, kinds, strict=True)) if k[0] or unicodedata.category(c) == "Nd"]
    core = list(zip(token, kinds, strict=True))[solid[0] : solid[-1] + 1]
    letters, latin = sum(k[0] for _, k in core), sum(k[1] for _, k in core)
    other = sum(not k[0] and c not in "-'’" for c, k in core)
    return letters > 0 and 4 * other <= letters and not (latin == letters and latin >= 3 and not any(k[2] for _, k in core))


def judged(text: str, pages: int = 1) -> str:
    """no-text, gibberish or ok, from shares of characters and tokens."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) == 0 or codes.max() > max(1_000, len(codes)):
        chars = Counter(text)
    else:
        seen = np.bincount(codes)
        chars = {chr(c): int(seen[c]) for c in np.flatnonzero(seen)}
    visible = sum(n for c, n in chars.items() if c not in _SPACE)
    if pages < 1 or visible < 100 * pages:
        return "no-text"
    kinds = [(_kind(c), n) for c, n in chars.items()]
    letters, latin, vowels = (sum(n for k, n in kinds if k[i]) for i in range(3))
    if chars.get("\ufffd", 0) > 0.25 * visible or letters < 0.35 * visible or (2 * latin > letters and vowels < 0.25 * latin):
        return "gibberish"
    verdicts = [(v, n) for v, n in ((_good(t.decode("utf-8", "surrogatepass")), n) for t, n in Counter(text.encode("utf-8", "surrogatepass").split()).items()) if v is not None]
    tokens = sum(n for _, n in verdicts)
    return "gibberish" if tokens and sum(n for v, n in verdicts if v) < 0.45 * tokens else "ok"


@F.pandas_udf(StringType())
def _judged(texts: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else judged(t, int(n)) for t, n in zip(texts, pages, strict=True)], dtype=object)


def quality(text: Column, pages: Column | int = 1) -> Column:
    """`judged` of a column: one pass over the characters, each distinct token looked at once."""
    return _judged(text, F.lit(pages) if isinstance(pages, int) else pages)


# --- Passages ------------------------------------------------------------------------------------------------------

TARGET, MOST, LEAST = 250, 400, 60
# Headings of reference lists and of what may follow them.
_REFERENCES = re.compile(r"(?im)^[ \t]*(?:[0-9]+\.?|[IVXL]+\.?)?[ \t]*(?:references(?: and notes| cited)?|reference list|bibliography|literature cited|works cited|literatur|références|bibliografía)[ \t]*:?[ \t]*$")
_AFTER = re.compile(r"(?im)^[ \t]*(?:[A-Z0-9]+\.?)?[ \t]*(?:appendix|appendices|supplementary (?:material|information)|supporting information)\b[^\n]{0,60}$")


class Passage(NamedTuple):
    page: int
    ordinal: int
    section: str | None
    start: int
    end: int
    text: str


def references_span(pages: list[str]) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """(page, offset) of the last references heading and of what ends the list (the end of the text if nothing does); pages from 0."""
    for p in reversed(range(len(pages))):
        if heads := list(_REFERENCES.finditer(pages[p])):
            at = heads[-1].start()
            for q in range(p, len(pages)):
                if m := _AFTER.search(pages[q], at if q == p else 0):
                    return (p, at), (q, m.start())
            return (p, at), (len(pages), 0)
    return None


def _cuts(page: str, low: int, high: int) -> list[tuple[int, int]]:
    """Passages of page[low:high] as character offsets."""
    words = [(m.start(), m.end()) for m in re.compile(r"\S+").finditer(page, low, high)]

    def ends(k: int) -> bool:
        end = words[k][1]
        if k + 1 == len(words) and end == high or page.startswith("\n\n", end):
            return True
        if page[end - 1] not in ".?!":
            return False
        follow = page[words[k + 1][0]] if k + 1 < len(words) else ""
        return bool(follow) and (follow.isupper() or follow.isdigit() or follow == "(")

    out: list[tuple[int, int]] = []
    first = 0
    while len(words) - first >= TARGET:  # up to the first end of a sentence from the target on; if none comes, to the last one before it
        stop = next((k for k in range(first + TARGET - 1, min(first + MOST, len(words))) if ends(k)), None)
        if stop is None:
            if len(words) - first < MOST:
                break
            stop = next((k for k in range(first + TARGET - 2, first, -1) if ends(k)), first + MOST - 1)
        out.append((words[first][0], words[stop][1]))
        first = stop + 1
    if first < len(words):
        out.append((words[first][0], words[-1][1]))
    if len(out) > 1 and len(page[slice(*out[-1])].split()) < LEAST:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def passages(pages: list[str]) -> list[Passage]:
    """Passages of about 250 words that never cross a page nor the edge of the references; offsets in bytes of UTF-8."""
    span = references_span(pages)
    out: list[Passage] = []
    for p, page in enumerate(pages):
        edges = sorted({0, len(page), *(at for where, at in span or () if where == p)})
        at = start = 0  # the byte offset `start` belongs to the character `at`
        for low, high in zip(edges, edges[1:], strict=False):
            inside = span is not None and span[0] <= (p, low) < span[1]
            for a, b in _cuts(page, low, high):
                start += len(page[at:a].encode())
                end = start + len(page[a:b].encode())
                out.append(Passage(p + 1, len(out), "references" if inside else None, start, end, page[a:b]))
                at, start = b, end
    return out


# --- Clues ---------------------------------------------------------------------------------------------------------

# Patterns of arXiv stamps, DOIs and their labels, and of file names that are an identifier.
_STAMP = re.compile(r"(?i)\barXiv:\s*((?:\d{4}\.\d{4,5})|(?:[a-z-]+(?:\.[a-z]{2})?/\d{7}))(?:v\d+)?\s+(?:\[[^\]\n]{1,30}\]\s+)?\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}")
_DOI = re.compile(r"\b10\.\d{4,9}/[!#-;=?-Z^-z|~]+")
_LABEL = re.compile(r"(?i)(?:\bdoi\s*:?\s*|doi\.org/)$")
_ARXIV_NAME = re.compile(r"^\d{4}\.\d{4,5}(?:v\d+)?$")
_DOI_NAME = re.compile(r"^(10\.\d{4,9})[_/](.+)$")
_PMID = re.compile(r"\bPMID:?\s*([1-9][0-9]{4,8})\b")


def _own_brackets(doi: str) -> str:
    """A DOI up to a parenthesis that holds more than letters, digits and dashes: that isn't its own."""
    foreign = re.search(r"\((?![0-9A-Za-z-]+\))", doi)
    return doi[: foreign.start()] if foreign else doi


def dois(text: str) -> list[tuple[str, bool]]:
    """(DOI, whether a label stands before it); one that a line end breaks is joined."""
    joined = re.sub(r"(10\.\d{4,9}/\S*[.\-/_])\n(?=[0-9A-Za-z])", r"\1", text)
    return [(found, bool(_LABEL.search(joined[max(0, m.start() - 16) : m.start()]))) for m in _DOI.finditer(joined) if (found := normal_doi(balanced(_own_brackets(m[0]))))]


def clues(name: str, pages: list[str], metadata: tuple[str, ...] = (), most: int = 6) -> list[tuple[str, str]]:
    """Identifiers that may be the document's own, the surest first, each once."""
    first, second = (pages + ["", ""])[:2]
    lines = first.split("\n")
    edges = "\n".join(lines[:5]) + "\n\n" + "\n".join(lines[-5:])
    stem = re.sub(r"(?i)\.pdf$", "", name)
    found: list[tuple[str, str | None]] = [("arxiv", normal_arxiv(m[1])) for page in (first, second) for m in _STAMP.finditer(page)]
    if _ARXIV_NAME.match(stem):
        found.append(("arxiv", normal_arxiv(stem)))
    found += [("doi", d) for d, label in dois(edges) if label]
    found += [("doi", d) for value in metadata for d, _ in dois(value)]
    found += [("doi", d) for d, label in dois(first) if label]
    found += [("pmid", m[1]) for m in _PMID.finditer(first)]
    if m := _DOI_NAME.match(stem):
        found.append(("doi", normal_doi(f"{m[1]}/{m[2]}")))
    found += [("doi", d) for page in (first, second) for d, _ in dois(page)]
    return list(dict.fromkeys((k, v) for k, v in found if v))[:most]


def _key(text: str) -> str:
    return "".join(c for c in fold_text(text) if c.isalnum())


def _words(text: str) -> list[str]:
    """Folded runs of letters: a digit or mark set against a name doesn't hide it."""
    return "".join(c if c.isalpha() else " " for c in fold_text(text)).split()


def has_words(words: list[str], wanted: list[str]) -> bool:
    """Whether the wanted words stand in a row."""
    return bool(wanted) and f" {' '.join(wanted)} " in f" {' '.join(words)} "


def mentions_title(pages: list[str], title: str, surname: str | None) -> bool:
    """Whether a text names a work: its title (of ten bytes or more as a key) and, where known, its first author; else a long title before a colon."""
    key, there = _key(title), _key(" ".join(pages))
    if len(key.encode()) < 10 or surname and not any(has_words(_words(p), _words(surname)) for p in pages):
        return False
    main = _key(title.split(":")[0]) if surname and ":" in title else ""
    return key in there or len(main.encode()) >= 20 and main in there


def resembles(page: str, title: str, surname: str | None, share: float = 0.6, further: tuple[str, ...] = ()) -> bool:
    """Whether the top of a first page holds most words of a title, and it or a further page the author."""
    top = set(_words("\n".join(page.split("\n")[:12])))
    wanted = [w for w in _words(title) if len(w) >= 3]
    named = bool(surname) and any(has_words(_words(p), _words(surname)) for p in (page, *further))
    return named and len(wanted) >= 3 and sum(w in top for w in wanted) >= share * len(wanted)


def identity_matches(pages: list[str], title: str, surname: str | None) -> bool:
    """Whether a downloaded text is the work that was asked for: its first two pages mention or resemble it."""
    first = pages[:2]
    return bool(first) and (mentions_title(first, title, surname) or resembles(first[0], title, surname, further=tuple(first[1:])))
