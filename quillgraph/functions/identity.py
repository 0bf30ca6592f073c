"""Identifiers of works: recognising them and bringing them to one form.

`parse` runs on typed input, one value at a time; the column functions do the same for
DataFrames in built-in expressions.
"""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The shapes of public identifiers.
DOI = r"^10\.[0-9]{4,9}(?:\.[0-9]+)*/\S+$"
DOI_PREFIX = r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*"
INDEX_ID = r"^W[1-9][0-9]*$"
ARXIV_NEW = r"^[0-9]{2}(?:0[1-9]|1[0-2])\.[0-9]{4,5}$"
ARXIV_OLD = r"^[a-z]+(?:-[a-z]+)*(?:\.[A-Z]{2})?/[0-9]{2}(?:0[1-9]|1[0-2])[0-9]{3}$"
PMID = r"^[1-9][0-9]*$"
WORK_ID = r"^F[0-9A-HJKMNP-TV-Z]{8}$"
PAGE_TAIL = r"(?i)(?:\.(?:pdf|html?|xml|txt|full|abstract)|/(?:full|abstract|pdf|epdf|html))$"


KIND_VALUE = StructType([StructField("kind", StringType()), StructField("value", StringType())])


class Identity(NamedTuple):
    kind: str
    value: str


class BadIdentity(ValueError):
    """Looks like an identifier of a kind and isn't one."""


def balanced(text: str) -> str:
    """Without full stops, commas and semicolons at the end, and without closing parentheses that nothing opens."""
    while text:
        if text[-1] in ".,;" or (text[-1] == ")" and text.count(")") > text.count("(")):
            text = text[:-1]
        else:
            break
    return text


def normal_doi(text: str) -> str | None:
    found = balanced(unquote(re.sub(DOI_PREFIX, "", text.strip()))).lower()
    return found if re.match(DOI, found) else None


def normal_index_id(text: str) -> str | None:
    found = re.split(r"[?#]", text.strip().rstrip("/"))[0].rsplit("/", 1)[-1].upper()
    return found if re.match(INDEX_ID, found) else None


def normal_arxiv(text: str) -> str | None:
    found = re.sub(r"v[0-9]+$", "", re.sub(r"(?i)\.pdf$", "", text.strip()))
    return found if re.match(ARXIV_NEW, found) or re.match(ARXIV_OLD, found) else None


def normal_work_id(text: str) -> str | None:
    found = text.strip().upper()
    return found if re.match(WORK_ID, found) and any(c.isdigit() for c in found[1:]) else None


def _of_url(url: str) -> Identity:
    parts = urlsplit(url if "://" in url else f"https://{url}")
    host, path = (parts.hostname or "").removeprefix("www."), unquote(parts.path)
    if host in ("doi.org", "dx.doi.org"):
        if found := normal_doi(path.lstrip("/")):
            return Identity("doi", found)
        raise BadIdentity(url)
    if host.endswith("openalex.org"):
        if found := normal_index_id(path):
            return Identity("index", found)
        raise BadIdentity(url)
    if host.endswith("arxiv.org") and (m := re.match(r"/(?:abs|pdf|html)/(.+)$", path)):
        if found := normal_arxiv(m[1].rstrip("/")):
            return Identity("arxiv", found)
        raise BadIdentity(url)
    if (host == "pubmed.ncbi.nlm.nih.gov" and (m := re.match(r"/([0-9]+)", path))) or (host == "ncbi.nlm.nih.gov" and (m := re.match(r"/pubmed/([0-9]+)", path))):
        return Identity("pmid", m[1])
    if m := re.search(r"10\.[0-9]{4,9}(?:\.[0-9]+)*/.+", path):
        tail = m[0].rstrip("/")
        while (cut := re.sub(PAGE_TAIL, "", tail)) != tail:
            tail = cut
        if found := normal_doi(re.sub(r"^(10\.1101/[0-9.]+)v[0-9]+$", r"\1", tail)):
            return Identity("doi", found)
    return Identity("url", url)


def parse(typed: str) -> Identity:
    """Work id, index id, DOI, arXiv, PMID, URL or, failing all, a title; a malformed identifier is an error, not a title."""
    text = typed.strip()
    if not text:
        raise BadIdentity(typed)
    if found := normal_work_id(text):
        return Identity("work", found)
    if m := re.match(r"(?i)^(doi|arxiv|pmid|openalex)(?:\s*:\s*|\s+)(\S.*)$", text):
        kind = m[1].lower()
        found = {"doi": normal_doi, "arxiv": normal_arxiv, "openalex": normal_index_id, "pmid": lambda x: x if re.match(PMID, x) else None}[kind](m[2])
        if found:
            return Identity("index" if kind == "openalex" else kind, found)
        if " " not in m[2].strip():
            raise BadIdentity(typed)
    if re.match(r"(?i)^w[0-9]+$", text):
        if found := normal_index_id(text):
            return Identity("index", found)
        raise BadIdentity(typed)
    if re.match(r"(?i)^https?://", text) or re.match(r"(?i)^(?:[a-z0-9-]+\.)+[a-z]{2,}/", text):
        return _of_url(text)
    if text.startswith("10.") and "/" in text:
        if found := normal_doi(text):
            return Identity("doi", found)
        raise BadIdentity(typed)
    if found := normal_arxiv(text):
        return Identity("arxiv", found)
    if re.match(r"^[0-9]{5,}$", text):
        if re.match(PMID, text):
            return Identity("pmid", text)
        raise BadIdentity(typed)
    return Identity("title", text)


def doi_of(c: Column) -> Column:
    """A DOI without resolver and punctuation at its end, lower case; null if it isn't one."""
    bare = F.try_url_decode(F.regexp_replace(F.trim(c), DOI_PREFIX, ""))
    cut = F.lower(F.regexp_replace(bare, r"[.,;]+$", ""))
    closes = F.regexp_count(cut, F.lit(r"\)")) > F.regexp_count(cut, F.lit(r"\("))
    cut = F.when(closes, F.regexp_replace(cut, r"\)[.,;]*$", "")).otherwise(cut)
    return F.when(F.rlike(cut, F.lit(DOI)), cut)


def index_id_of(c: Column) -> Column:
    last = F.upper(F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), "/+$", ""), "/"), -1))
    return F.when(F.rlike(last, F.lit(INDEX_ID)), last)


def arxiv_of(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\.pdf$", ""), r"v[0-9]+$", "")
    return F.when(F.rlike(bare, F.lit(ARXIV_NEW)) | F.rlike(bare, F.lit(ARXIV_OLD)), bare)


def abstract_of(index: Column) -> Column:
    """The text of an inverted index (word -> positions)."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def expand_ranges(text: str, most: int = 30) -> list[int]:
    """The numbers of "3-5, 9"; empty if a range runs backwards or over more than `most`."""
    out: list[int] = []
    for part in re.split(r"\s*[,;]\s*", text.strip()):
        if not (m := re.fullmatch(r"(\d{1,3})(?:\s*[–—-]\s*(\d{1,3}))?", part)):
            return []
        first, last = int(m[1]), int(m[2] or m[1])
        if last < first or last - first >= most:
            return []
        out += range(first, last + 1)
    return out


def ranges_of(c: Column, most: int = 30) -> Column:
    """`expand_ranges` of a column, in built-in expressions: the whole is matched once, each part looked at once, and a bad range makes all of them null."""
    part = r"[0-9]{1,3}(?:\s*[–—-]\s*[0-9]{1,3})?"
    good = F.rlike(c, F.lit(rf"^\s*{part}(?:\s*[,;]\s*{part})*+\s*$"))
    parts = F.split(F.translate(c, "–—; \t\n\x0b\f\r", "--,"), ",")
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "-", 1).try_cast("int").alias("a"), F.substring_index(p, "-", -1).try_cast("int").alias("b")))
    numbers = F.flatten(F.transform(pairs, lambda p: F.when((p["b"] >= p["a"]) & (p["b"] - p["a"] < most), F.sequence(p["a"], p["b"]))))
    return F.coalesce(F.when(good, numbers), F.when(c.isNotNull(), F.array().cast("array<int>")))


@F.pandas_udf(KIND_VALUE)
def of_url(urls: pd.Series) -> pd.DataFrame:
    """The identifier in a URL; `url` where there is none, `bad` where there should be one."""

    def one(url: str) -> tuple[str, str]:
        try:
            return tuple(_of_url(url))
        except (BadIdentity, ValueError):
            return "bad", url

    return pd.DataFrame([one(u) if isinstance(u, str) else (None, None) for u in urls], columns=["kind", "value"])


def year_of(c: Column) -> Column:
    """The first year 1500-2099 in a free date."""
    found = F.regexp_extract(c, r"(?:^|[^0-9])(1[5-9][0-9]{2}|20[0-9]{2})(?:[^0-9]|$)", 1)
    return F.when(found != "", found.cast("int"))


def display_title(title: Column, index_id: Column, work_id: Column) -> Column:
    return F.coalesce(F.when(F.trim(title) != "", title), index_id, work_id)


def in_text(surnames: Column, year: Column) -> Column:
    """How a text cites a work: "A", "A and B" or "A et al.", with the year."""
    n = F.size(surnames)
    who = F.when(n == 1, F.get(surnames, F.lit(0))).when(n == 2, F.concat_ws(" and ", surnames)).when(n > 2, F.concat(F.get(surnames, F.lit(0)), F.lit(" et al.")))
    return F.when(year.isNotNull(), F.concat_ws(", ", who, year.cast("string"))).otherwise(who)


def best_page(doi: Column, landing: Column, open_url: Column, index_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://doi.org/"), doi), landing, open_url, F.concat(F.lit("https://openalex.org/"), index_id))


def pdf_links(best: Column, listed: Column) -> Column:
    """Open http(s) PDF links of locations (struct with url, is_oa, version): the best first, each URL once, versions in order."""
    ranks = F.array(*map(F.lit, ("published", "accepted", "preprint")))
    every = F.filter(F.concat(F.array(best), F.coalesce(listed, F.array())), lambda x: x["is_oa"] & F.rlike(x["url"], F.lit("^https?://")))
    numbered = F.transform(every, lambda x, i: F.struct(F.when(F.array_position(ranks, x["version"]) > 0, F.array_position(ranks, x["version"])).otherwise(F.lit(4)).alias("rank"), i.alias("i"), x["url"].alias("url")))
    first = F.filter(numbered, lambda x, i: ~F.exists(F.slice(numbered, 1, i), lambda y: y["url"] == x["url"]))
    return F.transform(F.array_sort(first), lambda x: x["url"])
