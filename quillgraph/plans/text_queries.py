"""Text queries over documents and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from quillgraph.functions import identity, pagetext, textnorm
from quillgraph.operators import lists, text
from quillgraph.queries import query
from quillgraph.views import view

_V = pagetext._VOWEL
_N = "len(regexp_extract_all({0}, '{1}'))".format


@query(
    "txt2_quality",
    f"""WITH m AS (SELECT doc_id, text, {_N('text', '[^ \t\n\r\f\v]')} AS visible, {_N('text', r'\p{L}')} AS letters, {_N('text', r'\p{Latin}')} AS latin, {_N('text', _V)} AS vowels,
        list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda t: regexp_matches(t, '\\p{{L}}')) AS tokens FROM documents),
    k AS (SELECT *, list_transform(tokens, lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{Nd}}]+|[^\\p{{L}}\\p{{Nd}}]+$', '', 'g')) AS cores FROM m),
    w AS (SELECT *, len(list_filter(cores, lambda c: regexp_matches(c, '\\p{{L}}') AND 4 * len(regexp_extract_all(c, '[^\\p{{L}}\\-''’]')) <= len(regexp_extract_all(c, '\\p{{L}}'))
        AND NOT (len(regexp_extract_all(c, '\\p{{Latin}}')) = len(regexp_extract_all(c, '\\p{{L}}')) AND len(regexp_extract_all(c, '\\p{{Latin}}')) >= 3 AND NOT regexp_matches(c, '{_V}')))) AS good FROM k)
    SELECT doc_id, CASE WHEN visible < 100 THEN 'no-text' WHEN letters < 0.35 * visible THEN 'gibberish' WHEN 2 * latin > letters AND vowels < 0.25 * latin THEN 'gibberish' WHEN len(tokens) > 0 AND good < 0.45 * len(tokens) THEN 'gibberish' ELSE 'ok' END AS status FROM w""",
)
def _txt2(spark, d):
    return view(spark, d, "documents").select("doc_id", pagetext.quality(F.col("text")).alias("status"))


def _works(spark, d):
    return view(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.array("text").alias("pages"))


_LIGATED = "text"
for _a, _b in pagetext.LIGATURES.items():
    _LIGATED = f"replace({_LIGATED}, '{_a}', '{_b}')"


@query("txt1_clean", rf"""WITH a AS (SELECT doc_id, nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text FROM documents), b AS (SELECT doc_id, regexp_replace(text, '-\n([0-9])', '-\1', 'g') AS text FROM a), c AS (SELECT doc_id, {_LIGATED} AS text FROM b),
    e AS (SELECT doc_id, ltrim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x09\x0B-\x1F\x7F-\x{{9F}}\p{{Co}}\p{{Zs}}]', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\n +', chr(10), 'g'), ' ') AS text FROM c)
    SELECT 'D' || doc_id AS work_id, trim(regexp_replace(regexp_replace(text, ' +\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM e""")
def _txt1(spark, d):
    return text.cleaned(_works(spark, d)).select("work_id", F.get("pages", F.lit(0)).alias("text"))


@query("txt3_passages")
def _txt3(spark, d):
    return text.passages(text.read(_works(spark, d)))


@query("txt10_read")
def _txt10(spark, d):
    return text.read(_works(spark, d)).select("work_id", "pages", "chars", "status", F.size("passages").alias("passages"))


@query("fts13_page_text")
def _fts13(spark, d):
    return text.page_text(text.passages(text.read(_works(spark, d))))


_CITED = "As was shown before [1, 3-4] this holds.\n\nReferences\n" + "\n".join(f"[{i}] Inor A. Lasting studies number {w} anew. Journal {i}, 200{i}." for i, w in enumerate(("one", "two", "three", "four", "five"), 1))


@query("ctx_mentions", "SELECT 'D' || doc_id AS from_work, r AS to_work, 1 AS page, 'bracket' AS method, CAST(0.9 AS DOUBLE) AS confidence FROM documents, (VALUES ('R1'), ('R3'), ('R4')) t(r)")
def _ctx(spark, d):
    """Every document with a closing sentence that cites three of five listed references."""
    works = view(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.array(F.concat("text", F.lit("\n\n" + _CITED))).alias("pages"))
    refs = spark.createDataFrame([(i, f"R{i}", f"Lasting studies number {w} anew", 2000 + i, "Inor", 1) for i, w in enumerate(("one", "two", "three", "four", "five"), 1)], "ref_seq int, id string, title string, year int, surname string, authors int")
    every = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in refs.collect()])
    listed = works.select("work_id", F.explode(every).alias("r")).select("work_id", "r.*", F.lit(None).cast("string").alias("doi"))
    return text.mentions(works, listed).select("from_work", "to_work", "page", "method", "confidence")


@query("scal2_title_key", "SELECT doc_id, regexp_replace(lower(string_split(text, chr(10))[1]), '[^\\p{L}\\p{Nd}]', '', 'g') AS key FROM documents")
def _scal2(spark, d):
    return view(spark, d, "documents").select("doc_id", textnorm.title_key(F.get(F.split("text", "\n"), F.lit(0))).alias("key"))


@query(
    "scal3_similar_names",
    "WITH k AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g') AS a FROM part), t AS (SELECT *, regexp_replace(lower('red widgets'), '[^\\p{L}\\p{Nd}]', '', 'g') AS b FROM k) SELECT p_partkey, round(CASE WHEN a = '' THEN 0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS similarity FROM t",
)
def _scal3(spark, d):
    return view(spark, d, "part").select("p_partkey", F.round(textnorm.similarity(F.col("p_name"), F.lit("red widgets")), 6).alias("similarity"))


@query("scal4_doi", r"""WITH x AS (SELECT page_id, 'https://doi.org/10.' || (1000 + page_id % 9000) || '/ABC(' || page_id || ')' || CASE page_id % 4 WHEN 0 THEN ').' WHEN 1 THEN ';' ELSE '' END AS raw FROM pages) SELECT page_id, '10.' || (1000 + page_id % 9000) || '/abc(' || page_id || ')' AS doi FROM x""")
def _scal4(spark, d):
    raw = F.concat(F.lit("https://doi.org/10."), (1000 + F.col("page_id") % 9000).cast("string"), F.lit("/ABC("), F.col("page_id").cast("string"), F.lit(")"), F.when(F.col("page_id") % 4 == 0, ").").when(F.col("page_id") % 4 == 1, ";").otherwise(""))
    return view(spark, d, "pages").select("page_id", identity.doi_of(raw).alias("doi"))


@query("scal9_tokens", f"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(strip_accents(string_split(text, chr(10))[1])), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents) SELECT word, count(*) AS titles FROM t WHERE octet_length(encode(word)) >= 3 AND word NOT IN ({', '.join(f"'{w}'" for w in sorted(textnorm.STOP))}) GROUP BY word""")
def _scal9(spark, d):
    """Folded title words, as (word, titles)."""
    @F.pandas_udf(ArrayType(StringType()))
    def words(t: pd.Series) -> pd.Series:
        return t.map(lambda x: sorted(set(textnorm.tokens(x or ""))))

    titles = view(spark, d, "documents").select(F.get(F.split("text", "\n"), F.lit(0)).alias("t"))
    return titles.select(F.explode(words("t")).alias("word")).groupBy("word").agg(F.count("*").alias("titles"))


@query("scal11_abstract", "SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' '), '^ | $', '', 'g') AS abstract FROM documents")
def _scal11(spark, d):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    index = lists.inverted(view(spark, d, "documents").select("doc_id", words.alias("words")), "doc_id")
    return index.select("doc_id", identity.abstract_of(F.col("index")).alias("abstract"))


@query("scal14_surname", "SELECT s_suppkey, list_last(string_split(trim(regexp_replace(s_name, '#', ' ')), ' ')) AS surname FROM supplier")
def _scal14(spark, d):
    return view(spark, d, "supplier").select("s_suppkey", textnorm.surname(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("surname"))


@query("scal15_display_title", "SELECT work_id, coalesce(nullif(trim(title), ''), index_id, work_id) AS title FROM {works}")
def _scal15(spark, d):
    return view(spark, d, "works").select("work_id", identity.display_title(F.col("title"), F.col("index_id"), F.col("work_id")).alias("title"))


@query("scal16_in_text", "WITH a AS (SELECT work_id, list(n.name ORDER BY position) AS names FROM {authorship} JOIN {authors} n USING (author_id) GROUP BY 1) SELECT work_id, CASE len(names) WHEN 1 THEN names[1] WHEN 2 THEN names[1] || ' and ' || names[2] ELSE names[1] || ' et al.' END AS cited FROM a")
def _scal16(spark, d):
    names = view(spark, d, "authorship").join(view(spark, d, "authors"), "author_id").groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("names"))
    return names.select("work_id", identity.in_text(F.col("names"), F.lit(None).cast("int")).alias("cited"))


@query("scal18_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def _scal18(spark, d):
    return view(spark, d, "orders").select("o_orderkey", identity.year_of(F.date_format("o_orderdate", "d MMM yyyy")).alias("year"))


@query("exp3_overlap", r"""WITH l AS (SELECT doc_id AS id, list_filter(string_split(regexp_replace(text, '\n', ' ', 'g'), ' '), lambda w: w <> '') AS a, list_filter(string_split(string_split(text, chr(10))[1], ' '), lambda w: w <> '') AS b FROM documents),
    x AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(a) AS w FROM l) u GROUP BY ALL), y AS (SELECT id, w, count(*) AS m FROM (SELECT id, unnest(b) AS w FROM l) u GROUP BY ALL), s AS (SELECT id, sum(least(n, m)) AS same FROM x JOIN y USING (id, w) GROUP BY id)
    SELECT l.id, round(CASE WHEN len(a) + len(b) > 0 THEN 2 * coalesce(same, 0) / (len(a) + len(b)) ELSE 0 END, 6) AS f1 FROM l LEFT JOIN s USING (id)""")
def _exp3(spark, d):
    docs = view(spark, d, "documents")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    left = docs.select(F.col("doc_id").alias("id"), words(F.replace("text", F.lit("\n"), F.lit(" "))).alias("words"))
    right = docs.select(F.col("doc_id").alias("id"), words(F.get(F.split("text", "\n"), F.lit(0))).alias("words"))
    return text.shingle_recall(left, right).select("id", F.round("f1", 6).alias("f1"))


@query("exp6_sample", "SELECT type, work_id, CAST(place AS INT) AS place FROM (SELECT type, work_id, row_number() OVER (PARTITION BY type ORDER BY md5('42:' || work_id), work_id) AS place FROM {works}) x WHERE place <= 10")
def _exp6(spark, d):
    """Ten works of each type, in the order of a seeded hash (sampling is the feature)."""
    works = view(spark, d, "works").select("type", "work_id", F.md5(F.concat(F.lit("42:"), "work_id").cast("binary")).alias("h"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("h", "work_id"))
    return works.withColumn("place", place).filter("place <= 10").select("type", "work_id", "place")


_FOLD = "strip_accents(lower({0}))"
_KEY = "regexp_replace(" + _FOLD + ", '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_WORDS = "list_filter(string_split_regex(" + _FOLD + ", '[^\\p{{L}}]+'), lambda x: x <> '')"
_ROW = "contains(' ' || array_to_string({0}, ' ') || ' ', ' ' || array_to_string({1}, ' ') || ' ')"


@query("txt12_identity", f"""WITH a AS (SELECT d.doc_id, d.text, coalesce(string_split(o.text, chr(10))[1], '') AS title, CASE WHEN d.doc_id % 2 = 0 THEN regexp_extract(d.text, '[^\\s]+') END AS surname FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + d.doc_id % 3),
    k AS (SELECT *, {_KEY.format("title")} AS key, {_KEY.format("text")} AS there, {_WORDS.format("text")} AS words, {_WORDS.format("surname")} AS own, {_WORDS.format("array_to_string(string_split(text, chr(10))[1:12], chr(10))")} AS top, list_filter({_WORDS.format("title")}, lambda x: length(x) >= 3) AS wanted, {_KEY.format("string_split(title, ':')[1]")} AS main FROM a),
    n AS (SELECT *, coalesce(surname, '') <> '' AS known, len(own) > 0 AND {_ROW.format("words", "own")} AS there_by_name FROM k)
    SELECT doc_id, octet_length(encode(key)) >= 10 AND (NOT known OR there_by_name) AND (contains(there, key) OR known AND contains(title, ':') AND octet_length(encode(main)) >= 20 AND contains(there, main))
        OR known AND coalesce(there_by_name, FALSE) AND len(wanted) >= 3 AND len(list_filter(wanted, lambda x: list_contains(top, x))) >= 0.6 * len(wanted) AS same FROM n""")
def _txt12(spark, d):
    """Whether documents are the works that were asked for: a third by their own first line, the others by that of a document after them; every second with its first word as the author's name."""
    docs = view(spark, d, "documents")
    asked = docs.select((F.col("doc_id")).alias("asked"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    rows = docs.select("doc_id", "text", (F.col("doc_id") + F.col("doc_id") % 3).alias("asked")).join(asked, "asked", "left")
    surname = F.when(F.col("doc_id") % 2 == 0, F.regexp_extract("text", r"\S+", 0))
    return text.identity_checked(rows.select("doc_id", F.array("text").alias("pages"), F.coalesce("title", F.lit("")).alias("title"), surname.alias("surname"))).select("doc_id", "same")


@query("src11_front_title", "SELECT p_partkey, p_name || ' ' || p_brand || ' again' AS title FROM part")
def _src11(spark, d):
    """The title candidate of a front page out of runs of text with sizes and places."""
    from quillgraph.operators.text import front_titles

    run = lambda t, size, top, left: F.struct(t.cast("string").alias("text"), F.lit(size).alias("size"), F.lit(top).alias("top"), F.lit(left).alias("left"))
    runs = F.array(run(F.lit("X"), 40.0, 700.0, 0.0), run(F.concat("p_brand", F.lit(" again")), 20.1, 600.0, 90.0), run(F.col("p_name"), 20.0, 601.0, 10.0), run(F.lit("arXiv:2101.00001v2 [cs.CL] 3 Jan 2021"), 30.0, 400.0, 0.0), run(F.lit("many more words of the page itself"), 10.0, 500.0, 0.0))
    return front_titles(view(spark, d, "part").select(F.col("p_partkey").alias("work_id"), F.explode(runs).alias("r")).select("work_id", "r.*")).withColumnRenamed("work_id", "p_partkey")


@query("exp4_reference_recall", "SELECT 5 * count(*) AS listed, 5 * count(*) - 2 * count(*) FILTER (doc_id % 2 = 0) AS matched, 5 * count(*) - 2 * count(*) FILTER (doc_id % 2 = 0) AS confirmed, round((5 * count(*) - 2 * count(*) FILTER (doc_id % 2 = 0)) / (5 * count(*)), 6) AS recall, 1.0::DOUBLE AS precision FROM documents")
def _exp4(spark, d):
    """Entries of reference lists matched to known references, against the truth; in every second list two entries have lost their titles and years."""
    whole = _CITED.split("References\n")[1]
    broken = "\n".join(line if n not in (1, 3) else f"[{n + 1}] Somebody Else. Unknown." for n, line in enumerate(whole.split("\n")))
    works = view(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.array(F.concat(F.lit("Body.\n\nReferences\n"), F.when(F.col("doc_id") % 2 == 0, broken).otherwise(whole))).alias("pages"))
    refs = F.array(*[F.struct(F.lit(i).alias("ref_seq"), F.lit(f"R{i}").alias("id"), F.lit(f"Lasting studies number {w} anew").alias("title"), F.lit(2000 + i).alias("year"), F.lit("Inor").alias("surname"), F.lit(1).alias("authors"), F.lit(None).cast("string").alias("doi")) for i, w in enumerate(("one", "two", "three", "four", "five"), 1)])
    listed = works.select("work_id", F.explode(refs).alias("r")).select("work_id", "r.*")
    return text.matching_quality(text.listed_references(works, listed), listed.select("work_id", F.col("id").alias("ref")))
