"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.toxicity import fit, score

    docs = _docs(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("id", "doc_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.simhash import near_duplicates

    found = near_duplicates(_docs(spark, sf_dir), width=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a ledger table, which begins empty in each call."""
    from quillgraph.llm.common import place_for
    from quillgraph.llm.secrets import digest, update

    return digest(update(_docs(spark, sf_dir), place_for(spark, "ledger")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.packing import pack_online

    return pack_online(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("ids")


def op5_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sequence, with checksums of its row of the id matrix and of its positions."""
    from quillgraph.llm.packing import pack_decreasing

    packed = pack_decreasing(_docs(spark, sf_dir))
    return packed.select("sequence_id", "doc_ids", "starts", "cu_seqlens", F.element_at("cu_seqlens", -1).cast("long").alias("used"), F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.licenses import labels

    return labels(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.sharding import assign

    placed = assign(_docs(spark, sf_dir), [1.0] * 8, grown=[1.0] * 9)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.langid import fit, predict

    docs = _docs(spark, sf_dir)
    return predict(docs, fit(docs)).withColumnRenamed("id", "doc_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.decontaminate import matches

    return matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.quality import judge

    judged = judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.whiten import fit, whiten

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(table, fit(table)).withColumnRenamed("id", "vec_id")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.clusters import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.ngrams import fit, score

    docs = _docs(spark, sf_dir)
    return score(docs, fit(docs)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op5_token_matrix": op5_token_matrix,
    "op6_licenses": op6_licenses,
    "op7_sharding": op7_sharding,
    "op8_language": op8_language,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op11_whitening": op11_whitening,
    "op12_clusters": op12_clusters,
    "op13_language_model": op13_language_model,
}



def _secrets_sql() -> str:
    """The spans of each rule: what splitting leaves between the matches gives their positions."""
    from quillgraph.llm.secrets import RULES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    parts = []
    for place, r in enumerate(RULES):
        pattern = r.pattern.replace(")++", ")+")  # the same here: nothing follows that could match less
        if pattern.startswith("(?i)"):  # here A-Z alone is meant
            head, tail = pattern[4:].split(")", 1)
            pattern = "(" + "|".join(map(any_case, head[1:].split("|"))) + ")" + tail
        q = quoted(pattern)
        parts.append(f"""SELECT doc_id, {place} AS place, {quoted(r.kind)} AS kind, s AS start, s + length(m) AS "end" FROM (SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s, unnest(ms) AS m, unnest(own) AS o
            FROM (SELECT doc_id, string_split_regex(text, {q}) AS ps, regexp_extract_all(text, {q}, 0) AS ms, regexp_extract_all(text, {q}, {r.group}) AS own FROM documents WHERE text IS NOT NULL)) WHERE length(o) >= {r.least}""")
    base = [i for i, r in enumerate(RULES) if r.base]
    counts = ", ".join(f"count(*) FILTER (place = {i}) AS n_{RULES[i].kind}" for i in base)
    return f"""WITH s AS ({" UNION ALL ".join(parts)}), t AS (SELECT *, kind || ':' || start || ':' || "end" AS spelt FROM s)
        SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(spelt, ',' ORDER BY start, place) FILTER (place <= {max(base)}), '')) AS base_sha256, coalesce(string_agg(spelt, ',' ORDER BY start, place), '') AS spans
        FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id"""


def _licenses_sql() -> str:
    """Diagonals of word grams, merged and verified, by text instead of hash."""
    from quillgraph.llm.licenses import COVER, DRIFT, SEPARATORS, SHORT, TEMPLATES

    rows = ", ".join(f"({n}, '{t.label}', {t.base}, {t.width}, {len(t.words)}, {at}, '{' '.join(t.words[at : at + t.width])}')" for n, t in enumerate(TEMPLATES) for at in range(len(t.words) - t.width + 1))
    rolled = " UNION ALL ".join(f"SELECT doc_id, {k} AS width, unnest(range(len(w) - {k - 1})) AS pos, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM d WHERE len(w) >= {k}" for k in sorted({t.width for t in TEMPLATES}))
    return f"""WITH l(tpl, label, base, width, total, spot, gram) AS (VALUES {rows}),
        d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
        h AS (SELECT DISTINCT doc_id, tpl, label, base, l.width, total, pos - spot AS diagonal, spot FROM ({rolled}) g JOIN l USING (width, gram)),
        v AS (SELECT doc_id, tpl, label, base, width, total, diagonal, min(spot) AS a, max(spot) AS b, count(*) AS n FROM h GROUP BY ALL),
        p AS (SELECT doc_id, label, base, diagonal AS first, 1.0::DOUBLE AS cover FROM v WHERE width = {SHORT} AND n = total - {SHORT - 1}),
        m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) AS run FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) > {DRIFT} THEN 1 ELSE 0 END AS new FROM v WHERE width <> {SHORT}) x),
        c AS (SELECT m.doc_id, m.tpl, m.label, m.base, m.run, m.total, count(DISTINCT h.spot + o) AS n, min(m.diagonal + m.a) AS first FROM m JOIN h USING (doc_id, tpl, diagonal), range(5) t(o) GROUP BY ALL),
        s AS (SELECT doc_id, label, base, first, cover FROM p UNION ALL SELECT doc_id, label, base, first, round(n / total, 6) FROM c WHERE round(n / total, 6) >= {COVER}),
        a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM s GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN a USING (doc_id)"""


def _sharding_sql() -> str:
    """Slots of equal order, checksums by the bit-by-bit rule over four bits at a time."""
    best = lambda n: f"CAST(list_position(u, list_max(u[1:{n}])) - 1 AS INT)"
    nibbles = "list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(t)) + 1), lambda i: CAST(strpos('0123456789ABCDEF', substr(x, i + 2 * (i % 2) - 1, 1)) - 1 AS BIGINT))), lambda a, b: xor(a >> 4, k[xor(a, b) % 16 + 1]))"
    return f"""WITH k AS (SELECT list_transform(range(16), lambda n: list_reduce(list_prepend(n, range(4)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS k),
        d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x, list_transform(range(9), lambda s: (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s), 1, 13) AS BIGINT))) AS u FROM documents),
        c AS (SELECT doc_id, t, u, CASE WHEN t = '' THEN 0 ELSE xor({nibbles}, 4294967295) END AS text_crc32 FROM d, k),
        p AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':slot'), 1, 3))::INT AS bucket, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, text_crc32, {best(8)} AS shard, {best(9)} AS grown_shard FROM c)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM p"""


def _clusters_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Each round measures every vector against every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM kept QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d := list_sum(list_transform(list_zip(kept.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) AS best FROM kept, c{r} GROUP BY row)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT best.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN kept USING (row), range(1, {dims + 1}) t(i) GROUP BY ALL),
            c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(parts)}, t AS (SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance FROM a{rounds} JOIN kept USING (row))
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM t JOIN c{rounds} ON c = cluster"""


ORACLE_SQL: dict[str, str] = {"op12_clusters": _clusters_sql(), "op1_secrets": _secrets_sql(), "op6_licenses": _licenses_sql(), "op7_sharding": _sharding_sql()}
