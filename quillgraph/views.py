"""The citation graph and its library, derived from the driver's tables.

Each view is one SELECT in the SQL that Spark and DuckDB share; `{name}` stands for a
table or an earlier view.  Spark binds the placeholders to DataFrames, `sql()` to CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # Nodes: customers and orders have been fetched, the others are stubs; arrival is the order in which they came.
    "works": """
        SELECT 'C' || c_custkey AS work_id, 'C' || c_custkey AS index_id, c_name AS title, CAST(NULL AS INT) AS year, c_mktsegment AS venue,
               'customer' AS type, CAST(0 AS BIGINT) AS cited_by_count, TRUE AS hydrated, c_custkey % 10 = 0 AS is_seed, 0 AS depth, FALSE AS unresolved, c_custkey AS arrival FROM {customer}
        UNION ALL SELECT 'O' || o_orderkey, 'O' || o_orderkey, o_orderpriority, CAST(year(o_orderdate) AS INT), o_orderstatus, 'order', CAST(0 AS BIGINT), TRUE, FALSE, 1, FALSE, 1000000000000 + o_orderkey FROM {orders}
        UNION ALL SELECT 'P' || p_partkey, 'P' || p_partkey, p_name, CAST(NULL AS INT), p_brand, 'part', CAST(p_size AS BIGINT), FALSE, FALSE, 2, p_partkey % 50 = 0, 2000000000000 + p_partkey FROM {part}
        UNION ALL SELECT 'S' || s_suppkey, 'S' || s_suppkey, s_name, CAST(NULL AS INT), CAST(NULL AS VARCHAR(99)), 'supplier', CAST(0 AS BIGINT), FALSE, FALSE, 3, FALSE, 3000000000000 + s_suppkey FROM {supplier}
        UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey, n_name, CAST(NULL AS INT), CAST(NULL AS VARCHAR(99)), 'nation', CAST(0 AS BIGINT), FALSE, FALSE, 4, FALSE, 4000000000000 + n_nationkey FROM {nation}
        UNION ALL SELECT 'R' || r_regionkey, CAST(NULL AS VARCHAR(99)), r_name, CAST(NULL AS INT), CAST(NULL AS VARCHAR(99)), 'region', CAST(0 AS BIGINT), FALSE, FALSE, 5, FALSE, 5000000000000 + r_regionkey FROM {region}""",
    "edges": """
        SELECT DISTINCT 'C' || o_custkey AS from_work, 'O' || o_orderkey AS to_work FROM {orders}
        UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey FROM {lineitem}
        UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey FROM {lineitem}
        UNION ALL SELECT DISTINCT 'S' || s_suppkey, 'N' || s_nationkey FROM {supplier}
        UNION ALL SELECT DISTINCT 'N' || n_nationkey, 'R' || n_regionkey FROM {nation}""",
    "cites": "SELECT from_work, to_work, row_number() OVER (PARTITION BY from_work ORDER BY to_work) AS ref_seq FROM {edges}",
    "authors": "SELECT 'S' || s_suppkey AS author_id, s_name AS name FROM {supplier}",
    "authorship": """SELECT work_id, author_id, row_number() OVER (PARTITION BY work_id ORDER BY author_id) - 1 AS position
        FROM (SELECT DISTINCT 'P' || l_partkey AS work_id, 'S' || l_suppkey AS author_id FROM {lineitem}) AS x""",
    # The user's layer: regions hold nations as collections, market segments are labels.
    "collections": """SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS INT) AS parent_id FROM {region}
        UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey FROM {nation}""",
    "collection_work": "SELECT 100 + c_nationkey AS collection_id, 'C' || c_custkey AS work_id FROM {customer}",
    "labels_of": """SELECT c_mktsegment AS label, 'C' || c_custkey AS work_id FROM {customer}
        UNION ALL SELECT 'rich', 'C' || c_custkey FROM {customer} WHERE c_acctbal > 5000""",
    "label_names": "SELECT DISTINCT label AS name FROM {labels_of} UNION ALL SELECT 'unused'",
    "favourites": "SELECT 'C' || c_custkey AS work_id FROM {customer} WHERE c_acctbal < 0",
    "files": """SELECT 'P' || p_partkey AS work_id, lower(p_brand) || '/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.PDF' WHEN p_size % 3 = 1 THEN '.pdf' ELSE '.txt' END AS path,
               p_size % 7 = 0 AS missing, CASE p_size % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'accepted' WHEN 2 THEN 'preprint' ELSE 'other' END AS version, p_size AS added_at FROM {part}
        UNION ALL SELECT 'P' || p_partkey, 'copies/' || p_partkey || '.pdf', FALSE, 'preprint', 0 FROM {part} WHERE p_partkey % 5 = 0""",
    "read_state": """SELECT 'P' || p_partkey AS work_id, CASE WHEN p_size % 10 = 0 THEN 'no-text' WHEN p_size % 10 = 1 THEN 'gibberish' ELSE 'ok' END AS status, p_size AS pages FROM {part} WHERE p_partkey % 2 = 0""",
    "pdf_state": """SELECT 'P' || p_partkey AS work_id, CASE p_size % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'none' END AS availability FROM {part} WHERE p_partkey % 3 = 0""",
    "attempts": """SELECT event_id AS attempt_id, 'P' || (user_id % 200 + 1) AS work_id, event_type AS outcome, ts AS tried_at, CAST(value AS BIGINT) AS size FROM {events}""",
    "mentions": """SELECT from_work, to_work, ref_seq % 9 + 1 AS page, ref_seq * 17 % 100 AS start, 'sentence ' || to_work AS sentence, CAST(CASE ref_seq % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.85 ELSE 0.95 END AS DOUBLE) AS confidence
        FROM {cites} WHERE from_work LIKE 'O%' AND ref_seq % 2 = 1""",
    # Text: a passage is a line of a document, the title its first line.
    "passages": """SELECT doc_id, ordinal, text, lang FROM (SELECT doc_id, lang, pos AS ordinal, text FROM {lines}) AS x WHERE length(trim(text)) > 0""",
}

#: For Spark alone: the edges as they lie in the tables, with repeated pairs, for steps that drop repeats on their way.
PLANS: dict[str, str] = {"links": VIEWS["edges"].replace("DISTINCT ", "")}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = re.compile(r"\{(" + "|".join(sorted({*VIEWS, *TABLES, "lines"})) + r")\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table of the driver as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "lines":
        return table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "posexplode(split(text, '\n')) AS (pos, text)")
    text = PLANS.get(name) or VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def sql(body: str) -> str:
    """`body` for DuckDB, with a CTE for each view that it names in braces."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n not in TABLES and n not in order:
                if n != "lines":
                    need(VIEWS[n])
                order.append(n)

    need(body)
    lines = "SELECT doc_id, lang, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents"
    ctes = ", ".join(f"{n} AS ({lines if n == 'lines' else VIEWS[n]})" for n in order)
    head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    rest = body.removeprefix(head)
    out = body if not ctes else f"{head}{ctes}, {rest}" if rest != body else f"WITH {ctes} {body}"
    return _NAME.sub(r"\1", out)
