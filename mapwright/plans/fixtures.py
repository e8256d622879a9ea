"""Bindings from the driver's tables to the roles the operators expect.

Each binding is one query in the SQL both engines share, so the checked results
start from the same rows. ``AT(array, n)`` is the n-th element, counted from one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from mapwright.functions.constants import FEEL_DIMENSIONS

TIE_SHIFT = 1.3e-9

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_FEEL = ",\n  ".join(
    f"CAST(AT(e.embedding, {i + 1}) AS DOUBLE) AS {name}" for i, name in enumerate(FEEL_DIMENSIONS)
)

FIXTURES = {
    "movies": """
        SELECT p_partkey AS movie_id,
          concat(p_name, ' (', CAST(1950 + p_size AS VARCHAR(4)), ')') AS title,
          CASE p_type WHEN 'STANDARD' THEN 'Drama|Romance' WHEN 'SMALL' THEN 'Action|Sci-Fi'
            WHEN 'LARGE' THEN 'Comedy' WHEN 'ECONOMY' THEN 'Western|Film-Noir'
            WHEN 'MEDIUM' THEN 'Experimental' END AS genres,
          p_brand AS brand, p_retailprice AS price, p_size AS size
        FROM part""",
    "ratings": """
        SELECT l_partkey AS movie_id, l_quantity AS rating, l_orderkey AS rater FROM lineitem""",
    "tags": """
        SELECT l_partkey AS movie_id,
          CASE l_returnflag WHEN 'A' THEN 'dark atmosphere' WHEN 'R' THEN 'witty film' END AS tag,
          l_orderkey AS ord, l_linenumber AS line, l_extendedprice AS price
        FROM lineitem""",
    "artists": """
        SELECT c_name AS mbid, CASE WHEN c_acctbal > 0 THEN c_name END AS artist_lastfm,
          concat('MB ', c_name) AS artist_mb,
          CASE WHEN c_nationkey > 5 THEN n_name ELSE ' ' END AS country_lastfm,
          n_name AS country_mb,
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'Indie Rock; pop' WHEN 'HOUSEHOLD' THEN 'trap; beats'
            WHEN 'MACHINERY' THEN 'techno;house' WHEN 'BUILDING' THEN 'choral' END AS tags_lastfm,
          CASE WHEN c_acctbal > 0 THEN CAST(FLOOR(c_acctbal) AS BIGINT) ELSE 0 END AS listeners,
          CASE WHEN c_acctbal > 0 THEN CAST(FLOOR(c_acctbal * 7) AS BIGINT) ELSE 0 END AS scrobbles,
          c_nationkey = 3 AS ambiguous
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "business": """
        SELECT s_name AS business_id, s_suppkey AS suppkey, concat('Place ', s_name) AS name,
          CASE WHEN s_nationkey < 6 THEN 'Restaurants, Italian, Pizza'
            WHEN s_nationkey < 12 THEN 'Sushi Bars, restaurants'
            WHEN s_nationkey < 18 THEN 'Coffee & Tea, Restaurants'
            WHEN s_nationkey < 22 THEN 'Shopping' END AS categories,
          CAST(1 + s_nationkey % 5 AS DOUBLE) AS stars, n AS review_count,
          s_acctbal AS latitude
        FROM supplier JOIN (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey) c
          ON s_suppkey = l_suppkey""",
    "tips": """
        SELECT s_name AS business_id, concat(l_returnflag, l_linestatus) AS text,
          l_orderkey AS ord, l_linenumber AS line, l_extendedprice AS price
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "raw_reviews": """
        SELECT d.doc_id AS ord, md5(d.text) AS review_id, d.source AS entity_id, d.text AS review_text,
          d.lang AS language, CAST(d.n_chars % 13 AS VARCHAR(4)) AS rating,
          CAST(l.toxic AS VARCHAR(4)) AS spoiler_tag,
          concat('[', CAST(d.n_chars % 7 AS VARCHAR(9)), ', ', CAST(d.n_chars % 11 AS VARCHAR(9)), ']')
            AS helpful,
          CASE WHEN l.quality = 1 THEN 'True' WHEN l.quality = 0 THEN 'no' END AS matched,
          CASE WHEN l.doc_id IS NULL THEN 'release_group' WHEN l.quality = 1 THEN 'artist'
            ELSE 'release' END AS entity_type,
          d.n_chars AS n_chars, d.n_chars % 4 AS useful, d.n_chars % 3 AS funny, d.n_chars % 2 AS cool
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "orders_as_reviews": """
        SELECT o_orderkey AS review_id, o_custkey AS entity_id, o_totalprice AS price,
          o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS created
        FROM orders""",
    "linkage_reviews": """
        SELECT l_orderkey AS ord, l_linenumber AS line, l_extendedprice AS price,
          CASE WHEN l_returnflag = 'A' THEN concat(upper(p_name), ' (', CAST(1950 + p_size AS VARCHAR(4)), ')')
            WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN p_name
            WHEN l_returnflag = 'N' THEN concat(p_name, ' !')
            WHEN l_linestatus = 'F' THEN concat(p_name, ' (II) (', CAST(CAST(1950 + l_quantity AS INT) AS VARCHAR(4)), ')')
            ELSE p_brand END AS movie
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "embedding_table": """
        SELECT CAST(e.vec_id AS VARCHAR(20)) AS entity_id, e.embedding AS embedding, e.label AS label,
          CASE e.vec_id % 3 WHEN 0 THEN 'movies' WHEN 1 THEN 'music' ELSE 'restaurants' END AS domain
        FROM embeddings e""",
    # A second modality: the review vectors of the entities some label covers.
    "review_vectors": """
        SELECT CAST(e.vec_id AS VARCHAR(20)) AS entity_id, REVERSED(e.embedding) AS embedding,
          l.quality + 1 AS review_count,
          CASE e.vec_id % 3 WHEN 0 THEN 'movies' WHEN 1 THEN 'music' ELSE 'restaurants' END AS domain
        FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id""",
    "map_items": f"""
        SELECT concat(CASE e.vec_id % 3 WHEN 0 THEN 'movies' WHEN 1 THEN 'music' ELSE 'restaurants' END,
            ':', CAST(e.vec_id AS VARCHAR(20))) AS id,
          CASE e.vec_id % 3 WHEN 0 THEN 'movies' WHEN 1 THEN 'music' ELSE 'restaurants' END AS domain,
          CAST(e.vec_id AS VARCHAR(20)) AS source_id,
          coalesce(p.p_name, concat('item ', CAST(e.vec_id AS VARCHAR(20)))) AS title,
          CAST(AT(e.embedding, 1) AS DOUBLE) AS x, CAST(AT(e.embedding, 2) AS DOUBLE) AS y,
          CASE WHEN e.label = 0 THEN -1 ELSE e.label END AS cluster,
          p.p_type AS macro_genre,
          CASE p.p_size % 4 WHEN 0 THEN 'Drama|Comedy' WHEN 1 THEN 'Comedy' WHEN 2 THEN 'War|Drama|Sci-Fi'
            WHEN 3 THEN 'Jazz, Soul' END AS categories,
          concat(coalesce(p.p_name, ''), ' ', coalesce(lower(p.p_type), ''), ' the film') AS tags_text,
          CAST(s.n AS DOUBLE) AS popularity, s.r AS rating,
          coalesce(l.quality + 1, 0) AS review_count,
          {_FEEL}
        FROM embeddings e LEFT JOIN part p ON e.vec_id = p.p_partkey
          LEFT JOIN (SELECT l_partkey, COUNT(*) AS n, AVG(l_quantity) AS r FROM lineitem GROUP BY l_partkey) s
            ON e.vec_id = s.l_partkey
          LEFT JOIN labels l ON e.vec_id = l.doc_id""",
    # A denser map over every part, customer and supplier, with many shared points.
    "places": """
        SELECT concat('movies:', CAST(p_partkey AS VARCHAR(20))) AS id, 'movies' AS domain, p_partkey AS n,
          CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice % 40 AS DOUBLE) AS y, p_type AS category,
          p_retailprice AS popularity FROM part
        UNION ALL
        SELECT concat('music:', CAST(c_custkey AS VARCHAR(20))), 'music', c_custkey,
          CAST(c_nationkey * 2 AS DOUBLE), c_acctbal / 250, c_mktsegment, c_acctbal FROM customer
        UNION ALL
        SELECT concat('restaurants:', CAST(s_suppkey AS VARCHAR(20))), 'restaurants', s_suppkey,
          CAST(s_nationkey AS DOUBLE), CAST(s_suppkey % 40 AS DOUBLE), 'none', s_acctbal FROM supplier""",
}


def _spark_text(sql: str) -> str:
    sql = re.sub(r"\bAT\(", "element_at(", sql)
    sql = re.sub(r"REVERSED\(", "reverse(", sql)
    return re.sub(r"VARCHAR\(\d+\)", "STRING", sql)


def _duck_text(sql: str) -> str:
    sql = re.sub(r"\bAT\(", "list_extract(", sql)
    return re.sub(r"REVERSED\(", "list_reverse(", sql)


class Tables:
    """Base tables and bound roles of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name in FIXTURES:
            text = FIXTURES[name]
            used = [t for t in BASE_TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
            for t in used:
                text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            return self.spark.sql(_spark_text(text), **{t: self.base(t) for t in used})
        raise AttributeError(name)


def rounded_doubles(sql: str) -> str:
    """Expand ``R6(expr)``: double, six digits, no negative zero."""
    while (start := sql.find("R6(")) >= 0:
        depth, end = 1, start + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + 3 : end - 1]
        sql = f"{sql[:start]}(round(CAST({inner} AS DOUBLE) + {TIE_SHIFT}, 6) + 0.0){sql[end:]}"
    return sql


def with_fixtures(sql: str) -> str:
    """Put the bound roles a query names in front of it."""
    names = [n for n in FIXTURES if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", sql)]
    ctes = ",\n".join(f"{n} AS ({_duck_text(FIXTURES[n])})" for n in names)
    body = rounded_doubles(sql.strip())
    if not ctes:
        return body
    if re.match(r"WITH\b", body, re.I):
        recursive = re.match(r"WITH RECURSIVE\b", body, re.I)
        rest = body[len("WITH RECURSIVE") if recursive else len("WITH"):]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
