"""A graph derived from the star-schema tables, and the same derivation as DuckDB CTEs.

Regions, nations, suppliers, parts and customers are nodes; keys decide status and confidence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..operators.text_index import TextIndex, build_index
from .checkpoints import at_end, delete, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple, TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of ``documents``, built once for each session and state of the table, as an index is meant to be."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    written = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    known = (spark.sparkContext.applicationId, sf_dir, written)
    if known not in _indexes:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        at_end(lambda: delete(spark, folder))
        _indexes[known] = build_index(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    return _indexes[known]


_NODES = [("R", "Region", "region", "r_regionkey", "r_name"), ("N", "Nation", "nation", "n_nationkey", "n_name"), ("S", "Supplier", "supplier", "s_suppkey", "s_name"), ("P", "Part", "part", "p_partkey", "p_name"), ("C", "Customer", "customer", "c_custkey", "c_name")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, entity_type, name, normalized_name, k, status, confidence, created_ts, source_doc."""
    out = None
    for prefix, kind, name, key, label in _NODES:
        t = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("k"), F.col(label).alias("name"), F.lit(kind).alias("entity_type"), F.lit(prefix).alias("prefix"))
        out = t if out is None else out.unionByName(t)
    k = F.col("k")
    status = F.when(F.col("prefix").isin("R", "N"), "verified").when(k % 10 == 0, "rejected").when(k % 10 <= 2, "proposed").otherwise("verified")
    return out.select(
        F.concat("prefix", k.cast("string")).alias("id"),
        "entity_type",
        "name",
        normalize_name(F.col("name")).alias("normalized_name"),
        "k",
        status.alias("status"),
        F.when(k % 13 != 0, ((k * 37) % 101).cast("double") / F.lit(100.0).cast("double")).alias("confidence"),
        ((k * 7919) % 100000).cast("double").alias("created_ts"),
        (k % 97).alias("source_doc"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, relation_type, src, dst, status, confidence, invalidated_ts, created_ts."""
    line = table(spark, sf_dir, "lineitem")
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))

    def pairs(df: DataFrame, kind: str, a: str, sk: str, b: str, dk: str) -> DataFrame:
        return df.select(F.lit(kind).alias("relation_type"), F.lit(a).alias("a"), F.col(sk).cast("long").alias("sk"), F.lit(b).alias("b"), F.col(dk).cast("long").alias("dk"))

    out = pairs(nation, "part_of", "N", "n_nationkey", "R", "n_regionkey")
    out = out.unionByName(pairs(supplier, "located_in", "S", "s_suppkey", "N", "s_nationkey"))
    out = out.unionByName(pairs(customer, "located_in", "C", "c_custkey", "N", "c_nationkey"))
    out = out.unionByName(pairs(line.select("l_suppkey", "l_partkey").distinct(), "supplies", "S", "l_suppkey", "P", "l_partkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bought = line.select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    out = out.unionByName(pairs(bought, "ordered", "C", "o_custkey", "P", "l_partkey"))
    sk, dk, free = F.col("sk"), F.col("dk"), F.col("relation_type") != "part_of"
    m = (sk * 7 + dk * 3) % 10
    src, dst = F.concat("a", sk.cast("string")), F.concat("b", dk.cast("string"))
    return out.select(
        F.concat_ws(":", "relation_type", src, dst).alias("id"),
        "relation_type",
        src.alias("src"),
        dst.alias("dst"),
        F.when(~free, "verified").when(m == 0, "rejected").when(m <= 2, "proposed").otherwise("verified").alias("status"),
        F.when((sk + dk) % 11 != 0, ((sk * 31 + dk) % 101).cast("double") / F.lit(100.0).cast("double")).alias("confidence"),
        F.when(free & ((sk + dk) % 17 == 0), (sk + dk).cast("double")).alias("invalidated_ts"),
        ((sk * 13 + dk * 17) % 100000).cast("double").alias("created_ts"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critic reviews: kind, item_id, engine, model (null for some), prompt_version, score, created_ts, seq."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("node").alias("kind"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("item_id"), F.col("event_type").alias("engine"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("model"), F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("prompt_version"), F.least(F.col("value") / F.lit(500.0).cast("double"), F.lit(1.0).cast("double")).alias("score"), F.col("ts").alias("created_ts"), F.col("event_id").alias("seq"))


_STATUS = "CASE WHEN {fixed} THEN 'verified' WHEN {m} = 0 THEN 'rejected' WHEN {m} <= 2 THEN 'proposed' ELSE 'verified' END"


def normalize_sql(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[^0-9a-z]+', '', 'g')"
    return f"CASE WHEN length({bare}) <= 3 THEN regexp_replace(lower({x}), '\\s+', '', 'g') ELSE {bare} END"


NODES_SQL = (
    "kg_nodes AS (SELECT prefix || CAST(k AS VARCHAR) AS id, entity_type, name, "
    + normalize_sql("name")
    + " AS normalized_name, k, "
    + _STATUS.format(fixed="prefix IN ('R', 'N')", m="k % 10")
    + " AS status, CASE WHEN k % 13 <> 0 THEN CAST((k * 37) % 101 AS DOUBLE) / 100.0::DOUBLE END AS confidence, CAST((k * 7919) % 100000 AS DOUBLE) AS created_ts, k % 97 AS source_doc FROM ("
    + " UNION ALL ".join(f"SELECT CAST({key} AS BIGINT) AS k, {label} AS name, '{kind}' AS entity_type, '{prefix}' AS prefix FROM {name}" for prefix, kind, name, key, label in _NODES)
    + "))"
)
EDGES_SQL = (
    "kg_edges AS (SELECT relation_type || ':' || a || sk || ':' || b || dk AS id, relation_type, a || sk AS src, b || dk AS dst, "
    + _STATUS.format(fixed="relation_type = 'part_of'", m="(sk * 7 + dk * 3) % 10")
    + " AS status, CASE WHEN (sk + dk) % 11 <> 0 THEN CAST((sk * 31 + dk) % 101 AS DOUBLE) / 100.0::DOUBLE END AS confidence,"
    " CASE WHEN relation_type <> 'part_of' AND (sk + dk) % 17 = 0 THEN CAST(sk + dk AS DOUBLE) END AS invalidated_ts, CAST((sk * 13 + dk * 17) % 100000 AS DOUBLE) AS created_ts FROM ("
    "SELECT 'part_of' AS relation_type, 'N' AS a, CAST(n_nationkey AS BIGINT) AS sk, 'R' AS b, CAST(n_regionkey AS BIGINT) AS dk FROM nation"
    " UNION ALL SELECT 'located_in', 'S', s_suppkey, 'N', s_nationkey FROM supplier"
    " UNION ALL SELECT 'located_in', 'C', c_custkey, 'N', c_nationkey FROM customer"
    " UNION ALL SELECT DISTINCT 'supplies', 'S', l_suppkey, 'P', l_partkey FROM lineitem"
    " UNION ALL SELECT DISTINCT 'ordered', 'C', o_custkey, 'P', l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"
)
REVIEWS_SQL = "reviews AS (SELECT 'node' AS kind, 'C' || user_id AS item_id, event_type AS engine, CASE WHEN event_id % 3 <> 0 THEN 'm' || (event_id % 3) END AS model, 'p' || (event_id % 2) AS prompt_version, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS score, ts AS created_ts, event_id AS seq FROM events)"
SUB_SQL = (
    "vn AS (SELECT * FROM kg_nodes WHERE status = 'verified'), "
    "ve AS (SELECT e.* FROM kg_edges e JOIN vn s ON e.src = s.id JOIN vn d ON e.dst = d.id WHERE e.status = 'verified' AND e.invalidated_ts IS NULL)"
)


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


GRAPH_SQL = with_sql(NODES_SQL, EDGES_SQL)
SUBGRAPH_SQL = with_sql(NODES_SQL, EDGES_SQL, SUB_SQL)
