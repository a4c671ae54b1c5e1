"""Review queues, critic reviews and the status changes that people make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from .graph import visible

#: Queue orders: (key, descending); null keys come last and (created_ts, kind, item_id) ends every order.
ORDERS = {"created": (None, False), "confidence": ("confidence", False), "confidence_desc": ("confidence", True), "critic": ("critic_score", False)}
DISAGREEMENT = 0.35


def latest_review(reviews: DataFrame, by_engine: bool = False) -> DataFrame:
    """The newest review of each item (ties: the largest seq)."""
    keys = ["kind", "item_id", *(["engine"] if by_engine else [])]
    rest = [c for c in reviews.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("created_ts", "seq")).alias("r")
    return reviews.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(f"review_{c}") for c in rest])


def pending(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed nodes and edges: kind, item_id, type_name, label, confidence, created_ts."""
    n = nodes.where("status = 'proposed'").select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), F.col("entity_type").alias("type_name"), F.col("name").alias("label"), "confidence", "created_ts")
    names = nodes.select("id", "name")
    a, b = names.select(F.col("id").alias("src"), F.col("name").alias("a")), names.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    ends = edges.where("status = 'proposed'").join(a, "src", "left").join(b, "dst", "left")
    short = lambda name, key: F.coalesce(name, F.substring(key, 1, 10))
    e = ends.select(F.lit("edge").alias("kind"), F.col("id").alias("item_id"), F.col("relation_type").alias("type_name"), F.concat(short(F.col("a"), F.col("src")), F.lit(" → "), short(F.col("b"), F.col("dst"))).alias("label"), "confidence", "created_ts")
    return n.unionByName(e)


def order_keys(order: str) -> list[Column]:
    """Ascending sort keys of a queue order: null flag, key (negated where descending), ties."""
    key, down = ORDERS[order]
    ties = [F.col("created_ts"), F.col("kind"), F.col("item_id")]
    if key is None:
        return ties
    return [F.col(key).isNull().cast("int"), F.coalesce(-F.col(key) if down else F.col(key), F.lit(0.0)), *ties]


def review_queue(nodes: DataFrame, edges: DataFrame, reviews: DataFrame, order: str = "created", limit: int = 100, cursor: tuple | None = None, kind: str | None = None, type_name: str | None = None) -> DataFrame:
    """A page of the queue with its position; ``cursor`` is the previous page's last key."""
    critic = latest_review(reviews).select("kind", "item_id", F.col("review_score").alias("critic_score"))
    q = pending(nodes, edges)
    q = q.where(F.col("kind") == kind) if kind else q
    q = q.where(F.col("type_name") == type_name) if type_name else q
    q = q.join(critic, ["kind", "item_id"], "left").withColumn("disagrees", F.coalesce(F.abs(F.col("confidence") - F.col("critic_score")) >= DISAGREEMENT, F.lit(False)))
    keys = order_keys(order)
    if cursor is not None:
        if len(cursor) != len(keys):
            raise ValueError(f"a cursor of order {order!r} has {len(keys)} values")
        q = q.where(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) > F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(cursor)]))
    page = q.orderBy(*keys).limit(limit)
    return page.withColumn("pos", F.row_number().over(Window.orderBy(*keys)))  # over one page


def with_evidence(page: DataFrame, citations: DataFrame, documents: DataFrame) -> DataFrame:
    """A queue's page with ``evidence``: the excerpt of each item's first citation by document and place."""
    from ..functions.text import span_excerpt

    first = citations.join(F.broadcast(page.select("kind", "item_id")), ["kind", "item_id"], "left_semi").groupBy("kind", "item_id").agg(F.min(F.struct("doc_id", "start", "end")).alias("at"))  # a page
    texts = first.select("kind", "item_id", "at.*").join(documents.select("doc_id", "text"), "doc_id", "left")
    said = texts.select("kind", "item_id", span_excerpt(F.col("text"), F.col("start"), F.col("end")).alias("evidence"))
    return page.join(said, ["kind", "item_id"], "left")


def with_properties(page: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A queue's page with its items' ``properties`` (of nodes also ``aliases``); a table without such a column has none."""
    asked = F.broadcast(page.select("kind", "item_id"))  # a page

    def of(rows: DataFrame, kind: str) -> DataFrame:
        get = lambda c, t: (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
        return rows.select(F.lit(kind).alias("kind"), F.col("id").alias("item_id"), get("aliases", "array<string>"), get("properties", "map<string,string>")).join(asked, ["kind", "item_id"], "left_semi")

    return page.join(F.broadcast(of(nodes, "node").unionByName(of(edges, "edge"))), ["kind", "item_id"], "left")  # a page's items


def cursor_of(row, order: str) -> tuple:
    key, down = ORDERS[order]
    ties = (row["created_ts"], row["kind"], row["item_id"])
    if key is None:
        return ties
    v = row[key]
    return (int(v is None), 0.0 if v is None else -v if down else v, *ties)


def unscored(nodes: DataFrame, reviews: DataFrame, engine: str) -> DataFrame:
    """Visible nodes without a review by ``engine``."""
    done = reviews.where((F.col("engine") == engine) & (F.col("kind") == "node")).select(F.col("item_id").alias("id"))
    return visible(nodes, True).join(done, "id", "left_anti")


def disagreements(nodes: DataFrame, reviews: DataFrame, gap: float = DISAGREEMENT) -> DataFrame:
    latest = latest_review(reviews).where("kind = 'node'").select(F.col("item_id").alias("id"), F.col("review_score").alias("critic_score"))
    return visible(nodes, True).join(latest, "id").where(F.abs(F.col("confidence") - F.col("critic_score")) >= gap)


def upsert_reviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by (kind, item_id, engine); scores are clamped to 0..1, rows without one left out."""
    clamped = new.where("score IS NOT NULL").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    return old.join(clamped, ["kind", "item_id", "engine"], "left_anti").unionByName(clamped)


def mock_critic(labels: Column) -> Column:
    return F.when(F.contains(F.lower(labels), F.lit("suspicious")), 0.15).otherwise(0.9)


# Status changes: frames in, frames out ----------------------------------------------------


def set_status(rows: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """``rows`` with the status of those in ``ids`` (id) replaced."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(*rows.columns)


def approve_edges(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges are approved where both ends are verified; ``cascade`` verifies the ends first."""
    if cascade:
        chosen = edges.join(ids.select("id"), "id", "left_semi")
        nodes = set_status(nodes, chosen.select(F.col("src").alias("id")).unionByName(chosen.select(F.col("dst").alias("id"))), "verified")
    ok = nodes.where("status = 'verified'").select("id")
    ready = edges.join(ids.select("id"), "id", "left_semi").join(ok.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, set_status(edges, ready.select("id"), "verified")


def reopen(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes back to proposed, unless a current verified edge holds them."""
    live = edges.where("status = 'verified' AND invalidated_ts IS NULL")
    held = live.select(F.col("src").alias("id")).unionByName(live.select(F.col("dst").alias("id")))
    return set_status(nodes, ids.select("id").join(held, "id", "left_anti"), "proposed")


def invalidate(edges: DataFrame, ids: DataFrame, ts: float) -> DataFrame:
    """Verified edges not yet invalidated get the time; status and history stay."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    now = F.when(F.col("_hit") & (F.col("status") == "verified") & F.col("invalidated_ts").isNull(), F.lit(float(ts))).otherwise(F.col("invalidated_ts"))
    return edges.join(hit, "id", "left").withColumn("invalidated_ts", now).select(*edges.columns)


def bulk_approve(nodes: DataFrame, edges: DataFrame, entity_type: str | None = None, relation_type: str | None = None, min_confidence: float | None = None, source_doc: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes first (skipped where relation_type is given), then edges between verified nodes.

    entity_type scopes edges to both ends; unknown confidence never reaches ``min_confidence``.
    """
    sure = F.col("confidence") >= min_confidence if min_confidence is not None else F.lit(True)
    if relation_type is None:
        pick = (F.col("status") == "proposed") & sure
        pick = pick & (F.col("entity_type") == entity_type) if entity_type else pick
        pick = pick & (F.col("source_doc") == source_doc) if source_doc is not None else pick
        nodes = nodes.withColumn("status", F.when(F.coalesce(pick, F.lit(False)), "verified").otherwise(F.col("status")))
    edges = cut(edges)  # read twice; joins over a store's own lineage would all run within one task
    pick = (F.col("status") == "proposed") & sure
    pick = F.coalesce(pick & (F.col("relation_type") == relation_type) if relation_type else pick, F.lit(False))
    ok = visible(nodes.where(F.col("entity_type") == entity_type) if entity_type else nodes).select("id", F.lit(True).alias("_ok")).distinct()
    asked = edges.where(pick)  # only these are joined, each end once
    for end in ("src", "dst"):
        asked = asked.join(ok.withColumnsRenamed({"id": end, "_ok": f"_{end}"}), end, "left")
    decided = asked.withColumn("status", F.when(F.col("_src") & F.col("_dst"), "verified").otherwise(F.col("status")))
    return nodes, edges.where(~pick).unionByName(decided.select(*edges.columns))


def bulk_report(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """kind, approved, skipped: what a bulk approval changed, and the proposed rows that it left."""
    out = None
    for kind, old, new in zip(("node", "edge"), before, after):
        both = old.where("status = 'proposed'").select("id").join(new.select("id", "status"), "id")
        one = both.agg(F.count_if(F.col("status") == "verified").alias("approved"), F.count_if(F.col("status") == "proposed").alias("skipped")).select(F.lit(kind).alias("kind"), "approved", "skipped")
        out = one if out is None else out.unionByName(one)
    return out
