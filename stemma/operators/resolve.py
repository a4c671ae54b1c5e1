"""Entity resolution: binding mentions to nodes, duplicate candidates, merges."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.checkpoints import cut
from .graph import visible
from .likeness import signal_pairs

NAME_RATIO, CONTAINED_LENGTH, COSINE = 0.82, 4, 0.90
SCORES = {"containment": 0.85, "shared alias": 0.95}
GRAM, MAX_GRAM_BLOCK, HOT = 3, 64, 10_000


def resolve_mentions(mentions: DataFrame) -> DataFrame:
    """Bind rows (seq, entity_type, name, normalized_name, confidence) to one node a resolution key.

    The first mention by seq mints the node; every mention is counted as a citation, and the best
    known confidence is kept. Aggregation alone: no key's rows are gathered.
    """
    first = F.min_by(F.struct("name", "seq"), "seq").alias("first")
    out = mentions.where("normalized_name <> ''").groupBy("entity_type", "normalized_name").agg(first, F.count("*").alias("citations"), F.max("confidence").alias("confidence"))
    return out.select("entity_type", "normalized_name", F.col("first.name").alias("name"), F.col("first.seq").alias("minted_by"), "citations", "confidence")


def bind_to_existing(mentions: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions with the visible node they bind to: exact key, else alias key, else null (mint)."""
    seen = visible(nodes, True)
    exact = seen.groupBy("entity_type", "normalized_name").agg(F.min("id").alias("exact_id"))
    named = seen.select("id", "entity_type").join(aliases.select(F.col("node_id").alias("id"), F.col("normalized_alias").alias("normalized_name")), "id")
    other = named.groupBy("entity_type", "normalized_name").agg(F.min("id").alias("alias_id"))
    on = ["entity_type", "normalized_name"]
    return mentions.join(exact, on, "left").join(other, on, "left").withColumn("node_id", F.coalesce("exact_id", "alias_id")).drop("exact_id", "alias_id")


def resolve_sequentially(mentions: DataFrame) -> DataFrame:
    """seq, node_key: binding where one batch's aliases chain, so that order matters.

    Only mentions linked by shared keys can bind to each other; each linked set is walked alone, in
    seq order, by the first seq that owns one of its keys.
    """
    from .graph import connected_components

    keyed = mentions.select("seq", "entity_type", F.explode(F.array_distinct(F.concat(F.array("normalized_name"), "alias_keys"))).alias("key")).where("key <> ''")
    node = lambda c: F.concat_ws("\x1f", "entity_type", c)
    head = mentions.select("seq", node("normalized_name").alias("head"), "entity_type", "alias_keys", "normalized_name")
    links = keyed.join(head.select("seq", "head"), "seq").select(F.col("head").alias("src"), node("key").alias("dst"))
    ids = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    parts = connected_components(ids, links.where("src <> dst").distinct())
    rows = head.join(parts.withColumnRenamed("id", "head"), "head").select("component", "seq", "normalized_name", "alias_keys")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, exact, alias = None, {}, {}
        for batch in batches:
            seqs, owners = [], []
            for component, seq, name, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if component != at:
                    at, exact, alias = component, {}, {}
                owner = exact.get(name, alias.get(name))
                if owner is None:
                    owner = exact[name] = seq
                for k in keys:
                    alias.setdefault(k, owner)
                seqs.append(seq)
                owners.append(owner)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(owners, pa.int64())], names=["seq", "node_key"])

    return in_order(rows.withColumn("seq", F.col("seq").cast("long")), "component", "seq").mapInArrow(walk, "seq long, node_key long")


def in_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with each group in one partition and its rows behind one another: a task walks many groups in one pass, and Spark's sort holds them."""
    return rows.repartition(group).sortWithinPartitions(group, *order)


def dedupe_edges(rows: DataFrame) -> DataFrame:
    """One edge a (relation_type, src, dst); later mentions only add citations."""
    return rows.groupBy("relation_type", "src", "dst").agg(F.count("*").alias("citations"), F.min("seq").alias("minted_by"))


def union_aliases(rows: DataFrame, key: list[str]) -> DataFrame:
    """Sorted aliases of each key, the first surface (by seq) of each normalized form."""
    first = rows.groupBy(*key, "normalized_alias").agg(F.min_by("surface", F.struct("seq", "surface")).alias("surface"))
    return first.groupBy(*key).agg(F.array_sort(F.collect_list("surface")).alias("aliases"))


def fill_properties(target: str, source: str):
    """Union of two maps in which the target's values win."""
    return F.map_concat(F.col(target), F.map_filter(F.col(source), lambda k, _: ~F.map_contains_key(target, k)))


# Candidates -------------------------------------------------------------------------------


def block_keys(nodes: DataFrame, alias_keys: str | None = None) -> DataFrame:
    """id, entity_type, key, gram: exact keys and character 3-grams of names and aliases."""
    names = F.array_distinct(F.concat(F.array("normalized_name"), alias_keys)) if alias_keys else F.array("normalized_name")
    texts = nodes.select("id", "entity_type", F.explode(names).alias("t")).where("t <> ''")
    grams = F.when(F.length("t") >= GRAM, F.transform(F.sequence(F.lit(1), F.length("t") - GRAM + 1), lambda i: F.substring(F.col("t"), i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    exact = texts.select("id", "entity_type", F.col("t").alias("key"), F.lit(False).alias("gram"))
    return exact.unionByName(texts.select("id", "entity_type", F.explode(grams).alias("key"), F.lit(True).alias("gram"))).distinct()


def block_pairs(nodes: DataFrame, alias_keys: str | None = None, max_block: int | None = None) -> DataFrame:
    """Pairs a < b of one type that share a key: all of them, unless ``max_block`` is given.

    Then grams of more than ``max_block`` nodes open no pairs, and a whole name or alias that more
    nodes share makes them one class: each is paired with its smallest member only. Keys of more than
    ``HOT`` nodes are never sent anywhere, so that no task gets all rows of one. What looks for
    duplicates (``alike_names``, ``scan_candidates``) takes no blocks, as these lose pairs.
    """
    on = ["entity_type", "key", "gram"]
    keys = block_keys(nodes, alias_keys)
    if max_block is None:
        keys = cut(keys)
        return keys.select(F.col("id").alias("a"), *on).join(keys.select(F.col("id").alias("b"), *on), on).where("a < b").select("a", "b").distinct()
    sized = cut(keys.groupBy(*on).agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > 1))
    most = max(HOT, max_block)
    hot = sized.where(F.col("n") > most)  # a row for HOT rows of keys at most
    cool = keys.join(F.broadcast(hot.select(*on)), on, "left_anti")
    k = cut(cool.join(sized.where(F.col("n") <= F.when(F.col("gram"), max_block).otherwise(most)), on))
    few = k.where(F.col("n") <= max_block)
    every = few.select(F.col("id").alias("a"), *on).join(few.select(F.col("id").alias("b"), *on), on).select("a", "b")
    star = k.where(F.col("n") > max_block).select("first", "id").unionByName(keys.where("NOT gram").join(F.broadcast(hot.where("NOT gram").select(*on, "first")), on).select("first", "id"))
    return every.unionByName(star.select(F.col("first").alias("a"), F.col("id").alias("b"))).where("a < b").distinct()


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def numbered_letters(text: Column) -> Column:
    """The letters of a text as an array, each with how many of it came so far: shared elements are shared letters, counted."""
    upto = lambda i: F.substring(text, F.lit(1), i)
    letter = lambda i: F.substring(text, i, F.lit(1))
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(letter(i), (i - F.length(F.replace(upto(i), letter(i), F.lit("")))).cast("string")))
    return F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<string>"))


def within_reach(named: DataFrame, nodes: DataFrame, threshold: float = NAME_RATIO) -> DataFrame:
    """Those of (a, b, name_a, name_b) whose ratio may reach ``threshold``, by two upper bounds of it.

    The ratio is 2 * matches / (both lengths), and no more can match than the shorter name has
    letters, nor than both have of each letter.
    """
    a, b = F.length("name_a"), F.length("name_b")
    near = named.where((a + b == 0) | (2.0 * F.least(a, b) / (a + b) >= threshold))
    letters = nodes.select("id", numbered_letters(F.col("normalized_name")).alias("letters"))  # once a node, not once a pair
    both = near.join(letters.select(F.col("id").alias("a"), F.col("letters").alias("letters_a")), "a").join(letters.select(F.col("id").alias("b"), F.col("letters").alias("letters_b")), "b")
    shared = F.size(F.array_intersect("letters_a", "letters_b"))
    return both.where((a + b == 0) | (2.0 * shared / (a + b) >= threshold)).select(*named.columns)


def similar_names(named: DataFrame, nodes: DataFrame, threshold: float = NAME_RATIO) -> DataFrame:
    """a, b, ratio of the pairs that reach ``threshold``; the ratio itself is taken where the bounds allow it only.

    Equal names need none, and two names are rated once, however many nodes bear them.
    """
    same = named.where("name_a = name_b").select("a", "b", F.lit(1.0).alias("ratio"))
    apart = named.where("name_a <> name_b")
    both = apart.select("name_a", "name_b").distinct()
    names = nodes.select(F.col("normalized_name").alias("id"), "normalized_name").distinct()
    near = within_reach(both.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "name_a", "name_b"), names, threshold)
    rated = near.select("name_a", "name_b", name_ratio("name_a", "name_b").alias("ratio")).where(F.col("ratio") >= threshold)
    return same.where(F.lit(threshold) <= 1.0).unionByName(apart.join(rated, ["name_a", "name_b"]).select("a", "b", "ratio"))


def pair_names(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("id", "normalized_name")
    return pairs.join(n.select(F.col("id").alias("a"), F.col("normalized_name").alias("name_a")), "a").join(n.select(F.col("id").alias("b"), F.col("normalized_name").alias("name_b")), "b")


def containment(pairs: DataFrame) -> DataFrame:
    """Pairs whose shorter name, of 4 characters or more, is part of the longer."""
    a, b = F.col("name_a"), F.col("name_b")
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return pairs.where((a != b) & (F.length(short) >= CONTAINED_LENGTH) & F.contains(long, short))


def contained_names(nodes: DataFrame, max_block: int = MAX_GRAM_BLOCK) -> DataFrame:
    """a, b: ``containment`` of ``block_pairs(nodes)``, compared once for two different names and not for each pair of their bearers.

    Bearers of one name never count, so whole names open no pairs here; grams are counted by nodes,
    as in ``block_pairs``.
    """
    on = ["entity_type", "normalized_name"]
    named = nodes.where("normalized_name <> ''").select("id", *on)
    names = named.distinct().groupBy(*on).agg(F.count("*").alias("bearers")).withColumn("id", F.struct(*on))
    keys = block_keys(names).where("gram").join(names.select("id", "bearers"), "id")
    rare = keys.groupBy("entity_type", "key").agg(F.sum("bearers").alias("n"), F.count("*").alias("names")).where((F.col("n") <= max_block) & (F.col("names") > 1))
    k = keys.select("entity_type", "key", F.col("id.normalized_name").alias("name")).join(rare.select("entity_type", "key"), ["entity_type", "key"])
    pairs = k.withColumnRenamed("name", "name_a").join(k.withColumnRenamed("name", "name_b"), ["entity_type", "key"]).where("name_a < name_b")
    found = containment(pairs.select("entity_type", "name_a", "name_b").distinct())
    bearer = lambda end: named.select(F.col("id").alias(end), "entity_type", F.col("normalized_name").alias(f"name_{end}"))
    both = found.join(bearer("a"), ["entity_type", "name_a"]).join(bearer("b"), ["entity_type", "name_b"])
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike_names(nodes: DataFrame, threshold: float = NAME_RATIO) -> DataFrame:
    """a, b, ratio of all pairs of one type whose names reach ``threshold``, however many share a name or parts of one."""
    return signal_pairs(nodes, threshold).select("a", "b", F.col("alike").alias("ratio"))


def scan_candidates(nodes: DataFrame, aliases: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """a, b, score, reasons of likely duplicates among visible nodes: all pairs of one type that any signal speaks for.

    ``vectors``: id, embedding of the nodes that have one.
    """
    keys = aliases.groupBy(F.col("node_id").alias("id")).agg(F.collect_set("normalized_alias").alias("alias_keys"))
    seen = visible(nodes, True).select("id", "entity_type", "normalized_name").join(keys, "id", "left")
    seen = seen.withColumn("keys", F.concat(F.array("normalized_name"), F.coalesce("alias_keys", F.array().cast("array<string>"))))
    if vectors is not None:
        seen = seen.join(vectors.select("id", F.col("embedding").alias("vector")), "id", "left")
    found = signal_pairs(cut(seen.drop("alias_keys")), NAME_RATIO, CONTAINED_LENGTH, "keys", "vector" if vectors is not None else None, COSINE)
    fixed = {"inside": "containment", "alias": "shared alias"}
    scores = [F.col("alike"), *[F.when(F.col(c), F.lit(SCORES[n])) for c, n in fixed.items()], F.col("near")]
    rated = lambda c, n: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n} "), F.format_number(c, 2)))
    says = [rated("alike", "name similarity"), *[F.when(F.col(c), F.lit(f"{n} {SCORES[n]:.2f}")) for c, n in fixed.items()], rated("near", "embedding cosine")]
    return found.select("a", "b", F.greatest(*scores).alias("score"), F.array_compact(F.array(*says)).alias("reasons"))


def record_candidates(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known candidates, and fresh ones under canonical order that no known one blocks, whatever its status."""
    canonical = fresh.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).groupBy("a", "b").agg(F.max("score").alias("score"))
    return known.unionByName(canonical.join(known.select("a", "b"), ["a", "b"], "left_anti").withColumn("status", F.lit("proposed")))


def pending_candidates(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proposed candidates with both names; stale where an end isn't visible."""
    n = nodes.select("id", "name", "status")
    ends = [n.select(F.col("id").alias(x), F.col("name").alias(f"name_{x}"), F.col("status").alias(f"status_{x}")) for x in ("a", "b")]
    seen = lambda x: F.coalesce(F.col(f"status_{x}").isin("verified", "proposed"), F.lit(False))
    return candidates.where("status = 'proposed'").join(ends[0], "a", "left").join(ends[1], "b", "left").withColumn("stale", ~(seen("a") & seen("b")))


def review_candidates(candidates: DataFrame, nodes: DataFrame, citations: DataFrame) -> DataFrame:
    """``pending_candidates`` with both ends' numbers of citations, best score first."""
    n = citations.where("kind = 'node'").groupBy("item_id").agg(F.count("*").alias("n"))
    out = pending_candidates(candidates, nodes)
    for end in ("a", "b"):
        out = out.join(n.select(F.col("item_id").alias(end), F.col("n").alias(f"citations_{end}")), end, "left")
    return out.fillna({"citations_a": 0, "citations_b": 0}).orderBy(F.desc("score"), "a", "b")


def scan_stats(nodes: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of a scan: nodes looked at, pairs compared, candidates found, and the share of all pairs that was compared."""
    seen = visible(nodes, True).agg(F.count("*").alias("nodes"))
    parts = [pairs.agg(F.count("*").alias("pairs_checked")), found.agg(F.count("*").alias("candidates"))]
    for part in parts:
        seen = seen.crossJoin(F.broadcast(part))  # one row each
    return seen.withColumn("share", F.when(F.col("nodes") > 1, F.col("pairs_checked") / (F.col("nodes") * (F.col("nodes") - 1) / 2)).otherwise(0.0))


def dismiss(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    hit = pairs.select("a", "b").distinct().withColumn("_hit", F.lit(True))
    return candidates.join(hit, ["a", "b"], "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "proposed"), "dismissed").otherwise(F.col("status"))).drop("_hit")


# Merging ----------------------------------------------------------------------------------


def merge_nodes(nodes: DataFrame, edges: DataFrame, target: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Fold ``source`` into ``target`` where only nodes and edges are kept (``store.merge_store`` takes all frames).

    The source is rejected with a note. Its current edges move; one that would repeat a live edge,
    or loop, is rejected where it stands.
    """
    from .store import check_merge, repoint_edges

    check_merge(nodes, target, source)
    is_source = F.col("id") == source
    kept = nodes.withColumn("review_note", F.when(is_source, F.lit(f"merged-into:{target}"))).withColumn("status", F.when(is_source, "rejected").otherwise(F.col("status")))
    return kept, repoint_edges(edges, target, source).select(*edges.columns)
