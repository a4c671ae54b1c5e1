"""Communities: label propagation, in tasks or by joins, with extractive summaries.

Labels spread in id order: in a round a vertex sees the new labels of smaller neighbours and the old
ones of larger neighbours. Small components are worked through one a task. A large one is solved by
joins: a round's labels are the only solution of label(v) = commonest of (new labels of smaller
neighbours, old labels of larger ones), since each vertex depends on smaller ones alone, and so
starting from the old labels and recomputing the vertices whose inputs changed, until none does,
ends at just the labels that the serial order gives. Vertices whose neighbours stand still are left
alone, within a round and from round to round.

Where the id order falls into few stretches that no edge lies within (as where ids begin with a kind
and edges join different kinds), a stretch's vertices don't see one another: one step a stretch and
round gives the serial order's labels for the whole graph, and no components are needed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.checkpoints import cut
from .graph import between, connected_components, degree

ROUNDS, TOP = 20, 5
STRETCHES, ROW = 12, 50_000


def propagate(nodes: list[str], pairs: list[tuple[str, str]], rounds: int = ROUNDS) -> dict[str, str]:
    """Labels after asynchronous propagation in id order: the commonest neighbouring label, ties to the smallest."""
    around = defaultdict(set)
    for a, b in pairs:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    label = {n: n for n in nodes}
    for _ in range(rounds):
        before = dict(label)
        for n in sorted(around):
            counts = Counter(label[m] for m in around[n])
            label[n] = min(counts, key=lambda x: (-counts[x], x))
        if before == label:
            break
    return label


def _commonest(ways: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label: the commonest label over ``ways`` (id, far, smaller), ties to the smallest; ``labels`` has (id, old, new)."""
    seen = ways.join(labels.select(F.col("id").alias("far"), "old", "new"), "far").select("id", F.when(F.col("smaller"), F.col("new")).otherwise(F.col("old")).alias("label"))
    counts = seen.groupBy("id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("id", F.col("best.label").alias("said"))


def propagate_by_joins(pairs: DataFrame, rounds: int = ROUNDS, most_steps: int = 1000) -> DataFrame:
    """id, label of all vertices of ``pairs`` (a, b), as ``propagate`` gives them, however large a component is."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("far")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("far"))).where("id <> far").distinct()
    ways = cut(both.withColumn("smaller", F.col("far") < F.col("id")))
    labels = cut(ways.select("id").distinct().select("id", F.col("id").alias("old"), F.col("id").alias("new")))
    touched = None  # all of them
    steps = 0
    for _ in range(rounds):
        while True:
            asked = ways if touched is None else ways.join(touched, "id", "left_semi")
            said = _commonest(asked, labels)
            now = labels.join(said, "id", "left").select("id", "old", F.coalesce("said", "new").alias("next"), "new")
            stepped = cut(now.select("id", "old", F.col("next").alias("new"), (F.col("next") != F.col("new")).alias("moved")))
            labels, moved = stepped.select("id", "old", "new"), stepped.where("moved").select(F.col("id").alias("far"))
            touched = cut(ways.where("smaller").join(moved, "far", "left_semi").select("id").distinct())
            steps += 1
            if touched.isEmpty():
                break
            if steps > most_steps:
                raise RuntimeError(f"labels did not settle in {most_steps} steps")
        changed = labels.where("old <> new").select(F.col("id").alias("far"))
        if changed.isEmpty():
            break
        touched = cut(ways.where("NOT smaller").join(changed, "far", "left_semi").select("id").distinct())
        labels = labels.select("id", F.col("new").alias("old"), "new")
    return labels.select("id", F.col("new").alias("label"))


def stretches(pairs: DataFrame, most: int = STRETCHES) -> list[str] | None:
    """The least ids of stretches of the id order without an inner edge, from the second on; ``pairs`` has a < b. None where there are more than ``most``."""
    found: list[str] = []
    while len(found) < most:
        rest = pairs.where(F.col("a") >= found[-1]) if found else pairs
        first = rest.agg(F.min("b")).first()[0]
        if first is None:
            return found
        found.append(first)
    return None


def propagate_by_stretches(pairs: DataFrame, starts: list[str], rounds: int = ROUNDS) -> DataFrame:
    """id, label of all vertices of ``pairs`` (a < b, distinct), as ``propagate`` gives them; ``starts`` are those of ``stretches``.

    A vertex's neighbours lie in other stretches: smaller ones had their turn in this round, larger
    ones have it later. Neighbours are kept as lists of at most some ``ROW`` ids.
    """
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("far")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("far")))
    hot = both.groupBy("far").agg(F.ceil(F.count("*") / ROW).alias("pieces")).where("pieces > 1")  # a row for ROW rows at most
    dealt = both.join(F.broadcast(hot), "far", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(0)))
    place = F.lit(0)
    for start in starts:
        place = place + (F.col("id") >= start).cast("int")
    ways = cut(dealt.withColumn("stretch", place).groupBy("stretch", "far", "piece").agg(F.collect_list("id").alias("ids")))
    own = cut(both.select("id").distinct().withColumn("stretch", place))
    every = range(len(starts) + 1)
    labels = [own.where(F.col("stretch") == i).select("id", F.col("id").alias("label")) for i in every]
    changed, done, step = [0] * len(labels), [-1] * len(labels), 0  # when a stretch's labels last changed, and when it last had its turn
    for _ in range(rounds):
        before = step
        for i in every:
            others = [j for j in every if j != i]
            if not any(changed[j] > done[i] for j in others):
                continue
            step += 1
            known = labels[others[0]]
            for j in others[1:]:
                known = known.unionByName(labels[j])
            seen = ways.where(F.col("stretch") == i).join(known.withColumnRenamed("id", "far"), "far").select(F.explode("ids").alias("id"), "label")
            counts = seen.groupBy("id", "label").agg(F.count("*").alias("n"))
            best = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
            now = cut(best.join(labels[i].withColumnRenamed("label", "was"), "id").select("id", F.col("best.label").alias("label"), (F.col("best.label") != F.col("was")).alias("moved")))
            labels[i], done[i] = now.select("id", "label"), step
            if not now.where("moved").isEmpty():
                changed[i] = step
        if step == before:
            break
    out = labels[0]
    for more in labels[1:]:
        out = out.unionByName(more)
    return out


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, most_edges: int = 1_000_000) -> DataFrame:
    """id, label; edges are undirected, loops dropped. A graph of more than ``most_edges`` edges goes by ``stretches`` if it can.

    Else a component of up to ``most_edges`` edges is one task, a larger one goes by joins.
    """
    from ..plans.shipping import ship

    ship(nodes.sparkSession)
    inside = cut(between(edges, nodes).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    starts = stretches(inside) if inside.count() > most_edges else None
    if starts is not None:
        labels = propagate_by_stretches(inside, starts, rounds)
        return nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    parts = cut(connected_components(nodes, inside.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    placed = cut(inside.join(parts.withColumnRenamed("id", "a"), "a").select("component", "a", "b"))
    large = cut(placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("component"))
    rows = parts.select("component", F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(placed).join(large, "component", "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["b"].isna()
        label = propagate(sorted(pdf.loc[alone, "a"]), list(zip(pdf.loc[~alone, "a"], pdf.loc[~alone, "b"])), rounds)
        return pd.DataFrame(label.items(), columns=["id", "label"])

    small = rows.groupBy("component").applyInPandas(run, "id string, label string")
    if large.isEmpty():
        return small
    return small.unionByName(propagate_by_joins(placed.join(large, "component", "left_semi"), rounds))


def communities(labels: DataFrame, partitions: int = 64) -> DataFrame:
    """id, label, community_id: numbered by falling size, then smallest member.

    Numbers come from ranges of the order: each range counts its own, and a small table of range
    sizes gives the numbers before it.
    """
    sized = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    dealt = cut(sized.repartitionByRange(partitions, F.desc("size"), "first").withColumn("part", F.spark_partition_id()))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "first")) - 1
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")  # a row a range
    number = dealt.withColumn("n", inner).join(F.broadcast(before), "part").select("label", (F.col("n") + F.col("before")).cast("string").alias("n"))
    name = F.concat(F.lit("community-"), F.when(F.length("n") < 3, F.lpad("n", 3, "0")).otherwise(F.col("n")))
    return labels.join(number.select("label", name.alias("community_id")), "label")


def summaries(nodes: DataFrame, edges: DataFrame, members: DataFrame, write: Callable[[Column], Column] | None = None) -> DataFrame:
    """community_id, member_count, top_members, summary; ``write`` turns the extracted summary into another text."""
    ranked = members.join(nodes.select("id", "name"), "id").join(degree(edges), "id", "left").fillna({"degree": 0})
    place = F.struct((-F.col("degree")).alias("d"), "name", "id")
    dealt = ranked.select("community_id", place.alias("t"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    w = Window.partitionBy("community_id", "part").orderBy("t")  # the best of a community are among the best of its parts
    sizes = dealt.groupBy("community_id").agg(F.count("*").alias("member_count"))
    few = dealt.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP).groupBy("community_id").agg(F.slice(F.array_sort(F.collect_list("t")), 1, TOP).alias("t"))
    top = sizes.join(few, "community_id")
    a = members.select(F.col("id").alias("src"), F.col("community_id"))
    b = members.select(F.col("id").alias("dst"), F.col("community_id").alias("other"))
    inner = edges.join(a, "src").join(b, "dst").where("community_id = other").groupBy("community_id", "relation_type").agg(F.count("*").alias("n"))
    said = inner.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "relation_type"))).alias("rels"))
    names = F.transform("t", lambda x: x["name"])
    relations = F.array_join(F.transform("rels", lambda x: F.concat(x["relation_type"], F.lit(" ×"), (-x["k"]).cast("string"))), ", ")
    text = F.concat(F.col("member_count").cast("string"), F.lit(" entities centered on "), F.array_join(names, ", "), F.when(F.col("rels").isNotNull(), F.concat(F.lit("; internal relations: "), relations)).otherwise(""))
    return top.join(said, "community_id", "left").select("community_id", "member_count", F.array_join(names, ", ").alias("top_members"), (write(text) if write else text).alias("summary"))


def list_communities(summarized: DataFrame, limit: int = 20) -> DataFrame:
    """The largest communities of ``summaries``, ties by id."""
    return summarized.orderBy(F.desc("member_count"), "community_id").limit(limit)


class UnknownCommunity(LookupError):
    """No community has this id."""


def community_members(summarized: DataFrame, members: DataFrame, nodes: DataFrame, community_id: str) -> DataFrame:
    """id, name, entity_type, status of one community's members by (name, id); an id that no community has is an error."""
    if summarized.where(F.col("community_id") == community_id).isEmpty():
        raise UnknownCommunity(community_id)
    mine = members.where(F.col("community_id") == community_id).select("id")
    return nodes.join(mine, "id", "left_semi").select("id", "name", "entity_type", "status").orderBy("name", "id")
