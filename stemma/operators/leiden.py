"""Communities by modularity or the constant Potts model: local moving, splitting into connected parts, aggregation.

Both objectives are sums over communities of w(C) - rho * a(C)^2 / 2 (up to constants), with w the
weight of a community's inner edges and a(C) the sum of its vertices' sizes: a vertex counts 1 and
rho is the resolution for the Potts model; it counts its degree and rho is 1 / 2m for modularity.

A step of local moving finds for every vertex the community that gains most by taking it, a new one
of its own included. Of all these moves those are made that are the best one for both communities
they touch: no community is in two moves, so gains add up exactly and the objective rises with every
step; it can't swing. Growth doesn't hang on that: after ``steps`` steps communities become the
vertices of the next level, where they move as a whole. Between the levels communities fall apart
into their connected parts (which never lowers either objective), so all communities are connected.
When a level brings nothing the vertices themselves are moved once more on what was found.

Ties go to the smaller name; the result depends on the graph alone. Labels are names of member
vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from .graph import between, connected_components

STEPS, LEVELS = 30, 20
_LEAST_GAIN = 1e-12


def _steps(ways: DataFrame, state: DataFrame, rho: float, steps: int) -> tuple[DataFrame, int]:
    """(state after local moving, moves made). ``ways``: id, far, w both ways round; ``state``: id, a, c (its community)."""
    moves = 0
    for step in range(steps):
        total = state.groupBy("c").agg(F.sum("a").alias("total"))
        there = ways.join(state.select(F.col("id").alias("far"), F.col("c").alias("to")), "far").groupBy("id", "to").agg(F.sum("w").alias("w"))
        here = state.join(total, "c").select("id", "a", "c", F.col("total").alias("own"))
        asked = there.join(here, "id").join(total.withColumnRenamed("c", "to"), "to")
        inner = F.col("to") == F.col("c")
        value = F.col("w") - rho * F.col("a") * F.when(inner, F.col("total") - F.col("a")).otherwise(F.col("total"))
        scored = asked.select("id", "a", "c", "own", "to", inner.alias("inner"), value.alias("v"))
        best = scored.groupBy("id").agg(
            F.first("a").alias("a"),
            F.first("c").alias("c"),
            F.first("own").alias("own"),
            F.max(F.when(F.col("inner"), F.col("v"))).alias("stay"),
            F.min(F.when(~F.col("inner"), F.struct((-F.col("v")).alias("v"), "to"))).alias("go"),
        )
        stay = F.coalesce("stay", -rho * F.col("a") * (F.col("own") - F.col("a")))
        alone = F.struct(F.lit(0.0).alias("v"), F.concat("id", F.lit(f"\x01{step}")).alias("to"))  # -0.0 would sort apart
        target = F.when((F.col("own") > F.col("a")) & (F.coalesce(F.col("go.v"), F.lit(1.0)) >= 0), alone).otherwise(F.col("go"))
        wish = best.select("id", "c", target.alias("t"), stay.alias("stay")).select("id", "c", F.col("t.to").alias("to"), (-F.col("t.v") - F.col("stay")).alias("gain")).where(F.col("gain") > _LEAST_GAIN)
        wish = cut(wish)
        key = F.struct((-F.round("gain", 9)).alias("g"), "id")
        first = wish.select(F.explode(F.array("c", "to")).alias("x"), key.alias("k")).groupBy("x").agg(F.min("k").alias("k"))
        made = wish.select("id", "c", "to", key.alias("mine"))
        made = made.join(first.select(F.col("x").alias("c"), F.col("k").alias("k1")), "c").join(first.select(F.col("x").alias("to"), F.col("k").alias("k2")), "to").where("mine = k1 AND mine = k2")
        made = cut(made.select("id", F.col("to").alias("next")))
        n = made.count()
        if not n:
            break
        moves += n
        state = cut(state.join(made, "id", "left").select("id", "a", F.coalesce("next", "c").alias("c")))
    return state, moves


def _connected(ways: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with communities cut into their connected parts, named by their smallest member."""
    a, b = state.select("id", "c"), state.select(F.col("id").alias("far"), F.col("c").alias("d"))
    inner = ways.join(a, "id").join(b, "far").where("c = d AND id < far").select(F.col("id").alias("src"), F.col("far").alias("dst"))
    parts = connected_components(state.select("id"), cut(inner))
    return cut(state.select("id", "a").join(parts.withColumnRenamed("component", "c"), "id"))


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float | None = None, steps: int = STEPS, levels: int = LEVELS) -> DataFrame:
    """id, label. ``resolution`` is the Potts model's; without one modularity is maximised. Edges are undirected and counted once."""
    if resolution is not None and resolution <= 0:
        raise ValueError("the resolution must be above zero")
    pairs = cut(between(edges, nodes).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    ways = cut(pairs.select(F.col("a").alias("id"), F.col("b").alias("far")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("far"))).withColumn("w", F.lit(1.0)))
    m = pairs.count()
    ids = nodes.select("id").distinct()
    if not m:
        return ids.select("id", F.col("id").alias("label"))
    if resolution is None:
        rho = 1.0 / (2 * m)
        sizes = ids.join(ways.groupBy("id").agg(F.sum("w").alias("a")), "id", "left").fillna({"a": 0.0})
    else:
        rho, sizes = resolution, ids.withColumn("a", F.lit(1.0))
    base = cut(sizes.withColumn("c", F.col("id")))
    found = base  # the vertices' communities so far
    for _ in range(levels):
        # Communities as vertices: what lies between them is their edges; inner weight can't change by moving them.
        at = lambda name, other: found.select(F.col("id").alias(name), F.col("c").alias(other))  # noqa: B023, E731
        joined = ways.join(at("id", "x"), "id").join(at("far", "y"), "far").where("x <> y")
        coarse = cut(joined.groupBy(F.col("x").alias("id"), F.col("y").alias("far")).agg(F.sum("w").alias("w")))
        level = cut(found.groupBy("c").agg(F.sum("a").alias("a")).select(F.col("c").alias("id"), "a", F.col("c")))
        moved, n = _steps(coarse, level, rho, steps)
        if n:
            up = moved.select(F.col("id").alias("c"), F.col("c").alias("next"))
            found = cut(found.join(up, "c").select("id", "a", F.col("next").alias("c")))
        fine, more = _steps(ways, found, rho, steps)
        if not n + more:
            break
        found = _connected(ways, fine)
    return found.select("id", F.col("c").alias("label"))


def objective(edges: DataFrame, labels: DataFrame, resolution: float | None = None) -> float:
    """Modularity, or the Potts model's value at ``resolution``, of a partition (id, label)."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    inner, m = both.agg(F.coalesce(F.sum((F.col("x") == F.col("y")).cast("double")), F.lit(0.0)), F.count("*")).first()
    if resolution is not None:
        size = labels.groupBy("label").agg(F.count("*").alias("n"))
        return inner - resolution * (size.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0])
    ends = both.select(F.explode(F.array("x", "y")).alias("label")).groupBy("label").agg(F.count("*").alias("k"))
    return inner / m - (ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0) / (4.0 * m * m) if m else 0.0
