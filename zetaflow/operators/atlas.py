"""Corpus map: communities of a neighbour graph, their terms, centres, exemplars, trails and a projection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..sources.state import keep

#: Nodes up to which labels are passed in one task; above, level by level over the cluster, with the same result.
IN_PLACE_NODES = 200_000
PRIOR = 500.0


def diversity(neighbours: DataFrame, owner: DataFrame) -> DataFrame:
    """Distinct other documents among each chunk's neighbours. ``owner`` has (id, doc)."""
    own = owner.select(F.col("id").alias("qid"), F.col("doc").alias("mine"))
    return neighbours.join(own, "qid").join(owner, "id").groupBy("qid").agg(F.count_distinct(F.when(F.col("doc") != F.col("mine"), F.col("doc"))).alias("others"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``node, label``: each node takes the label with the most weight around it; it keeps its own on a tie, else the smallest.

    Labels change in place, in node order, until a round moves none. A small graph
    takes one task. In a larger one, nodes whose smaller neighbours have all had
    their turn form a level; those of one level share no edge, so they take their
    turn at once, and the result is that of the node order. The edges of one node
    meet in one row: mutual nearest neighbours are at most k.
    """
    edges = keep(edges.select("a", "b", "sim"))  # they are counted first and passed on in both directions
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    if both.select("a").distinct().limit(IN_PLACE_NODES + 1).count() <= IN_PLACE_NODES:
        return both.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: _in_place(pdf, rounds), "node long, label long")
    return _by_levels(both, rounds)


def _levels(both: DataFrame) -> list[DataFrame]:
    """Nodes in levels, each after all of its smaller neighbours: what has none left goes, with its edges to larger ones."""
    nodes = keep(both.select(F.col("a").alias("node")).distinct())
    open_ = keep(both.filter("b < a").select("a", "b").distinct())
    levels = []
    while not nodes.isEmpty():
        held = open_.select(F.col("a").alias("node")).distinct()
        levels.append(keep(nodes.join(held, "node", "left_anti")))
        nodes = keep(nodes.join(held, "node", "left_semi"))
        open_ = keep(open_.join(levels[-1].withColumnRenamed("node", "b"), "b", "left_anti"))
    return levels


def _by_levels(both: DataFrame, rounds: int) -> DataFrame:
    levels = _levels(both)
    labels = [keep(n.withColumn("label", F.col("node"))) for n in levels]
    near = [keep(both.join(n, both.a == n.node, "left_semi")) for n in levels]
    for _ in range(rounds):
        moved = False
        for i, edges in enumerate(near):
            now = reduce(DataFrame.unionByName, labels)
            seen = edges.join(now.withColumnRenamed("node", "b"), "b").groupBy("a", "label").agg(F.array_sort(F.collect_list(F.struct("b", "sim"))).alias("of"))
            # sums in the order of neighbours, as in one task, so that equal weights stay equal
            votes = seen.select("a", "label", F.reduce("of", F.lit(0.0), lambda x, e: x + e.sim.cast("double")).alias("w"))
            mine = votes.join(labels[i].select(F.col("node").alias("a"), F.col("label").alias("own")), "a")
            best = mine.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label") != F.col("own"), "label")).alias("label"), F.first("own").alias("own"))
            turned = keep(best)
            moved |= not turned.filter("label <> own").isEmpty()
            labels[i] = turned.drop("own")
        if not moved:
            break
    return reduce(DataFrame.unionByName, labels)


def _in_place(pdf: pd.DataFrame, rounds: int) -> pd.DataFrame:
    near: dict[int, list] = {}
    for a, b, w in zip(pdf["a"], pdf["b"], pdf["sim"], strict=True):
        near.setdefault(int(a), []).append((int(b), float(w)))
    near = {n: sorted(near[n]) for n in sorted(near)}
    label = {n: n for n in near}
    for _ in range(rounds):
        moved = False
        for n, around in near.items():
            votes: dict[int, float] = {}
            for b, w in around:
                votes[label[b]] = votes.get(label[b], 0.0) + w
            most = max(votes.values())
            if votes.get(label[n], -1.0) < most:
                label[n] = min(x for x, w in votes.items() if w == most)
                moved = True
        if not moved:
            break
    return pd.DataFrame({"node": list(label), "label": list(label.values())})


def communities(members: DataFrame, least: int = 25, docs: int = 3, most: int = 24) -> DataFrame:
    """Kept labels (node, label, doc): large and varied enough, the largest first, ties to the first member."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("doc").alias("docs"), F.min("node").alias("first"))
    return sizes.filter((F.col("size") >= least) & (F.col("docs") >= docs)).orderBy(F.desc("size"), "first").limit(most)


def theme_terms(tokens: DataFrame, k: int = 9, least: int = 4, least_overall: int = 8) -> DataFrame:
    """Terms over-represented in each theme (theme, term): log-odds against a Dirichlet prior, largest z first."""
    own = tokens.filter("theme is not null").groupBy("theme", "term").agg(F.count(F.lit(1)).cast("double").alias("f"))
    totals = own.groupBy("theme").agg(F.sum("f").alias("c_total"))
    overall = tokens.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("g"))
    whole = overall.agg(F.sum("g").alias("g_total"))
    x = own.join(overall, "term").join(totals, "theme").crossJoin(F.broadcast(whole)).filter((F.col("f") >= least) & (F.col("g") >= least_overall))
    prior = PRIOR * F.col("g") / F.col("g_total")
    odds = lambda n, total: (n + prior) / (total + PRIOR - n - prior)
    z = F.log(odds(F.col("f"), F.col("c_total")) / odds(F.col("g"), F.col("g_total"))) / F.sqrt(1.0 / (F.col("f") + prior) + 1.0 / (F.col("g") + prior))
    w = Window.partitionBy("theme").orderBy(F.desc("z"), "term")
    return x.withColumn("z", z).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select("theme", "term", "z", "nth")


def centroids(members: DataFrame, dim: int, group: str = "theme") -> DataFrame:
    """Unit sum of each group's vectors (group, v)."""
    sums = members.groupBy(group).agg(F.array(*(F.sum(F.col("v")[i].cast("double")) for i in range(dim))).alias("s"))
    n = F.sqrt(F.reduce("s", F.lit(0.0), lambda a, x: a + x * x))
    return sums.select(group, F.transform("s", lambda x: x / F.greatest(n, F.lit(1e-9))).alias("centre"))


def exemplars(members: DataFrame, centres: DataFrame, k: int = 5, group: str = "theme") -> DataFrame:
    """The ``k`` members nearest the centre, one per document (group, id, doc, v)."""
    from ..functions.vector import dot

    scored = members.join(centres, group).select(group, "id", "doc", dot(F.col("v"), F.col("centre")).alias("sim"))
    one = Window.partitionBy(group, "doc").orderBy(F.desc("sim"), "id")
    top = Window.partitionBy(group).orderBy(F.desc("sim"), "id")
    return scored.withColumn("n", F.row_number().over(one)).filter("n = 1").withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k).drop("n")


def trail(seed: int, near: dict[int, list[tuple[int, float]]], base: dict[int, str], theme: set[int], steps: int = 7, repeat: float = 0.995) -> list[int]:
    """From the seed to the nearest unvisited work, no near-verbatim repeat, members of the theme first; kept if three long."""
    out, seen = [seed], {base[seed]}
    while len(out) < steps:
        open_ = [(n, s) for n, s in near.get(out[-1], []) if base[n] not in seen and s < repeat]
        step = next((n for n, _ in open_ if n in theme), next((n for n, _ in open_), None))
        if step is None:
            break
        out.append(step)
        seen.add(base[step])
    return out if len(out) >= 3 else []


def trails(neighbours: DataFrame, base: DataFrame, themes: DataFrame, seeds: DataFrame, steps: int = 7, repeat: float = 0.995) -> DataFrame:
    """``theme, step, node``: :func:`trail` for all themes at once, a join per step on one node of each theme.

    ``neighbours`` (qid, id, dist, rank), ``base`` (id, base: the work a chunk is
    of), ``themes`` (id, theme), ``seeds`` (theme, node).
    """
    works = base.select(F.col("id").alias("node"), "base")
    near = neighbours.select(F.col("qid").alias("from"), F.col("id").alias("node"), "dist", "rank").filter(F.lit(1.0) - F.col("dist") < repeat).join(works, "node")
    near = near.join(themes.select(F.col("id").alias("node"), F.col("theme").alias("of")), "node", "left")
    at = seeds.join(works, "node").select("theme", "node", F.array("node").alias("nodes"), F.array("base").alias("seen"))
    for _ in range(steps - 1):  # each step names the one before once, so the plan grows by one join
        fits = (F.col("node") == F.col("from")) & ~F.array_contains("seen", F.col("base"))
        order = Window.partitionBy("theme").orderBy(F.col("to").isNull(), F.coalesce(F.col("of") == F.col("theme"), F.lit(False)).desc(), "rank")
        went = at.join(near.withColumnRenamed("node", "to"), fits, "left").withColumn("n", F.row_number().over(order)).filter("n = 1")
        grow = lambda c, new: F.when(F.col("to").isNull(), F.col(c)).otherwise(F.array_append(c, F.col(new))).alias(c)
        at = went.select("theme", F.col("to").alias("node"), grow("nodes", "to"), grow("seen", "base"))
    return at.filter(F.size("nodes") >= 3).select("theme", F.posexplode("nodes").alias("step", "node"))


def fit_view(points: DataFrame) -> DataFrame:
    """Points (id, x, y) scaled to the unit square; an axis without extent lies in the middle."""
    box = points.agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    scale = lambda c: F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}"))).otherwise(F.lit(0.5))
    return points.crossJoin(F.broadcast(box)).select("id", scale("x").alias("x"), scale("y").alias("y"))


def hit_test(points: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """The point nearest to a place within reach, the smaller identifier of equals; no row if there is none."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("d", d).filter(F.col("d") <= reach * reach).orderBy("d", "id").limit(1)


def principal_axes(vectors: DataFrame, dim: int, k: int = 2, iterations: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, k axes) by power iteration on the covariance, which is added up by the executors; dim^2 numbers reach the driver."""

    def run(batches):
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=float).reshape(-1, dim)
            n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    parts = vectors.select("v").mapInPandas(run, "n long, s array<double>, c array<double>")
    total = parts.agg(F.sum("n"), *(F.sum(F.col("s")[i]) for i in range(dim)), *(F.sum(F.col("c")[i]) for i in range(dim * dim))).first() if dim <= 16 else None
    if total is not None:
        n, s, c = total[0], np.array(total[1 : 1 + dim]), np.array(total[1 + dim :])
    else:
        flat = parts.select("n", F.posexplode(F.concat("s", "c")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").toPandas()
        n, s, c = int(flat["n"].iloc[0]), flat["x"].to_numpy()[:dim], flat["x"].to_numpy()[dim:]
    mean = s / max(1, n)
    cov = c.reshape(dim, dim) / max(1, n) - np.outer(mean, mean)
    axes: list[np.ndarray] = []
    for a in range(k):
        v = np.cos(np.arange(dim) * (a + 1.7) + 0.3)
        for _ in range(iterations):
            for u in axes:
                v = v - (v @ u) * u
            v = cov @ v
            v /= max(np.linalg.norm(v), 1e-12)
        axes.append(v)
    return mean, np.array(axes)


def sample_points(ordered: DataFrame, total: int, want: int) -> DataFrame:
    """Every point at which a stride accumulator steps (column ``i`` from 0), and all members of a theme."""
    step = F.floor((F.col("i") + 1) * want / total) > F.floor(F.col("i") * want / total)
    return ordered.filter(step | F.col("theme").isNotNull())


def passage(text) -> object:
    return snippet(text, 220)
