"""Saved models: a table of tree nodes, read back as trees, and scored by column expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import WHOLE, Change, Ledger

NODE = "tree int, node int, depth int, feature string, threshold double, left int, right int, value double, rows long"


def node_rows(trees: list[tuple], names: list[str]) -> list[tuple]:
    """Rows of NODE: trees numbered from 0, their nodes from 0 at the top down to their depth; leaves have a value, others a feature."""
    out = []

    def add(t: int, tree: tuple, own: list, depth: int = 0) -> int:
        own.append(None)
        at = len(own) - 1
        if len(tree) == 2:
            own[at] = (t, at, depth, None, None, None, None, float(tree[0]), int(tree[1]))
        else:
            f, threshold, left, right, n = tree
            own[at] = (t, at, depth, names[f], float(threshold), add(t, left, own, depth + 1), add(t, right, own, depth + 1), None, int(n))
        return at

    for t, tree in enumerate(trees):
        own: list = []
        add(t, tree, own)
        out += own
    return out


def save_model(ledger: Ledger, model_id: str, trees: list[tuple], names: list[str]) -> None:
    """The model in place of what was saved under its id. A model is as large as its trees, not as its data."""
    rows = ledger.spark.createDataFrame(node_rows(trees, names), NODE).withColumn("model_id", F.lit(model_id))
    ledger.commit({"model_nodes": Change(rows, F.col("model_id") == model_id, (WHOLE,))})


def nodes_of(ledger: Ledger, model_id: str) -> DataFrame:
    rows = ledger.read("model_nodes").where(F.col("model_id") == model_id).drop("model_id")
    if rows.isEmpty():
        raise ValueError(f"no model {model_id}")
    return rows


def load_model(ledger: Ledger, model_id: str) -> tuple[list[tuple], list[str]]:
    """(trees as nested tuples, names of their features in order)."""
    rows = nodes_of(ledger, model_id).collect()
    names = sorted({r.feature for r in rows if r.feature is not None})
    of = {(r.tree, r.node): r for r in rows}

    def build(t: int, at: int) -> tuple:
        r = of[t, at]
        return (r.value, r.rows) if r.feature is None else (names.index(r.feature), r.threshold, build(t, r.left), build(t, r.right), r.rows)

    return [build(t, 0) for t in sorted({t for t, _ in of})], names


def scored(rows: DataFrame, nodes: DataFrame, name: str = "composite_score") -> DataFrame:
    """``rows`` with ``name``, the sum of the values of the leaves they come to.

    The nodes become one row of arrays (a model's size), which each task has; rows walk down by column expressions.
    A row goes left where its feature is at most the threshold; a null goes right. Other columns stay.
    """
    depth = nodes.agg(F.max("depth")).first()[0]
    names = sorted(r[0] for r in nodes.where("feature is not null").select("feature").distinct().collect())
    place = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("feature")), F.lit(0)).cast("int") if names else F.lit(0)
    cell = F.struct("node", place.alias("f"), "threshold", "left", "right", "value")
    trees = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(cell)).alias("t")).agg(F.collect_list("t").alias("_trees"))
    both = rows.crossJoin(F.broadcast(trees))  # one row
    x = F.array(*[F.col(n).cast("double") for n in names]) if names else F.array(F.lit(0.0))

    def leaf(t):
        step = lambda at: F.when(x[t[at]["f"] - 1] <= t[at]["threshold"], t[at]["left"]).otherwise(t[at]["right"])
        return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), F.lit(0), lambda at, _: F.when(t[at]["f"] == 0, at).otherwise(step(at)))

    total = F.aggregate("_trees", F.lit(0.0), lambda s, t: s + t[leaf(t)]["value"])
    return both.withColumn(name, total).drop("_trees")
