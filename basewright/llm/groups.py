"""Connected components and linking inside candidate buckets.

Both join and aggregate; no task sees a whole bucket, nor more of a component
than a bounded number of edges, and nothing but row counts goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import ID_ROWS, small, stored

#: Edges (16 bytes each) up to which one task ends a contraction.
FEW_EDGES = 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the edges (a, b) and the least id of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _ended(batches):
    ends = [[np.asarray(batch[c]) for c in "ab"] for batch in batches if batch.num_rows]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rooted(*(np.concatenate(x) for x in zip(*ends)))], ["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """id, root for every id in ``edges`` (a, b: long); root is the component's least id.

    Contraction: each vertex moves to the neighbour that comes first in an order
    drawn anew in each round, so any shape shrinks by a constant factor; the last
    ``FEW_EDGES`` are ended at once. Moves are put together from the last round
    back to the first, so a vertex is joined only in rounds that it moved in.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    rounds = []
    while edges.limit(FEW_EDGES + 1).count() > FEW_EDGES:
        rank = lambda c, turn=len(rounds): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        near = _both(edges).groupBy("a").agg(F.min(rank("b")).alias("best"))
        moves = stored(near.select(F.col("a").alias("id"), F.least(F.col("best"), rank("a"))["v"].alias("to")), "moves")
        rounds.append(moves)
        for end in "ab":
            step = small(moves.select(F.col("id").alias(end), F.col("to").alias("_to")), ID_ROWS)
            edges = edges.join(step, end).drop(end).withColumnRenamed("_to", end)
        edges = stored(edges.where("a <> b").distinct(), "edges")
    labels = stored(edges.coalesce(1).mapInArrow(_ended, "id long, root long"), "labels")
    if not rounds:
        return labels
    for moves in reversed(rounds):
        labels = stored(moves.join(small(labels.withColumnRenamed("id", "to"), ID_ROWS), "to", "left").select("id", F.coalesce("root", "to").alias("root")), "labels")
    total = labels.groupBy("root").agg(F.min("id").alias("least"))
    return stored(labels.join(small(stored(total, "roots"), ID_ROWS), "root").select("id", F.col("least").alias("root")), "components")


def link_buckets(members: DataFrame, close: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame] | None = None, closer: Callable[[str, str], Column] | None = None, sure: Callable[[str, str], Column] | None = None, stars: int = 2) -> DataFrame:
    """id, root over all pairs that share a bucket and are confirmed; ids without a link are absent.

    ``members`` (a stored table): key, v and a struct ``d``, whose long ``lead`` is least for members likely
    to have many links. ``close(x, y)`` says by the two structs whether a pair is worth confirming;
    ``confirm`` keeps the true links of (a, b).

    A bucket first links its members to one of them, another one in each of the
    ``stars`` rounds; members already in one component need no test. What is
    left are buckets that still hold several components: there every pair of
    members of different components is tested, filtered inside the join. For
    these few members ``refine`` may give a finer sketch (v, e) that ``closer``
    compares, and ``sure`` once more, once for each pair.
    """
    spark = members.sparkSession
    tested = edges = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, root long")
    for turn in range(stars + 1):
        state = members.join(small(labels, ID_ROWS), F.col("v") == F.col("id"), "left").select("key", "v", "d", F.coalesce("root", "v").alias("c")) if turn else members.withColumn("c", F.col("v"))
        first = F.col("d.lead") if turn == 0 else F.lit(0)
        hub = F.min(F.struct(first.alias("lead"), F.xxhash64("v", F.lit(turn)).alias("h"), F.col("v").alias("v"), F.col("c").alias("c")))
        live = stored(state.groupBy("key").agg(hub.alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", "hub"), "buckets")
        if not live.limit(1).count():
            break
        if turn < stars:
            spokes = state.join(small(live), "key").where(F.col("c") != F.col("hub.c")).select(F.col("hub.v").alias("x"), F.col("v").alias("y")).distinct()
            look = members.select(F.col("v"), "d").dropDuplicates(["v"])
            look = small(stored(look, "looks"), ID_ROWS // 10)
            pairs = spokes.join(look.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x").join(look.select(F.col("v").alias("y"), F.col("d").alias("dy")), "y").where(close("dx", "dy"))
        else:
            rest = stored(state.join(small(live.select("key")), "key"), "rest")
            finer = stored(refine(stored(rest.select("v").distinct(), "rest-ids")), "finer") if refine else rest.select("v", F.lit(0).alias("e")).distinct()
            homes = rest.groupBy("v").agg(F.collect_set("key").alias("homes"))
            rest = rest.join(finer.join(homes, "v"), "v")
            left, right = (rest.select("key", F.col("v").alias(n), *[F.col(c).alias(f"{c[0]}{n}") for c in ("d", "c", "e", "homes")]) for n in "xy")
            near = close("dx", "dy") & closer("ex", "ey") if closer else close("dx", "dy")
            # a pair comes out of the first bucket that both are in
            once = F.array_min(F.array_intersect("hx", "hy")) == left.key
            pairs = left.join(right, (left.key == right.key) & (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & near & (once & sure("ex", "ey") if sure else once))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(small(tested, ID_ROWS), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        edges = stored(edges.union(confirm(pairs).select("a", "b")), "links")
        tested = stored(tested.union(pairs), "tested")
        labels = components(edges)
    return labels
