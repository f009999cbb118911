"""Exact nearest search over an adaptive tree of target cells.

The targets of an area lie on a grid of 4096 x 4096 cells over their own extent.  Cells that hold few
targets together are one leaf; crowded ones are cut further, each level by 8 x 8, so neither an empty
region nor a crowded spot sets the width for the others.  A node keeps the box and one member.

A query goes down the levels: an upper bound of the distance to a node's member bounds what it can
still gain, and nodes whose box is farther than its best bound are left.  A node carries its children
(64 at most) in one row, so they are judged before anything is shuffled; a handful of nodes per query
and level stay, wherever the query is.  Queries stop at leaves, whatever their level, and only the
members of those are measured.  All joins are on (area, node); on the way down queries are salted,
because many of them may look at one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.session import written_table

#: Targets of a leaf, levels, and bits of the grid that one level reads.
LEAF, LEVELS, BITS = 16, 4, 3
_GRID = 1 << LEVELS * BITS


def tree(targets: DataFrame, keys: list[str], geometry: list[str], payload: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(cells, members): cells with their node on every level (id0 .. id4), the level of their leaf, box and one member; members with their leaf (id4).

    Targets with equal ``geometry`` are one member with the first payload in ``order``.
    """
    box = ["_x0", "_y0", "_x1", "_y1"]
    t = targets.groupBy(*keys, *geometry, *box).agg(F.min(F.struct(F.col(order).alias("o"), F.col(payload).alias("p"))).alias("_op"))
    x, y = (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2
    span = t.groupBy(*keys).agg(F.min(x).alias("_mx"), F.min(y).alias("_my"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("_w"))
    t = t.join(span, keys) if keys else t.crossJoin(F.broadcast(span))  # without areas the span is one row
    on_grid = lambda v, low: F.least(F.lit(_GRID - 1), F.floor(F.coalesce(F.try_divide(v - F.col(low), F.col("_w")), F.lit(0.0)) * _GRID)).cast("long")
    t = written_table(t.withColumns({"_cx": on_grid(x, "_mx"), "_cy": on_grid(y, "_my")}).drop("_mx", "_my", "_w"))
    member = F.first(F.struct(*geometry)).alias("rep")
    cells = t.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("n"), F.min("_x0").alias("_x0"), F.min("_y0").alias("_y0"), F.max("_x1").alias("_x1"), F.max("_y1").alias("_y1"), member)

    def at(level: int):
        cut = (LEVELS - level) * BITS
        return F.lit(level << 40) + F.shiftleft(F.shiftright("_cx", cut), 20) + F.shiftright("_cy", cut)

    cells = cells.withColumns({f"_a{i}": at(i) for i in range(1, LEVELS + 1)})
    for i in range(1, LEVELS):
        many = cells.groupBy(*keys, f"_a{i}").agg(F.sum("n").alias(f"_n{i}"))
        cells = cells.join(many, [*keys, f"_a{i}"])
    # a leaf stands for itself on all levels below it
    leaf = F.coalesce(*[F.when(F.col(f"_n{i}") <= LEAF, F.lit(i)) for i in range(1, LEVELS)], F.lit(LEVELS))
    cells = cells.withColumn("_leaf", leaf)
    ids = [F.lit(0).cast("long").alias("id0")]
    for i in range(1, LEVELS + 1):
        own = F.col(f"_a{i}")
        for k in range(1, i):
            own = F.when(F.col("_leaf") == k, F.col(f"_a{k}")).otherwise(own)
        ids.append(own.alias(f"id{i}"))
    cells = written_table(cells.select(*keys, "_cx", "_cy", *box, "rep", "_leaf", *ids))
    members = t.join(cells.select(*keys, "_cx", "_cy", f"id{LEVELS}"), [*keys, "_cx", "_cy"]).select(*keys, f"id{LEVELS}", *geometry, "_op.*")
    return cells, members


def nearest(queries: DataFrame, targets: DataFrame, query_id: str, payload: str, order: str, distance, at_most, box_distance, geometry: list[str],
            qx: str, qy: str, keys: list[str], salt: int = 8) -> DataFrame:
    """(query_id, distance, payload): the nearest target, ties by ``order``; null when the area has none.

    ``distance(columns)`` is the distance from the query to a target whose geometry columns are given
    by name, ``at_most(columns)`` that or a cheaper upper bound of it, ``box_distance(box)`` a lower
    bound for all targets within the box's _x0, _y0, _x1, _y1.
    """
    cells, members = tree(targets, keys, geometry, payload, order)
    depth = cells.agg(F.max("_leaf")).first()[0] or 1
    q = queries.select(*keys, query_id, qx, qy)
    mine, box = [*keys, query_id, qx, qy], ["_x0", "_y0", "_x1", "_y1"]
    salts = F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_s")
    own_salt = F.pmod(F.hash(query_id), F.lit(salt)).alias("_s")
    # few sites may stand in one partition: the search takes more work than the rows show
    n = 2 * max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), q.sparkSession.sparkContext.defaultParallelism)
    front, at_leaf = q.repartition(n, *keys, query_id).select(*mine, F.lit(0).cast("long").alias("_node"), F.lit(None).cast("double").alias("_ub")), None
    for i in range(1, depth + 1):
        # the first level goes on whole; from the second on a leaf is an end
        part = cells.filter(F.col("_leaf") >= i) if i > 2 else cells
        nodes = part.groupBy(*keys, f"id{i - 1}", f"id{i}").agg(*[f(b).alias(b) for b, f in zip(box, (F.min, F.min, F.max, F.max))], F.first("rep").alias("rep"), (F.max("_leaf") <= i).alias("leaf"))
        nodes = nodes.groupBy(*keys, F.col(f"id{i - 1}").alias("_node")).agg(F.collect_list(F.struct(F.col(f"id{i}").alias("id"), *box, "rep", "leaf")).alias("_kids")).select("*", salts)
        # queries made from a few rows look small to the planner, which would send them all through the driver
        side = front.select("*", own_salt)
        j = (side if i > 1 else side.hint("merge")).join(nodes, [*keys, "_node", "_s"])
        j = j.select(*mine, F.least(F.array_min(F.transform("_kids", lambda k: at_most({g: k["rep"][g] for g in geometry}))), "_ub").alias("_ub"), "_kids")
        # the outer form: for the plain one the planner repeats the lists in a filter below
        j = j.select(*mine, "_ub", F.inline_outer("_kids")).withColumn("_lb", box_distance({b: F.col(b) for b in box})).filter(F.col("_lb") <= F.col("_ub"))
        j = j.select(*mine, "_ub", "_lb", "id", "leaf")
        if i > 1:
            j = j.withColumn("_ub", F.min("_ub").over(W.partitionBy(*mine))).filter(F.col("_lb") <= F.col("_ub"))
        if i > 1 or i == depth:
            ends = j.filter("leaf").select(*mine, F.col("id").alias(f"id{LEVELS}"))
            at_leaf = ends if at_leaf is None else at_leaf.unionByName(ends)
        front = (j.filter(~F.col("leaf")) if i > 1 else j).select(*mine, F.col("id").alias("_node"), "_ub")
    # members are many and a leaf holds few: no copies of them, a crowded leaf is left to the skew join
    cand = at_leaf.join(members, [*keys, f"id{LEVELS}"])
    best = cand.groupBy(*keys, query_id).agg(F.min(F.struct(distance({g: F.col(g) for g in geometry}).alias("d"), "o", "p")).alias("_b"))
    return q.select(*keys, query_id).join(best, [*keys, query_id], "left").select(*keys, query_id, F.col("_b.d").alias("distance"), F.col("_b.p").alias(payload))
