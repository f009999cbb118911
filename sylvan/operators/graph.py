"""Road-graph operators: routing edges, shortest paths, centrality, paths and flows.

Searches by length run in :mod:`.overlay`: exact inside the parts of a network, joined over the ends
of the edges between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.formulas import R_EARTH_ETL, WALK_SPEED
from ..functions.geo import haversine_m
from ..functions.numeric import js_round
from ..functions.session import cut_lineage, written_table
from . import overlay
from .cells import is_circulation, road_tier
from .ranking import exact_rank
from .reports import graph_degree
from .spatial import assign_points_to_polygons, middle_vertex, sum_per_cell

PARK = ("park_id",)


def routing_edges(roads: DataFrame, group_cols=PARK) -> DataFrame:
    """Undirected routing edges a < b: circulation ways only, no loops, missing length 1, parallel edges reduced to the shortest."""
    ln = F.when(F.coalesce(F.col("length"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("length"))
    return roads.filter(is_circulation() & F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).groupBy(
        *group_cols, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(ln).alias("length"))


def both_directions(edges: DataFrame, group_cols=PARK) -> DataFrame:
    return edges.select(*group_cols, F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.col("length")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.col("length")))))


def node_coordinates(lines: DataFrame, group_cols=PARK, seq: str = "segment_id") -> DataFrame:
    """Position of each node: u is the first and v the last vertex; the last row wins."""
    c = F.col("coords")
    first, last = c[0], F.element_at(c, -1)
    ends = F.array(F.struct(F.col("u").alias("node"), first["lng"].alias("lng"), first["lat"].alias("lat"), F.lit(0).alias("o")),
                   F.struct(F.col("v").alias("node"), last["lng"].alias("lng"), last["lat"].alias("lat"), F.lit(1).alias("o")))
    e = lines.filter(F.size(c) >= 2).select(*group_cols, seq, F.inline(ends)).filter(F.col("node").isNotNull())
    g = e.groupBy(*group_cols, "node").agg(F.max_by(F.struct("lng", "lat"), F.struct(seq, "o")).alias("_p"))
    return g.select(*group_cols, "node", "_p.lng", "_p.lat")


def entrance_node(nodes: DataFrame, group_cols=PARK) -> DataFrame:
    """Graph node nearest to the centre (center_lng, center_lat columns), with the snap distance."""
    d = haversine_m("center_lng", "center_lat", "lng", "lat", R_EARTH_ETL)
    g = nodes.groupBy(*group_cols).agg(F.min_by(F.struct("node", "lng", "lat", d.alias("snap_m")), F.struct(d, "node")).alias("_e"))
    return g.select(*group_cols, F.col("_e.node").alias("src"), F.col("_e.lng").alias("entrance_lng"), F.col("_e.lat").alias("entrance_lat"), F.col("_e.snap_m").alias("snap_m"))


def shortest_paths(edges: DataFrame, sources: DataFrame, group_cols=PARK, max_distance: float | None = None, most: int = overlay.MOST) -> DataFrame:
    """Shortest distance from every source to every reachable node: (group, src, node, distance).

    Networks of more than ``most`` nodes are cut into parts, see :mod:`.overlay`.  ``max_distance``
    bounds the search (20 minutes of walking need 1600 m).
    """
    keys = list(group_cols)
    return overlay.distances(overlay.network(edges, keys, most), sources, max_distance)


def cell_network_distance(dist: DataFrame, nodes: DataFrame, polygons: DataFrame, group_cols=PARK, **kw) -> DataFrame:
    """Smallest node distance per cell with the winning node's position."""
    keys = list(group_cols)
    n = dist.select(*keys, "node", "distance").join(nodes, [*keys, "node"])
    hit = assign_points_to_polygons(n, polygons, "node", group_cols=keys, **kw).join(n, [*keys, "node"])
    g = hit.groupBy(*keys, "h3_id").agg(F.min(F.struct("distance", "node", "lng", "lat")).alias("_m"))
    return g.select(*keys, "h3_id", F.col("_m.distance").alias("network_m"), F.col("_m.node").alias("node"), F.col("_m.lng").alias("node_lng"), F.col("_m.lat").alias("node_lat"))


def walk_access(cells: DataFrame, network: DataFrame, entrance: DataFrame, group_cols=PARK) -> DataFrame:
    """Walking minutes and route directness per cell; unreachable cells stay null."""
    keys = list(group_cols)
    j = cells.select(*keys, "h3_id").join(network, [*keys, "h3_id"], "left").join(entrance, keys, "left")
    line = haversine_m("entrance_lng", "entrance_lat", "node_lng", "node_lat", R_EARTH_ETL)
    return j.select(*keys, "h3_id", F.bround("network_m", 1).alias("network_distance_m"), F.bround(F.col("network_m") / WALK_SPEED, 1).alias("walk_minutes"),
                    F.when(F.col("network_m") > 0, F.bround(line / F.col("network_m"), 3)).alias("directness"))


def cell_intersections(roads: DataFrame, nodes: DataFrame, polygons: DataFrame, group_cols=PARK, **kw) -> DataFrame:
    """Nodes of degree 3 or more per cell."""
    keys = list(group_cols)
    d = graph_degree(roads, keys).filter(F.col("degree") >= 3).join(nodes, [*keys, "node"])
    hit = assign_points_to_polygons(d, polygons, "node", group_cols=keys, **kw)
    c = hit.groupBy(*keys, "h3_id").agg(F.count(F.lit(1)).alias("n"))
    return polygons.select(*keys, "h3_id").join(c, [*keys, "h3_id"], "left").select(*keys, "h3_id", F.coalesce("n", F.lit(0)).cast("long").alias("intersections"))


def cell_barriers(lines: DataFrame, polygons: DataFrame, group_cols=PARK, **kw) -> DataFrame:
    """Primary (2) and secondary (1) segments by middle vertex per cell."""
    keys = list(group_cols)
    w = F.when(road_tier() == "primary", 2).when(road_tier() == "secondary", 1)
    m = middle_vertex(lines, *keys, w.alias("_w")).filter(F.col("_w").isNotNull())
    j = polygons.select(*keys, "h3_id").join(sum_per_cell(m, "_w", polygons, keys, **kw), [*keys, "h3_id"], "left")
    return j.select(*keys, "h3_id", F.coalesce("_sum", F.lit(0)).cast("long").alias("barrier_score"))


def graph_nodes(edges: DataFrame, group_cols=PARK) -> DataFrame:
    return edges.select(*group_cols, F.explode(F.array("a", "b")).alias("node")).distinct()


def closeness(edges: DataFrame, sources: DataFrame, group_cols=PARK, net: overlay.Network | None = None) -> DataFrame:
    """Closeness of each source with the component-size correction: (r-1)/sum(d) * (r-1)/(N-1)."""
    keys = list(group_cols)
    net = net or overlay.network(edges, keys)
    n = net.nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = F.col("reached") - 1
    c = F.coalesce(F.try_divide(r, "total") * F.try_divide(r, F.col("_n") - 1), F.lit(0.0))
    return overlay.totals(net, sources).join(n, keys).select(*keys, F.col("src").alias("node"), "reached", c.alias("closeness"))


#: Sources of the betweenness of one network.
PIVOTS = 500


def pivots(edges: DataFrame, group_cols=PARK, n: int = PIVOTS) -> DataFrame:
    """Pivot sources (group, src, pivot): ``n`` nodes of each group in the order of a hash of the node, all of them in smaller groups."""
    keys = list(group_cols)
    order = [F.md5(F.col("node").cast("string").cast("binary")), F.col("node")]
    ranked = exact_rank(graph_nodes(edges, keys), keys, order, "pivot")
    return ranked.filter(F.col("pivot") <= n).select(*keys, F.col("node").alias("src"), "pivot")


def betweenness(edges: DataFrame, pivots: DataFrame, group_cols=PARK, net: overlay.Network | None = None) -> DataFrame:
    """Weighted betweenness from a table of pivot sources, normalised and rescaled by N/k."""
    keys = list(group_cols)
    net = net or overlay.network(edges, keys)
    pivots = cut_lineage(pivots.select(*keys, "src"))
    dep = overlay.dependencies(net, pivots)
    n = net.nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    k = pivots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    j = net.nodes.select(*keys, "node").join(dep, [*keys, "node"], "left").join(n, keys).join(k, keys)
    scale = F.col("_n") / F.col("_k") / ((F.col("_n") - 1) * (F.col("_n") - 2))
    x = F.coalesce("dependency", F.lit(0.0))
    return j.select(*keys, "node", F.when(F.col("_n") > 2, x * scale).otherwise(x).alias("betweenness"))


def space_syntax(edges: DataFrame, positions: DataFrame, group_cols=PARK, n_pivots: int = PIVOTS) -> DataFrame:
    """Integration and Choice of every node with a position: 0-100 within its network, two decimals, with position and degree.

    Integration is the closeness from every node, Choice the betweenness from the pivots.
    """
    keys = list(group_cols)
    edges = cut_lineage(edges)
    net = overlay.network(edges, keys)
    close = closeness(edges, net.nodes.select(*keys, F.col("node").alias("src")), keys, net).select(*keys, "node", "closeness")
    j = written_table(close.join(betweenness(edges, pivots(edges, keys, n_pivots), keys, net), [*keys, "node"]))
    ends = j.groupBy(*keys).agg(*[f(c).alias(f"_{name}_{c}") for c in ("closeness", "betweenness") for name, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str):
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.bround((F.col(c) - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo) * 100.0, 2)

    degree = edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))
    out = j.join(ends, keys).join(degree, [*keys, "node"]).join(positions.select(*keys, "node", "lng", "lat"), [*keys, "node"])
    return out.select(*keys, "node", "lng", "lat", scaled("closeness").alias("integration"), scaled("betweenness").alias("choice"), "degree")


def bfs_tree(adjacency: DataFrame, starts: DataFrame, group_cols=()) -> tuple[DataFrame, int]:
    """(group, start, node, parent, level) of every node reachable from the starts, and the number of levels.

    ``adjacency``: source, target, seq (neighbours are tried in seq order, both directions); of
    several edges between two nodes the first counts.  A node belongs to its first discoverer: the
    one that stands first in its own level, which is the order of (parent's place, seq).  A
    neighbour of a level lies in the level before, the same or the next one, so two levels are all
    that is looked at; the visited set is never read or rewritten.
    """
    keys = list(group_cols)
    both = F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v"), F.col("seq").cast("long").alias("q")), F.struct(F.col("target").alias("u"), F.col("source").alias("v"), F.col("seq").cast("long").alias("q")))
    adj = adjacency.select(*keys, F.inline(both)).filter(F.col("u") != F.col("v"))
    adj = written_table(adj.groupBy(*keys, "u", "v").agg(F.min("q").alias("q")))
    own = [*keys, "start"]
    level = written_table(starts.select(*own).distinct().select(*own, F.col("start").alias("node"), F.col("start").alias("parent"), F.lit(1).cast("long").alias("place"), F.lit(0).alias("level")))
    levels, before = [], level
    while not level.isEmpty():
        levels.append(level)
        cand = level.select(*own, F.col("node").alias("u"), "place").join(adj, [*keys, "u"])
        cand = cand.groupBy(*own, F.col("v").alias("node")).agg(F.min(F.struct("place", "q", "u")).alias("m"))
        old = level.select(*own, "node").unionByName(before.select(*own, "node"))
        fresh = cand.join(old, [*own, "node"], "left_anti")
        place = F.row_number().over(W.partitionBy(*own).orderBy("m.place", "m.q", "node")).cast("long")
        before, level = level, written_table(fresh.select(*own, "node", F.col("m.u").alias("parent"), place.alias("place"), F.lit(len(levels)).alias("level")))
    out = (levels or [level])[0]
    for t in levels[1:]:
        out = out.unionByName(t)
    return out.drop("place"), len(levels)


def bfs_paths(adjacency: DataFrame, pairs: DataFrame, group_cols=()) -> DataFrame:
    """Fewest-hop path per (start, end): array of nodes, or the direct hop when there is none.

    The search keeps parents only.  Paths come from pointer jumping: ancestors at 1, 2, 4, ... steps
    by joining the table with itself, then each path is filled in from the longest jump down, so
    the rounds grow with the logarithm of the longest path and no path is carried along.
    """
    keys = list(group_cols)
    own = [*keys, "start"]
    tree, depth = bfs_tree(adjacency, pairs.select(*own), keys)
    tree = written_table(tree)
    jumps = [tree.filter(F.col("level") > 0).select(*own, "node", F.col("parent").alias("up"))]
    while 1 << len(jumps) < depth:
        last = jumps[-1]
        again = last.select(*own, F.col("node").alias("up"), F.col("up").alias("_up2"))
        jumps.append(written_table(last.join(again, [*own, "up"]).select(*own, "node", F.col("_up2").alias("up"))))
    ends = pairs.select(*own, "end").distinct().join(tree.withColumnRenamed("node", "end"), [*own, "end"])
    steps = ends.select(*own, "end", F.col("end").alias("node"), F.col("level").alias("at"))
    for i in range(len(jumps) - 1, -1, -1):
        # every known place of a path gives the one 2^i steps before it
        more = steps.join(jumps[i], [*own, "node"]).select(*own, "end", F.col("up").alias("node"), (F.col("at") - (1 << i)).alias("at"))
        steps = written_table(steps.unionByName(more))
    paths = steps.groupBy(*own, "end").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("_p")).select(*own, "end", F.col("_p.node").alias("path"))
    j = pairs.join(paths, [*own, "end"], "left")
    return j.withColumn("path", F.coalesce("path", F.array("start", "end")))


def capped_path(path, max_intermediate: int):
    """Keep the ends and the first intermediate stops."""
    return F.when(F.size(path) <= max_intermediate + 2, path).otherwise(
        F.concat(F.slice(path, 1, max_intermediate + 1), F.slice(path, F.size(path), 1)))


def traversal_counts(steps: DataFrame, group_cols=("package_id",), space: str = "space") -> DataFrame:
    """How often each space is a step, and its priority 1-10 relative to the busiest space."""
    keys = list(group_cols)
    c = steps.groupBy(*keys, space).agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy(*keys).agg(F.max("n").alias("_m"))
    return c.join(top, keys).select(*keys, space, "n", F.greatest(F.lit(1.0), F.least(F.lit(10.0), js_round(F.col("n") / F.greatest(F.lit(1), F.col("_m")) * 10.0))).alias("priority"))


def _legs(steps: DataFrame, keys, journey: str, position: str, space: str) -> DataFrame:
    """Consecutive steps of a journey whose origin differs from the destination."""
    w = W.partitionBy(*keys, journey).orderBy(position)
    return steps.withColumns({"origin": F.col(space), "destination": F.lead(space).over(w)}).filter(F.col("destination").isNotNull() & (F.col("origin") != F.col("destination")))


def od_demand(steps: DataFrame, group_cols=("package_id",), journey: str = "journey_id", position: str = "position", space: str = "space", persona: str = "persona_id") -> DataFrame:
    """Origin-destination demand from consecutive journey steps: weight, number of journeys, personas.

    Journeys and personas are reduced pairwise before they are counted; the journeys themselves are
    rows of :func:`od_journeys`, since a busy relation has very many.
    """
    keys = list(group_cols)
    per = _legs(steps, keys, journey, position, space).groupBy(*keys, "origin", "destination", journey).agg(F.sum("weight").alias("_w"), F.min(persona).alias(persona))
    return per.groupBy(*keys, "origin", "destination").agg(js_round(F.sum("_w"), 6).alias("weight"), F.count(F.lit(1)).alias("journeys"), F.sort_array(F.collect_set(persona)).alias("personas"))


def od_journeys(steps: DataFrame, group_cols=("package_id",), journey: str = "journey_id", position: str = "position", space: str = "space") -> DataFrame:
    """The journeys behind each origin-destination relation, one row per relation and journey."""
    keys = list(group_cols)
    return _legs(steps, keys, journey, position, space).select(*keys, "origin", "destination", journey).distinct()


# Column order of the experience flow.
FLOW_TIERS = ["age", "archetype", "activity", "experience", "space", "score", "cost"]


def flow_links(rows: DataFrame, group_cols=(), tiers=None, value: str = "area", tier_order=("Kids", "Teens", "Adults", "Old")) -> DataFrame:
    """Sum of areas between adjacent columns and the age tier with the largest part of each link."""
    keys, t = list(group_cols), list(tiers or FLOW_TIERS)
    v = F.greatest(F.lit(1.0), F.coalesce(F.col(value).cast("double"), F.lit(1.0)))
    pairs = F.array(*[F.struct(F.lit(a).alias("source_column"), F.col(a).cast("string").alias("source"), F.lit(b).alias("target_column"), F.col(b).cast("string").alias("target")) for a, b in zip(t, t[1:])])
    ex = rows.select(*keys, v.alias("_v"), F.col(t[0]).alias("_age"), F.inline(pairs))
    ids = ["source_column", "source", "target_column", "target"]
    per = ex.groupBy(*keys, *ids, "_age").agg(F.sum("_v").alias("_v"))
    order = F.array_position(F.array(*[F.lit(x) for x in tier_order]), F.col("_age"))
    return per.groupBy(*keys, *ids).agg(F.sum("_v").alias("value"), F.max_by("_age", F.struct("_v", -order)).alias("dominant_tier"))
