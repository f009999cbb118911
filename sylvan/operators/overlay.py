"""Shortest paths, path counts and dependencies over partitioned networks.

A network is cut into connected-looking parts of at most ``most`` nodes.  Inside a part everything is
exact and done in arrays, many sources at a time: distances, numbers of shortest paths, dependencies.
Between parts only the ends of cut edges matter.  A path is an alternation of stretches inside a part
and cut edges, which makes the decomposition unique, so path counts multiply and add up exactly.  The
rounds of joins between parts are as many as a path crosses cut edges, not as it has edges, and their
state has a row per source and end of a cut edge, not per source and node.  A network that fits one
part has no cut edge and no round at all.

Lengths become whole micrometres, so that sums do not depend on their order and equal paths are equal.

Work is dealt by (network, part, block of sources): neither a large network nor many sources meet in
one task.  A task holds one part (at most ``most`` nodes and its edges) and about :data:`SOURCES`
sources.  A dense part first loses the edges that a way round beats, which no shortest path takes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.session import cut_lineage, ship_code, written_table

#: Nodes of a part, sources of a block, numbers in one array of a search, micrometres in a metre.
MOST, SOURCES, CELLS, UNIT = 2048, 256, 1 << 22, 1_000_000
FAR = np.int64(1) << 60
#: Landmarks of a part, and arcs a node from which on detours are looked for.
LANDMARKS, DENSE = 16, 8


@dataclass
class Network:
    """``nodes`` (keys, node, part, idx), ``pieces`` (keys, part, size, border, u, v, w), ``cuts`` (keys, part, idx, part2, idx2, w)."""

    keys: list[str]
    nodes: DataFrame
    pieces: DataFrame
    cuts: DataFrame
    crossed: bool


def parts(edges: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """(keys, node, part): nodes grouped along edges into parts of at most ``most`` nodes; a part is named by one of its nodes.

    Small networks are one part.  In larger ones every group proposes to the neighbour with which it
    shares the most edges for their sizes; a hash of the round makes about half of the groups hosts,
    which take proposals while there is room.  The rounds grow with the logarithm of ``most``.
    """
    nodes = edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    size = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_first"))
    label = written_table(nodes.join(size, keys).select(*keys, "node", F.when(F.col("_n") <= most, F.col("_first")).otherwise(F.col("node")).alias("part"), (F.col("_n") > most).alias("_open")))
    if label.filter("_open").isEmpty():
        return label.drop("_open")
    done, label = label.filter(~F.col("_open")).drop("_open"), label.filter("_open").drop("_open")
    ends = edges.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    rnd = 0
    while True:
        sizes = label.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
        p = ends.join(label.withColumnsRenamed({"node": "u", "part": "p"}), [*keys, "u"]).join(label.withColumnsRenamed({"node": "v", "part": "q"}), [*keys, "v"])
        p = p.filter(F.col("p") != F.col("q")).groupBy(*keys, "p", "q").agg(F.count(F.lit(1)).alias("w"))
        p = p.join(sizes.withColumnsRenamed({"part": "p", "n": "np"}), [*keys, "p"]).join(sizes.withColumnsRenamed({"part": "q", "n": "nq"}), [*keys, "q"]).filter(F.col("np") + F.col("nq") <= most)
        rating = F.col("w") / F.col("np") / F.col("nq")
        host = lambda c: F.xxhash64(F.col(c), F.lit(rnd)) % 2 == 0  # noqa: E731,B023
        p = p.withColumns({"rating": rating, "guest": ~host("p") & host("q")})
        best = p.filter("guest").groupBy(*keys, "p").agg(F.max_by(F.struct("q", "np", "nq"), F.struct("rating", F.xxhash64("p", "q"))).alias("b"), F.max("rating").alias("rating")).select(*keys, "p", "b.*", "rating")
        room = F.sum("np").over(W.partitionBy(*keys, "q").orderBy(F.desc("rating"), "p").rowsBetween(W.unboundedPreceding, 0))
        moves = best.withColumn("_room", room).filter(F.col("_room") + F.col("nq") <= most).select(*keys, F.col("p").alias("part"), F.col("q").alias("_to"))
        moved = label.join(moves, [*keys, "part"], "left")
        new = cut_lineage(moved.select(*keys, "node", F.coalesce("_to", "part").alias("part"), F.col("_to").isNotNull().alias("_moved")))
        # a round without a move may be the hash's doing: stop when no pair of neighbours has room
        if new.filter("_moved").isEmpty() and p.isEmpty():
            return done.unionByName(new.drop("_moved"))
        label, rnd = new.drop("_moved"), rnd + 1


def _large(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that must not broadcast them.

    Node numbers repeat from network to network, so a file has less than a byte a node: the planner
    would take the nodes, or the sources, of many networks for a small table and send them all
    through the driver.
    """
    return rows.hint("merge")


def network(edges: DataFrame, group_cols=("park_id",), most: int = MOST) -> Network:
    """Cut ``edges`` (keys, a, b, length) into parts; the tables are written once."""
    keys = list(group_cols)
    p = parts(edges, keys, most)
    nodes = written_table(p.withColumn("idx", (F.row_number().over(W.partitionBy(*keys, "part").orderBy("node")) - 1).cast("int")))
    w = F.greatest(F.lit(1).cast("long"), F.round(F.col("length") * UNIT).cast("long"))
    e = edges.select(*keys, "a", "b", w.alias("w"))
    # each edge finds its ends once, before it becomes two arcs
    e = e.join(_large(nodes.withColumnsRenamed({"node": "a", "part": "pa", "idx": "ia"})), [*keys, "a"]).join(_large(nodes.withColumnsRenamed({"node": "b", "part": "pb", "idx": "ib"})), [*keys, "b"])
    ways = [F.struct(*[F.col(c).alias(n) for c, n in zip(way, ("part", "idx", "part2", "idx2"))]) for way in (("pa", "ia", "pb", "ib"), ("pb", "ib", "pa", "ia"))]
    arcs = written_table(e.select(*keys, "w", F.inline(F.array(*ways))))
    cuts = arcs.filter(F.col("part") != F.col("part2"))
    inner = arcs.filter(F.col("part") == F.col("part2")).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(F.col("idx2").alias("v"), F.col("idx").alias("u"), "w"))).alias("a"))
    border = cuts.groupBy(*keys, "part").agg(F.array_sort(F.collect_set("idx")).alias("border"))
    size = nodes.groupBy(*keys, "part").agg(F.count(F.lit(1)).cast("int").alias("size"))
    none = F.array().cast("array<int>")
    pieces = size.join(inner, [*keys, "part"], "left").join(border, [*keys, "part"], "left")
    pieces = pieces.select(*keys, "part", "size", F.coalesce("border", none).alias("border"), *[F.coalesce(F.col(f"a.{c}"), F.array().cast(t)).alias(c) for c, t in (("u", "array<int>"), ("v", "array<int>"), ("w", "array<bigint>"))])
    return Network(keys, nodes, written_table(pieces), cuts, not cuts.isEmpty())


# --- inside a part ---------------------------------------------------------------


class Piece:
    """The edges of one part as arrays: arcs in the order of their heads, and where each head begins; the same by tails."""

    def __init__(self, n: int, u, v, w):
        self.n, self.u, self.v, self.w = n, np.asarray(u, np.int64), np.asarray(v, np.int64), np.asarray(w, np.int64)
        self.heads, self.head_at = np.unique(self.v, return_index=True)
        self.by_tail = np.argsort(self.u, kind="stable")
        self.tails, self.tail_at = np.unique(self.u[self.by_tail], return_index=True)

    def without_detours(self) -> Piece:
        """The same distances and shortest paths with fewer arcs, given that every arc is there in both directions.

        An arc longer than the way between its ends over some landmark is on no shortest path.
        """
        if len(self.u) <= DENSE * self.n:
            return self
        marks = np.unique(np.linspace(0, self.n - 1, LANDMARKS).astype(np.int64))
        dist = np.full((len(marks), self.n), FAR)
        dist[np.arange(len(marks)), marks] = 0
        for s in self.chunks(len(marks)):
            dist[s] = self.relax(dist[s])
        # one landmark at a time: an array of landmarks by arcs would be the largest of the task
        keep = np.ones(len(self.u), bool)
        for d in dist:
            keep &= self.w <= d[self.u] + d[self.v]
        return Piece(self.n, self.u[keep], self.v[keep], self.w[keep])

    def chunks(self, rows: int):
        step = max(1, CELLS // max(1, len(self.u), self.n))
        return [slice(i, min(rows, i + step)) for i in range(0, rows, step)]

    def relax(self, dist: np.ndarray) -> np.ndarray:
        """Distances from starting values, a row per source."""
        while len(self.u):
            near = np.minimum.reduceat(dist[:, self.u] + self.w, self.head_at, axis=1)
            near = np.minimum(near, dist[:, self.heads])
            if np.array_equal(near, dist[:, self.heads]):
                break
            dist[:, self.heads] = near
        return np.minimum(dist, FAR)

    def tight(self, dist: np.ndarray) -> np.ndarray:
        return (dist[:, self.u] + self.w == dist[:, self.v]) & (dist[:, self.u] < FAR)

    def counts(self, tight: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Shortest paths from starting numbers, in waves along the tight arcs."""
        total, wave = start.copy(), start
        while len(self.u) and wave.any():
            nxt = np.zeros_like(wave)
            nxt[:, self.heads] = np.add.reduceat(np.where(tight, wave[:, self.u], 0.0), self.head_at, axis=1)
            total, wave = total + nxt, nxt
        return total

    def shares(self, tight: np.ndarray, counts: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Dependency by number of paths: sum over the nodes behind of (1 / paths + share), with ``out`` for what lies outside."""
        def back(x: np.ndarray) -> np.ndarray:
            y = np.zeros_like(x)
            if len(self.u):
                flow = np.where(tight, x[:, self.v], 0.0)[:, self.by_tail]
                y[:, self.tails] = np.add.reduceat(flow, self.tail_at, axis=1)
            return y

        with np.errstate(divide="ignore"):
            wave = back(np.where(counts > 0, 1.0 / counts, 0.0)) + out
        total = wave
        while wave.any():
            wave = back(wave)
            total = total + wave
        return total


def _piece(row) -> Piece:
    return Piece(row.size, row.u, row.v, row.w).without_detours()


def _per_group(net: Network, work: DataFrame, function, schema: str, table: DataFrame | None = None) -> DataFrame:
    """``function(row)`` -> columns, for every row (keys, part, blk, arrays) of ``work`` with its piece."""
    keys, by = net.keys, [*net.keys, "part", "blk"]
    table = net.pieces if table is None else table
    spark = table.sparkSession
    ship_code(spark)
    n = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a fixed number of partitions: the rows are few and small, the work behind each is not
    rows = _large(work).join(table, [*keys, "part"]).repartition(n, *by)
    kept = [f for f in rows.schema.fields if f.name in by]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            cols = function(row)
            size = len(next(iter(cols.values())))
            # plain objects: Arrow-backed strings come in chunks, which Spark does not take
            own = {f.name: pd.Series([getattr(row, f.name)] * size, dtype=object) for f in kept}
            out.append(pd.DataFrame({**own, **{k: pd.Series(v, dtype=object) if np.asarray(v).dtype == object else v for k, v in cols.items()}}))
        return pd.concat(out)

    return rows.groupBy(*by).applyInPandas(run, f"{head}, {schema}")


def _gathered(rows: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """Rows of a (network, part, block) as parallel arrays."""
    g = rows.groupBy(*keys, "part", "blk").agg(F.collect_list(F.struct(*fields)).alias("_l"))
    return g.select(*keys, "part", "blk", *[F.col(f"_l.{f}").alias(f) for f in fields])


def _grid(row, fields: dict[str, float], width: int, columns) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sources of a row, and one array (source, column) per field, filled with its default."""
    srcs, at = np.unique(np.asarray(row.src), return_inverse=True)
    out = []
    for name, default in fields.items():
        m = np.full((len(srcs), width), default)
        m[at, columns] = getattr(row, name)
        out.append(m)
    return srcs, out


# --- between parts ---------------------------------------------------------------


def borders(net: Network) -> DataFrame:
    """(keys, part, border, dist, paths): distances and path counts between all ends of cut edges of a part, as bytes."""
    def run(row) -> dict:
        piece, b = _piece(row), np.asarray(row.border)
        dist, paths = np.full((len(b), row.size), FAR), np.zeros((len(b), row.size))
        dist[np.arange(len(b)), b], paths[np.arange(len(b)), b] = 0, 1
        for s in piece.chunks(len(b)):
            dist[s] = piece.relax(dist[s])
            paths[s] = piece.counts(piece.tight(dist[s]), paths[s])
        return {"dist": [dist[:, b].tobytes()], "paths": [paths[:, b].tobytes()]}

    work = net.pieces.filter(F.size("border") > 0).select(*net.keys, "part", F.lit(0).alias("blk"))
    out = _per_group(net, work, run, "dist binary, paths binary").drop("blk")
    return written_table(out.join(net.pieces.select(*net.keys, "part", "border"), [*net.keys, "part"]))


def _border_arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.asarray(row.border)
    return b, np.frombuffer(row.dist, np.int64).reshape(len(b), len(b)), np.frombuffer(row.paths).reshape(len(b), len(b))


def _rows(srcs: np.ndarray, mask: np.ndarray, columns: np.ndarray, **values: np.ndarray) -> dict:
    i, j = np.nonzero(mask)
    return {"src": srcs[i], "idx": np.asarray(columns)[j].astype(np.int32), **{k: v[i, j] for k, v in values.items()}}


def placed_sources(net: Network, sources: DataFrame) -> DataFrame:
    """Sources (keys, src) with part, idx and block; blocks are of about equal size by a hash."""
    keys = net.keys
    s = sources.select(*keys, "src").distinct().join(_large(net.nodes.withColumnRenamed("node", "src")), [*keys, "src"])
    n = s.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("long").alias("_b"))
    return written_table(s.join(n, keys).select(*keys, "src", "part", "idx", F.pmod(F.xxhash64("src"), "_b").cast("int").alias("blk")))


def _leaving(net: Network, starts: DataFrame, src_type: str) -> DataFrame:
    """From sources to the ends of cut edges of their own part: (keys, part, blk, src, idx, d, n)."""
    def run(row) -> dict:
        piece, b = _piece(row), np.asarray(row.border)
        srcs, (dist,) = _grid(row, {"d": FAR}, row.size, np.asarray(row.idx))
        found, paths = np.empty((len(srcs), len(b)), np.int64), np.empty((len(srcs), len(b)))
        for s in piece.chunks(len(srcs)):
            dist[s] = piece.relax(dist[s].astype(np.int64))
            num = piece.counts(piece.tight(dist[s]), (dist[s] == 0).astype(float))
            found[s], paths[s] = dist[s][:, b], num[:, b]
        return _rows(srcs, found < FAR, b, d=found, n=paths)

    work = _gathered(starts.withColumn("d", F.lit(0).cast("long")), net.keys, "src", "idx", "d")
    return _per_group(net, work, run, f"src {src_type}, idx int, d long, n double", net.pieces.filter(F.size("border") > 0))


def _through(net: Network, links: DataFrame, rows: DataFrame, src_type: str) -> DataFrame:
    """From entries (d, n) of a part to its ends: the least distance and the paths that have it."""
    def run(row) -> dict:
        b, dist, paths = _border_arrays(row)
        srcs, (d, n) = _grid(row, {"d": FAR, "n": 0.0}, len(b), np.searchsorted(b, np.asarray(row.idx)))
        best, num = np.full(d.shape, 2 * FAR), np.zeros(d.shape)
        for k in np.nonzero((d < FAR).any(axis=0))[0]:
            via = d[:, k:k + 1] + dist[k]
            num = np.where(via < best, 0.0, num) + np.where(via <= best, n[:, k:k + 1] * paths[k], 0.0)
            best = np.minimum(best, via)
        return _rows(srcs, best < FAR, b, d=best, n=num)

    return _per_group(net, _gathered(rows, net.keys, "src", "idx", "d", "n"), run, f"src {src_type}, idx int, d long, n double", links)


def _over(net: Network, rows: DataFrame, *more: str) -> DataFrame:
    """Across the cut edges: rows at (part, idx) move to (part2, idx2)."""
    j = rows.join(net.cuts, [*net.keys, "part", "idx"])
    return j.select(*net.keys, "src", "blk", F.col("part2").alias("part"), F.col("idx2").alias("idx"), (F.col("d") + F.col("w")).alias("d"), *more)


def entries(net: Network, links: DataFrame, leaving: DataFrame, src_type: str, farthest: int | None = None) -> DataFrame:
    """(keys, src, blk, part, idx, d): least distance at which each source comes over a cut edge to each end."""
    at = [*net.keys, "src", "blk", "part", "idx"]
    state, step = None, leaving
    while True:
        cand = _over(net, step).groupBy(*at).agg(F.min("d").alias("d"))
        if farthest is not None:
            cand = cand.filter(F.col("d") <= farthest)
        if state is None:
            state = written_table(cand.withColumn("fresh", F.lit(True)))
        else:
            m = state.drop("fresh").join(cand.withColumnRenamed("d", "_c"), at, "full_outer")
            better = F.col("_c").isNotNull() & (F.col("d").isNull() | (F.col("_c") < F.col("d")))
            state = written_table(m.select(*at, F.when(better, F.col("_c")).otherwise(F.col("d")).alias("d"), better.alias("fresh")))
        fresh = state.filter("fresh").drop("fresh")
        if fresh.isEmpty():
            return state.drop("fresh")
        step = _through(net, links, fresh.withColumn("n", F.lit(0.0)), src_type)


def _summed(tables: list[DataFrame], by: list[str], value: str) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return written_table(out.groupBy(*by).agg(F.sum(value).alias(value)))


def entry_counts(net: Network, links: DataFrame, leaving: DataFrame, at_entries: DataFrame, src_type: str) -> DataFrame:
    """Entries with ``n``, the shortest paths that come over their cut edge, summed up crossing by crossing."""
    at, waves, step = [*net.keys, "src", "blk", "part", "idx", "d"], [], leaving
    while True:
        wave = written_table(_over(net, step, "n").join(at_entries, at).groupBy(*at).agg(F.sum("n").alias("n")))
        waves.append(wave)
        if wave.isEmpty():
            return _summed(waves, at, "n")
        step = _through(net, links, wave, src_type)


def _searched(row, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Sources, given distances and path numbers of a part's starting nodes."""
    srcs, (d, n) = _grid(row, {"d": FAR, "n": 0.0}, row.size, np.asarray(row.idx))
    return srcs, d.astype(np.int64), n, piece.chunks(len(srcs))


def _starts(net: Network, placed: DataFrame, at_entries: DataFrame | None) -> DataFrame:
    """Sources at 0 with one path, and entries; a source's own node is never entered at a distance of 0."""
    s = placed.select(*net.keys, "src", "blk", "part", "idx", F.lit(0).cast("long").alias("d"), F.lit(1.0).alias("n"))
    if at_entries is None:
        return s
    e = at_entries.select(*net.keys, "src", "blk", "part", "idx", "d", (F.col("n") if "n" in at_entries.columns else F.lit(0.0)).alias("n"))
    own = s.select(*net.keys, "src", "part", "idx")
    return s.unionByName(e.join(own, [*net.keys, "src", "part", "idx"], "left_anti"))


def _prepared(net: Network, sources: DataFrame, farthest: int | None = None):
    placed = placed_sources(net, sources)
    src_type = placed.schema["src"].dataType.simpleString()
    if not net.crossed:
        return placed, src_type, None, None, None
    links, leaving = borders(net), written_table(_leaving(net, placed, src_type))
    return placed, src_type, links, leaving, entries(net, links, leaving, src_type, farthest)


def distances(net: Network, sources: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(keys, src, node, distance) of every reachable node, sources (keys, src) included."""
    far = None if max_distance is None else round(max_distance * UNIT)
    placed, src_type, _, _, ends = _prepared(net, sources, far)
    limit = FAR - 1 if far is None else far

    def run(row) -> dict:
        piece = _piece(row)
        srcs, d, _, chunks = _searched(row, piece)
        for s in chunks:
            d[s] = piece.relax(d[s])
        return _rows(srcs, d <= limit, np.arange(row.size), d=d)

    work = _gathered(_starts(net, placed, ends), net.keys, "src", "idx", "d", "n")
    out = _per_group(net, work, run, f"src {src_type}, idx int, d long")
    out = out.join(_large(net.nodes), [*net.keys, "part", "idx"]).select(*net.keys, "src", "node", (F.col("d") / UNIT).alias("distance"))
    alone = sources.select(*net.keys, "src").distinct().join(_large(net.nodes.withColumnRenamed("node", "src")), [*net.keys, "src"], "left_anti")
    return out.unionByName(alone.select(*net.keys, "src", F.col("src").alias("node"), F.lit(0.0).alias("distance")))


def totals(net: Network, sources: DataFrame) -> DataFrame:
    """(keys, src, reached, total): nodes reached, the source included, and the sum of their distances; added up inside the parts first."""
    placed, src_type, _, _, ends = _prepared(net, sources)

    def run(row) -> dict:
        piece = _piece(row)
        srcs, d, _, chunks = _searched(row, piece)
        for s in chunks:
            d[s] = piece.relax(d[s])
        near = d < FAR
        return {"src": srcs, "reached": near.sum(axis=1), "total": np.where(near, d, 0).sum(axis=1)}

    work = _gathered(_starts(net, placed, ends), net.keys, "src", "idx", "d", "n")
    out = _per_group(net, work, run, f"src {src_type}, reached long, total long")
    return out.groupBy(*net.keys, "src").agg(F.sum("reached").alias("reached"), (F.sum("total") / UNIT).alias("total"))


def _leaving_shares(net: Network, links: DataFrame, at_entries: DataFrame, starts: DataFrame, src_type: str) -> DataFrame:
    """(keys, src, blk, part, idx, out): per end of a cut edge, the shares of all that lies beyond its cut edges."""
    at = [*net.keys, "src", "blk", "part", "idx"]

    def inside(row) -> dict:
        piece = _piece(row)
        srcs, given, n, chunks = _searched(row, piece)
        d, b = given.copy(), np.asarray(row.border)
        num, share = np.empty(n.shape), np.empty(n.shape)
        for s in chunks:
            d[s] = piece.relax(d[s])
            t = piece.tight(d[s])
            num[s] = piece.counts(t, np.where(given[s] == d[s], n[s], 0.0))
            share[s] = piece.shares(t, num[s], np.zeros(num[s].shape))
        with np.errstate(divide="ignore"):
            y = 1.0 / num + share
        return _rows(srcs, (d < FAR)[:, b], b, d=d[:, b], y=y[:, b])

    first = _per_group(net, _gathered(starts, net.keys, "src", "idx", "d", "n"), inside, f"src {src_type}, idx int, d long, y double", net.pieces.filter(F.size("border") > 0))
    true = written_table(first)
    # only what is entered over a cut edge on a shortest path
    wave = written_table(true.join(at_entries.select(*at, "d"), [*at, "d"]))
    held = written_table(_gathered(wave.withColumn("y", F.lit(0.0)), net.keys, "src", "idx", "d").withColumnsRenamed({"src": "src_in", "idx": "idx_in", "d": "d_in"}))

    def back(row) -> dict:
        b, dist, paths = _border_arrays(row)
        srcs, (dx, x) = _grid(row, {"d": FAR, "out": 0.0}, len(b), np.searchsorted(b, np.asarray(row.idx)))
        where = {s: i for i, s in enumerate(srcs)}
        got = [(where[s], k, d) for s, k, d in zip(row.src_in, np.searchsorted(b, np.asarray(row.idx_in)), row.d_in) if s in where]
        out = {"src": [], "idx": [], "d": [], "y": []}
        for i, k, d in got:
            y = float(np.where(d + dist[k] == dx[i], paths[k] * x[i], 0.0).sum())
            if y:
                out["src"].append(srcs[i]), out["idx"].append(b[k]), out["d"].append(d), out["y"].append(y)
        return out

    outs = []
    while True:
        # the cut edges are there in both directions: from the entry back to the end it came from
        j = wave.join(net.cuts, [*net.keys, "part", "idx"])
        x = j.select(*net.keys, "src", "blk", F.col("part2").alias("part"), F.col("idx2").alias("idx"), (F.col("d") - F.col("w")).alias("d"), "y")
        # a cut edge that no shortest path takes gives a distance that its end has not
        x = written_table(x.groupBy(*at, "d").agg(F.sum("y").alias("out")).join(true.select(*at, "d"), [*at, "d"]))
        outs.append(x)
        if x.isEmpty():
            return _summed(outs, [*at, "d"], "out")
        work = _gathered(x, net.keys, "src", "idx", "d", "out").join(held, [*net.keys, "part", "blk"])
        wave = written_table(_per_group(net, work, back, f"src {src_type}, idx int, d long, y double", links))


def dependencies(net: Network, sources: DataFrame) -> DataFrame:
    """(keys, node, dependency): the dependencies of all sources on each node, summed up; nodes with none are left out."""
    placed, src_type, links, leaving, ends = _prepared(net, sources)
    out_type = "array<double>"
    if ends is None:
        work = _gathered(_starts(net, placed, None), net.keys, "src", "idx", "d", "n")
        work = work.withColumns({"src_out": F.slice("src", 1, 0), "idx_out": F.array().cast("array<int>"), "out": F.array().cast(out_type)})
    else:
        counted = entry_counts(net, links, leaving, ends, src_type)
        starts = written_table(_starts(net, placed, counted))
        beyond = _leaving_shares(net, links, counted, starts, src_type)
        beyond = _gathered(beyond, net.keys, "src", "idx", "out").withColumnsRenamed({"src": "src_out", "idx": "idx_out"})
        work = _gathered(starts, net.keys, "src", "idx", "d", "n").join(beyond, [*net.keys, "part", "blk"], "left")

    def run(row) -> dict:
        piece = _piece(row)
        srcs, given, n, chunks = _searched(row, piece)
        where = {s: i for i, s in enumerate(srcs)}
        out = np.zeros(n.shape)
        if row.out is not None:
            for s, k, x in zip(row.src_out, row.idx_out, row.out):
                if s in where:
                    out[where[s], k] = x
        total, d = np.zeros(row.size), given.copy()
        for s in chunks:
            d[s] = piece.relax(d[s])
            t = piece.tight(d[s])
            num = piece.counts(t, np.where(given[s] == d[s], n[s], 0.0))
            dep = num * piece.shares(t, num, out[s])
            total += np.where(d[s] == 0, 0.0, dep).sum(axis=0)
        k = np.nonzero(total)[0]
        return {"idx": k.astype(np.int32), "x": total[k]}

    got = _per_group(net, work, run, "idx int, x double").groupBy(*net.keys, "part", "idx").agg(F.sum("x").alias("dependency"))
    return got.join(_large(net.nodes), [*net.keys, "part", "idx"]).select(*net.keys, "node", "dependency")
