"""SimHash near duplicates by tiled exact comparison (operator 5).

A fingerprint has one bit per bit of the shingle hashes.  Distinct fingerprints are ranked by the
bit counts of their four quarters and cut into tiles of ``TILE``; the quarters of two fingerprints
within ``radius`` bits differ by at most ``radius`` in their counts, taken together, so only tiles
whose ranges come that close are paired.  A pair of tiles is compared as a whole in numpy (exclusive
or, bit count) in blocks that fit the processor's cache; blocks are skipped by the same rule.
A pair of tiles returns a spanning forest of its links, never all pairs of a dense group.  Groups
are found by alternating star contraction over written tables.

The work grows with the square of the number of distinct fingerprints divided by what the counts
rule out (about 0.3 of pairs stay of 236,000 fingerprints, 0.13 of 2.8 million, whose blocks are
more alike); exact copies cost nothing, since they share a fingerprint.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer
words than a shingle form one shingle; a document without an id gets the group of its text, and
does not name it; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import exact_rank
from .common import only_tables_of, ship, written_table

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 8192
#: Rows and columns compared at once: few, so that their bit counts lie close together.
_ROWS, _COLUMNS = 128, 256
#: Where the quarters of a fingerprint begin.
_QUARTERS = (0, 16, 32, 48)


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of A-Z-lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and the six white-space bytes only
    if not words:
        return np.zeros(0, np.uint64)
    # fewer words than a shingle are one shingle
    shingles = zip(*[words[i:] for i in range(size)]) if len(words) >= size else [words]
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), np.uint64, max(1, len(words) - size + 1))


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    h = shingle_hashes(text or "", size, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with their fingerprint; row by row, no shuffle."""
    ship(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = pa.array([fingerprint(x.as_py()) for x in part.column(place)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


class Groups:
    """Union of index pairs, many at a time; the root of a group is its smallest index."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _boxes(f: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest bit count of every quarter, for each block of ``step`` fingerprints."""
    counts = np.stack([np.bitwise_count(f >> np.uint64(at) & np.uint64(0xFFFF)).astype(np.int16) for at in _QUARTERS], axis=1)
    begins = np.arange(0, len(f), step)
    return np.minimum.reduceat(counts, begins), np.maximum.reduceat(counts, begins)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``a`` (``b`` is None) or between ``a`` and ``b``."""
    both = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    groups = Groups(len(both))
    if len(a) and len(other):
        (a_low, a_high), (b_low, b_high) = _boxes(a, _ROWS), _boxes(other, _COLUMNS)
        gap = np.maximum(0, np.maximum(b_low[None] - a_high[:, None], a_low[:, None] - b_high[None])).sum(axis=2)
        for i, j in zip(*((at * step).tolist() for at, step in zip(np.nonzero(gap <= radius), (_ROWS, _COLUMNS)))):
            if b is None and j + _COLUMNS <= i:
                continue
            apart = np.bitwise_count(a[i:i + _ROWS, None] ^ other[None, j:j + _COLUMNS])
            # links are rare, and looking for their places takes longer than the comparison
            if apart.min() <= radius:
                x, y = np.nonzero(apart <= radius)
                groups.join(x + i, y + j + shift)
    child = np.flatnonzero(groups.root != np.arange(len(both)))
    return both[child], both[groups.root[child]]


def tiles_of(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """tile, low, high, fps: ``tile`` fingerprints (column ``fp``) at most, in order of their quarters' bit counts, and the range of each count."""
    quarters = [f"q{at}" for at in _QUARTERS]
    f = fps.select("fp", *[F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(0xFFFF))).alias(q) for at, q in zip(_QUARTERS, quarters)])
    ranked = exact_rank(f, [], [F.col(c) for c in (*quarters, "fp")])
    ranges = [F.array(*[f(q) for q in quarters]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    tiles = ranked.withColumn("tile", F.floor((F.col("rank") - 1) / tile)).groupBy("tile").agg(F.sort_array(F.collect_list(F.struct(*quarters, "fp"))).alias("s"), *ranges)
    return written_table(tiles.select("tile", "low", "high", F.transform("s", lambda x: x["fp"]).alias("fps")))


def tile_pairs(tiles: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: pairs of tiles whose bit counts come near enough, a tile and itself included."""
    # tiles are in order of their first quarter, so a tile's partners are among the tiles up to the last that begins near enough
    counts = tiles.sparkSession.range(17).select(F.col("id").cast("int").alias("count"))
    begins = tiles.groupBy(F.get("low", F.lit(0)).alias("at")).agg(F.max("tile").alias("last_tile"))
    reach = counts.join(F.broadcast(begins), F.col("at") <= F.col("count") + radius).groupBy("count").agg(F.max("last_tile").alias("until"))  # 17 rows at most on either side
    first, second = ([F.col("tile").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")] for x in "ab")
    pairs = tiles.select(*first).join(F.broadcast(reach), F.get("high_a", F.lit(0)) == F.col("count")).withColumn("b", F.explode(F.sequence("a", "until")))
    less = lambda x, y, i: F.get(f"low_{x}", F.lit(i)) - F.get(f"high_{y}", F.lit(i))
    gap = reduce(add, [F.greatest(F.lit(0), less("b", "a", i), less("a", "b", i)) for i in range(len(_QUARTERS))])
    return pairs.join(tiles.select(*second), "b").filter(gap <= radius).select("a", "b")


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """u, v: links between distinct fingerprints (column ``fp``) that connect all groups."""
    spark = fps.sparkSession
    ship(spark)
    tiles = tiles_of(fps, tile)
    work = tile_pairs(tiles, radius).join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b")
    # few rows of much work each: deal them out one by one
    work = work.repartition(8 * spark.sparkContext.defaultParallelism, "a", "b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("simhash")
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column("a")[k].as_py(), batch.column("b")[k].as_py()
                fa, fb = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("fa", "fb"))
                u, v = forest(fa, None if a == b else fb, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return work.mapInArrow(run, "u long, v long")


def star_groups(edges: DataFrame, at_most: int = 60) -> DataFrame:
    """u, root for every node with a link: root is the smallest node of its group (and not listed itself).

    Alternating star contraction: nodes hang their larger neighbours, then their smaller ones, on
    the smallest one.  Minima are combined before each shuffle and written, so that joins on a
    node with very many neighbours can be split.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).first())

    e = written_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(e)
    for _ in range(at_most):
        if not seen[0]:
            return e.select("u", F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written_table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = written_table(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written_table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written_table(small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = state(e)
        if now == seen:
            return e.select("u", F.col("v").alias("root"))
        seen = now
    raise RuntimeError("star contraction did not settle")


def components(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fp, n, component_id: for every distinct fingerprint of ``rows`` (doc_id, fp) its group, named by the smallest doc_id."""
    fps = written_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")))
    stars = star_groups(links(fps, radius, tile))
    rooted = written_table(fps.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "n", "first_doc", F.coalesce("root", "fp").alias("root")))
    names = written_table(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")))
    return written_table(rooted.select("fp", "n", "root").join(names, "root").select("fp", "n", "root", "component_id"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grouped(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id per document."""
    rows = written_table(fingerprinted(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return rows.join(components(rows, radius, tile).select("fp", "component_id"), "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One document of each group, with all its columns: the one that names the group."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("rid"))
    marked = written_table(fingerprinted(marked).select("_doc", "doc_id", "rid", "fp"))
    rows = marked.select("doc_id", "rid", "fp")
    groups = components(rows.select("doc_id", "fp"), radius, tile)
    # smallest id first, null ids last, then the order of rows
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid")).alias("keep")
    kept = rows.join(groups.select("fp", "root"), "fp").groupBy("root").agg(first).select(F.col("keep.rid").alias("rid"))
    # written, so that the planner knows the number of copies: while they are few, the documents need no shuffle
    copies = written_table(rows.select("rid").join(kept, "rid", "left_anti"))
    return marked.join(copies, "rid", "left_anti").select("_doc.*")
