"""Pareto fronts of groups of any size.

A row is dominated if another row of its group is nowhere worse and somewhere better (all objectives
are minimised); equal rows do not dominate each other.  Rows never meet on their group alone:

1. distinct vectors are dealt into chunks by a hash, and every chunk keeps its own front.  What a
   chunk drops is dominated for good, and domination is transitive, so the rest may forget it;
2. groups that fit one chunk are done.  The survivors of the others are gathered into blocks of one
   cell of a grid cut at the medians of the objectives, and a block is compared only with blocks
   whose smallest values are nowhere above its largest.  Blocks are bounded, and a task compares two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import ship_code, written_table

#: Vectors of a chunk or block.
BLOCK = 2048


def beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows are dominated by one of ``by``, a few hundred at a time."""
    out = np.zeros(len(rows), bool)
    for i in range(0, len(rows), 256):
        part = rows[i:i + 256, None, :]
        out[i:i + 256] = ((by[None] <= part).all(axis=2) & (by[None] < part).any(axis=2)).any(axis=1)
    return out


def front(rows: np.ndarray) -> np.ndarray:
    """Rows no other row dominates: in the order of their sums a row is beaten by earlier ones only, so good rows go first."""
    rows = rows[np.argsort(rows.sum(axis=1), kind="stable")]
    kept = rows[:0]
    for i in range(0, len(rows), 256):
        part = rows[i:i + 256]
        part = part[~beaten(part, kept)]
        kept = np.vstack([kept, part[~beaten(part, part)]])
    # sums may tie by rounding, in the wrong order
    return kept[~beaten(kept, kept)]


def _same(value, n: int) -> pd.Series:
    """One value n times, as plain objects: Arrow-backed strings come in chunks, which Spark does not take."""
    return pd.Series([value] * n, dtype=object)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def non_dominated(rows: DataFrame, group_cols, objectives, block: int = BLOCK) -> DataFrame:
    """The rows of ``rows`` that no row of their group dominates.  A null objective makes a row incomparable: it stays and beats none."""
    keys, obj = list(group_cols), list(objectives)
    spark = rows.sparkSession
    ship_code(spark)
    whole = F.lit(True)
    for o in obj:
        whole = whole & F.col(o).isNotNull()
    # adding zero makes -0.0 and 0.0 one value
    points = rows.filter(whole).select(*keys, F.array(*[F.col(o).cast("double") + F.lit(0.0) for o in obj]).alias("v")).distinct()
    points = written_table(points)
    size = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name != "v")
    dealt = points.join(size, keys).withColumn("chunk", F.pmod(F.hash("v"), "chunks"))
    n = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def own_front(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = front(_vectors(pdf["v"]))
        return pd.DataFrame({**{k: _same(pdf[k].iloc[0], len(kept)) for k in [*keys, "chunks"]}, "v": pd.Series(list(kept), dtype=object)})

    left = dealt.repartition(n, *keys, "chunk").groupBy(*keys, "chunk").applyInPandas(own_front, f"{head}, chunks int, v array<double>")
    left = written_table(left)
    kept, many = left.filter("chunks = 1").select(*keys, "v"), left.filter("chunks > 1").drop("chunks")
    if not many.isEmpty():
        kept = kept.unionByName(_across_blocks(many, keys, len(obj), block, n, head))
    back = kept.select(*keys, *[F.col("v")[i].alias(f"_o{i}") for i in range(len(obj))])
    j = rows.filter(whole)
    marks = [F.col(o).cast("double") + F.lit(0.0) for o in obj]
    j = j.withColumns({f"_o{i}": m for i, m in enumerate(marks)})
    same = j.join(back, [*keys, *[f"_o{i}" for i in range(len(obj))]], "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])
    return same.unionByName(rows.filter(~whole))


def _across_blocks(points: DataFrame, keys: list[str], d: int, block: int, n: int, head: str) -> DataFrame:
    middle = points.groupBy(*keys).agg(*[F.percentile_approx(F.col("v")[i], 0.5, 100).alias(f"_m{i}") for i in range(d)])
    cell = F.lit(0)
    for i in range(d):
        cell = cell * 2 + (F.col("v")[i] > F.col(f"_m{i}")).cast("int")
    p = points.join(middle, keys).select(*keys, "v", cell.alias("cell"))
    size = p.groupBy(*keys, "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_c"))
    p = p.join(size, [*keys, "cell"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("_c")).cast("int"))
    at = [*keys, "cell", "part"]
    ends = [f(F.col("v")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = written_table(p.groupBy(*at).agg(F.collect_list("v").alias("vs"), *ends))
    other = [F.col("cell").alias("cell2"), F.col("part").alias("part2")]
    # one row per block and no vectors in it: the pairs of blocks that can have to do with each other
    a = blocks.select(*keys, *other, *[F.col(f"lo{i}").alias(f"l{i}") for i in range(d)])
    near = blocks.select(*at, *[f"hi{i}" for i in range(d)]).join(a, keys)
    for i in range(d):
        near = near.filter(F.col(f"l{i}") <= F.col(f"hi{i}"))
    pairs = near.select(*at, "cell2", "part2")
    pairs = pairs.join(blocks.select(*at, "vs"), at).join(blocks.select(*keys, *other, F.col("vs").alias("by")), [*keys, "cell2", "part2"])

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            vs, by = _vectors(row.vs), _vectors(row.by)
            lost = vs[beaten(vs, by)]
            out.append(pd.DataFrame({**{k: _same(getattr(row, k), len(lost)) for k in keys}, "v": pd.Series(list(lost), dtype=object)}))
        return pd.concat(out)

    pair = [*at, "cell2", "part2"]
    lost = pairs.repartition(n, *pair).groupBy(*pair).applyInPandas(compared, f"{head}, v array<double>")
    return points.select(*keys, "v").join(lost.distinct(), [*keys, "v"], "left_anti")


def band(rows: DataFrame, group_cols, id_col: str, larger_is_better, depth: int, pairs: DataFrame, pair_cols=("a", "b"), margins=None) -> DataFrame:
    """Ids (group, id) of the rows that fewer than ``depth`` rows of their group beat in ``larger_is_better``.

    ``pairs`` lists the ids to compare, in either order; the rows meet over it.  A better value counts
    only if it is better by more than its margin, so that a later rounding cannot make it equal.
    """
    keys, (a, b), margins = list(group_cols), pair_cols, list(margins or [0.0] * len(larger_is_better))
    both = pairs.select(*keys, F.inline(F.array(F.struct(F.col(a).alias("_x"), F.col(b).alias("_y")), F.struct(F.col(b).alias("_x"), F.col(a).alias("_y")))))
    of = lambda who: rows.select(*keys, F.col(id_col).alias(who), *[F.col(c).alias(f"{who}_{c}") for c in larger_is_better])
    j = both.join(of("_x"), [*keys, "_x"]).join(of("_y"), [*keys, "_y"])
    no_worse, better = F.lit(True), F.lit(False)
    for c, m in zip(larger_is_better, margins):
        no_worse = no_worse & (F.col(f"_y_{c}") >= F.col(f"_x_{c}"))
        better = better | (F.col(f"_y_{c}") > F.col(f"_x_{c}") + m)
    lost = j.filter(no_worse & better).groupBy(*keys, F.col("_x").alias(id_col)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= depth)
    return rows.select(*keys, id_col).join(lost, [*keys, id_col], "left_anti")
