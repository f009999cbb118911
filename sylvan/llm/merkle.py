"""Merkle manifest of a dataset: one leaf per row, one tree per group, one tree over the groups.

Coordinates without a sort.  The keys of a group form a bitmap that is kept as its non-zero 64-bit
words only: every task combines the bits of its rows (``bit_or``), words of the same place are
merged, and popcount directories are laid over them in four levels (words of a container of 2^16
keys, containers of a region, regions of a sector, sectors of the group).  A level never has more
than 65,537 entries below one parent, however large a group is.  The rank of a row is the number of
rows below its word plus the bits below its own bit, so a leaf finds its place with one join.

Every level of a tree is a table of slot arrays: the nodes of one run as one string of digests, 64
hex digits a slot, keyed by group and run.  A run is hashed into the node of the next level, so each
level has a sixteenth of the rows of the one below.  Ways down give each run the arrays above it.

Defined results:

* null key: such rows stand before all others of their group, in the order of their leaves;
* rows with the same key: in the order of their leaves; equal rows take neighbouring places, one
  result row each (equal rows are counted before anything is shuffled row by row, and only words in
  which a key repeats are ranked by an exact distributed rank);
* null group: a group of its own before all others; null values count as ``-``, empty ones as ``0:``;
* empty table: no rows; one row: leaf, subroot and root are the same, the proof is empty;
* very long texts are hashed in the task that reads them and never shuffled; further columns of the
  input are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators.ranking import exact_rank
from .common import ascii_lower, written_table

#: Consecutive nodes that are hashed into one, and bits of a digest as hex text.
RUN, DIGEST = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a key below a word, a container, a region and a sector.
_WORD, _STEPS = 6, (10, 16, 16)
#: The word of null keys: below the smallest word a 64-bit key can have.
_NULL_WORD = -(1 << 57) - 1
_G = "_group"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(fields=FIELDS, **changed: Column) -> Column:
    return digest(*[encoded(changed.get(f, F.col(f"`{f}`"))) for f in fields])


def lowered_sample(key: str = "doc_id", text: str = "text") -> tuple[Column, dict[str, Column]]:
    """The tampering of the check: where 5 divides the CRC of the decimal key, A-Z of the text are lower-cased."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0, F.lit(False)), {text: ascii_lower(F.col(f"`{text}`"))}


def hashed(docs: DataFrame, key: str = "doc_id", group: str = "source", fields=FIELDS, tampered: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """(group, key, leaf, tampered leaf, copies), written once: the only pass over the texts."""
    leaf = leaf_of(fields)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias(_G),
        F.col(f"`{key}`").cast("long").alias("key"), leaf.alias("leaf"),
        (F.when(tampered[0], leaf_of(fields, **tampered[1])) if tampered else F.lit(None).cast("string")).alias("other"))
    # '-' is below '=' in bytes, so the group of nulls comes first
    rows = rows.groupBy(_G, "key", "leaf", "other").agg(F.count(F.lit(1)).alias("copies"))
    return written_table(rows.withColumn("word", F.coalesce(F.shiftright("key", _WORD), F.lit(_NULL_WORD))))


def _below(keys: list[str], by: str) -> Column:
    """Rows of the smaller entries of the same parent."""
    return F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def bitmap_words(rows: DataFrame) -> DataFrame:
    """The non-zero words of the key bitmaps: (group, word, bits, n), n being the rows of its keys."""
    bit = F.when(F.col("key").isNull(), F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(key & 63 as int))"))
    return rows.groupBy(_G, "word").agg(F.bit_or(bit).alias("bits"), F.sum("copies").alias("n"))


def directories(words: DataFrame) -> DataFrame:
    """Each word with ``base``, the rows of the smaller words of its group."""
    levels, names = [words], ["word", "container", "region", "sector"]
    for i, bits in enumerate(_STEPS):
        low, high = names[i], names[i + 1]
        levels[i] = levels[i].withColumn(high, F.shiftright(low, bits))
        levels.append(levels[i].groupBy(_G, high).agg(F.sum("n").alias("n")))
    base = levels[3].select(_G, "sector", _below([_G], "sector").alias("base"))
    for i in (2, 1, 0):
        low, high = names[i], names[i + 1]
        here = levels[i].withColumn("_in", _below([_G, high], low))
        keep = [c for c in here.columns if c not in ("_in", high, "n") or c == "n" and i == 0]
        base = here.join(base, [_G, high]).select(*keep, (F.col("base") + F.col("_in")).alias("base"))
    return base


def placed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """One row per leaf with ``pos``, its 0-based place in its group.  ``words`` as from :func:`directories`."""
    j = rows.join(words, [_G, "word"])
    single = F.col("n") == F.bit_count("bits")
    mask = F.expr("case when key & 63 = 0 then 0L else shiftrightunsigned(-1L, cast(64 - (key & 63) as int)) end")
    plain = j.filter(single).select(_G, "key", "leaf", "other", (F.col("base") + F.bit_count(F.col("bits").bitwiseAND(mask))).alias("pos"))
    if words.filter(~single).isEmpty():
        return plain
    copies = j.filter(~single).select(_G, "word", "base", "key", "leaf", "other", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    ranked = exact_rank(copies, [_G, "word"], [F.col("key").asc_nulls_first(), F.col("leaf"), F.col("copy")])
    return plain.unionByName(ranked.select(_G, "key", "leaf", "other", (F.col("base") + F.col("rank") - 1).alias("pos")))


def _up(pos: Column) -> Column:
    return F.shiftright(pos.cast("long"), 4)


def _above(n: Column) -> Column:
    return _up(n + (RUN - 1))


def _slots(members: Column, field: str) -> Column:
    return F.array_join(F.transform(F.array_sort(members), lambda m: m[field]), "")


def _runs(nodes: DataFrame, *carry: str) -> DataFrame:
    """Nodes (group, pos, n, leaf) to runs: the digests of up to sixteen nodes as one slot array."""
    member = F.struct((F.col("pos") % RUN).cast("int").alias("slot"), "leaf", *carry)
    runs = nodes.groupBy(_G, _up(F.col("pos")).alias("run")).agg(F.collect_list(member).alias("_m"), F.max("n").alias("n"))
    more = [F.array_sort("_m").alias("members")] if carry else []
    return runs.select(_G, "run", "n", _slots(F.col("_m"), "leaf").alias("slots"), *more)


def _node(runs: DataFrame) -> Column:
    """A lone node of a level is the root of its tree and is not hashed again."""
    return F.when(F.col("n") == 1, F.col("slots")).otherwise(F.sha2("slots", 256))


def _levels(first: DataFrame, most: int) -> list[DataFrame]:
    """Runs of every level, the largest group having ``most`` nodes; each is written once."""
    levels = [written_table(first)]
    while most > RUN:
        most = -(-most // RUN)
        nodes = levels[-1].filter(F.col("n") > RUN).select(_G, F.col("run").alias("pos"), _above(F.col("n")).alias("n"), F.sha2("slots", 256).alias("leaf"))
        levels.append(written_table(_runs(nodes)))
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(group, top): the root of every group's tree."""
    tops = [lv.filter(F.col("n") <= RUN).select(_G, _node(lv).alias("top")) for lv in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _ways(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(group, run, carried columns of ``ends``, way) for the runs of the lowest level.

    ``way`` lists the slot arrays from the level above the run up to those of ``ends``; a run
    finds its parent by (group, parent run), so no key is hotter than sixteen rows, and only the
    last run of each tree looks up the row of its group.
    """
    more = [c for c in ends.columns if c not in (_G, "way")]
    above = None
    for lv in reversed(levels):
        last = lv.filter(F.col("n") <= RUN).select(_G, "run").join(ends, _G).select(_G, "run", *more, "way")
        if above is not None:
            kids = lv.filter(F.col("n") > RUN).select(_G, "run", _up(F.col("run")).alias("_up"))
            up = above.select(_G, F.col("run").alias("_up"), F.col("slots").alias("_s"), *more, "way")
            step = F.array(F.struct(F.col("_s").alias("slots"), (F.col("run") % RUN).cast("int").alias("slot")))
            last = last.unionByName(kids.join(up, [_G, "_up"]).select(_G, "run", *more, F.concat(step, "way").alias("way")))
        above = last.join(lv.select(_G, "run", "slots"), [_G, "run"]) if lv is not levels[0] else last
    return above


def _cut(step: Column) -> tuple[Column, Column]:
    at = step["slot"] * DIGEST
    return F.substring(step["slots"], F.lit(1), at), F.substring(step["slots"], at + (DIGEST + 1), F.lit(RUN * DIGEST))


def siblings(way: Column) -> Column:
    """The other digests of every run on a way, bottom up, as one string."""
    return F.array_join(F.transform(way, lambda s: F.concat(*_cut(s))), "")


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the slot arrays of its way give."""
    def up(h: Column, s: Column) -> Column:
        before, after = _cut(s)
        return digest(before, h, after)

    return F.aggregate(way, leaf, up)


@dataclass
class Manifest:
    """The levels of the group trees (level 0 carries the leaves), the levels of the tree over the groups, and the root."""

    levels: list[DataFrame]
    group_levels: list[DataFrame]
    groups: DataFrame
    root: str | None


_EMPTY = "cast(array() as array<struct<slots:string,slot:int>>)"


def build(docs: DataFrame, key: str = "doc_id", group: str = "source", fields=FIELDS, tampered: tuple[Column, dict[str, Column]] | None = None) -> Manifest:
    """Every level of the manifest as a written table; only the largest group, the number of groups and the root reach the driver."""
    rows = hashed(docs, key, group, fields, tampered)
    words = written_table(directories(bitmap_words(rows)))
    sizes = words.groupBy(_G).agg(F.sum("n").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    leaves = placed(rows, words).join(sizes, _G)
    levels = _levels(_runs(leaves, "key", "other"), most)
    groups = written_table(exact_rank(_tops(levels), [], [F.col(_G)]))
    n = groups.count()
    nodes = groups.select(F.lit("").alias(_G), (F.col("rank") - 1).alias("pos"), F.lit(n).cast("long").alias("n"), F.col("top").alias("leaf"))
    group_levels = _levels(_runs(nodes), n)
    top = _tops(group_levels).first()
    return Manifest(levels, group_levels, groups, top["top"] if top else None)


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: key, group (``-`` for null, else ``=`` and its name), leaf, other leaf, subroot and the way to the root."""
    ways = _ways(m.group_levels, m.group_levels[-1].select(_G).distinct().withColumn("way", F.expr(_EMPTY)))
    # a group's own run, then the arrays above it; a tree of one group has no array at all
    runs = m.group_levels[0].join(ways, [_G, "run"]).select("run", "n", "slots", "way")
    place = F.col("rank") - 1
    at = m.groups.select(F.col(_G), F.col("top").alias("subroot"), _up(place).alias("run"), (place % RUN).cast("int").alias("slot"))
    own = F.array(F.struct("slots", "slot"))
    ends = written_table(at.join(runs, "run").select(_G, "subroot", F.when(F.col("n") > 1, F.concat(own, "way")).otherwise(F.col("way")).alias("way")))
    low = m.levels[0].join(_ways(m.levels, ends), [_G, "run"])
    leaf = low.select(_G, "n", "slots", "subroot", "way", F.explode("members").alias("m"))
    own = F.array(F.struct("slots", F.col("m.slot").alias("slot")))
    way = F.when(F.col("n") > 1, F.concat(own, "way")).otherwise(F.col("way"))
    return leaf.select(F.col(_G).alias("group"), F.col("m.key").alias("key"), F.col("m.leaf").alias("leaf"), F.col("m.other").alias("other"), "subroot", way.alias("way"))
