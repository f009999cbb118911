"""Benchmark decontamination by windows of normalised words (operator 2, JVM side only).

The windows of all benchmark items form one hash set.  Training documents are read once.  Inside
the row, a hash of three words of every window is looked up in the set sent along with the plan;
windows that pass are joined by their whole text, so a hit is exact.  Only such windows and one row
per document are shuffled.  This holds while the set has at most ``BROADCAST_WINDOWS`` entries; with
more, all windows are joined by a shuffle, with the same result.

Defined results: null and wordless texts have no windows and are never contaminated; an item
without words has none either; items of the same text are all named; an item without an id
marks documents but is not named; repeated documents each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, written_table

WINDOW = 10
#: Largest set that is broadcast: at about 200 bytes a window, some 40 MB.
BROADCAST_WINDOWS = 200_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, a-z and characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")


def _windows(w: Column, length: Column, size: int | Column) -> Column:
    """All windows of ``size`` words of ``w`` as (position, text)."""
    return F.when(length >= size, F.transform(F.sequence(F.lit(0), length - size), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i + 1, size), " ").alias("gram")))).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram, size, items: each distinct window, its length in words and the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    grams = items.filter(F.size("w") > 0).select("item", size.alias("size"), F.explode(let(F.col("w"), lambda w: _windows(w, F.size(w), F.least(F.size(w), F.lit(window))))).alias("g"))
    return grams.groupBy(F.col("g.gram").alias("gram"), F.col("size")).agg(F.collect_set("item").alias("items"))


def window_sizes(benchmark: DataFrame, window: int = WINDOW) -> list[int]:
    """The lengths of windows that occur: ``window`` values at most."""
    n = F.least(F.size(words(F.col("text"))), F.lit(window))
    return sorted(r["n"] for r in benchmark.select(n.alias("n")).filter("n > 0").distinct().collect())


def probe(w: Column, i: Column, size: int) -> Column:
    """Hash of three words of the window of ``size`` words that starts at ``i``: first, middle and last."""
    return F.xxhash64(F.get(w, i), F.get(w, i + size // 2), F.get(w, i + size - 1))


def _probes(benchmark: DataFrame, sizes: list[int], window: int, most: int) -> dict[int, list[int]] | None:
    """Probes of all benchmark windows by length, or None if there are more than ``most``."""
    items = benchmark.select(words(F.col("text")).alias("w"))
    out: dict[int, list[int]] = {}

    def all_probes(size: int) -> Column:
        return F.explode(let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: probe(w, i, size))))

    for size in sizes:
        held = items.filter(F.size("w") >= window if size == window else F.size("w") == size)
        found = held.select(all_probes(size).alias("h")).distinct().limit(most + 1).collect()
        out[size] = [r["h"] for r in found]
        if sum(map(len, out.values())) > most:
            return None
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, row_id, n_words, items (array), spans (array of start, end word, merged).

    ``row_id`` tells repeated documents apart inside this result.
    """
    sizes = window_sizes(benchmark, window)
    known = benchmark_windows(benchmark, window)
    probes = _probes(benchmark, sizes, window, broadcast_windows)
    if probes is not None and known.count() <= broadcast_windows:
        known = F.broadcast(known)

    def grams(w: Column, size: int) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - size)
        if probes is not None:
            at = F.filter(at, lambda i: probe(w, i, size).isin(probes[size]))
        found = F.transform(at, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i + 1, size), " ").alias("gram"), F.lit(size).alias("size")))
        return F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<struct<pos:int,gram:string,size:int>>"))

    def rows(w: Column) -> Column:
        # the first row stands for the document itself and carries its number of words
        own = F.array(F.struct((-F.size(w) - 1).alias("pos"), F.lit(None).cast("string").alias("gram"), F.lit(0).alias("size")))
        return F.concat(own, *[grams(w, s) for s in sizes])

    scanned = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row_id"), words(F.col("text")).alias("w"))
    scanned = scanned.select("doc_id", "row_id", F.explode(let(F.col("w"), rows)).alias("x")).select("doc_id", "row_id", "x.*")
    found = scanned.join(known, ["gram", "size"], "left").filter(F.col("items").isNotNull() | (F.col("pos") < 0))
    per = found.groupBy("doc_id", "row_id").agg(
        F.max(F.when(F.col("pos") < 0, -F.col("pos") - 1)).cast("long").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("pos") >= 0, F.col("items"))))).alias("items"),
        F.sort_array(F.collect_list(F.when(F.col("pos") >= 0, F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"))))).alias("spans"))
    return per.withColumn("spans", merged(F.col("spans")))


def merged(spans: Column) -> Column:
    """Union of sorted half-open spans: a span starts where it lies beyond all ends before it.

    One pass: for each span, the largest end so far; then starts and ends of the runs.
    """
    kind = "array<struct<start:int,end:int>>"
    ends = lambda s: F.aggregate(
        s, F.struct(F.array().cast(kind).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda acc, x: F.when(x["start"] <= acc["end"], F.struct(acc["done"].alias("done"), acc["start"].alias("start"), F.greatest(acc["end"], x["end"]).alias("end")))
        .otherwise(F.struct(F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).alias("done"), x["start"].alias("start"), x["end"].alias("end"))),
        lambda acc: F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))))
    return ends(spans)


def covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any benchmark window, with all their columns.

    Rows are matched by doc_id and a digest of the text, so documents that share an id are judged apart.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"))
    dirty = hits(docs.select(key.alias("doc_id"), F.col("text")), benchmark, **options).filter(F.size("spans") > 0).select(F.col("doc_id").alias("key")).distinct()
    # written, so that the planner knows their number: while they are few, the documents need no shuffle
    return tagged.join(written_table(dirty), "key", "left_anti").select("doc.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id and the remaining words of each document, space-joined, with the hit words removed."""
    h = hits(docs, benchmark, **options).filter(F.size("spans") > 0)
    per = h.groupBy("doc_id").agg(F.first("spans").alias("spans"))
    rest = docs.select("doc_id", words(F.col("text")).alias("w")).join(per, "doc_id", "left")
    pieces = lambda w: F.when(F.col("spans").isNull(), w).otherwise(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.slice(w, F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("spans"), i - 1)["end"]) + 1,
                          F.when(i == F.size("spans"), F.size(w)).otherwise(F.get(F.col("spans"), i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("spans"), i - 1)["end"])))))
    return rest.select("doc_id", F.array_join(let(F.col("w"), pieces), " ").alias("text"))
