r"""Secret scans: fixed patterns, and windows of high Shannon entropy over candidate strings.

Candidates are the maximal runs of a character class that are at least one window long.  A window
slides over a candidate; the counts of its characters change by one character in and one out, and
so does the sum of ``c * log2(c)`` over the counts, from which the entropy follows.  The candidate
is reported when some window reaches the class's threshold, unless the allow-list knows it or it
touches the candidate of an earlier class (wider classes first, so that a secret is reported
whole).  Spans of the fixed patterns stay as they are; an entropy span on the same place confirms
one and tells its bits.

Everything is Column expressions inside the row: no Python worker, no shuffle, no join.  Texts
without any candidate cost one search.  Positions come from the lengths of the pieces between the
matches, added up in blocks, so a text with very many matches stays near linear.

Defined results: null and empty texts have no spans; positions count code points; a very long text
or run costs its own task only, a long run is one candidate of any length; equal rows give equal
results, rows are never joined, so repeated ids are harmless; an empty table gives no rows; the input's
columns are kept, whatever their names, and the result is one new struct column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The patterns of the contract, in its order: kind, pattern, shortest length and the group it is measured on.
# The last two match whole runs, so their shortest length can stand in the pattern: a run that is too
# short has no other match.  In the first a match that is too short must be found, and dropped.
PATTERNS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)


@dataclass(frozen=True)
class CharClass:
    """A character class: ``cover`` for the pattern, ``alphabet`` for the counts, the window and the least bits a character."""

    kind: str
    cover: str
    alphabet: str
    window: int
    bits: float


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A random string of a class lies well above its threshold in some window; words, names and paths lie below.
CLASSES = (
    CharClass("entropy_base64", r"A-Za-z0-9+/_-", _DIGITS + _UPPER + _LOWER + "+/_-", 24, 4.0),
    CharClass("entropy_hex", "0-9A-Fa-f", _DIGITS + "ABCDEF" + "abcdef", 20, 3.0),
    CharClass("entropy_upper", "A-Z0-9", _DIGITS + _UPPER, 20, 3.7),
)
#: Candidates that are not secrets, whole string: letters only, digits only, words with short numbers between marks, UUIDs.
ALLOWED = (
    r"[A-Za-z+/_-]+",
    r"[0-9+/_-]+",
    r"(?:[A-Za-z]{0,15}[0-9]{0,4}[+/_-])*[A-Za-z]{0,15}[0-9]{0,4}",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r".*(?:EXAMPLE|example).*",
)
#: Words directly before a candidate that mark a digest, a revision or an inlined picture.
ALLOWED_BEFORE = r"(?:sha(?:1|224|256|384|512)|md5|commit|revision|integrity|base64)[\x20:=,\x22'-]*$"
#: Code points before a candidate in which such a word is looked for.
BEFORE = 16
#: Entropy sums are integers of 1 / SCALE bits, so that no order of additions can change a verdict.
SCALE = 1 << 20


def _lengths(parts: Column) -> Column:
    return F.transform(parts, F.length)


def _running(values: Column, block: int = 256) -> Column:
    """Sums of the values before each one, in blocks: an array that grows by one element at a time is copied each time."""
    def within(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")))

    def shifted(parts: Column) -> Column:
        totals = within(F.transform(parts, lambda p: p["sum"]))["out"]
        return F.flatten(F.zip_with(parts, totals, lambda p, t: F.transform(p["out"], lambda x: x + t)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block))
    return let(F.transform(starts, lambda i: within(F.slice(values, i, F.lit(block)))), shifted)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>>: the leftmost non-overlapping matches, start in code points."""
    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def at(v: Column) -> Column:
        n = F.size(v["found"])
        steps = F.zip_with(F.slice(_lengths(v["between"]), F.lit(1), n), _lengths(v["found"]), lambda b, m: F.struct(b.alias("b"), m.alias("m")))
        before = let(steps, lambda s: F.zip_with(_running(F.transform(s, lambda x: x["b"] + x["m"])), s, lambda r, x: r + x["b"]))
        return F.when(n > 0, F.zip_with(before, v["found"], lambda p, f: F.struct(p.alias("start"), f.alias("value"))))

    return F.coalesce(let(both, at), F.array().cast("array<struct<start:int,value:string>>"))


_SPANS = "array<struct<kind:string,start:int,end:int,value:string,bits:double>>"


def _span(kind: str, m: Column, bits: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), bits.alias("bits"))


def pattern_spans(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """Spans of one fixed pattern.  A match that is too short is dropped and its characters are not tried again."""
    long_enough = lambda m: F.length(F.regexp_extract(m["value"], pattern, group) if group else m["value"]) >= least
    return F.transform(F.filter(matches(text, pattern), long_enough), lambda m: _span(kind, m, F.lit(None).cast("double")))


def _fixed(c: int) -> int:
    return round(c * math.log2(c) * SCALE) if c else 0


def entropy(value: Column, cls: CharClass) -> Column:
    """Largest entropy in bits a character over the windows of ``value``, a string of the class's characters."""
    w, size = cls.window, len(cls.alphabet)
    table = F.array(*[F.lit(_fixed(c)).cast("long") for c in range(w + 2)])
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))

    def slide(code: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"))

        def moved(s: Column, i: Column) -> Column:
            """Character i enters, character i - w leaves (0: none yet)."""
            into, out = F.get(code, i), F.when(i >= w, F.get(code, i - w)).otherwise(0)

            def counted(c: Column) -> Column:
                a, b = F.get(s["counts"], c["into"] - 1), F.coalesce(F.get(s["counts"], c["out"] - 1), F.lit(0))
                g = lambda n: F.get(table, n)
                gain = F.when(c["into"] == c["out"], 0).otherwise(g(a + 1) - g(a) + F.when(c["out"] > 0, g(b - 1) - g(b)).otherwise(0))
                total = s["sum"] + gain
                counts = F.transform(s["counts"], lambda v, j: v + (j == c["into"] - 1).cast("int") - (j == c["out"] - 1).cast("int"))
                return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= w - 1, F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

            return let(F.struct(into.alias("into"), out.alias("out")), counted)

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, moved)["least"]

    return F.lit(math.log2(w)) - let(codes, slide) / (SCALE * w)


def threshold(cls: CharClass) -> float:
    """The threshold as the entropy of the largest integer sum that still reaches it."""
    return math.log2(cls.window) - math.floor((math.log2(cls.window) - cls.bits) * cls.window * SCALE) / (SCALE * cls.window)


def candidates(text: Column, cls: CharClass, allowed=ALLOWED) -> Column:
    """Runs of a class that are at least a window long and not on the allow-list."""
    whole = F.lit("^(?:" + "|".join(f"(?:{a})" for a in allowed) + ")$")

    def known(m: Column) -> Column:
        from_ = F.greatest(m["start"] - BEFORE, F.lit(0))
        before = F.lower(F.substring(text, from_ + 1, m["start"] - from_))
        return F.rlike(m["value"], whole) | F.rlike(before, F.lit(ALLOWED_BEFORE))

    return F.filter(matches(text, f"[{cls.cover}]{{{cls.window},}}"), lambda m: ~known(m))


def class_spans(runs: Column, cls: CharClass) -> Column:
    """The candidates with a window of high entropy."""
    tried = F.transform(runs, lambda m: _span(cls.kind, m, entropy(m["value"], cls)))
    return F.filter(tried, lambda s: s["bits"] >= threshold(cls))


def _and_apart(old: Column, new: Column) -> Column:
    """The old spans and those of the new ones that touch none of them."""
    def both(v: Column) -> Column:
        free = F.filter(v["new"], lambda n: ~F.exists(v["old"], lambda o: (o["start"] < n["end"]) & (n["start"] < o["end"])))
        return F.concat(v["old"], free)

    return let(F.struct(old.alias("old"), new.alias("new")), both)


def _sorted(found: Column, classes) -> Column:
    kinds = F.array(*[F.lit(k) for k in [*[p[0] for p in PATTERNS], *[c.kind for c in classes]]])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("at"), F.array_position(kinds, s["kind"]).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def scanned(docs: DataFrame, text: str = "text", out: str = "secrets", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``docs`` with a column ``out``: array<struct<kind, start, end, value, bits>> in the order of start, then kind as listed."""
    gate = "|".join([PATTERNS[0][1], r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", *[f"[{c.cover}]{{{c.window}}}" for c in classes]])
    # helper columns stand beside a struct of the row, so no column of the caller can clash; one step
    # is one projection, because expressions nested this deep exceed the analyzer's iterations
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("doc"), F.col(f"`{text}`").alias("t"))
    rows = rows.withColumn("t", F.when(F.rlike("t", F.lit(gate)), F.col("t")))
    for i, p in enumerate(PATTERNS):
        rows = rows.withColumn(f"p{i}", pattern_spans(F.col("t"), *p))
    rows = rows.withColumn("hot", F.array().cast(_SPANS))
    for i, c in enumerate(classes):
        rows = rows.withColumn(f"m{i}", candidates(F.col("t"), c, allowed))
        rows = rows.withColumn(f"c{i}", class_spans(F.col(f"m{i}"), c))
        rows = rows.withColumn("hot", _and_apart(F.col("hot"), F.col(f"c{i}")))
    rows = rows.withColumn("found", F.concat(*[f"p{i}" for i in range(len(PATTERNS))], "hot"))
    return rows.select("doc.*", _sorted(F.col("found"), classes).alias(out))


def joined(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
