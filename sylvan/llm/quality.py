"""Quality rules whose cutoffs are certified on labelled holdouts (operator 1, JVM side only).

Every rule rejects a document when one of its measures exceeds a cutoff.  The joint settings of
all rules stand in one order fixed before any data are seen: it begins without rules, and each
setting tightens one rule by one cutoff, the strictest setting last.  In each stratum the settings
are tested in this order by the exact binomial test (the Clopper-Pearson upper bound): do they
reject, all rules taken together, at most ``alpha`` of the labelled good documents?  The first
failure ends the stratum, and the last setting before it is used.  A sequence tested in a fixed
order needs no correction for its length, so only the strata divide ``delta``, and all certificates
hold together with probability 1 - delta.

Defined results: a null text counts as empty; a document of an unlisted or null language belongs
to the stratum ``other``; a stratum with too few labels certifies nothing and rejects by the base
rules only; labels that are null or not 0/1 are ignored, and a document with several labels is
good if one of them says so; repeated rows each get their own row in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spaced_words, written_table

#: Listed strata; all other languages share one more, so the table of cutoffs has a fixed size.
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
#: False rejection of good documents that a stratum may suffer, and the risk of a wrong certificate.
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs tried per rule, fixed before any data are seen; a rule rejects what exceeds its cutoff.
GRID = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5),
    "dup_line_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "long_words": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0),
    "short_words": (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Low bits that hold a word position; longer texts are compared by whole hashes at once.
_POSITION_BITS = 21


def _hash3(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def covered_words(w: Column, starts: Column) -> Column:
    """Words in 3-word windows that start at one of ``starts`` and share their words with another of them."""
    def covered(at: Column) -> Column:
        # each start covers 3 words, minus what the start before covers already
        return F.aggregate(
            F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"),
            lambda acc, i: acc + F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), F.get(at, i) - F.get(at, i - 1))))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        hit = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | ((i < last) & F.coalesce(same(i, i + 1), F.lit(False))))
        return let(F.sort_array(F.transform(hit, lambda i: F.get(s, i)["p"])), lambda at: F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(covered(at)))

    pairs = F.transform(starts, lambda i: F.struct(_hash3(w, i).alias("h"), i.alias("p")))
    return F.when(F.size(starts) == 0, F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeated))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_m`` of the base counts, filled row by row without a shuffle.

    Repeated windows: short hashes with the position in their low bits are sorted as plain longs,
    and only windows whose short hash occurs again are compared by their 64-bit hash.  The columns
    between are projections of their own, used twice each, so that the optimizer keeps them apart.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mask = (1 << _POSITION_BITS) - 1
    empty = F.array().cast("array<int>")
    kept = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(kept, lambda k: F.struct(F.size(k).cast("long").alias("n"), (F.size(k) - F.size(F.array_distinct(k))).cast("long").alias("dup")))
    at = F.sequence(F.lit(0), F.size("_w") - 3)
    df = docs.withColumn("_w", spaced_words(t)).withColumn("_n", F.size("_w"))
    df = df.withColumn("_s", F.when((F.col("_n") > 3) & (F.col("_n") <= mask), F.sort_array(F.transform(
        at, lambda i: F.shiftleft(_hash3(F.col("_w"), i), _POSITION_BITS).bitwiseOR(i.cast("long"))))))
    pairs = F.filter(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.shiftrightunsigned(F.get(F.col("_s"), i).bitwiseXOR(F.get(F.col("_s"), i - 1)), _POSITION_BITS) == 0)
    low = lambda i: F.get(F.col("_s"), i).bitwiseAND(F.lit(mask)).cast("int")
    both = let(pairs, lambda f: F.array_distinct(F.concat(F.transform(f, low), F.transform(f, lambda i: low(i - 1)))))
    df = df.withColumn("_c", F.when(F.col("_n") > mask, at).when(F.size("_s") > 1, both).otherwise(empty))
    return df.withColumn("_l", lines).withColumn("_m", F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("_l.dup").alias("n_dup_lines"),
        covered_words(F.col("_w"), F.col("_c")).alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
    )).drop("_w", "_n", "_s", "_c", "_l")


def rule_values(m: str = "_m") -> dict[str, Column]:
    """The measure of each rule; larger is worse.  Empty texts give 0."""
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{m}.{a}").cast("double"), F.col(f"{m}.{b}").cast("double")), F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "long_words": share("word_chars", "n_words"),
        "short_words": -share("word_chars", "n_words"),
    }


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def stratum(lang: str = "lang", strata=STRATA) -> Column:
    return F.when(F.col(lang).isin(*strata), F.col(lang)).otherwise(F.lit(OTHER))


def _ln_gamma(x: Column) -> Column:
    """ln(Gamma(x)) for x >= 1: Stirling's series at x + 8 and the product rule back to x."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    for i in range(8):
        series = series - F.log(x + float(i))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for counts k below the mean (1 beyond it).

    Terms are added from k downwards; they fall at least as fast as a normal density, so the sum
    ends 40 deviations below the mean, where the rest is far below the precision of a double.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 50).cast("int")
    odds = math.log1p(-p) - math.log(p)
    total = F.aggregate(
        F.sequence(F.lit(0), terms), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("term")),
        # term: ln of C(n, k-j) p^.. relative to the first one
        lambda acc, j: F.struct(
            (acc["sum"] + F.exp(acc["term"])).alias("sum"),
            (acc["term"] + F.when(k - j > 0, F.log((k - j) / (n - k + j + 1)) + odds).otherwise(F.lit(0.0))).alias("term")),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def settings(grid=None) -> list[tuple[str, float]]:
    """The fixed order of joint settings: setting i uses the last cutoff of every rule among the first i + 1 entries.

    All rules go from their loosest to their strictest cutoff in step, by the share of their cutoffs passed.
    """
    grid = grid or GRID
    order = sorted(((i + 1) / len(cuts), n, i) for n, cuts in enumerate(grid.values()) for i in range(len(cuts)))
    names, loose_first = list(grid), [sorted(map(float, cuts), reverse=True) for cuts in grid.values()]
    return [(names[n], loose_first[n][i]) for _, n, i in order]


def certified_cutoffs(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, strata=STRATA, grid=None) -> DataFrame:
    """One row per stratum with the cutoff of every rule in the strictest certified setting (null: the rule is not used).

    ``documents``: doc_id, stratum, base_failed and the rule measures.  ``labels``: doc_id, quality.
    Counts are kept per stratum before anything is moved; the result has len(strata) + 1 rows at most.
    """
    grid = grid or GRID
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_g")).filter("_g = 1").select("doc_id")
    steps = settings(grid)
    # the first setting that rejects the document: stricter ones reject it too
    first = F.least(*[F.when(F.col(r) > c, F.lit(i)) for i, (r, c) in enumerate(steps)], F.lit(len(steps)))
    # the method only decides about documents that pass the base rules, so its risk is measured on those
    held = documents.filter(~F.col("base_failed")).join(good, "doc_id").select("stratum", first.alias("_first"))
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("_first") <= i, 1)).alias(f"k_{i}") for i in range(len(steps))])
    flat = counts.select("stratum", "n", F.posexplode(F.array(*[f"k_{i}" for i in range(len(steps))])).alias("step", "k"))
    failed = F.when(binomial_tail(F.col("k"), F.col("n"), alpha) > delta / (len(strata) + 1), F.col("step"))
    passed = flat.groupBy("stratum").agg(F.coalesce(F.min(failed), F.lit(len(steps))).alias("_passed")).filter("_passed > 0")

    def cutoff(rule: str) -> Column:
        so_far = [min((c for r, c in steps[:i + 1] if r == rule), default=None) for i in range(len(steps))]
        return F.get(F.array(*[F.lit(c).cast("double") for c in so_far]), F.col("_passed") - 1)

    return passed.select("stratum", *[cutoff(r).alias(f"cut_{r}") for r in grid])


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, strata=STRATA, grid=None) -> DataFrame:
    """doc (struct of all columns of ``docs``) and q: the base counts, base_failed, kept, rejected_by and stratum.

    ``docs``: doc_id, text, lang and any more.  The measures are computed once and written; the
    cutoffs and the verdicts both read them.
    """
    grid = grid or GRID
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    row = written_table(measured(rows).select("doc", F.struct(
        stratum("doc.lang", strata).alias("stratum"), base_failed().alias("base_failed"), F.col("_m").alias("m"), *[v.alias(r) for r, v in rule_values().items()]).alias("_q")))
    cuts = certified_cutoffs(row.select("doc.doc_id", "_q.stratum", "_q.base_failed", *[f"_q.{r}" for r in grid]), pick_labels(labels), alpha, delta, strata, grid)
    # len(strata) + 1 rows at most, whatever the input
    out = row.withColumn("_s", F.col("_q.stratum")).join(F.broadcast(cuts.withColumnRenamed("stratum", "_s")), "_s", "left")
    over = F.filter(F.array(*[F.when(F.col(f"_q.{r}") > F.col(f"cut_{r}"), F.lit(r)) for r in grid]), lambda x: x.isNotNull())
    return out.select("doc", F.struct(
        *[F.col(f"_q.m.{b}").alias(b) for b in BASE], F.col("_q.base_failed").alias("base_failed"), (~F.col("_q.base_failed") & (F.size(over) == 0)).alias("kept"),
        F.array_join(over, ",").alias("rejected_by"), F.col("_q.stratum").alias("stratum")).alias("q"))


def pick_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id"), F.col("quality"))
