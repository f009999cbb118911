"""URL filters: host and path rules, then a character language-model ratio (operator 9, JVM side only).

URLs that a rule decides train two variable-order Markov models of their characters, one of
accepted and one of rejected URLs.  A character's probability after its two predecessors is
interpolated down to one, none and the uniform distribution (Witten-Bell weights: contexts that
were followed by many different characters trust the shorter context more).  Other URLs are allowed
if the mean log-likelihood difference per character reaches a cutoff, which is the one of least
balanced error on rule-decided URLs kept out of training.

Characters are mapped to an alphabet of ``len(ALPHABET)`` symbols, so the models have at most its
cube of rows, whatever the input; that bound is why they may be broadcast.

Defined results: a null URL or one without "://" has an empty host and path, no rule, and is judged
by its characters; without examples of both kinds everything undecided is allowed; repeated rows
each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, written_table
from .html_text import url_parts

#: host, path, verdict; a rule fits its host and all below it.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Symbols: letters, 0 for any digit, marks, ~ for all else, ^ before the beginning and $ after the end.
ALPHABET = LOWER + "0/._-?=&#%:~^$"
CUTS = [round(0.05 * i, 2) for i in range(-20, 21)]
#: First hex digits of a URL's md5 that put it among the rule-decided URLs used for the cutoff only.
HELD_OUT = ("0", "1", "2")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path in one text, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit("^^"), F.regexp_replace(F.regexp_replace(low, "[0-9]", "0"), r"[^a-z0/._\-?=&#%:]", "~"), F.lit("$"))


def grams(s: Column) -> Column:
    """Every symbol with its two predecessors."""
    return let(s, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substr(x, i, F.lit(3))))


def model(counts: DataFrame) -> DataFrame:
    """gram, ratio: log P(accepted) - log P(rejected) of the last symbol after the first two.

    ``counts``: gram, n_allow, n_block; at most the cube of the alphabet.
    """
    g = counts.select("gram", F.substring("gram", 1, 2).alias("ab"), F.substring("gram", 2, 2).alias("bc"), F.substring("gram", 2, 1).alias("b"), F.substring("gram", 3, 1).alias("c"), "n_allow", "n_block")
    kinds = ("allow", "block")
    total = lambda df, key, tag: df.groupBy(key).agg(*[x for k in kinds for x in (F.sum(f"n_{k}").alias(f"{tag}_n_{k}"), F.count(F.when(F.col(f"n_{k}") > 0, 1)).alias(f"{tag}_t_{k}"))])
    pairs = g.groupBy("bc", "b", "c").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])
    long, short = total(g, "ab", "ab"), total(pairs, "b", "b")
    single = pairs.groupBy("c").agg(*[F.sum(f"n_{k}").alias(f"c_{k}") for k in kinds])
    everything = counts.agg(*[F.sum(f"n_{k}").alias(f"all_{k}") for k in kinds])
    df = g.join(pairs.select("bc", *[F.col(f"n_{k}").alias(f"bc_{k}") for k in kinds]), "bc").join(long, "ab").join(short, "b").join(single, "c").join(F.broadcast(everything))  # one row

    def mixed(n: str, seen: str, types: str, lower: Column) -> Column:
        weight = F.col(seen) + F.col(types)
        return F.when(weight > 0, (F.col(n) + F.col(types) * lower) / weight).otherwise(lower)

    def log_p(k: str) -> Column:
        p0 = (F.col(f"c_{k}") + 1) / (F.col(f"all_{k}") + len(ALPHABET))
        p1 = mixed(f"bc_{k}", f"b_n_{k}", f"b_t_{k}", p0)
        return F.log(mixed(f"n_{k}", f"ab_n_{k}", f"ab_t_{k}", p1))

    return df.select("gram", (log_p("allow") - log_p("block")).alias("ratio"))


def scored(rows: DataFrame) -> DataFrame:
    """rid, url_score of ``rows`` (rid, symbols, verdict, held): the mean difference per symbol."""
    spread = rows.select("rid", F.when(~F.col("held"), F.col("verdict")).alias("v"), F.explode(grams(F.col("symbols"))).alias("gram"))
    counts = written_table(spread.groupBy("gram").agg(F.count(F.when(F.col("v") == "allow", 1)).alias("n_allow"), F.count(F.when(F.col("v") == "block", 1)).alias("n_block")))
    ratios = F.broadcast(written_table(model(counts)))  # at most len(ALPHABET) ** 3 rows
    return spread.select("rid", "gram").join(ratios, "gram").groupBy("rid").agg(F.round(F.avg("ratio"), 6).alias("url_score"))


def cutoff(scores: DataFrame, cuts=CUTS) -> float | None:
    """The cut of least balanced error over ``scores`` (verdict, url_score); None without both kinds."""
    s = F.col("url_score")
    counts = scores.agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")],
                        *[F.count(F.when((F.col("verdict") == "allow") & (s < c), 1)).alias(f"lost_{i}") for i, c in enumerate(cuts)],
                        *[F.count(F.when((F.col("verdict") == "block") & (s >= c), 1)).alias(f"let_{i}") for i, c in enumerate(cuts)]).first()
    if not counts["allow"] or not counts["block"]:
        return None
    return min(cuts, key=lambda c: (round(counts[f"lost_{cuts.index(c)}"] / counts["allow"] + counts[f"let_{cuts.index(c)}"] / counts["block"], 12), abs(c), c))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, url_score of every page."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = written_table(rows.withColumn("rule", name).withColumn("verdict", verdict).withColumn("symbols", symbols(F.col("url")))
                         .withColumn("held", F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)).drop("url"))
    scores = written_table(scored(rows))
    both = written_table(rows.select("rid", "page_id", "host", "path", "rule", "verdict", "held").join(scores, "rid"))
    cut = cutoff(both.filter("held and verdict is not null"))
    learnt = F.lit("allow") if cut is None else F.when(F.col("url_score") >= cut, "allow").otherwise("block")
    return both.select("page_id", "host", "path", "rule", F.coalesce("verdict", learnt).alias("verdict"), "url_score")
