"""Row-level text Columns: all JVM expressions, no Python functions, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .numeric import c


def str_array(words) -> str:
    """SQL text of a constant string array; the optimizer folds it into one literal."""
    return "array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")"


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row.

    The optimizer may inline a column into the lambda that uses it, which would
    evaluate it once per array element; a lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lower(text) -> Column:
    return F.lower(F.coalesce(c(text), F.lit("")))


def trie_pattern(words) -> str:
    """One regular expression for all words, longest first at each place, with shared beginnings.

    A text is then read once for the whole list instead of once per word.
    """
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node: dict) -> str:
        parts = [re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", ch) + build(child) for ch, child in node.items() if ch]
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
        return f"(?:{body})?" if "" in node and body else body

    return build(root)


def grouped_pattern(words, size: int = 6) -> str:
    """The same, with a look at the first letter before each ``size`` beginnings: most places of a text are left after a few of them."""
    by: dict = {}
    for w in words:
        by.setdefault(w[0], []).append(w)
    first = sorted(by)
    parts = []
    for i in range(0, len(first), size):
        some = first[i:i + size]
        letters = "".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", ch) for ch in some)
        parts.append(f"(?=[{letters}]){trie_pattern([w for ch in some for w in by[ch]])}")
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def contains_any(lowered: Column, words) -> Column:
    """Some word occurs as a substring; the text is read once."""
    return F.rlike(c(lowered), F.lit(trie_pattern(words)))


def text_matches_any(text, words) -> Column:
    """Any keyword occurs as a substring of the lower-cased text."""
    return contains_any(_lower(text), words)


def found_words(lowered: Column, words) -> Column:
    """The distinct words that occur as substrings, overlapping ones too.

    A look-ahead gives the longest word at every place of the text; words that begin a longer one
    are added from the list.
    """
    words = list(dict.fromkeys(words))
    raw = F.array_distinct(F.regexp_extract_all(c(lowered), F.lit(f"(?=({grouped_pattern(words)}))"), F.lit(1)))
    begun = {w: [x for x in words if x != w and w.startswith(x)] for w in words}
    begun = {w: x for w, x in begun.items() if x}
    if not begun:
        return raw
    table = F.create_map(*[x for w, xs in begun.items() for x in (F.lit(w), F.expr(str_array(xs)))])
    keys = F.expr(str_array(begun))
    return let(raw, lambda r: F.array_distinct(F.concat(r, F.flatten(F.transform(F.array_intersect(r, keys), lambda w: F.try_element_at(table, w))))))


def _hits(found: Column, words) -> Column:
    return F.size(F.array_intersect(F.expr(str_array(words)), found))


def hit_count(lowered: Column, words) -> Column:
    return F.size(found_words(lowered, words))


def sentiment_hits(text, found: Column | None = None) -> Column:
    """struct<pos, neg>: positive and negative words present.  ``found``: words known to be in the text, these among them."""
    found = found_words(_lower(text), [*lx.POSITIVE_WORDS, *lx.NEGATIVE_WORDS]) if found is None else found
    return let(found, lambda f: F.struct(_hits(f, lx.POSITIVE_WORDS).alias("pos"), _hits(f, lx.NEGATIVE_WORDS).alias("neg")))


def rule_words(text, lexicon=None) -> Column:
    """The words of the issue categories and of both sentiments that occur, for rules that share one reading of the text."""
    return found_words(_lower(text), [*[w for _, ws, _ in lexicon or lx.ISSUE_LEXICON for w in ws], *lx.POSITIVE_WORDS, *lx.NEGATIVE_WORDS])


def word_frame(lowered) -> Column:
    """Lower-cased text in which every word is delimited by spaces.

    Non-word characters other than the plain space become `` \\u0001 ``, so a
    whole-word test is a substring test for `` word `` and a phrase still needs
    the single spaces between its words.
    """
    return F.concat(F.lit(" "), F.regexp_replace(c(lowered), r"[^A-Za-z0-9_ ]", " \u0001 "), F.lit(" "))


def category_scores(text, lexicon=None, found: Column | None = None) -> Column:
    """array<int>: per category, one point per keyword found, one more as a whole word."""
    lists = [w for _, w, _ in lexicon or lx.ISSUE_LEXICON]
    words = "array(" + ", ".join(str_array(w) for w in lists) + ")"
    every = [w for ws in lists for w in ws]
    # few keywords occur in a text: each is looked for as a whole word, which takes less than framing the whole text
    plain = all(re.fullmatch(r"[A-Za-z0-9_]+( [A-Za-z0-9_]+)*", w) for w in every)

    def whole(v, k):
        if plain:
            return F.rlike(v["f"], F.concat(F.lit("(?<![A-Za-z0-9_])"), k, F.lit("(?![A-Za-z0-9_])")))
        return F.contains(v["f"], F.concat(F.lit(" "), k, F.lit(" ")))

    def points(v):
        # The whole-word test runs only for keywords that occur at all.
        return lambda ks: F.aggregate(F.array_intersect(ks, v["w"]), F.lit(0), lambda acc, k: acc + 1 + whole(v, k).cast("int"))

    seen = let(_lower(text), lambda t: F.struct((found_words(t, every) if found is None else found).alias("w"), (t if plain else word_frame(t)).alias("f")))
    return let(seen, lambda v: F.transform(F.expr(words), points(v)))


def classify_issue(text, lexicon=None, found: Column | None = None) -> Column:
    """struct<score, category, advice, categories>: best category (first on ties) and all that match."""
    lexicon = lexicon or lx.ISSUE_LEXICON
    names, advice = str_array([n for n, _, _ in lexicon]), str_array([a for _, _, a in lexicon])

    def pick(s):
        best = F.array_max(s)
        win = F.when(best > 0, F.array_position(s, best).cast("int"))
        return F.struct(
            best.alias("score"),
            F.coalesce(F.get(F.expr(names), win - 1), F.lit(lx.DEFAULT_CATEGORY)).alias("category"),
            F.coalesce(F.get(F.expr(advice), win - 1), F.lit(lx.DEFAULT_ADVICE)).alias("advice"),
            F.array_compact(F.zip_with(F.expr(names), s, lambda n, x: F.when(x > 0, n))).alias("categories"),
        )

    return let(category_scores(text, lexicon, found), pick)


def labels_matched(lowered, labelled_words) -> Column:
    """array<string> of the labels with at least one word in the text, in list order."""
    pairs = "array(" + ", ".join(f"named_struct('n', '{n}', 'k', {str_array(w)})" for n, w in labelled_words) + ")"
    found = found_words(c(lowered), [w for _, ws in labelled_words for w in ws])
    return let(found, lambda f: F.transform(F.filter(F.expr(pairs), lambda x: F.arrays_overlap(x["k"], f)), lambda x: x["n"]))


def match_all_categories(text, lexicon=None) -> Column:
    """array<string> of every category with at least one keyword hit, in lexicon order."""
    return labels_matched(_lower(text), [(n, w) for n, w, _ in lexicon or lx.ISSUE_LEXICON])


def topic_of(category) -> Column:
    col, out = c(category), None
    for topic, cats in lx.TOPIC_GROUPS:
        out = F.when(col.isin(cats), F.lit(topic)) if out is None else out.when(col.isin(cats), F.lit(topic))
    return out.otherwise(F.lit(lx.DEFAULT_TOPIC))


def sentiment_of(rating, pos, neg) -> Column:
    r, p, n = c(rating), c(pos), c(neg)
    return (
        F.when(r >= 4, F.when(n > p + 1, F.lit("NEUTRAL")).otherwise(F.lit("POSITIVE")))
        .when(r <= 2, F.lit("NEGATIVE"))
        .when(n > p, F.lit("NEGATIVE"))
        .when(p > n, F.lit("POSITIVE"))
        .otherwise(F.lit("NEUTRAL"))
    )


def category_confidence(score) -> Column:
    s = c(score)
    return F.when(s == 0, F.lit(0.3)).otherwise(F.least(F.lit(1.0), F.lit(0.5) + s / F.lit(8.0)))


def split_words(text) -> Column:
    return F.split(c(text), lx.WHITESPACE + "+")


def word_count(text) -> Column:
    return F.size(F.filter(split_words(F.coalesce(c(text), F.lit(""))), lambda w: w != ""))


def js_trim(text) -> Column:
    return F.regexp_replace(c(text), f"^{lx.WHITESPACE}+|{lx.WHITESPACE}+$", "")


def tokenize_light(text) -> Column:
    low = F.translate(F.lower(F.coalesce(c(text), F.lit(""))), lx.LIGHT_PUNCT, " " * len(lx.LIGHT_PUNCT))
    return F.filter(split_words(low), lambda w: (w != "") & ~w.isin(lx.LIGHT_STOP))


def split_sentences(text) -> Column:
    parts = F.split(F.coalesce(c(text), F.lit("")), r"(?<=[.!?])" + lx.WHITESPACE + "+")
    return F.filter(F.transform(parts, js_trim), lambda s: F.length(s) > 3)


def extract_keywords(text, top: int = 5) -> Column:
    """Five most frequent longer words per row, ties by first position.

    Stays inside the row: the tokens are sorted once, runs of equal tokens are
    found by looking at the neighbour, and the runs are ordered.  O(n log n) in
    the length of the text and without a shuffle, so a very long text costs its
    own task and nothing else.  All-digit words precede the others on equal count.
    """
    toks = F.filter(
        split_words(F.translate(_lower(text), lx.KEYWORD_PUNCT, "")),
        lambda w: (F.length(w) > 3) & ~w.isin(lx.KEYWORD_STOP),
    )
    ordered = F.sort_array(F.transform(toks, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def runs(s):
        return F.filter(
            F.transform(s, lambda x, i: F.struct(x["w"].alias("w"), x["p"].alias("p"), i.alias("k"), F.size(s).alias("n"))),
            lambda x: ~x["w"].eqNullSafe(F.get(s, x["k"] - 1)["w"]),
        )

    def rank(r):
        def entry(x, i):
            number = x["w"].try_cast("long")
            return F.struct(
                (x["k"] - F.coalesce(F.get(r, i + 1)["k"], x["n"])).alias("neg"),
                F.when(x["w"].rlike(r"^(0|[1-9][0-9]{0,9})$") & (number < 4294967295), number).otherwise(F.lit(1 << 40)).alias("num"),
                x["p"].alias("p"), x["w"].alias("w"))

        return F.transform(F.slice(F.sort_array(F.transform(r, entry)), 1, top), lambda x: x["w"])

    return let(let(ordered, runs), rank)


def exploded(df, column: str, keep, name: str, pos: str | None = None):
    """One row per element of an array column; rows without elements vanish.

    The outer generator keeps the optimizer from adding a size filter on the column, which
    would compute an expensive array a second and third time below the generator.
    """
    gen = F.posexplode_outer(column).alias(pos, name) if pos else F.explode_outer(column).alias(name)
    return df.select(*keep, gen).filter(F.col(name).isNotNull())
