"""Row filters, search and table views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import any_of


def _has(col, needle: str):
    return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(needle.lower()))


def filter_reviews(df: DataFrame, rating=None, category=None, sentiment=None, search: str | None = None) -> DataFrame:
    """Conjunctive filter; ``search`` looks in place, text, author and recommendation."""
    if rating is not None:
        df = df.filter(F.col("rating") == rating)
    if category:
        df = df.filter(F.col("issue_category") == category)
    if sentiment:
        df = df.filter(F.col("sentiment") == sentiment)
    if search and search.strip():
        df = df.filter(any_of([_has(c, search) for c in ("park_name", "review_text", "author_name", "design_requirement")]))
    return df


def global_search(df: DataFrame, needle: str) -> DataFrame:
    low = needle.lower()
    return df.filter(any_of([_has(c, needle) for c in ("review_text", "author_name", "park_name")])
                     | F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(low))))


def table_page(df: DataFrame, filters: dict | None = None, sort=(), page: int = 0, size: int = 15, seq: str = "review_id") -> DataFrame:
    """Column filters, multi-column sort (name, descending?) and one page of rows."""
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name) == value)
    order = [F.desc(n) if d else F.asc(n) for n, d in sort]
    return df.orderBy(*order, F.asc(seq)).offset(page * size).limit(size)


def cross_filter(df: DataFrame, category: str | None = None, keyword: str | None = None) -> DataFrame:
    """Dashboard drill-down applied before every analysis."""
    if category:
        df = df.filter(F.col("issue_category") == category)
    if keyword:
        df = df.filter(_has("review_text", keyword))
    return df


def search_places(df: DataFrame, q: str) -> DataFrame:
    return df.filter(any_of([_has(c, q) for c in ("name", "formatted_address")]))


def park_site_filter(cells: DataFrame) -> DataFrame:
    """Cells with some park area."""
    return cells.filter(F.col("park_area_m2") > 0)


def opportunity_filter(df: DataFrame, sources=(), priorities=(), geometry_types=(), user_group=None, brief: str = "all", high_confidence=False) -> DataFrame:
    """Programs that match every given criterion; an empty criterion matches all."""
    if sources:
        df = df.filter(F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources])))
    if priorities:
        df = df.filter(F.col("priority").isin(list(priorities)))
    if geometry_types:
        df = df.filter(F.col("geometry_type").isin(list(geometry_types)))
    if user_group:
        df = df.filter(F.array_contains("users", user_group))
    if brief in ("required", "optional"):
        df = df.filter(F.array_contains("sources", f"brief-{brief}"))
    if high_confidence:
        df = df.filter(F.col("confidence") >= 70)
    return df


PRIORITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}  # fixed values


def opportunity_sort(df: DataFrame, key: str = "opportunity") -> DataFrame:
    """Order programs by one of 12 keys; ties keep catalogue order."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY_RANK.items() for x in kv])
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    orders = {
        "category": [F.asc("category"), F.desc("opportunity")],
        "recommendedArea": [F.coalesce("target_area", F.lit(-1.0)).desc()],
        "priority": [F.element_at(rank, F.col("priority")).desc()],
        "userGroup": [first("users").asc()], "source": [first("sources").asc()], "geometryType": [F.asc("geometry_type")],
        **{k: [F.desc(k)] for k in ("opportunity", "demand", "suitability", "feasibility", "confidence", "readiness")},
    }
    return df.orderBy(*orders[key], F.asc("program_order"))
