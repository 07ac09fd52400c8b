"""Dashboard reports: counts, trends, breakdowns, paging.

Totals are scalar subqueries, never windows over a whole table. Spines (the lists of
days or levels a report must show) have fixed size.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import lookup, title_case
from ..sources import schemas


def _rows() -> Column:
    return F.count(F.lit(1))


def summary_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all tables in one row."""
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(
        *[df.agg(_rows().alias("n")).scalar().alias(f"total_{name}") for name, df in tables.items()]
    )


def failure_trend(
    failures: DataFrame, as_of: str | datetime, time: str = "created_at", days: int = 7,
    fallback: bool = False,
) -> DataFrame:
    """Failures per day for the last days, oldest first, zero-filled: (position, name, failures).

    The time range filter comes first, so files can be skipped by their statistics.
    With ``fallback`` an empty window shows falling numbers from the table's total.
    """
    now = F.lit(as_of).cast(failures.schema[time].dataType)
    stamp = F.col(time)
    counts = (
        failures.filter((stamp >= now - F.expr(f"interval {days} days")) & stamp.isNotNull())
        .groupBy(F.to_date(time).alias("day"))
        .agg(_rows().alias("n"))
    )
    return _trend(counts, now, days, failures.agg(_rows().alias("n")).scalar() if fallback else None)


def _trend(counts: DataFrame, now: Column, days: int, total: Column | None) -> DataFrame:
    """Zero-filled days from (day, n) counts; with ``total`` an empty window shows falling numbers."""
    spine = counts.sparkSession.range(days).select(
        F.col("id").alias("position"),
        F.date_sub(F.to_date(now), F.lit(days - 1) - F.col("id").cast("int")).alias("day"),
    )
    trend = spine.join(counts, "day", "left").select(
        "position",
        F.date_format("day", "E dd").alias("name"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("failures"),
    )
    if total is not None:
        seen = trend.agg(F.sum("failures").alias("n")).scalar()
        falling = F.greatest(F.lit(0), total - F.col("position")).cast("bigint")
        trend = trend.withColumn(
            "failures", F.when((seen == 0) & (total > 0), falling).otherwise(F.col("failures"))
        )
    return trend


# --- the same from a store's counters -----------------------------------------------------

def _counted(counts: DataFrame, table: str, dimension: str) -> DataFrame:
    return counts.filter((F.col("table_name") == table) & (F.col("dimension") == dimension)).select("value", "n")


def summary_from_counters(counts: DataFrame) -> DataFrame:
    """``summary_counts`` from ``store.counters``."""
    of = lambda t: F.sum(F.when((F.col("table_name") == t) & (F.col("dimension") == "all"), F.col("n")))
    return counts.agg(*[F.coalesce(of(t), F.lit(0)).cast("bigint").alias(f"total_{t}") for t in schemas.TABLES])


def trend_from_counters(counts: DataFrame, as_of: str | datetime, days: int = 7, fallback: bool = False) -> DataFrame:
    """``failure_trend`` from ``store.counters``."""
    by_day = _counted(counts, "failures", "day").select(F.to_date("value").alias("day"), "n")
    total = _counted(counts, "failures", "all").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar() if fallback else None
    return _trend(by_day, F.lit(as_of).cast("timestamp"), days, total)


def breakdown_from_counters(counts: DataFrame) -> DataFrame:
    """``root_cause_breakdown`` from ``store.counters``."""
    return _named_causes(_counted(counts, "failures", "root_cause").select(F.col("value").alias("root_cause"), F.col("n").alias("value")))


def risk_from_counters(counts: DataFrame) -> DataFrame:
    """``risk_distribution`` from ``store.counters``."""
    levels = F.array(*[F.lit(r) for r in vocab.RISK_LEVELS])
    spine = counts.sparkSession.range(1).select(F.explode(levels).alias("name"))
    found = _counted(counts, "flaky_tests", "risk_level")
    return spine.join(found, F.lower("name") == F.col("value"), "left").select(
        "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("value")
    )


def root_cause_breakdown(failures: DataFrame) -> DataFrame:
    """Count per cause with display name and color."""
    return _named_causes(failures.groupBy("root_cause").agg(_rows().alias("value")))


def _named_causes(counts: DataFrame) -> DataFrame:
    color = lookup(F.col("root_cause"), vocab.CAUSE_COLORS, vocab.OTHER_COLOR)
    return counts.select(title_case("root_cause").alias("name"), "value", color.alias("color"))


def risk_distribution(flaky: DataFrame) -> DataFrame:
    """Count per risk level, all three levels shown: one pass to one row, then unpivoted."""
    return risk_share(flaky).select("name", "value")


def risk_share(flaky: DataFrame) -> DataFrame:
    """Count and share in percent (half up) of each risk level; zero without rows."""
    level = F.lower("risk_level")
    one = flaky.agg(*[F.count_if(level == r.lower()).alias(r) for r in vocab.RISK_LEVELS])
    total = sum((F.col(r) for r in vocab.RISK_LEVELS[1:]), F.col(vocab.RISK_LEVELS[0]))
    share = F.when(F.col("_total") > 0, F.floor(F.col("value") * 100.0 / F.col("_total") + 0.5))
    return (
        one.withColumn("_total", total)
        .unpivot("_total", vocab.RISK_LEVELS, "name", "value")
        .select("name", "value", F.coalesce(share, F.lit(0)).cast("bigint").alias("percent"))
    )


def avg_instability(flaky: DataFrame) -> DataFrame:
    """Mean of the score texts, half up, 0 without any number. Pass a page or the whole table."""
    number = F.regexp_extract("instability_score", r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    mean = F.floor(F.avg(number) + F.lit(0.5))
    return flaky.agg(F.coalesce(mean, F.lit(0)).cast("bigint").alias("average_score"))


def high_risk_count(flaky: DataFrame) -> DataFrame:
    return flaky.agg(F.count_if(F.lower("risk_level") == "high").alias("high_risk"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and percent per label (one decimal), most frequent first."""
    rows = df.filter(F.col(label).isNotNull())
    total = rows.agg(_rows().alias("n")).scalar()
    return (
        rows.groupBy(F.col(label).alias("label"))
        .agg(_rows().alias("count"))
        .withColumn("percent", F.round(F.col("count") * 100.0 / total, 1))
        .orderBy(F.desc("count"), "label")
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, from one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "missing")


def shape_profile(df: DataFrame) -> DataFrame:
    """Number of rows and columns, and the column names."""
    return df.agg(_rows().alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def head(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)


def recent_failures(failures: DataFrame, n: int = 5) -> DataFrame:
    return (
        failures.orderBy(F.desc("id")).limit(n)
        .select("id", "test_id", "test_name", "pipeline", "status", "root_cause", "healing")
    )


def page(df: DataFrame, order: list, number: int = 1, size: int = 10) -> DataFrame:
    """One page, with the page number, page size and the total in every row.

    Top rows are selected per task first. A deep page keeps (number * size) rows per
    task; use ``page_after`` to walk far.
    """
    total = df.agg(_rows().alias("n")).scalar()
    return (
        df.orderBy(*order).offset((number - 1) * size).limit(size)
        .withColumns({"total": total, "page": F.lit(number), "page_size": F.lit(size)})
    )


def page_after(df: DataFrame, last_id: int | None, size: int = 10, key: str = "id") -> DataFrame:
    """Next page in falling key order after ``last_id``; the filter reaches the scan."""
    rows = df if last_id is None else df.filter(F.col(key) < last_id)
    return rows.orderBy(F.desc(key)).limit(size)


def total_pages(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(_rows().alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("total_pages")
    )


def rank_probabilities(df: DataFrame, key: str, probabilities: str = "all_probabilities") -> DataFrame:
    """Classes of every row by falling probability; sorted inside the row, no shuffle."""
    entries = F.array_sort(
        F.map_entries(probabilities),
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1)
        .when(a["key"] > b["key"], 1)
        .otherwise(0),
    )
    ranked = df.select(key, F.posexplode(entries).alias("position", "entry"))
    return ranked.select(
        key,
        (F.col("position") + 1).alias("rank"),
        F.col("entry.key").alias("root_cause"),
        F.col("entry.value").alias("probability"),
    )


def metric_band(df: DataFrame, value: str = "value") -> DataFrame:
    """Display band of a metric between 0 and 1."""
    percent = F.col(value) * 100.0
    band = F.when(percent >= 80, "good").when(percent >= 60, "fair").otherwise("poor")
    return df.withColumn("band", band)
