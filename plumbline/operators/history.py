"""Runs and their history: outcomes, durations, paging, freshness, retention, review status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(status: Column, error: Column, warning: Column, failed_pages: Column) -> Column:
    return F.when(status == "cancelled", "cancelled").when((status == "failed") | (F.coalesce(error, F.lit("")) != ""), "failed").when((F.coalesce(warning, F.lit("")) != "") | (F.coalesce(failed_pages, F.lit(0)) > 0), "partial").otherwise("success")


def duration_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two timestamps; null if either is."""
    return F.timestamp_diff("MICROSECOND", started, finished) / 1e6


def fresh(stamp: Column, now: Column, hours: int) -> Column:
    """Whether a stamp is within its time to live; a missing one is not."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", stamp, now) <= hours * 3_600_000_000, F.lit(False))


def history_page(runs: DataFrame, order: list, limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """One page of a history, newest first by `order`, which must end in a unique column."""
    rows = runs if where is None else runs.where(where)
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def log_tail(log: Column, n: int = 80) -> Column:
    return F.when(F.size(log) > n, F.slice(log, -n, n)).otherwise(log)


def row_status(verified: Column, auto: Column, source: Column, quantity: Column, needs_review: Column) -> Column:
    """verified before auto before measured before review before ok."""
    no = F.lit(False)
    return F.when(F.coalesce(verified, no), "verified").when(F.coalesce(auto, no), "auto").when(F.startswith(F.coalesce(source, F.lit("")), F.lit("measured")), "measured").when(quantity.isNull() | F.coalesce(needs_review, no), "review").otherwise("ok")


def review_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, how many need a person, and the verified share in percent: 100 of none."""
    need = F.count_if(F.col("quantity").isNull() | F.coalesce("needs_review", F.lit(False)))
    total = F.count("*")
    return rows.groupBy(*keys).agg(total.alias("n"), need.alias("n_review"), F.round(100 * (total - need) / total, 1).alias("pct_verified"))


def weighted_progress(captured: Column, analysed: Column, total: Column) -> Column:
    """Capture fills the first 40 percent, analysis the next 50; 95 when both are done."""
    part = 40 * captured / F.nullif(total, F.lit(0)) + 50 * analysed / F.nullif(total, F.lit(0))
    return F.when(analysed >= total, 95.0).otherwise(F.round(F.coalesce(part, F.lit(0.0)), 1))
