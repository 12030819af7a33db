"""Turnover of index membership between successive lists, by ticker and by issuer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def months_between(a: Column, b: Column) -> Column:
    """Difference of calendar months; the day doesn't count."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def turnover(members: DataFrame, name: str, gap_months: int = 7) -> DataFrame:
    """``index_code, period_start, period_end, n_add, n_drop, added, dropped, n_members, spans_gap`` of successive snapshots.

    ``members``: one row a snapshot and name (with ``n`` and ``effective_date``). A period of more than ``gap_months`` calendar months spans a gap.
    """
    lists = members.groupBy("index_code", "n", "effective_date").agg(F.array_sort(F.collect_set(name)).alias("now"))
    w = Window.partitionBy("index_code").orderBy("n")
    pairs = lists.select("index_code", F.lag("effective_date").over(w).alias("period_start"), F.col("effective_date").alias("period_end"), "now", F.lag("now").over(w).alias("was"))
    added, dropped = F.array_sort(F.array_except("now", "was")), F.array_sort(F.array_except("was", "now"))
    return pairs.where("was is not null").select(
        "index_code", "period_start", "period_end", F.size(added).alias("n_add"), F.size(dropped).alias("n_drop"), F.array_join(added, ", ").alias("added"),
        F.array_join(dropped, ", ").alias("dropped"), F.size("now").alias("n_members"), (months_between(F.col("period_start"), F.col("period_end")) > gap_months).alias("spans_gap"),
    )


def membership_summary(members: DataFrame, name: str) -> DataFrame:
    """``index_code, name, n_present, n_total, pct_present, first_seen, last_seen, is_current`` of every name ever listed."""
    total = members.groupBy("index_code").agg(F.countDistinct("n").alias("n_total"), F.max("effective_date").alias("last_date"))
    seen = members.select("index_code", "n", "effective_date", name).distinct().groupBy("index_code", name).agg(
        F.count("*").alias("n_present"), F.min("effective_date").alias("first_seen"), F.max("effective_date").alias("last_seen")
    )
    return seen.join(total, "index_code").select(
        "index_code", name, "n_present", "n_total", (100 * F.col("n_present") / F.col("n_total")).alias("pct_present"), "first_seen", "last_seen", (F.col("last_seen") == F.col("last_date")).alias("is_current")
    )


def reported_against_found(reported: DataFrame, found: DataFrame) -> DataFrame:
    """Reported and found counts of each period: ``index_code, period_end, n_add_told, n_add, n_drop_told, n_drop, agrees``; the latest report (by turnover_id) of a period holds."""
    told = reported.where(F.col("period_end").isNotNull()).groupBy("index_code", "period_end").agg(F.max_by(F.struct("n_add", "n_drop"), "turnover_id").alias("t"))
    told = told.select("index_code", "period_end", F.col("t.n_add").alias("n_add_told"), F.col("t.n_drop").alias("n_drop_told"))
    both = found.select("index_code", "period_end", "n_add", "n_drop").join(told, ["index_code", "period_end"], "full")
    agrees = F.coalesce((F.col("n_add_told") == F.col("n_add")) & (F.col("n_drop_told") == F.col("n_drop")), F.lit(False))
    return both.withColumn("agrees", agrees)
