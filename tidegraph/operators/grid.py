"""Irregular readings onto a regular grid (problem 3).

Readings become one price for each series and session (an aggregate that combines on the map side), sessions are cut into
shards of ``shard`` sessions, and each shard of a series is summed up by its first and last reading. A scan over these summaries hands every shard, also
those without a reading, the state at its border: the price carried into it, and whether the series begins or ends in it. Then each shard fills its own sessions; what
it holds is bounded by its number of sessions, however many readings a series has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.runtime import small
from tidegraph.sources.tables import valid_price


def session_calendar(sessions: DataFrame) -> DataFrame:
    """``session_date, ord``: the open sessions numbered from 0. One row a calendar day at most, so one task orders it."""
    days = sessions.where(F.col("session_date").isNotNull()).groupBy("session_date").agg(F.max(F.coalesce("is_open", F.lit(False))).alias("is_open"))
    return days.where("is_open").select("session_date", (F.row_number().over(Window.orderBy("session_date")) - 1).alias("ord"))


def session_prices(readings: DataFrame, calendar: DataFrame) -> DataFrame:
    """``run_id, ticker, ord, price``: the last valid reading of each series and open session (by fecha, then reading_id; equal ones by price)."""
    valid = readings.where(valid_price(F.col("adjclose")) & F.col("fecha").isNotNull())
    placed = valid.select("run_id", "ticker", "reading_id", "fecha", "adjclose", F.to_date("fecha").alias("session_date")).join(calendar, "session_date")
    last = F.max(F.struct("fecha", "reading_id", "adjclose"))
    return placed.groupBy("run_id", "ticker", "ord").agg(last.alias("_last")).select("run_id", "ticker", "ord", F.col("_last.adjclose").alias("price"))


def filled_shards(prices: DataFrame, shard: int = 64) -> DataFrame:
    """``run_id, ticker, ord, price, observed``: every session of a series from its first to its last priced one."""
    obs = F.array_sort(F.collect_list(F.struct("ord", "price")))
    shards = prices.groupBy("run_id", "ticker", F.floor(F.col("ord") / shard).alias("shard")).agg(obs.alias("obs"))
    summed = shards.withColumn("first", F.col("obs")[0]).withColumn("last", F.element_at("obs", -1))
    w = Window.partitionBy("run_id", "ticker").orderBy("shard")
    begins, ends = F.lag("shard").over(w).isNull(), F.lead("shard").over(w).isNull()
    carried = summed.select(
        "run_id", "ticker", "shard", "obs", "last", F.lag("last.price").over(w).alias("carry"), F.lead("shard").over(w).alias("next_shard"),
        F.when(begins, F.col("first.ord")).otherwise(F.col("shard") * shard).alias("begin"), F.when(ends, F.col("last.ord")).otherwise((F.col("shard") + 1) * shard - 1).alias("end"),
    )
    # the shards without a reading up to the next one with any have the last price before them as their state
    own = F.struct("begin", "end", "carry", "obs")
    empty = F.transform(
        F.when(F.col("next_shard") - F.col("shard") > 1, F.sequence(F.col("shard") + 1, F.col("next_shard") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda s: F.struct((s * shard).alias("begin"), ((s + 1) * shard - 1).alias("end"), F.col("last.price").alias("carry"), F.array().cast(prices_type(prices)).alias("obs")),
    )
    each = carried.select("run_id", "ticker", F.inline(F.concat(F.array(own), empty)))
    gap = F.array(F.struct(F.col("begin").alias("ord"), F.col("carry").alias("price"), F.lit(False).alias("observed")))
    seen = F.transform("obs", lambda o: F.struct(o["ord"].alias("ord"), o["price"].alias("price"), F.lit(True).alias("observed")))
    leads = F.coalesce(F.get(F.col("obs"), F.lit(0))["ord"] > F.col("begin"), F.lit(True))
    pieces = each.select("run_id", "ticker", "end", F.concat(F.when(leads, gap).otherwise(F.slice(gap, 1, 0)), seen).alias("pieces"))
    reach = F.transform("pieces", lambda x, k: F.struct(x.alias("x"), F.coalesce(F.get(F.col("pieces"), k + 1)["ord"] - 1, F.col("end")).alias("to")))
    spans = pieces.select("run_id", "ticker", F.inline(reach))
    rows = spans.select("run_id", "ticker", "x", F.explode(F.sequence(F.col("x.ord"), F.col("to"))).alias("ord"))
    return rows.select("run_id", "ticker", "ord", "x.price", (F.col("x.observed") & (F.col("ord") == F.col("x.ord"))).alias("observed"))


def prices_type(prices: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in prices.schema.fields}
    return f"array<struct<ord:{kind['ord']},price:{kind['price']}>>"


def regular_grid(readings: DataFrame, sessions: DataFrame, shard: int = 64) -> DataFrame:
    """``run_id, ticker, session_day, price, observed``: one row for each open session from the first to the last with a valid reading.

    Sessions without a reading carry the price before them and have ``observed`` false. Null and NaN prices, prices not above 0, readings
    on closed days and readings without fecha belong to no session; a series without any valid reading on an open session has no rows.
    """
    calendar = small(session_calendar(sessions))
    rows = filled_shards(session_prices(readings, calendar), shard)
    return rows.join(calendar, "ord").select("run_id", "ticker", F.col("session_date").alias("session_day"), "price", "observed")


def missing_sessions(readings: DataFrame, sessions: DataFrame) -> DataFrame:
    """``run_id, ticker, session_day``: the grid's sessions without a reading, days as text."""
    return regular_grid(readings, sessions).where("not observed").select("run_id", "ticker", F.col("session_day").cast("string").alias("session_day"))


def coverage_check(readings: DataFrame, sessions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Declared and counted sessions of each series: ``run_id, ticker, n_declared, n_counted, n_missing, agrees``.

    Repeated declarations count once (the largest); series declared but never read count 0, those read but not declared have no declaration.
    """
    grid = regular_grid(readings, sessions).groupBy("run_id", "ticker").agg(F.count_if("observed").alias("n_counted"), F.count_if(~F.col("observed")).alias("n_missing"))
    told = coverage.groupBy("run_id", "ticker").agg(F.max("n_valid_days").alias("n_declared"))
    both = told.join(grid, ["run_id", "ticker"], "full")
    return both.select(
        "run_id",
        "ticker",
        "n_declared",
        F.coalesce("n_counted", F.lit(0)).alias("n_counted"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        F.coalesce(F.col("n_declared") == F.coalesce("n_counted", F.lit(0)), F.lit(False)).alias("agrees"),
    )
