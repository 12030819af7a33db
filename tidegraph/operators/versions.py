"""History of changing entity attributes (problem 1).

Gaps and islands over all snapshots: within a key, in the order of time, a row whose attribute hash differs from
that of the row before (``lag``) starts an island; a running sum numbers the islands; the first date of an island and that of the
next one bound the version. The rows of a key are reduced to one a date before the window, by an aggregate that
combines on the map side, so a key never holds more rows than there are dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import has_text, strip, words_joined
from tidegraph.operators.packed import packed_lists

OPEN_END = "9999-12-31"


def latest_per_date(rows: DataFrame, keys: list[str], date: str, stamp: str, tie: str, keep: list[str]) -> DataFrame:
    """One row for each key and date: that with the latest ``stamp`` (nulls first), ties by the larger ``tie``."""
    best = F.max_by(F.struct(*keep), F.struct(F.col(stamp), F.col(tie)))
    return rows.where(F.col(date).isNotNull()).groupBy(*keys, date).agg(best.alias("_best")).select(*keys, date, "_best.*")


def versions(rows: DataFrame, keys: list[str], date: str, value: Column) -> DataFrame:
    """``keys, value, valid_from, valid_to, n_rows`` for each run of equal ``value``; ``valid_to`` is the start of the next run, null if none.

    ``rows`` has one row for each key and date. Nulls in a key form a key of their own; a null value is a value.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    marked = rows.withColumn("_value", value).withColumn("_hash", F.xxhash64("_value"))
    # equal hashes are compared by value as well, so a collision can't join two versions
    differs = ~F.col("_hash").eqNullSafe(F.lag("_hash").over(w)) | ~F.col("_value").eqNullSafe(F.lag("_value").over(w))
    starts = marked.withColumn("_new", (F.lag(F.lit(1)).over(w).isNull() | differs).cast("int"))
    island = starts.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy(*keys, "_island").agg(F.min(date).alias("valid_from"), F.count("*").alias("n_rows"), F.first("_value").alias("value"))
    after = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("_island"))
    return spans.withColumn("valid_to", after).select(*keys, "value", "valid_from", "valid_to", "n_rows")


def snapshots(history: DataFrame) -> DataFrame:
    """``index_code, effective_date, history_id, tickers, n, next_date``: the snapshot of each index and date, numbered from 1 within the index.

    Deliveries without text or date are left aside; the latest received holds, ties by history_id.
    """
    told = history.where(has_text(F.col("tickers")))
    held = latest_per_date(told, ["index_code"], "effective_date", "received_at", "history_id", ["history_id", "tickers"])
    w = Window.partitionBy("index_code").orderBy("effective_date")
    return held.select("*", F.row_number().over(w).alias("n"), F.lead("effective_date").over(w).alias("next_date"))


def snapshot_lists(history: DataFrame) -> DataFrame:
    """``index_code, n, effective_date, next_date, tickers``: the array of the distinct tickers of each snapshot."""
    # the list travels with its dates, so no join back is needed
    tagged = snapshots(history).select(F.struct("index_code", "n", "effective_date", "next_date").alias("snap"), "tickers")
    return packed_lists(tagged, "snap", "tickers").select("row_id.*", F.array_distinct("values").alias("tickers"))


def snapshot_members(history: DataFrame) -> DataFrame:
    """``index_code, n, effective_date, next_date, ticker``: the distinct tickers of each snapshot."""
    return snapshot_lists(history).select("index_code", "n", "effective_date", "next_date", F.explode("tickers").alias("ticker"))


def memberships(history: DataFrame) -> DataFrame:
    """``index_code, ticker, valid_from, valid_to``: unbroken runs of snapshots that hold the ticker; ``valid_to`` null while it lasts.

    The attribute is presence: a snapshot with the ticker says ``true`` on its date and, unless it is the last, ``false`` on the date of the next
    one, which that one overrules if it holds the ticker too. The versions of ``true`` are the memberships. Rows of a ticker are brought
    together once; what follows keeps that partitioning.
    """
    keys = ["index_code", "ticker"]
    held = snapshot_members(history).select(*keys, "effective_date", "next_date").repartition(*keys)
    says = F.array(F.struct(F.col("effective_date").alias("date"), F.lit(True).alias("present")), F.struct(F.col("next_date").alias("date"), F.lit(False).alias("present")))
    told = held.select(*keys, F.inline(says)).where(F.col("date").isNotNull()).groupBy(*keys, "date").agg(F.max("present").alias("present"))
    spans = versions(told, keys, "date", F.col("present"))
    return spans.where("value").select(*keys, "valid_from", "valid_to")


def issuer_versions(actions: DataFrame) -> DataFrame:
    """``index_code, issuer_id, attribute, valid_from, valid_to`` from notices; rows without date or new_value are left aside."""
    told = actions.where(has_text(F.col("new_value"))).select(
        "index_code", "issuer_id", words_joined(F.col("event")).alias("attribute"), "effective_date", "recorded_at", "action_id", "new_value"
    )
    keys = ["index_code", "issuer_id", "attribute"]
    held = latest_per_date(told, keys, "effective_date", "recorded_at", "action_id", ["new_value"])
    return versions(held, keys, "effective_date", F.lower(strip(F.col("new_value"))))


def all_versions(history: DataFrame, actions: DataFrame) -> DataFrame:
    """Memberships and issuer attributes as ``index_code, entity, attribute, valid_from, valid_to``, dates as text, open ends as 9999-12-31."""
    dated = lambda df, entity, attribute: df.select(
        "index_code",
        F.col(entity).alias("entity"),
        attribute.alias("attribute"),
        F.col("valid_from").cast("string").alias("valid_from"),
        F.coalesce(F.col("valid_to").cast("string"), F.lit(OPEN_END)).alias("valid_to"),
    )
    return dated(memberships(history), "ticker", F.lit("membership")).unionByName(dated(issuer_versions(actions), "issuer_id", F.col("attribute")))
