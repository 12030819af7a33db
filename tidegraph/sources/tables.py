"""Sources and sinks: parquet and CSV readers with declared schemas, CSV and JSON writers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBERSHIP = T.StructType(
    [
        T.StructField("effective_date", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("n_tickers", T.IntegerType()),
        T.StructField("tickers", T.StringType()),
    ]
)
ALIASES = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("issuer_id", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables: ``<sf_dir>/<name>.parquet`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, read with a declared schema; a malformed row fails the job."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", quote='"', escape='"')


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Curated list file: ``tickers`` is parted by ``;``, empty parts are dropped, and the declared
    count has to equal the number of parts, else the job fails."""
    parts = F.filter(F.split("tickers", ";"), lambda x: F.trim(x) != "")
    rows = read_csv(spark, path, MEMBERSHIP).withColumn("members", parts)
    checked = F.when(F.size("members") != F.col("n_tickers"), F.raise_error(F.lit("declared count differs from the list"))).otherwise(F.col("members"))
    return rows.withColumn("members", checked.cast("array<string>")).orderBy("effective_date")


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def wide_matrix(edges: DataFrame, i: str = "i", j: str = "j", w: str = "w") -> DataFrame:
    """The square matrix of an upper-triangle edge list, for display: one row and column a node, 0 on the diagonal."""
    both = edges.select(F.col(i).alias("node"), F.col(j).alias("other"), F.col(w).alias("w")).unionByName(
        edges.select(F.col(j).alias("node"), F.col(i).alias("other"), F.col(w).alias("w"))
    )
    loops = both.select("node", F.col("node").alias("other"), F.lit(0.0).alias("w")).distinct()
    return both.unionByName(loops).groupBy("node").pivot("other").agg(F.first("w")).orderBy("node")


def as_json_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """One JSON text a row from the columns beside ``key``."""
    rest = [c for c in df.columns if c not in key]
    return df.select(*key, F.to_json(F.struct(*rest)).alias("json"))


def write_manifest(path: str, config: dict, versions: dict) -> None:
    """Run manifest (parameters and versions) as JSON; values JSON can't hold become text."""
    Path(path).write_text(json.dumps({"config": config, "versions": versions}, indent=1, default=str, sort_keys=True))


def valid_price(price: Column) -> Column:
    """Neither null nor NaN and above 0."""
    return price.isNotNull() & ~F.isnan(price) & (price > 0)
