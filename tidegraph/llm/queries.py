"""Queries pN_ on text collections. Tokenizers and trees have no SQL, but the faults of packings and mixtures have; the rest is tested in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.mixing import Target, kept, mix, mix_faults, mix_report
from tidegraph.llm.packing import pack_faults, pack_items, pack_report
from tidegraph.llm.spam import spam_pages
from tidegraph.llm.tokens import token_counts
from tidegraph.plans.runtime import cut_lineage
from tidegraph.sources.tables import table

MOST_NAMES = 1000  #: pack_sizes and mix_targets are parameter tables of a few rows


def _few(rows: DataFrame) -> list[Row]:
    """The rows of a parameter table; more than ``MOST_NAMES`` are an error."""
    got = rows.take(MOST_NAMES + 1)
    if len(got) > MOST_NAMES:
        raise ValueError(f"a parameter table has more than {MOST_NAMES} names")
    return got


def _packs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = table(spark, sf_dir, "pack_sizes").groupBy("pack_name").agg(F.max("capacity_tokens").alias("c")).where("c > 0 and pack_name is not null")
    return sorted((r["pack_name"], r["c"]) for r in _few(rows))


def _targets(spark: SparkSession, sf_dir: str) -> list[Target]:
    rows = table(spark, sf_dir, "mix_targets").where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m"))
    return [Target(r["source"], r["w"], r["m"]) for r in sorted(_few(rows), key=lambda r: r["source"])]


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(token_counts(table(spark, sf_dir, "documents"), ["doc_id"]), _packs(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(p6_packed(spark, sf_dir), _packs(spark, sf_dir))


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, packs = token_counts(table(spark, sf_dir, "documents"), ["doc_id"]), _packs(spark, sf_dir)
    return pack_faults(cut_lineage(pack_items(sizes, packs)), sizes, packs)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(token_counts(table(spark, sf_dir, "documents"), ["source", "doc_id"]), _targets(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(kept(p7_mixture(spark, sf_dir)), _targets(spark, sf_dir))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_faults(kept(p7_mixture(spark, sf_dir)), _targets(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "page_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_packed, p6_report, p6_faults, p7_mixture, p7_report, p7_faults, p8_found)}
# what holds of any right packing and mixture, whatever the tokenizer
SQL: dict[str, str] = {
    "p6_faults": "SELECT DISTINCT pack_name, (SELECT count(*) FROM documents) AS items, 0 AS over_full, 0 AS cut_needlessly, 0 AS incomplete FROM pack_sizes WHERE capacity_tokens > 0",
    "p7_faults": "SELECT DISTINCT source, 0 AS used_too_often, false AS share_missed FROM mix_targets WHERE source IS NOT NULL",
}
