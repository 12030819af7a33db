"""Keyword-stuffed and link-list pages (problem 8).

Bagged decision trees over content and link features, trained on weak labels, then smoothed by the spam rate of each page's source, which stands for its host, as
the crawl has no other.

Content features rest on a lexicon: the log odds of each word between pages labelled spam and others, learned by Spark from the labelled pages. A page is
read in windows of some twenty words; the share of windows whose mean log odds are high tells how much of its *text* is filler, so a ruling that quotes an
advertisement stays a ruling. The rest are rates of links, tags, numbers, repeated words and pairs, sentence ends and long lines. Every page is
read whole, inside Arrow batches (``page_features``).

Training is bounded: ``MAX_LABELS`` given labels and about ``MAX_SAMPLE`` other pages, both samples by hash. All pages are scored.
A page without words is no spam; a page labelled both ways counts once for either label; without labels of both kinds nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.page_features import FEATURES, LEXICAL, PLAIN, Pages, lexical, pieces, plain
from tidegraph.plans.runtime import cut_lineage

MAX_LABELS = 20_000
MAX_SAMPLE = 10_000


def lexicon(labelled: DataFrame, least: int = 4, share: float = 0.0005) -> dict[bytes, float]:
    """Log odds of words between spam and other labelled pages (``text``, ``spam``), for words on at least ``least`` pages and ``share`` of all.

    The labelled pages are a bounded sample, so the words on some share of them are too.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    sums = labelled.groupBy().agg(F.count_if("spam").alias("s"), F.count_if(~F.col("spam")).alias("p")).first()
    counts = labelled.select("spam", F.explode(words).alias("word")).groupBy("word").agg(F.count_if("spam").alias("s"), F.count_if(~F.col("spam")).alias("p"))
    rows = counts.where(F.col("s") + F.col("p") >= max(least, share * (sums["s"] + sums["p"]))).collect()
    return {r["word"].encode(): float(np.clip(np.log((r["s"] + 0.5) / (sums["s"] + 1)) - np.log((r["p"] + 0.5) / (sums["p"] + 1)), -2, 3)) for r in rows}


def featured(pages: DataFrame, keep: list[str], odds: dict[bytes, float], which: tuple[str, ...] = FEATURES) -> DataFrame:
    """``keep`` and the features ``which`` (all, ``LEXICAL`` or ``PLAIN``) of every page that has words."""
    shared = pages.sparkSession.sparkContext.broadcast(odds)  # words of the bounded sample
    rows = pages.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, size in pieces(batch.column(len(keep))):
                part = batch.slice(begin, size)
                p = Pages(part.column(len(keep)))
                parts = [*([lexical(p, shared.value)] if which != PLAIN else []), *([plain(p)] if which != LEXICAL else [])]
                some = pa.array(np.flatnonzero(p.count))
                columns = [part.column(k).take(some) for k in range(len(keep))]
                values = np.concatenate(parts, axis=1)[np.asarray(some)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(v)) for v in values.T)], [*keep, *which])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, " + ", ".join(f"{c} double" for c in which))


def _forest(train: DataFrame, trees: int, depth: int, least: int | None = None):
    """Bagged trees with ``least`` pages in a leaf; by default a tenth of the spam pages, so single wrong labels can't be learned by heart. None if a label is missing."""
    n = train.groupBy().agg(F.count_if("spam").alias("s"), F.count_if(~F.col("spam")).alias("p")).first()
    if not n["s"] or not n["p"]:
        return None
    rows = _gather().transform(train).select(F.col("spam").cast("double").alias("label"), "features")
    least = least or max(1, min(50, n["s"] // 10))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=7, featureSubsetStrategy="sqrt").fit(rows)


def _gather() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def _chance(model, rows: DataFrame) -> DataFrame:
    return model.transform(_gather().transform(rows)).withColumn("score", vector_to_array("probability")[1])


def spam_scores(pages: DataFrame, labels: DataFrame, host: str = "source", trees: int = 40, depth: int = 6, weight: float = 0.1) -> DataFrame | None:
    """``doc_id, host, score, smoothed``: the trees' probability of spam of every page with words, and the mean of it and its host's rate, weighted by ``weight``.

    The given labels are few and partly wrong, so trees are trained twice: the first judge the labelled pages and a sample of at most about
    ``MAX_SAMPLE`` others; pages they are sure of are the weak labels, from which the lexicon and the trees in use are learned. None if the labels are not of both
    kinds. A null host is a host.
    """
    told = labels.where(F.col("label").isin("spam", "page")).select("doc_id", (F.col("label") == "spam").alias("spam")).distinct()
    told = told.orderBy(F.xxhash64("doc_id", "spam")).limit(MAX_LABELS)
    every = max(1, -(-pages.count() // MAX_SAMPLE))
    texts = pages.select("doc_id", "text").where(F.col("text").isNotNull())
    # the bounded sample is written once with a number a row, as ids and texts may be repeated; features and labels go by that number
    known = texts.join(F.broadcast(told), "doc_id", "left").where(F.col("spam").isNotNull() | (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
    known = cut_lineage(known.select(F.monotonically_increasing_id().alias("row"), "spam", "text"))
    first = cut_lineage(featured(known, ["row", "spam"], lexicon(known.where(F.col("spam").isNotNull()))))
    model = _forest(first.where(F.col("spam").isNotNull()), trees, depth)
    if model is None:
        return None
    # a given label stays unless the trees are all but certain of the other one; other pages get a label if the trees are sure
    score, given = F.col("score"), F.col("spam")
    stays = F.when(given & (score >= 0.1), True).when(~given & (score <= 0.9), False)
    weak = _chance(model, first).select("row", F.when(given.isNotNull(), stays).when(score >= 0.8, True).when(score <= 0.1, False).alias("spam"), *PLAIN)
    weak = cut_lineage(weak.where(F.col("spam").isNotNull()))
    sure = known.select("row", "text").join(F.broadcast(weak.select("row", "spam")), "row")  # of the bounded sample
    odds = lexicon(sure)
    anew = featured(sure, ["row"], odds, LEXICAL).join(weak, "row")
    model = _forest(cut_lineage(anew.select("spam", *FEATURES)), trees, depth + 2, 2)
    if model is None:
        return None
    rows = featured(pages.select("doc_id", F.col(host).alias("host"), "text").where(F.col("text").isNotNull()), ["doc_id", "host"], odds)
    scored = cut_lineage(_chance(model, rows).select("doc_id", "host", "score"))
    rates = scored.groupBy("host").agg(F.avg("score").alias("rate")).withColumnRenamed("host", "_host")
    # the rates are an aggregate by host; Spark broadcasts them only if small, else joins by key
    return scored.join(rates, F.col("host").eqNullSafe(F.col("_host"))).select("doc_id", "host", "score", ((1 - weight) * F.col("score") + weight * F.col("rate")).alias("smoothed"))


def valley(scores: DataFrame, low: int = 25, high: int = 75, width: int = 10) -> float:
    """The threshold: the middle of the emptiest stretch of ``width`` hundredths of the scores between two bounds, of several the one nearest to a half.

    Spark counts the scores in hundredths; only these counts come back.
    """
    counts = {r["bin"]: r["n"] for r in scores.groupBy(F.floor(F.col("smoothed") * 100).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()}
    half = width // 2
    weight = {c: sum(counts.get(k, 0) for k in range(c - half, c + half)) for c in range(low, high + 1)}
    best = [c for c in weight if weight[c] == min(weight.values())]
    # the middle of the run of equally empty places that comes nearest to a half
    nearest = min(best, key=lambda c: (abs(c - 50), c))
    run = [c for c in best if all(k in best for k in range(min(c, nearest), max(c, nearest) + 1))]
    return sum(run) / len(run) / 100


def spam_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of the pages whose smoothed score reaches the ``valley`` between the two kinds."""
    scores = spam_scores(pages, labels)
    if scores is None:
        return pages.select("doc_id").limit(0)
    return scores.where(F.col("smoothed") >= valley(scores)).select("doc_id")
