"""Mixing sources to target weights (problem 7).

Every source is a stream of blocks. Pfair scheduling gives block k of a source with weight w the release time floor((k-1)/w) and the deadline
ceil(k/w), in blocks of the mixture; earliest deadline first among the released then interleaves the sources with less than one block of deviation from their
shares at any point, however long the mixture. Weights are exact fractions of the given decimals (of parts of 2^-44 if their denominator is larger).

The order is worked out in segments of slots, each on its own: how many blocks of each source lie before a segment follows from the weights alone, as a block's
slot depends on blocks of higher priority only. Records find their block by a prefix sum over hash buckets and their slot by a join on (source, block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.runtime import cut_lineage

_PARTS = 1 << 44


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def whole_weights(shares: list[float]) -> list[int]:
    """Whole numbers in the proportion of the shares as written in decimals; their sum is the period. Beyond 2^44 they are rounded to that sum by largest remainders, at least 1 each."""
    exact = [Fraction(str(s)) for s in shares]
    exact = [s / sum(exact) for s in exact]
    period = math.lcm(*(w.denominator for w in exact))
    if period <= _PARTS:
        return [int(w * period) for w in exact]
    parts = [max(1, math.floor(w * _PARTS)) for w in exact]
    for k in sorted(range(len(parts)), key=lambda k: (parts[k] - exact[k] * _PARTS, k))[: max(0, _PARTS - sum(parts))]:
        parts[k] += 1
    parts[parts.index(max(parts))] += _PARTS - sum(parts)
    return parts


def blocks_before(t: int, weights: list[int]) -> list[int]:
    """How many blocks of each source earliest deadline first puts into the slots before ``t``.

    All blocks with deadlines up to t are among them. Of the blocks whose window crosses t those take part, by priority, that find a slot from their release on: for every
    time up to the release the blocks released from then on must fit into the slots left.
    """
    q = sum(weights)
    done = [p * t // q for p in weights]
    crossing = sorted((-(-(done[s] + 1) * q // p), s) for s, p in enumerate(weights) if p * t % q)
    if not crossing:
        return done
    release = {s: done[s] * q // weights[s] for _, s in crossing}
    low = min(release.values())
    step = np.arange(t - low, dtype=np.int64 if q * (t - low) < 1 << 62 else object)
    room = t - low - step
    for n, p in zip(list(done), weights, strict=True):
        whole, rest = divmod(p * low, q)
        room = room - np.maximum(0, n - (whole + (rest + p * step + q - 1) // q))
    left = t - sum(done)
    for _, s in crossing:
        until = release[s] - low + 1
        if left and (room[:until] >= 1).all():
            room[:until] -= 1
            done[s] += 1
            left -= 1
    return done


def pfair_slots(begin: int, end: int, weights: list[int]) -> tuple[list[int], list[int]]:
    """The source and the block (from 0) in each slot from ``begin`` to before ``end``: earliest deadline first among the released blocks."""
    q, sources = sum(weights), range(len(weights))
    done = blocks_before(begin, weights)
    release = [n * q // p for n, p in zip(done, weights, strict=True)]
    deadline = [-(-(n + 1) * q // p) for n, p in zip(done, weights, strict=True)]
    chosen, blocks = [], []
    for t in range(begin, end):
        s = min((s for s in sources if release[s] <= t), key=deadline.__getitem__)
        chosen.append(s)
        blocks.append(done[s])
        done[s] += 1
        release[s] = done[s] * q // weights[s]
        deadline[s] = -(-(done[s] + 1) * q // weights[s])
    return chosen, blocks


def block_slots(spark, sources: list[str], weights: list[int], slots: int, segment: int = 16_384) -> DataFrame:
    """``_source, _block, slot`` of the first ``slots`` slots, worked out in segments that don't wait for each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in batch["id"]:
                begin = int(n) * segment
                chosen, blocks = pfair_slots(begin, min(begin + segment, slots), weights)
                yield pd.DataFrame({"_source": [sources[s] for s in chosen], "_block": blocks, "slot": range(begin, begin + len(chosen))})

    return spark.range(-(-slots // segment)).mapInPandas(run, "_source string, _block bigint, slot bigint")


def source_offsets(sizes: DataFrame, bucket_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """``sizes`` (source, doc_id, n_tokens) with ``start``, the tokens before a record in its source, in an order by hash.

    A source is summed in hash buckets of about ``bucket_rows`` records, however large it is; only the buckets' sums are scanned in order.
    """
    n = sizes.count()
    buckets = max(1, -(-n // bucket_rows))
    h = F.xxhash64(F.lit(seed), "doc_id", "n_tokens")
    rows = sizes.withColumn("h", h).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy("source").orderBy("bucket")
    before = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.sum("t").over(w) - F.col("t")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("inner", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return summed.join(before, (F.col("source") == F.col("_s")) & (F.col("bucket") == F.col("_b"))).select("source", "doc_id", "n_tokens", (F.col("base") + F.col("inner")).alias("start"))


def mix(sizes: DataFrame, targets: list[Target], block: int = 8192, segment: int = 16_384) -> DataFrame:
    """``slot, source, doc_id, repeat_no, offset, n_tokens``: the mixture, to be read by slot, then offset.

    It is as long as the caps allow with every share met: the least of max_repeats * tokens / share over the sources. Sources without a target
    (a null source among them) are left out; a target without tokens, without share or without repeats is left out and the others' shares are scaled up. A record is taken whole if it
    starts before its source's quota, so a share is met to within one record; repeated rows are records of their own. No targets, or no
    records, give no rows.
    """
    wanted = {t.source: t for t in targets if t.source is not None and t.share is not None and t.max_repeats is not None and t.share > 0 and t.max_repeats > 0}
    known = sizes.where(F.col("source").isin(list(wanted))).select("source", "doc_id", "n_tokens")
    totals = {r["source"]: r["t"] for r in known.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row a target
    used = [t for s, t in wanted.items() if totals.get(s)]
    weights = whole_weights([t.share for t in used]) if used else []
    parts = sum(weights)
    length = min((Fraction(t.max_repeats * totals[t.source] * parts, w) for t, w in zip(used, weights, strict=True)), default=Fraction(0))
    quotas = [length * w / parts for w in weights]
    spark = known.sparkSession
    plan = spark.createDataFrame(
        [(t.source, int(totals[t.source]), math.ceil(quota), t.max_repeats) for t, quota in zip(used, quotas, strict=True)], "_source string, total long, quota long, most int"
    )
    placed = source_offsets(known).join(F.broadcast(plan), F.col("source") == F.col("_source")).drop("_source")  # one row a target
    rounds = F.sequence(F.lit(0), F.col("most") - 1)
    copies = placed.select("*", F.explode(rounds).alias("round")).withColumn("offset", F.col("round") * F.col("total") + F.col("start")).where(F.col("offset") < F.col("quota"))
    slots = max((-(-math.ceil(quota / block) * parts // w) for quota, w in zip(quotas, weights, strict=True)), default=0)
    order = block_slots(spark, [t.source for t in used], weights, slots, segment)
    met = copies.join(order, (F.col("source") == F.col("_source")) & (F.floor(F.col("offset") / block) == F.col("_block")))
    return met.select("slot", "source", "doc_id", (F.col("round") + 1).alias("repeat_no"), "offset", "n_tokens")


def mix_report(mixture: DataFrame, targets: list[Target]) -> DataFrame:
    """``source, target_share, actual_share, tokens, records, most_repeats`` of every target, 0 where it gave nothing."""
    told = mixture.sparkSession.createDataFrame([(t.source, float(t.share)) for t in targets], "_source string, target_share double")
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), F.max("repeat_no").alias("most_repeats"))
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # one row a target
    joined = told.join(got, F.col("source") == F.col("_source"), "left")
    return joined.select(
        F.col("_source").alias("source"), "target_share", F.coalesce(F.coalesce("tokens", F.lit(0)) / F.nullif(all_tokens, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "records", "most_repeats")),
    )


def mix_faults(mixture: DataFrame, targets: list[Target]) -> DataFrame:
    """``source, used_too_often, share_missed``: records used more often than their source's ``max_repeats``, and whether a source is further from its share of the whole than the largest records explain.

    Records are told apart by doc_id, so these have to be unique. Shares are those among the sources that gave anything; others have nothing to miss.
    """
    told = mixture.sparkSession.createDataFrame([(t.source, float(t.share), int(t.max_repeats)) for t in targets], "_source string, share double, most int")
    times = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("largest"))
    used = times.join(F.broadcast(told), F.col("source") == F.col("_source"))  # a row a target
    got = used.groupBy("source").agg(F.sum("t").alias("tokens"), F.max("largest").alias("largest"), F.count_if(F.col("times") > F.col("most")).alias("used_too_often"))
    every = Window.partitionBy()  # one row a target
    rows = told.join(got, F.col("source") == F.col("_source"), "left")
    due = F.col("share") / F.sum(F.when(F.col("tokens").isNotNull(), F.col("share"))).over(every) * F.sum("tokens").over(every)
    slack = F.sum("largest").over(every)
    return rows.select(F.col("_source").alias("source"), F.coalesce("used_too_often", F.lit(0).cast("long")).alias("used_too_often"), F.coalesce(F.abs(F.col("tokens") - due) > slack, F.lit(False)).alias("share_missed"))


def kept(mixture: DataFrame) -> DataFrame:
    """The mixture written to the checkpoint folder, to be read more than once."""
    return cut_lineage(mixture)
