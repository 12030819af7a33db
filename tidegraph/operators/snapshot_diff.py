"""What changed between full snapshots (problem 4).

Keys are mapped to persistent ordinals, written once and read again; each snapshot becomes a compressed bitmap over them (64-bit words, only words
with a set bit are stored), and each word carries vectors aligned with its set bits: the keys and the hashes of their payloads. ``cur & ~prev``
gives the additions, ``prev & ~cur`` the removals, and for the common bits the payload vectors are compared by ordinal.

The members of a group are spread over hash stripes of its keys, so many that a stripe holds about ``STRIPE_ROWS`` members; members and ordinals are brought
together by (group, stripe) once, and ordinals, words and the comparison with the word before follow in that one stage. A group has at most
one snapshot a date, so stripes of keys split any group, however hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.versions import snapshot_lists, snapshot_members
from tidegraph.plans.runtime import cut_lineage

WORD = 64
STRIPE_ROWS = 200_000


def _stripe(key: str, stripes: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), (stripes if isinstance(stripes, Column) else F.lit(stripes)).cast("long"))


def assign_ordinals(keys: DataFrame, group: str, key: str, known: DataFrame | None = None, stripes: Column | int = 16) -> DataFrame:
    """``group, key, ordinal``: a distinct number from 0 for each distinct key of a group, without holes.

    ``known``, an earlier result, is kept as it is and new keys come after it, so numbers last over runs. The keys of a group are numbered in
    ``stripes`` hash stripes (a column of ``keys``, the same for all rows of a group), each beginning where those before it end, so no task sorts a whole group. A null key is a key.
    """
    wanted = keys.groupBy(group, key).agg(F.max(_stripe(key, stripes)).alias("_stripe"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    if known is not None:
        wanted = wanted.join(known, same(wanted, known, group, key), "left_anti")
    numbered = wanted.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_stripe").orderBy(key)) - 1)
    sizes = numbered.groupBy(group, "_stripe").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(group).orderBy("_stripe")) - F.col("_n")).alias("_before")
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_stripe").alias("_s"), before)
    placed = numbered.join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_stripe") == F.col("_s")))
    ordinal = F.col("_place") + F.col("_before")
    if known is None:
        return placed.select(group, key, ordinal.cast("long").alias("ordinal"))
    taken = known.groupBy(F.col(group).alias("_t")).agg((F.max("ordinal") + 1).alias("_taken"))
    fresh = placed.join(taken, F.col(group).eqNullSafe(F.col("_t")), "left").select(group, key, (ordinal + F.coalesce("_taken", F.lit(0))).cast("long").alias("ordinal"))
    return known.select(group, key, "ordinal").unionByName(fresh)


def snapshot_changes(members: DataFrame, group: str, key: str, payload: str, ordinals: DataFrame, stripes: Column | int = 1) -> DataFrame:
    """``group, period_end, key, change_kind`` between successive snapshots.

    ``members``: distinct ``group, n, effective_date, next_date, key, payload``; ``n`` numbers the snapshots of a group from 1, ``next_date`` is that of the next one. A key with
    several payloads in a snapshot has the set of them. The first snapshot gives no rows. ``stripes`` is the same for all rows of a group.
    """
    spread = ordinals.join(
        members.groupBy(F.col(group).alias("_g")).agg(F.max(stripes if isinstance(stripes, Column) else F.lit(stripes)).alias("_stripes")), F.col(group).eqNullSafe(F.col("_g"))
    ).select(F.col(group).alias("g"), _stripe(key, F.col("_stripes")).alias("stripe"), F.col(key).alias("k"), "ordinal")
    told = members.select(
        F.col(group).alias("g"), _stripe(key, stripes).alias("stripe"), F.col(key).alias("k"), (F.col("n") == 1).alias("first"), "effective_date", "next_date", F.nullif(F.col(payload), F.col(key)).alias("payload"),
        F.col(payload).eqNullSafe(F.col(key)).alias("own"),
    )
    met = told.unionByName(spread, allowMissingColumns=True).repartition("g", "stripe")
    # the row of the ordinals lends its number to all rows of its key
    coded = met.withColumn("ordinal", F.max("ordinal").over(Window.partitionBy("g", "stripe", "k"))).where(F.col("effective_date").isNotNull())
    snap = ["g", "stripe", "effective_date", "next_date", "first"]
    cells = coded.groupBy(*snap, "ordinal", "k").agg(F.bit_xor(F.xxhash64("payload", "own")).alias("h"))
    bit = (F.col("ordinal") % WORD).cast("int")
    aligned = F.array_sort(F.collect_list(F.struct(bit.alias("bit"), "k", "h")))
    words = cells.groupBy(*snap, F.floor(F.col("ordinal") / WORD).alias("chunk")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("word"), aligned.alias("vector"))
    w = Window.partitionBy("g", "stripe", "chunk").orderBy("effective_date")
    # the word before is that of the snapshot before, or none if that snapshot has no bit in this word
    follows = F.lag("next_date").over(w) == F.col("effective_date")
    lined = words.select(
        "*", F.coalesce(F.when(follows, F.lag("word").over(w)), F.lit(0).cast("long")).alias("prev"), F.when(follows, F.lag("vector").over(w)).alias("prev_vector"),
        F.coalesce(F.lead("effective_date").over(w) == F.col("next_date"), F.lit(False)).alias("goes_on"),
    )
    cur, prev = F.col("word"), F.col("prev")
    added, removed, common = cur.bitwiseAND(F.bitwise_not(prev)), prev.bitwiseAND(F.bitwise_not(cur)), cur.bitwiseAND(prev)
    on = lambda vector, mask: F.filter(vector, lambda e: F.call_function("bit_get", mask, e["bit"]) == 1)
    # both filtered vectors hold the common bits in their order, so equal places are equal ordinals
    both = F.zip_with(on(F.col("vector"), common), on(F.col("prev_vector"), common), lambda a, b: F.struct(a["bit"].alias("bit"), a["k"].alias("k"), (~a["h"].eqNullSafe(b["h"])).alias("differs")))
    changed = F.filter(both, lambda e: e["differs"])
    now = F.when(~F.col("first"), F.concat(_tagged(on(F.col("vector"), added), "effective_date", "added"), _tagged(on(F.col("prev_vector"), removed), "effective_date", "removed"), _tagged(changed, "effective_date", "changed")))
    gone = F.when(F.col("next_date").isNotNull() & ~F.col("goes_on"), _tagged(F.col("vector"), "next_date", "removed"))
    found = lined.select("g", F.inline(F.concat(F.coalesce(now, F.array()), F.coalesce(gone, F.array()))))
    return found.select(F.col("g").alias(group), "period_end", F.col("k").alias(key), "change_kind")


def _tagged(entries: Column, end: str, kind: str) -> Column:
    return F.transform(F.coalesce(entries, F.array()), lambda e: F.struct(F.col(end).alias("period_end"), e["k"].alias("k"), F.lit(kind).alias("change_kind")))


def _issuers(members: DataFrame, aliases: DataFrame) -> DataFrame:
    known = aliases.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.min("issuer_id").alias("issuer_id"))
    return members.join(known, "ticker", "left").withColumn("issuer_id", F.coalesce("issuer_id", "ticker"))


def issuer_members(history: DataFrame, aliases: DataFrame) -> DataFrame:
    """Snapshot members with their issuer; a ticker not listed is its own issuer. A ticker listed twice takes the smaller issuer."""
    return _issuers(snapshot_members(history), aliases)


def issuer_changes(history: DataFrame, aliases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``index_code, period_end, issuer_id, change_kind`` for successive snapshots of each index.

    The ordinals of ``known``, of an earlier run, are kept. Lists are split once and written, then read for the ordinals and for the words.
    """
    values = F.sum(F.size("tickers")).over(Window.partitionBy("index_code"))
    lists = cut_lineage(snapshot_lists(history).withColumn("stripes", F.ceil(values / STRIPE_ROWS)))
    members = _issuers(lists.select("index_code", "n", "effective_date", "next_date", "stripes", F.explode("tickers").alias("ticker")), aliases)
    ordinals = cut_lineage(assign_ordinals(members, "index_code", "issuer_id", known, F.col("stripes")))
    return snapshot_changes(members, "index_code", "issuer_id", "ticker", ordinals, F.col("stripes"))
