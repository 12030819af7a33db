"""Filling fixed-capacity containers with items (problem 6).

Best-fit decreasing with a segment tree over remaining capacities: the items of a group, largest first, each go to the open container with the
least room that still holds them, found in logarithmic time. Groups are bounded in items and in volume and are cut by a hash, so
packing is spread over the cluster; containers that stay at most half full in their group are packed again, as items, in fewer groups.
Only an item larger than a container is cut: into full containers and a rest that is packed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.runtime import cut_lineage


class RoomTree:
    """The open containers by their room; a segment tree tells the least room not below a size."""

    def __init__(self, capacity: int):
        self.width = 1 << max(1, int(capacity).bit_length())
        self.some = bytearray(2 * self.width)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, container: int) -> None:
        held = self.open.setdefault(room, [])
        held.append(container)
        k = room + self.width
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and container of the tightest fit, taken out; None if no container has the room."""
        k = size + self.width
        if not self.some[k]:
            while k > 1 and (k & 1 or not self.some[k ^ 1]):
                k >>= 1
            if k <= 1:
                return None
            k ^= 1
            while k < self.width:
                k = 2 * k + (not self.some[2 * k])
        room = k - self.width
        held = self.open[room]
        container = held.pop()
        if not held:
            self.some[k] = 0
            k >>= 1
            while k and not (self.some[2 * k] or self.some[2 * k + 1]):
                self.some[k] = 0
                k >>= 1
        return room, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item; sizes are from 0 to ``capacity``."""
    order = np.argsort(-np.asarray(sizes), kind="stable")
    out = np.zeros(len(order), np.int64)
    tree, used = RoomTree(capacity), 0
    for at, size in zip(order.tolist(), np.asarray(sizes)[order].tolist(), strict=True):
        fit = tree.take(size)
        if fit is None:
            fit, used = (capacity, used), used + 1
        room, container = fit
        tree.put(room - size, container)
        out[at] = container
    return out


def _packed(items: DataFrame, group_items: int, group_fill: int) -> DataFrame:
    """``items`` (pack, capacity, key columns in ``item``, size, h) with a container number within its hash group: adds grp, container.

    Groups hold about ``group_items`` items or ``group_fill`` containers' volume, whichever is less. The number of groups of each pack comes from totals
    summed by Spark.
    """
    totals = items.groupBy("pack").agg(F.count("*").alias("n"), F.sum(F.col("size") / F.col("capacity")).alias("fill"))
    groups = totals.select(F.col("pack").alias("_pack"), F.greatest(F.ceil(F.col("n") / group_items), F.ceil(F.col("fill") / group_fill), F.lit(1)).alias("groups"))
    placed = items.join(F.broadcast(groups), F.col("pack") == F.col("_pack")).drop("_pack")  # one row a pack; packs are bounded
    placed = placed.withColumn("grp", F.pmod("h", "groups")).drop("groups", "h")
    schema = placed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        due = group_items
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= due:
                whole, held = _split_last(held)
                yield from _pack_table(whole)
                due = max(group_items, 2 * sum(b.num_rows for b in held))
        if held:
            yield from _pack_table(pa.Table.from_batches(held))

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", container bigint"
    return placed.repartition("pack", "grp").sortWithinPartitions("pack", "grp").mapInArrow(run, spec)


def _boundaries(table: pa.Table) -> np.ndarray:
    """Where the pack or group of the rows changes, and the number of rows."""
    pack = np.asarray(table.column("pack").combine_chunks().dictionary_encode().indices)
    grp = np.asarray(table.column("grp").combine_chunks())
    change = np.flatnonzero((pack[1:] != pack[:-1]) | (grp[1:] != grp[:-1])) + 1
    return np.concatenate([[0], change, [table.num_rows]])


def _split_last(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[pa.RecordBatch]]:
    table = pa.Table.from_batches(held)
    last = int(_boundaries(table)[-2])
    return table.slice(0, last), table.slice(last).combine_chunks().to_batches()


def _pack_table(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    cuts = _boundaries(table)
    size, capacity = (np.asarray(table.column(c).combine_chunks()) for c in ("size", "capacity"))
    out = np.concatenate([best_fit_decreasing(size[a:b], int(capacity[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    yield from table.append_column("container", pa.array(out)).combine_chunks().to_batches()


def pack_items(sizes: DataFrame, packs: list[tuple[str, int]], item: str = "doc_id", size: str = "n_tokens", group_items: int = 20_000, group_fill: int = 4096) -> DataFrame:
    """``pack_name, container, item, copy, piece, start, size``: every item in containers of each capacity.

    ``packs``: names and capacities above 0 (a short list). ``copy`` numbers repeated (item, size) rows from 1, ``piece`` the parts of a cut item from 1,
    ``start`` is the place in the item where the part starts. An item of size 0 lies in a container all the same; a null size counts as 0, a null item is
    an item. Containers are named by text; those of cut items are theirs alone.
    """
    if any(c <= 0 for _, c in packs):
        raise ValueError("capacities have to be above 0")
    rows = sizes.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("total"))
    rows = rows.groupBy("item", "total").agg(F.count("*").alias("copies")).select("item", "total", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    choice = F.array(*(F.struct(F.lit(n).alias("pack"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in packs))
    rows = rows.select("item", "total", "copy", F.inline(choice))
    full = F.floor(F.col("total") / F.col("capacity")).cast("long")
    whole = F.when(F.col("total") <= F.col("capacity"), F.lit(0)).otherwise(full)  # an item that fills a container exactly is packed, not cut
    rows = rows.withColumn("whole", whole).withColumn("rest", F.col("total") - F.col("whole") * F.col("capacity"))
    name = lambda *c: F.concat_ws("-", *c)
    cut = rows.where("whole > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))).alias("piece"))
    cut = cut.select(
        F.col("pack").alias("pack_name"), name(F.lit("full"), F.coalesce(F.col("item").cast("string"), F.lit("null")), "total", "copy", "piece").alias("container"),
        "item", "copy", "piece", ((F.col("piece") - 1) * F.col("capacity")).alias("start"), F.col("capacity").alias("size"),
    )
    loose = rows.where("rest > 0 or whole = 0").select(
        "pack", "capacity", F.struct("item", "copy", (F.col("whole") + 1).alias("piece"), (F.col("whole") * F.col("capacity")).alias("start")).alias("what"), F.col("rest").alias("size"),
        F.xxhash64("item", "total", "copy").alias("h"),
    )
    first = cut_lineage(_packed(loose, group_items, group_fill).withColumn("first", name("pack", F.col("grp"), F.col("container"))).drop("grp", "container"))
    # containers at most half full, about one a group, are items of a second round
    fills = first.groupBy("pack", "capacity", "first").agg(F.sum("size").alias("size")).where(F.col("size") * 2 <= F.col("capacity"))
    again = _packed(fills.select("pack", "capacity", "first", "size", F.xxhash64("first").alias("h")), group_items, group_items)
    moved = again.select(F.col("first").alias("_first"), name(F.lit("joint"), F.col("pack"), F.col("grp"), F.col("container")).alias("second"))
    placed = first.join(moved, F.col("first") == F.col("_first"), "left").select(
        F.col("pack").alias("pack_name"), F.coalesce("second", "first").alias("container"), "what.item", "what.copy", "what.piece", "what.start", "size"
    )
    return placed.unionByName(cut).withColumnRenamed("item", item)


def pack_report(placed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """``pack_name, containers, tokens, unused_share``: how full the containers of each pack are."""
    capacity = F.element_at(F.create_map(*(F.lit(x) for n, c in packs for x in (n, int(c)))), F.col("pack_name"))
    fills = placed.groupBy("pack_name", "container").agg(F.sum("size").alias("size"))
    sums = fills.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"))
    return sums.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * capacity))


def pack_faults(placed: DataFrame, sizes: DataFrame, packs: list[tuple[str, int]], item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``pack_name, items, over_full, cut_needlessly, incomplete``: items placed, containers above their capacity, items cut though they fit into one, and items whose parts don't sum up to them."""
    capacity = F.element_at(F.create_map(*(F.lit(x) for n, c in packs for x in (n, int(c)))), F.col("pack_name"))
    over = placed.groupBy("pack_name", "container").agg(F.sum("size").alias("s")).groupBy("pack_name").agg(F.count_if(F.col("s") > capacity).alias("over_full"))
    parts = placed.groupBy("pack_name", F.col(item).alias("item")).agg(F.sum("size").alias("s"), F.count("*").alias("pieces"))
    told = sizes.groupBy(F.col(item).alias("_item")).agg(F.sum(F.coalesce(size, F.lit(0))).alias("total"), F.max(size).alias("largest"), F.count("*").alias("n"))
    both = parts.join(told, F.col("item").eqNullSafe(F.col("_item")), "left")
    sums = both.groupBy("pack_name").agg(
        F.sum("n").alias("items"), F.count_if((F.col("largest") <= capacity) & (F.col("pieces") > F.col("n"))).alias("cut_needlessly"), F.count_if(~F.col("s").eqNullSafe(F.col("total"))).alias("incomplete")
    )
    return sums.join(over, "pack_name").select("pack_name", "items", "over_full", "cut_needlessly", "incomplete")
