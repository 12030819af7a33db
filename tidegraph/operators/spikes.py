"""Implausible spikes in measurements (problem 2).

Per source a robust exponentially weighted control chart: level and scale follow the readings, but a suspected reading is clipped
before it updates either, so a spike can't drag the chart along; a run of suspects longer than a few is a lasting
change, on which the chart starts anew. Run-length counters find standstills, physical limits the impossible.

Readings are put into the order of (series, time) by range partitions of equal numbers of rows, so no task holds a whole series however hot or bursty, and a
series may go on from one partition to the next. A task reads its partition in chunks and cuts the series in it into slices of ``slice_rows`` readings, each
with ``border_rows`` more on either side to settle the chart and to show the level beyond; the charts of many slices advance side by side in numpy. It gives few
rows: candidates, and histograms of moves and run lengths from which the usual move and the usual standstill of each series are summed
up. A candidate is then checked against them. Where a series goes on in the next partition, the readings on either side of the border are
brought together and charted once more, and the stretches of equal values at the edges of chunks are joined over all chunks by a scan over the edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.notes import suspensions
from tidegraph.plans.runtime import cut_lineage

SPIKE, STILL, MOVES, RUNS, EDGE, OPEN, BORDER = 1, 2, 3, 4, 5, 6, 7
_OUT = "kind int, run_id bigint, ticker string, slice bigint, reading_id bigint, at bigint, value double, n bigint"
_CHUNKS = 1 << 24  #: slice = partition * _CHUNKS + chunk


@dataclass(frozen=True)
class Chart:
    """Parameters of the control chart; scales are in usual moves (median absolute move / 0.6745)."""

    limit: float = 5.0  #: beyond so many scales from the level a reading is suspected
    clip: float = 2.0  #: a suspected reading counts as so many scales from the level
    level_weight: float = 0.6  #: weight of a new reading in the level
    scale_weight: float = 0.02  #: weight of a new move in the scale
    most: int = 5  #: at most so many readings in succession are a spike; more are a lasting change
    beside: int = 5  #: readings on either side that make the level before and after
    spike: float = 5.5  #: a spike lies so many of its series' usual moves off both levels
    still: int = 8  #: a standstill has at least so many readings
    still_factor: float = 1.25  #: and is so many times as long as the series' usual ones
    rare: float = 0.005  #: runs longer than the usual one are at most this share of all runs
    rare_least: int = 3  #: or this many
    slice_rows: int = 1024  #: readings of a slice
    border_rows: int = 128  #: and of its border on either side: some weights' memory, and more than a spike and the level beyond it
    chunk_rows: int = 150_000  #: readings a task charts at once
    least_rows: int = 65_536  #: readings of a range partition at least, as far as
    most_rows: int = 1_000_000  #: it has no more than so many


def control_charts(x: np.ndarray, starts: np.ndarray, p: Chart = Chart()) -> tuple[np.ndarray, np.ndarray]:
    """Suspected readings, and readings at which the chart started anew, for series laid end to end in ``x`` from ``starts`` on.

    All series advance side by side, one reading a step.
    """
    sizes = np.diff(np.append(starts, len(x)))
    order = np.argsort(-sizes, kind="stable")
    base, length = starts[order], sizes[order]
    moves = np.abs(np.diff(x, prepend=np.nan))
    moves[starts] = 0
    lanes = np.repeat(np.arange(len(starts)), sizes)
    scale = _medians(moves, lanes, moves > 0, len(starts))[order] / 0.6745
    scale = np.maximum(np.nan_to_num(scale), 1e-9)
    head = np.arange(len(x)) - starts[lanes] < 7
    level = _medians(x, lanes, head, len(starts))[order]
    count = np.zeros(len(order), int)
    suspect, anew = np.zeros(len(x), bool), np.zeros(len(x), bool)
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(length) else []
    for t, k in enumerate(live):
        at = base[:k] + t
        v, m, s = x[at], level[:k], scale[:k]
        off = v - m
        out = np.abs(off) > p.limit * s
        c = np.where(out, count[:k] + 1, 0)
        new = c > p.most
        suspect[at], anew[at] = out, new
        bound = p.clip * s
        level[:k] = np.where(new, v, m + p.level_weight * np.where(out, np.clip(off, -bound, bound), off))
        count[:k] = np.where(new, 0, c)
        move = np.minimum(moves[at], 3 * s)
        scale[:k] = np.where(move > 0, s + p.scale_weight * (1.33 * move - s), s)
    return suspect, anew


def _medians(v: np.ndarray, lane: np.ndarray, mask: np.ndarray, lanes: int) -> np.ndarray:
    """Median of the masked values of each lane, NaN if none; lanes are in ascending order."""
    v, lane = v[mask], lane[mask]
    order = np.lexsort((v, lane))
    v = v[order]
    n = np.bincount(lane, minlength=lanes)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    if not len(v):
        return np.full(lanes, np.nan)
    lo, hi = first + (n - 1) // 2, first + n // 2
    got = (v[np.clip(lo, 0, len(v) - 1)] + v[np.clip(hi, 0, len(v) - 1)]) / 2
    return np.where(n > 0, got, np.nan)


def spike_candidates(x: np.ndarray, starts: np.ndarray, p: Chart = Chart()) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (in log units) of suspected readings that lie off the level before and after them on the same side.

    The levels are medians of up to ``beside`` readings that aren't suspected, out of the nearest twice as many.
    """
    suspect, anew = control_charts(x, starts, p)
    n = len(x)
    lane = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    first = suspect & ~(np.concatenate([[False], suspect[:-1]]) & (np.concatenate([[-1], lane[:-1]]) == lane))
    last = suspect & ~(np.concatenate([suspect[1:], [False]]) & (np.concatenate([lane[1:], [-1]]) == lane))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    fine = (b - a < p.most) & ~anew[b]
    a, b = a[fine], b[fine]
    if not len(a):
        return np.zeros(0, int), np.zeros(0)
    ends = np.append(starts[1:], n)

    def beside(at: np.ndarray, step: int) -> np.ndarray:
        cols = at[:, None] + step * np.arange(1, 2 * p.beside + 1)
        ok = (cols >= starts[lane[at]][:, None]) & (cols < ends[lane[at]][:, None])
        cols = np.clip(cols, 0, n - 1)
        ok &= ~suspect[cols]
        ok &= np.cumsum(ok, axis=1) <= p.beside
        v = np.where(ok, x[cols], np.nan)
        level = np.full(len(at), np.nan)
        some = ok.any(axis=1)
        level[some] = np.nanmedian(v[some], axis=1)
        return level

    before, after = beside(a, -1), beside(b, 1)
    each = np.repeat(np.arange(len(a)), b - a + 1)
    at = np.arange(len(each)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + a[each]
    d1, d2 = x[at] - before[each], x[at] - after[each]
    with np.errstate(invalid="ignore"):
        off = np.where(d1 * d2 > 0, np.minimum(np.abs(d1), np.abs(d2)), 0)
        good = (off > 0) & (np.abs(before - after)[each] < off)
    return at[good], off[good]


def run_lengths(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches of equal values in series laid end to end."""
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    new[starts] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(v)))


@dataclass
class _Readings:
    """Readings in the order of their series and time; ``piece`` numbers the series in them."""

    run: pa.Array
    ticker: pa.Array
    fecha: np.ndarray
    reading: np.ndarray
    price: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, keys: tuple[str, ...]) -> tuple[_Readings, np.ndarray]:
        """The rows of ``table``, a repeated reading once, and which rows these are; ``keys`` tell series apart."""
        code = lambda k: np.asarray(table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1)).astype(np.int64)
        key = np.stack([code(k) for k in keys])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        reading = np.asarray(table.column("reading_id").combine_chunks())
        once = np.flatnonzero(new | np.concatenate([[True], reading[1:] != reading[:-1]]))
        col = lambda k: table.column(k).combine_chunks().take(pa.array(once))
        return cls(col("run_id"), col("ticker"), np.asarray(col("fecha")), reading[once], np.asarray(col("price")), (np.cumsum(new) - 1)[once]), once

    def logs(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.clip(np.log(self.price), -800, 800)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First place of each series, and the place after its last."""
        starts = np.flatnonzero(np.diff(self.piece, prepend=-1))
        return starts, np.append(starts[1:], len(self.piece))

    def rows(self, found: list[tuple], number: int | np.ndarray) -> pa.RecordBatch:
        """``_OUT`` rows of (kind, places, values, n, whether it is a reading)."""
        at = np.concatenate([f[1] for f in found]).astype(np.int64)
        kind = np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found])
        real = np.concatenate([np.full(len(f[1]), f[4]) for f in found])
        value, n = np.concatenate([f[2] for f in found]).astype(float), np.concatenate([f[3] for f in found]).astype(np.int64)
        take = pa.array(at)
        number = np.broadcast_to(number, len(self.piece))[at].astype(np.int64)
        columns = [pa.array(kind), self.run.take(take), self.ticker.take(take), pa.array(number), pa.array(np.where(real, self.reading[at], 0)), pa.array(np.where(real, self.fecha[at], 0)), pa.array(value), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "run_id", "ticker", "slice", "reading_id", "at", "value", "n"])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of spans laid end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _slice_spikes(r: _Readings, x: np.ndarray, lo: int, hi: int, p: Chart) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (places, distances) among the readings from ``lo`` to before ``hi``, charted in slices."""
    starts, ends = r.bounds()
    a, b = np.maximum(starts, lo), np.minimum(ends, hi)
    some = b > a
    starts, ends, a, b = starts[some], ends[some], a[some], b[some]
    slices = -(-(b - a) // p.slice_rows)
    of = np.repeat(np.arange(len(a)), slices)
    begin = a[of] + p.slice_rows * (np.arange(len(of)) - (np.cumsum(slices) - slices)[of])
    end = np.minimum(begin + p.slice_rows, b[of])
    first, size = np.maximum(begin - p.border_rows, starts[of]), np.minimum(end + p.border_rows, ends[of]) - np.maximum(begin - p.border_rows, starts[of])
    place, lanes = _spans(first, size), np.cumsum(size) - size
    at, off = spike_candidates(x[place], lanes, p)
    lane = np.searchsorted(lanes, at, "right") - 1
    mine = (place[at] >= begin[lane]) & (place[at] < end[lane])
    return place[at][mine], off[mine]


def _chunk(r: _Readings, lo: int, hi: int, number: int, opens: bool, closes: bool, p: Chart) -> pa.RecordBatch:
    """The rows of ``_OUT`` for the readings from ``lo`` to before ``hi``; those beside them are their border. ``opens`` and ``closes`` tell that the partition begins and ends here.

    An EDGE row is a stretch of equal values at an edge of the chunk, if its series may go on there (n is its length, value the price); an OPEN row is one of its readings (value is its
    place from 0 on, n the number of its edge in the chunk), so STILL and RUNS leave them out. n of a SPIKE is 1 near the first reading of the partition and 2 near the last, or both added, as it
    is to be charted again if its series goes on there; BORDER rows are the readings for that, n 0 at the beginning and 1 at the end.
    """
    n, x = len(r.piece), r.logs()
    last = int(r.piece[-1])
    at, off = _slice_spikes(r, x, lo, hi, p)
    near = opens * ((r.piece[at] == r.piece[0]) & (at < p.border_rows)) + 2 * closes * ((r.piece[at] == last) & (at >= n - p.border_rows))
    found = [(SPIKE, at, off, near, True)]
    starts, ends = r.bounds()
    first = np.unique(np.clip(starts[(ends > lo) & (starts < hi)], lo, None)) - lo
    begin, size = run_lengths(r.price[lo:hi], first)
    begin = begin + lo
    head, tail = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
    if len(begin):
        head[0] = opens or (lo > 0 and r.piece[lo - 1] == r.piece[lo])
        tail[-1] = closes or (hi < n and r.piece[hi] == r.piece[hi - 1])
    edge = head | tail
    # the number of an edge: 0 for the first of its series in the chunk
    second = tail & ~head & (head.any() and r.piece[lo] == r.piece[hi - 1])
    long = (size >= p.still) & ~edge
    at = _spans(begin[long] + 1, size[long] - 1)
    found.append((STILL, at, np.repeat(size[long], size[long] - 1), np.ones(len(at)), True))
    found.append((EDGE, begin[edge], r.price[begin[edge]], size[edge], True))
    at = _spans(begin[edge], size[edge])
    found.append((OPEN, at, at - np.repeat(begin[edge], size[edge]), np.repeat(second[edge], size[edge]), True))
    found.append((RUNS, *_histogram(begin[~edge], r.piece, size[~edge], lambda s: s.astype(float)), False))
    found.append((MOVES, *_moves(r, x, np.arange(max(lo, 1), hi)), False))
    if opens:
        at = np.flatnonzero(r.piece[: 2 * p.border_rows] == r.piece[0])
        found.append((BORDER, at, r.price[at], np.zeros(len(at)), True))
    if closes:
        at = np.flatnonzero(r.piece[-2 * p.border_rows :] == last) + max(0, n - 2 * p.border_rows)
        found.append((BORDER, at, r.price[at], np.ones(len(at)), True))
    return r.rows(found, number)


def _moves(r: _Readings, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    at = at[(r.piece[at] == r.piece[at - 1]) & (x[at] != x[at - 1])]
    return _histogram(at, r.piece, np.round(np.log2(np.abs(x[at] - x[at - 1])) * 16).astype(np.int64), lambda s: np.exp2(s / 16))


def _histogram(at: np.ndarray, piece: np.ndarray, step: np.ndarray, value) -> tuple[np.ndarray, ...]:
    """A place in each series, the values of its steps and how often they occur."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    _, where, n = np.unique(np.stack([piece[at], step]), axis=1, return_index=True, return_counts=True)
    return at[where], value(step[where]), n


def _read_partition(p: Chart):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, done, rows = TaskContext.get().partitionId() * _CHUNKS, 0, 0  # done: rows at the beginning that are border only

        def chunk(closes: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, number, done, rows
            table = pa.Table.from_batches(held)
            if not table.num_rows:
                return
            r, _ = _Readings.of(table, ("run_id", "ticker"))
            hi = len(r.piece) if closes else len(r.piece) - p.border_rows
            if hi > done:
                yield _chunk(r, done, hi, number, number % _CHUNKS == 0, closes, p)
                number += 1
                keep = max(0, hi - p.border_rows)
                kept = {"run_id": r.run, "ticker": r.ticker, "fecha": r.fecha, "reading_id": r.reading, "price": r.price}
                held, done = pa.table(kept).slice(keep).to_batches(), hi - keep
            rows = sum(b.num_rows for b in held)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= p.chunk_rows + 4 * p.border_rows:
                yield from chunk(False)
        if held:
            yield from chunk(True)

    return run


def _read_borders(p: Chart):
    """Charts of the readings on either side of each border, for the ``border_rows`` next to it, and the move over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def chart(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = pa.Table.from_batches(held)
            slices = np.asarray(table.column("slice").combine_chunks())
            same = np.flatnonzero(np.diff(slices)) + 1
            stop = table.num_rows if final else (int(same[-1]) if len(same) else 0)  # the last border may go on
            if stop:
                r, once = _Readings.of(table.slice(0, stop), ("run_id", "ticker", "slice"))
                right = np.asarray(table.column("right").combine_chunks().cast(pa.int8()))[once].astype(bool)
                x, (starts, ends) = r.logs(), r.bounds()
                border = starts + np.bincount(r.piece[~right], minlength=len(starts))
                at, off = spike_candidates(x, starts, p)
                mine = np.abs(at - border[r.piece[at]] + 0.5) < p.border_rows
                moved = border[(border > starts) & (border < ends)]
                yield r.rows([(SPIKE, at[mine], off[mine], np.zeros(mine.sum()), True), (MOVES, *_moves(r, x, moved), False)], slices[once])
            held = table.slice(stop).to_batches()
            rows = table.num_rows - stop

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= p.chunk_rows:
                yield from chart(False)
        if sum(b.num_rows for b in held):
            yield from chart(True)

    return run


def chart_rows(readings: DataFrame, rows: int, p: Chart = Chart()) -> DataFrame:
    """Candidates, histograms, edges and borders of every chunk (see ``_OUT``); readings have a valid price, fecha in microseconds and no null id; there are at most ``rows``."""
    width = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-rows // p.most_rows), min(width, -(-rows // p.least_rows)))
    order = ["run_id", "ticker", "fecha", "reading_id"]
    placed = readings.select(*order, "price").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(_read_partition(p), _OUT)


def _same() -> Column:
    return F.col("run_id").eqNullSafe(F.col("_run")) & F.col("ticker").eqNullSafe(F.col("_ticker"))


def settled_borders(found: DataFrame, p: Chart) -> DataFrame:
    """The SPIKE and MOVES rows of ``found``, with those near the border of a partition over which their series goes on replaced by a chart of both sides."""
    series = Window.partitionBy("_run", "_ticker").orderBy("_part")
    part = F.floor(F.col("slice") / _CHUNKS)
    spread = found.where(F.col("kind") == BORDER).select(F.col("run_id").alias("_run"), F.col("ticker").alias("_ticker"), part.alias("_part")).distinct()
    spread = spread.select("*", F.lag("_part").over(series).alias("_before"), F.lead("_part").over(series).alias("_after")).where("_before is not null or _after is not null")
    beside = found.where(F.col("kind") == BORDER).join(spread, _same() & (part == F.col("_part")))
    right = F.col("n") == 0
    sides = beside.select("run_id", "ticker", F.when(right, F.col("_before")).when(F.col("_after").isNotNull(), F.col("_part")).alias("slice"), right.alias("right"), F.col("at").alias("fecha"), "reading_id", F.col("value").alias("price"))
    keys = ["run_id", "ticker", "slice"]
    sides = sides.where("slice is not null").repartition(*keys).sortWithinPartitions("slice", "run_id", "ticker", "fecha", "reading_id")
    anew = sides.mapInArrow(_read_borders(p), _OUT)
    own = found.where((F.col("kind") == SPIKE) | (F.col("kind") == MOVES)).join(spread, _same() & (part == F.col("_part")) & (F.col("kind") == SPIKE) & (F.col("n") > 0), "left")
    again = (F.col("kind") == SPIKE) & ((F.col("n").bitwiseAND(1).cast("boolean") & F.col("_before").isNotNull()) | (F.col("n").bitwiseAND(2).cast("boolean") & F.col("_after").isNotNull()))
    return own.where(~again).select(found.columns).unionByName(anew.select(found.columns))


def joined_edges(found: DataFrame) -> DataFrame:
    """``run_id, ticker, slice, n, total, begins``: the stretches at the edges of slices by their number in the slice, with the length over all slices; the one that ``begins`` it has its first reading."""
    w = Window.partitionBy("run_id", "ticker").orderBy("slice", "at", "reading_id")
    edges = found.where(F.col("kind") == EDGE).select("run_id", "ticker", "slice", "at", "reading_id", "value", F.col("n").alias("size"))
    goes_on = (F.col("value") == F.lag("value").over(w)) & (F.col("slice") != F.lag("slice").over(w))
    edges = edges.select("*", (~F.coalesce(goes_on, F.lit(False))).alias("begins"), F.when(F.col("slice") == F.lag("slice").over(w), 1).otherwise(0).cast("bigint").alias("n"))
    edges = edges.withColumn("stretch", F.sum(F.col("begins").cast("int")).over(w))
    return edges.select("run_id", "ticker", "slice", "n", F.sum("size").over(Window.partitionBy("run_id", "ticker", "stretch")).alias("total"), "begins")


def suspect_readings(cells: DataFrame, provenance: DataFrame, p: Chart = Chart()) -> DataFrame:
    """``reading_id, reason`` of suspect readings: ``impossible``, ``spike`` or ``standstill``.

    Null and NaN prices and rows without reading_id are no readings; rows without fecha have no place in a series, so only the physical limit holds
    for them; rows with one reading_id are one reading. A spike needs a level on both sides, so the first and last readings of a series
    are none. A standstill's first reading is none; days that a note calls suspended are none.
    """
    told = cells.where(F.col("adjclose").isNotNull() & ~F.isnan("adjclose") & F.col("reading_id").isNotNull())
    impossible = told.where("adjclose <= 0").select("reading_id").distinct().withColumn("reason", F.lit("impossible"))
    readings = told.where((F.col("adjclose") > 0) & F.col("fecha").isNotNull()).select("run_id", "ticker", "reading_id", F.expr("unix_micros(cast(fecha as timestamp))").alias("fecha"), F.col("adjclose").alias("price"))
    found = cut_lineage(chart_rows(readings, cells.count(), p))  # few rows, read several times
    charted = settled_borders(found, p)
    edges = joined_edges(found)
    series = ["run_id", "ticker"]
    usual_move = charted.where(F.col("kind") == MOVES).groupBy(*series).agg((F.percentile("value", 0.5, F.col("n")) / 0.6745).alias("move"))
    runs = found.where(F.col("kind") == RUNS).select(*series, "value", "n").unionByName(edges.where("begins").select(*series, F.col("total").cast("double").alias("value"), F.lit(1).cast("bigint").alias("n")))
    runs = runs.groupBy(*series, "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*series)
    as_long = runs.withColumn("as_long", F.sum("n").over(w.orderBy(F.desc("value")))).withColumn("all", F.sum("n").over(w))
    usual_run = as_long.where(F.col("as_long") > F.greatest(F.lit(p.rare_least), p.rare * F.col("all"))).groupBy(*series).agg(F.max("value").alias("usual"))
    usual_move, usual_run, halts = (df.withColumnsRenamed({"run_id": "_run", "ticker": "_ticker"}) for df in (usual_move, usual_run, suspensions(provenance)))
    same = _same()
    spikes = charted.where(F.col("kind") == SPIKE)
    spikes = spikes.join(usual_move, same, "left").where(F.col("value") >= p.spike * F.coalesce("move", F.lit(0.0)))
    place = edges.where(F.col("total") >= p.still).select(F.col("run_id").alias("_run"), F.col("ticker").alias("_ticker"), F.col("slice").alias("_slice"), F.col("n").alias("_n"), "total", "begins")
    open_ = found.where(F.col("kind") == OPEN).join(place, same & (F.col("slice") == F.col("_slice")) & (F.col("n") == F.col("_n")))
    open_ = open_.where(~F.col("begins") | (F.col("value") > 0)).select(*series, "reading_id", "at", F.col("total").cast("double").alias("value"))
    still = found.where(F.col("kind") == STILL).select(*series, "reading_id", "at", "value").unionByName(open_)
    still = still.join(usual_run, same, "left").where(F.col("value") >= F.greatest(F.lit(p.still), p.still_factor * F.coalesce("usual", F.lit(1.0))))
    still = still.select("run_id", "ticker", "reading_id", F.to_date(F.timestamp_micros("at")).alias("day"))
    still = still.join(halts, same & F.col("day").between(F.col("from_day"), F.col("to_day")), "left_anti")
    return impossible.unionByName(spikes.select("reading_id", F.lit("spike").alias("reason"))).unionByName(still.select("reading_id", F.lit("standstill").alias("reason")))
