import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.functions.notes import parsed_date, suspensions
from tidegraph.operators.grid import coverage_check, missing_sessions, regular_grid
from tidegraph.operators.spikes import Chart, control_charts, run_lengths, suspect_readings

CELLS = "reading_id long, run_id long, ticker string, fecha timestamp, adjclose double, loaded_at timestamp, ord int, slice string, price string"
NOTES = "provenance_id long, run_id long, ticker string, note string"
START = dt.datetime(2021, 3, 1, 10)


def cells(spark, rows):
    """rows: reading, run, ticker, hours from the start, price"""
    return spark.createDataFrame([(i, r, t, None if h is None else START + dt.timedelta(hours=h), p, START, 1, "s", "p") for i, r, t, h, p in rows], CELLS)


def sessions(spark, n=40, closed=(5, 6, 12, 13)):
    days = [(START.date() + dt.timedelta(k), k not in closed, None) for k in range(n)]
    return spark.createDataFrame([*days, days[0], (None, True, None)], "session_date date, is_open boolean, holiday_name string")


def test_missing_sessions_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([1, None]), rng.choice(["A", "B", None]), rng.choice([None, *range(0, 900, 7)]), rng.choice([1.0, 2.5, None, math.nan, 0.0, -1.0])) for k in range(150)]
    rows += rows[:20]
    got = set(map(tuple, missing_sessions(cells(spark, rows), sessions(spark)).collect()))
    opened = [START.date() + dt.timedelta(k) for k in range(40) if k not in (5, 6, 12, 13)]
    have = {}
    for _, run, t, h, p in rows:
        if h is not None and p is not None and not math.isnan(p) and p > 0 and (d := (START + dt.timedelta(hours=h)).date()) in opened:
            have.setdefault((run, t), set()).add(d)
    assert got == {(r, t, str(d)) for (r, t), ds in have.items() for d in opened if min(ds) <= d <= max(ds) and d not in ds}


def test_grid_carries_prices_over_shards(spark):
    rows = [(1, 1, "A", 0, 5.0), (2, 1, "A", 1, 6.0), (3, 1, "A", 24 * 20, 7.0), (4, 1, "A", 24 * 5, 9.0)]
    grid = regular_grid(cells(spark, rows), sessions(spark), shard=3).orderBy("session_day").collect()
    assert len(grid) == 17
    assert [g.price for g in grid] == [6.0] * 16 + [7.0]
    assert [g.observed for g in grid] == [True, *[False] * 15, True]
    for shard in (1, 2, 7, 64):
        assert regular_grid(cells(spark, rows), sessions(spark), shard).orderBy("session_day").collect() == grid
    assert regular_grid(cells(spark, []), sessions(spark)).count() == 0
    assert regular_grid(cells(spark, rows), sessions(spark).limit(0)).count() == 0


def test_coverage_check(spark):
    told = spark.createDataFrame([(1, "A", 2), (1, "A", 2), (1, "B", None), (2, "C", 3)], "run_id long, ticker string, n_valid_days int")
    rows = [(1, 1, "A", 0, 5.0), (3, 1, "A", 24 * 20, 7.0), (4, 1, "D", 0, 1.0)]
    got = {r.ticker: (r.n_declared, r.n_counted, r.n_missing, r.agrees) for r in coverage_check(cells(spark, rows), sessions(spark), told).collect()}
    assert got == {"A": (2, 2, 15, True), "B": (None, 0, 0, False), "C": (3, 0, 0, False), "D": (None, 1, 0, False)}


@pytest.mark.parametrize("text", ["2022-10-04", "2022.10.04", "20221004", "4 Oct 2022", "4 de octubre de 2022", "04 October 2022", "4 octobre 2022"])
def test_dates_in_notes(spark, text):
    assert spark.range(1).select(parsed_date(F.lit(text)).alias("d")).first().d == dt.date(2022, 10, 4)


def test_suspensions(spark):
    notes = [
        "Halted by the exchange from 2022-01-03 until 2022.01.10, last price carried", "Cotizacion suspendida del 4 de noviembre de 2021 al 1 de diciembre de 2021", "Suspension announced for 20230125 but lifted before the open",
        "Trading suspended in the predecessor line only, 2022-06-23", "No suspension on record; vendor checked 2022-01-01", "Joined, return skipped on 2022-03-01, 2022-06-01", None, "", "suspension: 31 Feb 2022 / 99 Mar 2022",
        "ok. suspension: 23 Apr 2021 / 11 May 2021; No trading 20210601 - 20210603 (suspension), carried price is genuine",
    ]
    df = spark.createDataFrame([(k, 1, f"T{k}", n) for k, n in enumerate(notes)], NOTES)
    got = sorted((r.ticker, str(r.from_day), str(r.to_day)) for r in suspensions(df.union(df)).collect())
    assert got == [("T0", "2022-01-03", "2022-01-10"), ("T1", "2021-11-04", "2021-12-01"), ("T9", "2021-04-23", "2021-05-11"), ("T9", "2021-06-01", "2021-06-03")]


def walk(n, seed, start=50.0, sd=0.01):
    return np.round(start * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sd, n))), 4)


def found(spark, rows, notes=(), p=Chart()):
    df = suspect_readings(cells(spark, rows), spark.createDataFrame(list(notes), NOTES), p)
    out = {}
    for r in df.collect():
        out.setdefault(r.reason, set()).add(r.reading_id)
    return out


def series(x, run=1, ticker="A", base=0):
    return [(base + k, run, ticker, 5 * k, float(v)) for k, v in enumerate(x)]


def test_spikes_standstills_and_level_changes(spark):
    x = walk(400, 1)
    x[50] *= 1.4
    x[100:103] *= 0.6
    x[200:] *= 1.5  # a lasting change
    x[250:270] = x[250]
    x[300] = -1.0
    x[301] = 0.0
    rows = series(x) + [(1000, 1, "A", 3, None), (1001, 1, "A", 3, math.nan), (1002, 1, "A", None, -5.0), (1003, 1, "A", None, 5.0), (None, 1, "A", 4, -3.0)]
    rows += rows[:300]  # sent again
    got = found(spark, rows)
    assert got == {"spike": {50, 100, 101, 102}, "standstill": set(range(251, 270)), "impossible": {300, 301, 1002}}
    noted = found(spark, rows, [(1, 1, "A", f"suspension: {(START + dt.timedelta(hours=5 * 250)).date()} / {(START + dt.timedelta(hours=5 * 270)).date()}"), (2, 1, None, None)])
    assert "standstill" not in noted
    assert noted["spike"] == {50, 100, 101, 102}


@pytest.mark.parametrize("sd", [0.0005, 0.003, 0.05])
def test_limits_follow_the_noise_of_the_series(spark, sd):
    x = np.exp(np.cumsum(np.random.default_rng(31).normal(0, sd, 400))) * 50
    for k, moves in ((60, 12), (61, 12), (200, -12), (330, 3)):  # the last one is within the usual
        x[k] *= np.exp(moves * sd)
    assert found(spark, series(x)) == {"spike": {60, 61, 200}}


def test_slices_don_t_show(spark):
    x = walk(3000, 2)
    for k in (0, 5, 700, 701, 1499, 1500, 2250, 2999):
        x[k] *= 1.5
    x[740:760] = x[740]
    x[1800:] *= 0.5
    many = [r for s in range(30) for r in series(walk(40, 10 + s), ticker=f"S{s}", base=10_000 + 100 * s)]
    whole, cut = found(spark, series(x) + many, p=Chart(slice_rows=10_000, least_rows=1_000_000)), found(spark, series(x) + many, p=Chart(slice_rows=250, least_rows=700))
    assert whole == cut
    assert whole["spike"] == {5, 700, 701, 1499, 1500, 2250}  # the first and last have no level on one side
    assert whole["standstill"] == set(range(741, 760))


def test_slices_of_session_clustered_readings(spark):
    """Readings of a few open hours a day: the borders of slices often fall into closed hours."""
    x = walk(3200, 12)
    for k in range(60, 3200, 80):  # at and near every slice's first and last readings
        x[k] *= 1.5
    x[1590:1604] = x[1590]
    x[2250:2820] = x[2250]  # a stretch longer than a slice
    rows = [(k, 1, "A", 24 * (k // 80) + 0.05 * (k % 80), float(v)) for k, v in enumerate(x)]
    whole = found(spark, rows, p=Chart(slice_rows=10_000, least_rows=1_000_000))
    assert len(whole["spike"]) >= 30
    assert whole["standstill"] == {*range(1591, 1604), *range(2251, 2820)}
    for n in (80, 160, 200):
        assert found(spark, rows, p=Chart(slice_rows=n, least_rows=900, chunk_rows=500))["standstill"] == whole["standstill"]
    day = [(k, 1, "A", 24 * (k // 80) + 0.05 * (k % 80), float(v)) for k, v in enumerate(walk(1600, 13))]
    for first in (79, 80, 160, 239, 800, 1279, 1280):
        day[first] = (*day[first][:4], day[first][4] * 1.5)
    whole = found(spark, day, p=Chart(slice_rows=10_000, least_rows=1_000_000))
    assert whole["spike"] == {79, 80, 160, 239, 800, 1279, 1280}
    assert found(spark, day, p=Chart(slice_rows=80, least_rows=500, chunk_rows=300, border_rows=60)) == whole


def test_bursts_and_sparse_stretches_give_the_same_however_cut(spark):
    """Dense, sparse, dense with a standstill in the sparse stretch; a burst within an hour; readings all at one time."""
    rng = np.random.default_rng(21)
    hours = np.concatenate([np.arange(1500) * 0.5, 800 + 240.0 * np.arange(60), 16_000 + np.arange(1500) * 0.5])
    x = walk(len(hours), 22)
    x[1520:1540] = x[1520]
    burst = np.sort(np.concatenate([rng.uniform(0, 2000, 400), 500 + rng.uniform(0, 1, 3000)]))
    y, z = walk(len(burst), 23), walk(1500, 24)
    for v, at in ((x, (300, 1549, 2400)), (y, (50, 1700, 1701, 3300)), (z, (700,))):
        v[list(at)] *= 1.6
    rows = [(k, 1, "sparse", h, float(v)) for k, (h, v) in enumerate(zip(hours, x))]
    rows += [(10_000 + k, 1, "burst", h, float(v)) for k, (h, v) in enumerate(zip(burst, y))] + [(20_000 + k, 1, "once", 7.0, float(v)) for k, v in enumerate(z)]
    want = {"spike": {300, 1549, 2400, 10_050, 11_700, 11_701, 13_300, 20_700}, "standstill": set(range(1521, 1540))}
    for n, least, chunk in ((10_000, 10**6, 10**6), (1024, 2500, 150_000), (250, 2000, 700), (50, 2000, 400)):
        assert found(spark, rows, p=Chart(slice_rows=n, least_rows=least, chunk_rows=chunk)) == want


def test_short_constant_and_tied_series(spark):
    rows = series([5.0], ticker="one") + series([5.0] * 30, ticker="flat", base=100) + [(200 + k, 2, "ties", 7, 5.0 + k % 3 * 0.01) for k in range(50)] + series([math.inf, 1.0, 1.1], ticker="inf", base=300)
    got = found(spark, rows)
    assert got.get("standstill", set()) <= set(range(101, 130))
    assert "impossible" not in got
    assert found(spark, []) == {}


def test_null_keys_are_series(spark):
    x = walk(60, 4)
    x[30] *= 2
    rows = series(x, None, None) + series(walk(60, 5), 1, None, 100) + series(x, None, "A", 200)
    assert found(spark, rows) == {"spike": {30, 230}}


def test_charts_side_by_side_equal_one_by_one():
    parts = [walk(n, n) for n in (5, 80, 1, 300, 33)]
    for x in parts:
        x[len(x) // 2] *= 3
    logs = [np.log(x) for x in parts]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    together = control_charts(np.concatenate(logs), starts)[0]
    alone = np.concatenate([control_charts(x, np.array([0]))[0] for x in logs])
    assert (together == alone).all()
    assert [a.tolist() for a in run_lengths(np.array([1, 1, 2, 2, 2]), np.array([0, 3]))] == [[0, 2, 3], [2, 1, 2]]
