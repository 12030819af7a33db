import datetime as dt

from pyspark.sql import functions as F

from tidegraph.operators.snapshot_diff import assign_ordinals, issuer_changes, snapshot_changes
from tidegraph.operators.versions import all_versions, issuer_versions, memberships, versions

HISTORY = "history_id long, index_code string, effective_date date, source string, n_tickers int, tickers string, received_at timestamp, ticker int"
ACTIONS = "action_id long, index_code string, issuer_id string, effective_date date, event string, new_value string, recorded_at timestamp, valid_from string"


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(k)


def at(k):
    return dt.datetime(2020, 1, 1) + dt.timedelta(k)


def history(spark, rows):
    """rows: index, day, tickers, received"""
    return spark.createDataFrame([(k, i, None if d is None else day(d), None, None, t, None if r is None else at(r), 7) for k, (i, d, t, r) in enumerate(rows)], HISTORY)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_memberships_with_gaps_late_and_failed_deliveries(spark):
    h = history(spark, [
        ("X", 0, "A;B", 0), ("X", 10, "A", 9), ("X", 10, "A;C", 30), ("X", 10, None, 40), ("X", 10, "  ", 41), ("X", 20, "A;B;B", 20), ("X", 30, "B", 30), ("X", 30, "A", None),
        ("Y", 5, "A", 5), (None, 5, "Q", 5), ("X", None, "Z", 5),
    ])
    got = rows_of(memberships(h).select("index_code", "ticker", F.col("valid_from").cast("string"), F.col("valid_to").cast("string")))
    d = lambda k: str(day(k))
    want = [
        ("X", "A", d(0), d(30)), ("X", "B", d(0), d(10)), ("X", "B", d(20), None), ("X", "C", d(10), d(20)), ("Y", "A", d(5), None), (None, "Q", d(5), None),
    ]
    assert got == sorted(want, key=str)


def test_issuer_versions_normalise_and_skip(spark):
    rows = [
        (1, "X", "I", day(0), "Name change", "Foo", at(0)), (2, "X", "I", day(5), "NAME-CHANGE", " foo ", at(5)), (3, "X", "I", day(9), "name_change", "Bar", at(9)),
        (4, "X", "I", day(9), " name  change", "Baz", at(8)), (5, "X", "I", day(12), "Name change", None, at(9)), (6, "X", "I", day(13), "Name change", " ", at(9)), (7, "X", "I", None, "Name change", "Q", at(9)),
        (8, "X", "I", day(20), "Name change", "foo", None), (9, None, None, day(1), None, "v", at(1)), (9, None, None, day(1), None, "v", at(1)),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], ACTIONS)
    got = rows_of(issuer_versions(df).select("issuer_id", "attribute", F.col("valid_from").cast("string"), F.col("valid_to").cast("string")))
    d = lambda k: str(day(k))
    assert got == sorted([("I", "name change", d(0), d(9)), ("I", "name change", d(9), d(20)), ("I", "name change", d(20), None), (None, None, d(1), None)], key=str)


def test_versions_against_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(k, t, rng.choice([None, "a", "b"])) for k in range(20) for t in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(data, "k int, t int, v string")
    want = []
    for k in range(20):
        last = object()
        mine = []
        for _, t, v in (r for r in data if r[0] == k):
            if v != last:
                mine.append([k, t, None, 0])
            mine[-1][3] += 1
            last = v
        for a, b in zip(mine, mine[1:]):
            a[2] = b[1]
        want += map(tuple, mine)
    assert sorted(map(tuple, versions(df, ["k"], "t", F.col("v")).select("k", "valid_from", "valid_to", "n_rows").collect())) == sorted(want)


def test_empty_tables(spark):
    h, a = history(spark, []), spark.createDataFrame([], ACTIONS)
    assert all_versions(h, a).count() == 0
    assert issuer_changes(h, spark.createDataFrame([], "ticker string, issuer_id string")).count() == 0


def test_issuer_changes(spark):
    h = history(spark, [("X", 0, "A1;B;D", 0), ("X", 10, "A2;C;D;D2", 10), ("X", 20, "A2;C;D", 20), ("Y", 0, "Q", 0), (None, 0, "A1", 0), (None, 9, "B", 9), ("Z", 0, "A1", 0), ("Z", 1, "Q", 1)])
    aliases = spark.createDataFrame([("A1", "IA"), ("A2", "IA"), ("A2", "IA"), ("D2", "ID"), ("D", "ID"), (None, "N")], "ticker string, issuer_id string")
    got = rows_of(issuer_changes(h, aliases).withColumn("period_end", F.col("period_end").cast("string")).select("index_code", "period_end", "issuer_id", "change_kind"))
    d = lambda k: str(day(k))
    want = [
        ("X", d(10), "IA", "changed"), ("X", d(10), "B", "removed"), ("X", d(10), "C", "added"), ("X", d(10), "ID", "changed"), ("X", d(20), "ID", "changed"),
        (None, d(9), "IA", "removed"), (None, d(9), "B", "added"), ("Z", d(1), "IA", "removed"), ("Z", d(1), "Q", "added"),
    ]
    assert got == sorted(want, key=str)


def test_ordinals_are_distinct_and_persist(spark):
    keys = spark.createDataFrame([("g", f"k{n}") for n in range(300)] + [("h", "k1"), ("g", None)], "g string, k string")
    first = assign_ordinals(keys.limit(200), "g", "k").cache()
    second = assign_ordinals(keys, "g", "k", first)
    old, new = {(r.g, r.k): r.ordinal for r in first.collect()}, {(r.g, r.k): r.ordinal for r in second.collect()}
    assert all(new[k] == v for k, v in old.items())
    assert len(new) == 302
    assert len({(g, o) for (g, _), o in new.items()}) == 302
    assert max(new.values()) == 300


def test_bitmap_diff_against_sets(spark):
    import random

    rng = random.Random(5)
    lists = {(g, n): {f"k{rng.randrange(400)}": rng.choice("ab") for _ in range(250)} for g in "xy" for n in range(1, 6)}
    rows = [(g, n, day(n), day(n + 1) if n < 5 else None, k, p) for (g, n), m in lists.items() for k, p in m.items()]
    members = spark.createDataFrame(rows, "g string, n int, effective_date date, next_date date, k string, p string")
    ordinals = assign_ordinals(members, "g", "k").cache()
    got = set(map(tuple, snapshot_changes(members, "g", "k", "p", ordinals).collect()))
    assert got == set(map(tuple, snapshot_changes(members, "g", "k", "p", ordinals, 5).collect()))
    want = set()
    for g in "xy":
        for n in range(2, 6):
            a, b = lists[g, n - 1], lists[g, n]
            want |= {(g, day(n), k, "added") for k in b.keys() - a.keys()} | {(g, day(n), k, "removed") for k in a.keys() - b.keys()}
            want |= {(g, day(n), k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert got == want
