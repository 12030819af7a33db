import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm.packing import RoomTree, best_fit_decreasing, pack_faults, pack_items, pack_report
from tidegraph.llm.tokens import RANKS, token_counts, tokenizer

PACKS = [("small", 100), ("large", 1000)]


def brute_best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [b for b, r in enumerate(rooms) if r >= sizes[k]]
        b = min(fits, key=lambda b: rooms[b]) if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[b] -= sizes[k]
        out[k] = b
    return len(rooms), sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_search_of_all_containers(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 500])
    sizes = np.array([rng.randint(0, capacity) for _ in range(400)])
    out = best_fit_decreasing(sizes, capacity)
    rooms = capacity - np.bincount(out, weights=sizes).astype(int)
    n, want = brute_best_fit(sizes.tolist(), capacity)
    assert len(rooms) == n
    assert sorted(rooms.tolist()) == want


def test_room_tree():
    t = RoomTree(10)
    for room, b in ((3, 0), (7, 1), (7, 2), (10, 3)):
        t.put(room, b)
    assert t.take(4) == (7, 2)
    assert t.take(7) == (7, 1)
    assert t.take(8) == (10, 3)
    assert t.take(4) is None
    assert t.take(0) == (3, 0)
    assert best_fit_decreasing(np.array([], int), 5).tolist() == []


def items(spark, rows):
    return spark.createDataFrame([(d, n, "x", "y") for d, n in rows], "doc_id long, n_tokens long, pack string, container string")


def test_every_token_lies_in_one_container(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([0, None, 1, 50, 99, 100, 101, 250, 1000, 2345, rng.randint(1, 900)])) for k in range(800)] + [(None, 30), (7, 60), (7, 60), (7, 60)]
    placed = pack_items(items(spark, rows), PACKS, group_items=150, group_fill=60)
    got = placed.collect()
    for name, capacity in PACKS:
        fill, pieces = {}, {}
        for r in got:
            if r.pack_name == name:
                fill[r.container] = fill.get(r.container, 0) + r["size"]
                pieces.setdefault(r.doc_id, []).append((r.copy, r.piece, r.start, r["size"]))
        assert max(fill.values()) <= capacity
        total = sum(n or 0 for _, n in rows)
        assert sum(fill.values()) == total
        assert len(fill) <= total / capacity * 1.03 + 2
        want = {}
        for d, n in rows:
            want.setdefault(d, []).append(n or 0)
        for d, sizes in want.items():
            lengths = {}
            for copy, _, start, size in sorted(pieces[d], key=lambda p: (p[0], p[2])):
                key = copy
                lengths.setdefault(key, []).append((start, size))
            # pieces of one copy follow each other; only items above the capacity are cut
            if len(set(sizes)) == len(sizes) == 1:
                parts = lengths[1]
                assert [s for s, _ in parts] == np.cumsum([0, *(z for _, z in parts)])[:-1].tolist()
                assert sum(z for _, z in parts) == sizes[0]
                assert len(parts) == max(1, -(-sizes[0] // capacity))
    report = {r.pack_name: r for r in pack_report(placed, PACKS).collect()}
    assert report["small"].tokens == sum(n or 0 for _, n in rows)
    assert 0 <= report["small"].unused_share < 0.03


def test_empty_and_bad_input(spark):
    assert pack_items(items(spark, []), PACKS).count() == 0
    with pytest.raises(ValueError):
        pack_items(items(spark, [(1, 1)]), [("none", 0)])


def test_token_counts(spark):
    texts = ["", None, "Hello, world!", "word " * 40_000, "<|endoftext|>", "é█ ¶ 中文", "a" * 5000]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"]).collect()}
    enc = tokenizer(RANKS)
    for k, t in enumerate(texts):
        assert got[k] == (0 if t is None else len(enc.encode_ordinary(t)))
        if t:
            assert enc.decode(enc.encode_ordinary(t)) == t
    assert got[3] >= 40_000
    assert token_counts(df.limit(0), ["doc_id"]).agg(F.sum("n_tokens")).first()[0] is None


def test_faults_are_told(spark):
    sizes = spark.createDataFrame([(1, 30), (2, 150), (3, 0), (3, 20), (None, 5)], "doc_id long, n_tokens long")
    placed = pack_items(sizes, PACKS).cache()
    assert {tuple(r) for r in pack_faults(placed, sizes, PACKS).collect()} == {("small", 5, 0, 0, 0), ("large", 5, 0, 0, 0)}
    lost = placed.where("not (pack_name = 'small' and doc_id <=> 1)").union(placed.where("pack_name = 'large' and doc_id = 2").withColumn("size", F.lit(990)))
    assert {tuple(r) for r in pack_faults(lost, sizes, PACKS).collect()} == {("small", 4, 0, 0, 0), ("large", 5, 1, 1, 1)}
