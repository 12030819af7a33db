import random
from fractions import Fraction

import pytest

from tidegraph.llm.mixing import Target, blocks_before, mix, mix_faults, mix_report, pfair_slots, source_offsets, whole_weights

SIZES = "source string, doc_id long, n_tokens long, slot string, offset string"


def sizes(spark, rows):
    return spark.createDataFrame([(s, d, n, "x", "y") for s, d, n in rows], SIZES)


@pytest.mark.parametrize(
    "shares", [[0.3, 0.2, 0.15, 0.15, 0.1, 0.06, 0.04], [1.0], [0.5, 0.5], [0.9, 0.0999, 0.0001], [1, 2, 3], [1 / 3, 1 / 7, 0.12345, 0.4], [0.30001, 0.25, 0.2, 0.12345, 0.1, 0.02, 0.00654]]
)
def test_pfair_deviation_is_below_one_block_of_the_exact_share(shares):
    weights = whole_weights(shares)
    exact = [Fraction(str(s)) / sum(Fraction(str(s)) for s in shares) for s in shares]
    assert all(abs(Fraction(w, sum(weights)) - e) <= Fraction(1, 1 << 43) for w, e in zip(weights, exact))
    chosen, blocks = pfair_slots(0, 10_000, weights)
    done = [0] * len(shares)
    for t, (s, k) in enumerate(zip(chosen, blocks)):
        assert k == done[s]
        done[s] += 1
        assert all(abs(n - e * (t + 1)) < 1 for n, e in zip(done, exact))
    # a segment that begins anywhere knows what lies before it
    for begin in [1, 2, 3, 10, 11, 12, 13, 999, 1000, 4321, 9999]:
        assert blocks_before(begin, weights) == [chosen[:begin].count(s) for s in range(len(shares))]
        assert pfair_slots(begin, 10_000, weights) == (chosen[begin:], blocks[begin:])


def test_segments_far_on_follow_each_other():
    rng = random.Random(8)
    for _ in range(40):
        weights = whole_weights([rng.random() ** 3 + 0.001 for _ in range(rng.randint(2, 9))])
        begin = rng.randrange(10**9)
        chosen, _ = pfair_slots(begin, begin + 300, weights)
        before = blocks_before(begin, weights)
        for t in range(0, 300, 7):
            now = blocks_before(begin + t, weights)
            assert sum(now) == begin + t
            assert now == [n + chosen[:t].count(s) for s, n in enumerate(before)]
            assert all(abs(n * sum(weights) - w * (begin + t)) < sum(weights) for n, w in zip(now, weights))


def test_whole_weights():
    assert whole_weights([0.5, 0.25, 0.25]) == [2, 1, 1]
    tiny = whole_weights([1 / 3, 1e-30, 0.7])
    assert sum(tiny) == 1 << 44
    assert tiny[1] == 1


def test_offsets_are_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), d, rng.randint(0, 50)) for d in range(600)] + [("a", 5, 7), ("a", 5, 7)]
    got = source_offsets(sizes(spark, rows).select("source", "doc_id", "n_tokens"), bucket_rows=40).collect()
    assert len(got) == len(rows)
    for s in "ab":
        mine = sorted((r.start, r.n_tokens) for r in got if r.source == s)
        at = 0
        for start, n in sorted(mine, key=lambda x: (x[0], x[1])):
            assert start == at
            at += n


def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(3)
    rows = [(s, 10_000 * k + d, rng.randint(1, 200)) for k, (s, n) in enumerate((("big", 3000), ("mid", 800), ("tiny", 60), ("other", 100), (None, 50))) for d in range(n)]
    targets = [Target("big", 0.5, 1), Target("mid", 0.3, 2), Target("tiny", 0.2, 3), Target("absent", 0.1, 2)]
    df = sizes(spark, rows)
    mixed = mix(df, targets, block=500, segment=3)
    got = mixed.collect()
    assert {r.source for r in got} == {"big", "mid", "tiny"}
    used = {}
    for r in got:
        used[r.source, r.doc_id] = used.get((r.source, r.doc_id), 0) + 1
    cap = {"big": 1, "mid": 2, "tiny": 3}
    assert all(n <= cap[s] for (s, _), n in used.items())
    totals = {s: sum(r.n_tokens for r in got if r.source == s) for s in cap}
    every = sum(totals.values())
    for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(totals[s] / every - w) < 0.01
    # as long as the caps allow: the scarcest source is used up to its cap
    assert totals["tiny"] >= 3 * sum(n for s, _, n in rows if s == "tiny") - 200
    # at any slot a source is within a block and a record of its share
    order = sorted(got, key=lambda r: (r.slot, r.offset))
    run = {s: 0 for s in cap}
    last = order[0].slot
    for r in order:
        if r.slot != last:
            done = sum(run.values())
            for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
                assert abs(run[s] - w * done) < 500 + 3 * 200  # one block, and records that reach over the ends of blocks
            last = r.slot
        run[r.source] += r.n_tokens
    # the slots and blocks are those of one run over all slots
    chosen, blocks = pfair_slots(0, max(r.slot for r in got) + 1, whole_weights([0.5, 0.3, 0.2]))
    assert all((("big", "mid", "tiny")[chosen[r.slot]], blocks[r.slot]) == (r.source, r.offset // 500) for r in got)
    report = {r.source: r for r in mix_report(mixed, targets).collect()}
    assert report["absent"].tokens == 0
    assert report["absent"].records == 0
    assert abs(report["big"].actual_share - 0.5) < 0.01
    assert report["tiny"].most_repeats == 3


def test_nothing_to_mix(spark):
    targets = [Target("a", 1.0, 1)]
    assert mix(sizes(spark, []), targets).count() == 0
    assert mix(sizes(spark, [("b", 1, 5), (None, 2, 5)]), targets).count() == 0
    assert mix(sizes(spark, [("a", 1, 5)]), []).count() == 0
    assert [r.tokens for r in mix_report(mix(sizes(spark, [("a", 1, 0)]), targets), targets).collect()] == [0]


def test_faults_are_told(spark):
    targets = [Target("a", 0.5, 1), Target("b", 0.5, 2), Target("none", 0.2, 1)]
    rows = [(s, 100 * k + d, 10) for k, s in enumerate("ab") for d in range(50)]
    mixed = mix(sizes(spark, rows), targets, block=20).cache()
    assert {tuple(r) for r in mix_faults(mixed, targets).collect()} == {("a", 0, False), ("b", 0, False), ("none", 0, False)}
    more = mixed.union(mixed.where("source = 'a' and doc_id < 7"))
    assert {tuple(r) for r in mix_faults(more, targets).collect()} == {("a", 7, True), ("b", 0, True), ("none", 0, False)}
