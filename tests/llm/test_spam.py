import random

import numpy as np
import pyarrow as pa

from tidegraph.llm import page_features
from tidegraph.llm.page_features import LEXICAL, PLAIN, Pages, lexical, pieces, plain
from tidegraph.llm.spam import spam_pages, spam_scores, valley

LAW = "the court finds that the tenant of the lower mill had no claim for interest under the lease and the appeal is dismissed with costs by the registrar".split()
AD = ["cheap watches", "best payday loan", "casino bonus coupon", "top rated handbags", "slimming tea reviews", "used tyres near me", "instant tax help"]
GOODS = ["watches", "oak chairs", "ladders", "handbags", "used tyres"]


def ruling(rng):
    return ". ".join(" ".join(rng.choices(LAW, k=14)) for _ in range(rng.randint(4, 20))) + "."


def filler(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return ", ".join(rng.choices(AD, k=60))
    if kind == 1:
        return "\n".join(f"http://x{rng.randrange(99)}.example/{rng.choice(AD).replace(' ', '-')}" for _ in range(40))
    return " ".join(f"#{rng.choice(AD).replace(' ', '')} tag: {rng.choice(AD)} SKU {rng.randrange(9999)}" for _ in range(30))


def pages(n=700):
    rng = random.Random(9)
    rows, truth = [], set()
    for k in range(n):
        roll = rng.random()
        if roll < 0.12:
            rows.append((k, filler(rng), rng.choice(["a", "b", None])))
            truth.add(k)
        elif roll < 0.2:
            rows.append((k, "INVENTORY of the estate\n" + "\n".join(f"{rng.randrange(90)} {rng.choice(GOODS)}" for _ in range(40)), "a"))
        elif roll < 0.28:
            rows.append((k, ruling(rng) + ' "' + ", ".join(rng.choices(AD, k=8)) + '" ' + ruling(rng) + " " + ruling(rng), "b"))
        else:
            rows.append((k, ruling(rng), rng.choice(["a", "b", None])))
    return rows, truth


SCHEMA = "doc_id long, text string, source string, score string, host string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "h", "l") for r in rows], SCHEMA)


def test_held_out_accuracy(spark):
    rows, truth = pages()
    rng = random.Random(1)
    labelled = [(k, "spam" if (k in truth) != (rng.random() < 0.03) else "page") for k in range(0, 400, 2)]
    rows += [(9001, "", "a"), (9002, None, None), (9003, "   ", "b"), (9004, "¶", "a"), (9005, " ".join(ruling(rng) for _ in range(300)), "a"), (9006, filler(rng) * 200, "b"), (9006, filler(rng), "b")]
    labels = spark.createDataFrame([*labelled, labelled[0], (0, "page"), (None, "spam"), (5, None), (123456, "spam")], "doc_id long, label string")
    got = {r.doc_id for r in spam_pages(frame(spark, rows), labels).collect()}
    held = {k for k, _, _ in rows if k < 9000} - {k for k, _ in labelled}
    hits, misses, wrong = len(got & truth & held), len((truth & held) - got), len((got & held) - truth)
    assert hits / (hits + misses) > 0.95
    assert hits / (hits + wrong) > 0.95
    assert not got & {9001, 9002, 9003, 9005}
    assert 9006 in got


def test_without_labels_of_both_kinds(spark):
    rows, _ = pages(20)
    labels = spark.createDataFrame([(1, "page"), (2, "page")], "doc_id long, label string")
    assert spam_scores(frame(spark, rows), labels) is None
    assert spam_pages(frame(spark, rows), labels).count() == 0
    assert spam_pages(frame(spark, []), labels.limit(0)).count() == 0


def features(texts, odds):
    p = Pages(pa.array(texts, pa.string()))
    return [dict(zip(LEXICAL + PLAIN, [*a, *b])) for a, b in zip(lexical(p, odds).tolist(), plain(p).tolist())]


def test_features():
    odds = {b"cheap": 3.0, b"oak": -2.0}
    none, empty, got = features([None, "", "Cheap cheap LOAN http://a.example/x\n12 oak"], odds)
    assert set(none.values()) == set(empty.values()) == {0.0}
    assert got["links"] * 9 == 1
    assert got["spam_words"] * 9 == 2
    assert got["page_words"] * 9 == 1
    assert got["number_words"] * 9 == 1
    assert got["numbered_items"] == 0.5
    assert features([], odds) == []


def test_features_against_a_page_at_a_time():
    """Every feature of a batch equals that of each page alone, and the sums those counted word by word."""
    rng = random.Random(4)
    texts = [ruling(rng) if rng.random() < 0.5 else filler(rng) for _ in range(60)] + ["", None, "¶", "a", "1 2\n3; x | 4 - 5 / six • 7", " 9", "é É 12"]
    odds = {w.encode(): rng.uniform(-2, 3) for w in set(" ".join(AD + [" ".join(LAW)]).split())}
    together = features(texts, odds)
    for text, got in zip(texts, together):
        assert got == features([text], odds)[0]
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
        if not words:
            continue
        n, score = len(words), [odds.get(w.encode(), 0.0) for w in words]
        k = max(1, n // 20)
        means = sorted(sum(score[j * n // k : (j + 1) * n // k]) / ((j + 1) * n // k - j * n // k) for j in range(k))
        want = {
            "mean_odds": sum(score) / n, "filler_windows": sum(m > 0.3 for m in means) / k, "low_odds": means[3 * k // 10], "top_word": max(words.count(w) for w in set(words)) / n,
            "distinct_words": np.log1p(len(set(words))) / np.log1p(n), "distinct_pairs": np.log1p(len(set(zip(words, words[1:])))) / np.log1p(n), "log_words": np.log1p(n),
        }
        assert all(abs(got[c] - v) < 1e-9 for c, v in want.items())
    assert [r["numbered_items"] for r in together[-3:]] == [5 / 7, 1.0, 0.0]


def test_pieces(monkeypatch):
    monkeypatch.setattr(page_features, "PIECE_BYTES", 10)
    assert list(pieces(pa.array(["x" * 30, None, "", "abc", "x" * 8, "y"]))) == [(0, 1), (1, 3), (4, 2)]


def test_valley(spark):
    scores = spark.createDataFrame([(0.02,)] * 50 + [(0.45,)] * 5 + [(0.9,)] * 10, "smoothed double")
    assert 0.5 < valley(scores) < 0.85
    assert valley(scores.limit(0)) == 0.5
