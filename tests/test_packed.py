import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tidegraph.operators import packed
from tidegraph.operators.packed import scan_field, split_arrays, split_batch, split_packed


def fast(fields):
    lists, unsure = split_arrays(pa.array(fields, pa.string()))
    out = lists.to_pylist()
    for k in unsure:
        assert out[k] == []
        out[k] = scan_field(fields[k])
    return out


CASES = [
    (None, []), ("", []), ("   ", []), ("A.QX", ["A.QX"]), ("A;B,C|D\tE\nF\r\nG", list("ABCDEFG")),
    ("A / B/C /D", ["A", "B/C", "D"]), ("[A; ;B]", ["A", "B"]), ("{ 'A' , \"B,C\" }", ["A", "B,C"]), ("L'AOL.QX;'D''XR,O'", ["L'AOL.QX", "D'XR,O"]),
    ('"A""B";C', ['A"B', "C"]), ("AX R.QX; CCB ;;", ["AX R.QX", "CCB"]), ("A  B", ["A", "B"]), ("(A);(B)", ["(A)", "(B)"]), ('""', []), ("[]", []),
    ("A  'A", ["A", "A"]), ("A  'A'  B", ["A", "A", "B"]), ("A/", ["A"]), ("/A/B", ["A/B"]), (" [/A.QX/] ", ["A.QX"]), ('A / "TL&O"/', ["A", "TL&O"]), ('/"TL&O"', ["TL&O"]),
    ("A;/B/;C", ["A", "B", "C"]), ("//A//B//", ["A//B"]), ('"A"/B', ["A", "B"]), ("/", []), ("A/B /", ["A/B"]), ("'/A/'", ["/A/"]), ("/\xa0A", ["A"]),
    ('" A ";A;A', ["A", "A", "A"]), ("' ;B", [";B"]), ("/  OLKFB.QX ", ["OLKFB.QX"]), ("A 　B", ["A", "B"]),
]


@pytest.mark.parametrize(("field", "want"), CASES)
def test_cases(field, want):
    assert scan_field(field) == want
    assert fast([field]) == [want]


def test_whole_batch_keeps_rows_apart():
    assert fast([f for f, _ in CASES]) == [w for _, w in CASES]
    assert fast(["A;B" * 50_000])[0] == scan_field("A;B" * 50_000)


@settings(max_examples=1000, deadline=None)
@example(["A  'A", "'''", "''D'", "'L'AOL'"])
@example(["/A", "B/", "//", '"A"/B'])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="AB&-.'\"'\";,|/\t\n\r   [](){}　é", max_size=14)), max_size=6))
def test_masks_agree_with_the_exact_reader(fields):
    assert fast(fields) == [scan_field(f) for f in fields]


def test_pieces_give_the_same_rows(monkeypatch):
    fields = [f for f, _ in CASES] * 3 + ["A;B" * 50]
    ids = pa.array(range(len(fields)))
    rows = lambda: [r for b in split_batch(ids, pa.array(fields, pa.string())) for r in b.to_pylist()]
    want = sorted(map(str, rows()))
    monkeypatch.setattr(packed, "PIECE_BYTES", 7)
    assert len(list(packed._pieces(pa.array(fields, pa.string())))) > 20
    assert sorted(map(str, rows())) == want


def test_sliced_arrays():
    whole = pa.array(["x;y", "A;B", None, "C"])
    assert split_arrays(whole.slice(1, 3))[0].to_pylist() == [["A", "B"], [], ["C"]]


def test_in_spark(spark):
    df = spark.createDataFrame([(1, "A;A", "z"), (1, "A;A", "z"), (2, None, "z"), (3, "'B;C", "z")], "k long, t string, pos string")
    got = sorted(map(tuple, split_packed(df, "k", "t").collect()))
    assert got == [(1, 1, "A"), (1, 1, "A"), (1, 2, "A"), (1, 2, "A"), (3, 1, "B;C")]
    assert split_packed(df.limit(0), "k", "t").count() == 0
    assert list(split_batch(pa.array([], pa.int64()), pa.array([], pa.string()))) == []
