"""Several values packed in one field (problem 5).

``split_packed`` turns a packed text column into one row per value with its place. The work is done on
Arrow string buffers: quote parity and delimiter masks are computed over the bytes of a whole batch, the
child offsets of a list array follow from them, and the list array is flattened with parent ordinals.
Rows whose quoting the masks can't settle (quotes that open or close inside a value, brackets inside the
field, both kinds of quotes) are read by ``scan_field``, an exact reader of one field, so no row is guessed.

Rules: ``; , | tab newline`` part values outside quotes, as do two or more blanks and slashes that have a blank, another
delimiter or an end of the field (within its brackets) on either side, or follow a closed quote; brackets around the whole field and
empty slots are no values; a value loses its quotes and its outer white space, a doubled quote mark inside quotes stands for one. A quote
mark opens only where a slot starts, so ``L'AOL`` keeps its mark. An unclosed quote runs to the end of the field.

Null, empty and blank fields give no rows; repeated rows and values are kept; a field of any length is one row. The masks
take some hundred bytes for a byte of text, so a batch is read in pieces of about ``PIECE_BYTES``, or of one
field if that is larger. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = b"([{<", b")]}>"
_HARD = b";,|\t\n\r"
PIECE_BYTES = 1 << 20
#: Two and three byte UTF-8 white space: no-break, next line, ogham, general punctuation, ideographic, byte order mark.
_WIDE = (b"\xc2\xa0", b"\xc2\x85", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")


def split_packed(df: DataFrame, row_id: str, packed: str) -> DataFrame:
    """``(row_id, pos, value)``: one row for each value of ``packed``, ``pos`` counting from 1."""
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("row_id"), F.col(packed).cast("string").alias("packed")).where(F.col("packed").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from split_batch(batch.column(0), batch.column(1))

    return rows.mapInArrow(run, f"row_id {kind}, pos bigint, value string")


def packed_lists(df: DataFrame, row_id: str, packed: str) -> DataFrame:
    """``(row_id, values)``: one row for each non-null ``packed`` with the array of its values in their order, repeated ones included."""
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("row_id"), F.col(packed).cast("string").alias("packed")).where(F.col("packed").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin, size in _pieces(texts):
                for own, values in _piece_lists(ids.slice(begin, size), texts.slice(begin, size)):
                    yield pa.RecordBatch.from_arrays([own, values.cast(pa.list_(pa.string()))], ["row_id", "values"])

    return rows.mapInArrow(run, f"row_id {kind}, values array<string>")


def split_batch(ids: pa.Array, packed: pa.Array) -> Iterator[pa.RecordBatch]:
    """Batches of ``row_id, pos, value`` for one batch of fields."""
    for begin, size in _pieces(packed):
        yield from _split_piece(ids.slice(begin, size), packed.slice(begin, size))


def _pieces(packed: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of pieces of about ``PIECE_BYTES`` of text."""
    total = np.cumsum(pc.binary_length(packed).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(packed):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + PIECE_BYTES, side="right")))
        yield begin, end - begin
        begin = end


def _piece_lists(ids: pa.Array, packed: pa.Array) -> Iterator[tuple[pa.Array, pa.LargeListArray]]:
    """Rows and their list arrays: those the masks settle, then those of the exact reader."""
    lists, unsure = split_arrays(packed)
    if not len(unsure):
        yield ids, lists
        return
    sure = pa.array(np.delete(np.arange(len(packed)), unsure))
    yield ids.take(sure), lists.take(sure)
    yield ids.take(pa.array(unsure)), _scanned(packed, unsure)


def _split_piece(ids: pa.Array, packed: pa.Array) -> Iterator[pa.RecordBatch]:
    for own, values in _piece_lists(ids, packed):
        parents = pc.list_parent_indices(values)
        offsets = np.asarray(values.offsets)
        pos = np.arange(len(parents)) + offsets[0] - offsets[np.asarray(parents)] + 1
        yield pa.RecordBatch.from_arrays([own.take(parents), pa.array(pos, pa.int64()), values.flatten().cast(pa.string())], ["row_id", "pos", "value"])


def _scanned(packed: pa.Array, rows: np.ndarray) -> pa.LargeListArray:
    return pa.array([scan_field(packed[int(k)].as_py()) for k in rows], pa.large_list(pa.large_string()))


def _last_true(mask: np.ndarray) -> np.ndarray:
    """For each place the last place up to it where ``mask`` holds, else -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


def _next_true(mask: np.ndarray) -> np.ndarray:
    """For each place the first place from it where ``mask`` holds, else the length."""
    n = len(mask)
    return n - 1 - _last_true(mask[::-1])[::-1] if n else np.zeros(0, np.int64)


def split_arrays(packed: pa.Array) -> tuple[pa.LargeListArray, np.ndarray]:
    """The list array of the values of each field, and the rows left to the exact reader (empty in the list array)."""
    text = packed.cast(pa.large_string()).fill_null("")
    rows = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + rows + 1] if rows else np.zeros(1, np.int64)
    n = int(off[-1] - off[0])
    data = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    off = off - off[0]
    if not n:
        return pa.LargeListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int64)), pa.array([], pa.large_string())), np.zeros(0, np.int64)
    # one guard byte on either side keeps neighbours inside the arrays
    row = np.repeat(np.arange(rows), np.diff(off))
    first = off[:-1][row]
    at = np.arange(n)
    soft = np.isin(data, np.frombuffer(b" \x0b\x0c", np.uint8))
    for wide in _WIDE:
        hit = np.ones(n - len(wide) + 1, bool) if n >= len(wide) else np.zeros(0, bool)
        for k, byte in enumerate(wide):
            hit &= data[k : len(hit) + k] == byte
        for k in range(len(wide)):
            soft[k : len(hit) + k] |= hit
    hard = np.isin(data, np.frombuffer(_HARD, np.uint8))
    blank = soft | np.isin(data, np.frombuffer(b"\t\n\r", np.uint8))
    # brackets around the whole field
    solid_from, solid_to = _next_true(~blank), _last_true(~blank)
    filled = np.flatnonzero(np.diff(off) > 0)
    head, tail = solid_from[off[filled]], solid_to[off[filled + 1] - 1]
    some = (head <= tail) & (head < off[filled + 1])
    filled, head, tail = filled[some], head[some], tail[some]
    opens, closes = np.frombuffer(_OPEN, np.uint8), np.frombuffer(_CLOSE, np.uint8)
    wrapped = np.zeros(len(filled), bool)
    for a, b in zip(opens, closes, strict=True):
        wrapped |= (data[head] == a) & (data[tail] == b) & (head < tail)
    bracket = np.isin(data, np.concatenate([opens, closes]))
    unsure = np.zeros(rows, bool)
    unsure[filled] = wrapped & (np.bincount(row[bracket], minlength=rows)[filled] > 2)
    start, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64)  # of what lies inside the brackets
    start[filled], end[filled] = head + wrapped, tail + 1 - wrapped
    inside = (at >= start[row]) & (at < end[row])
    # a run of slashes parts values if a blank, a hard delimiter or an end of the field lies on either side
    slash = (data == 0x2F) & inside
    parts = hard | blank
    run_from, run_to = np.maximum(_last_true(~slash) + 1, start[row]), np.minimum(_next_true(~slash), end[row])
    opens_run = (run_from == start[row]) | parts[np.clip(run_from - 1, 0, n - 1)]
    ends_run = (run_to == end[row]) | parts[np.clip(run_to, 0, n - 1)]
    delimiter = hard | (slash & (opens_run | ends_run))
    # what lies beside each quote mark but for blanks: a delimiter, an end of the field, or other text
    edge = ~soft
    left = np.concatenate([[-1], _last_true(edge)[:-1]])
    right = np.concatenate([_next_true(edge)[1:], [n]])
    wide_gap = soft & np.concatenate([[False], soft[:-1]]) & (at > first) & ~_continues(data)
    at_start = (left < start[row]) | delimiter[np.clip(left, 0, n - 1)] | (np.concatenate([[-1], _last_true(wide_gap)[:-1]]) > left)
    at_end = (right >= end[row]) | delimiter[np.clip(right, 0, n - 1)] | (np.concatenate([_next_true(wide_gap)[1:], [n]]) < right)
    double, single = (data == 0x22) & inside, (data == 0x27) & inside
    single_edge = single & (at_start | at_end)
    has_double = np.bincount(row[double], minlength=rows) > 0
    unsure |= has_double & (np.bincount(row[single_edge], minlength=rows) > 0)
    mark = double | single_edge
    place = np.flatnonzero(mark)
    nth = np.arange(len(place)) - np.searchsorted(place, start[row[place]])  # of its row
    twin = (place > 0) & (data[place - 1] == data[place]) & mark[place - 1]
    twin_next = np.concatenate([twin[1:], [False]]) if len(place) else twin
    odd = nth % 2 == 1
    fits = np.where(odd, at_end[place] | twin_next, at_start[place] | twin) & ~((data[place] == 0x27) & at_start[place] & at_end[place])
    unsure[row[place[~fits]]] = True
    unsure |= np.bincount(row[place], minlength=rows) % 2 == 1
    count = np.cumsum(mark)
    base = np.concatenate([[0], count])[start[row]]
    quoted = (count - base) % 2 == 1
    # single marks inside single quotes come in pairs, else they close there
    loose = np.flatnonzero(single & ~mark & quoted & ~has_double[row])
    run_starts = np.flatnonzero(np.diff(loose, prepend=-2) != 1)
    unsure[row[loose[run_starts[np.diff(np.append(run_starts, len(loose))) % 2 == 1]]]] = True
    cut = (delimiter | wide_gap) & inside & ~quoted
    # slots lie between cuts; trimmed, unquoted and trimmed again they are the values
    sure = np.flatnonzero((end > start) & ~unsure)
    cuts = np.flatnonzero(cut & ~unsure[row])
    lo = np.sort(np.concatenate([start[sure], cuts + 1]))
    hi = np.sort(np.concatenate([cuts, end[sure]]))
    lo, hi = _trimmed(lo, hi, solid_from, solid_to, n)
    in_quotes = (hi - lo >= 2) & mark[np.clip(lo, 0, n - 1)] & mark[np.clip(hi - 1, 0, n - 1)]
    opened = lo.copy()
    lo, hi = _trimmed(lo + in_quotes, hi - in_quotes, solid_from, solid_to, n)
    keep = hi > lo
    lo, hi, in_quotes, opened = lo[keep], hi[keep], in_quotes[keep], opened[keep]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    chosen = np.cumsum(step)[:n] > 0
    slot = np.full(n, -1)
    slot[chosen] = np.repeat(np.arange(len(lo)), hi - lo)
    # the second mark of each doubled pair inside quotes goes
    same = np.concatenate([[False], data[1:] == data[:-1]])
    run = at - _last_true(~same)
    spare = chosen & (run % 2 == 1)
    spare[spare] = in_quotes[slot[spare]] & (data[np.flatnonzero(spare)] == data[opened[slot[spare]]])
    chosen &= ~spare
    sizes = np.bincount(slot[chosen], minlength=len(lo)) if len(lo) else np.zeros(0, np.int64)
    child = pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[chosen])))
    per_row = np.bincount(row[lo], minlength=rows) if len(lo) else np.zeros(rows, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)), child), np.flatnonzero(unsure)


def _continues(data: np.ndarray) -> np.ndarray:
    """Bytes that continue a UTF-8 character: a wide blank is one blank."""
    return (data & 0xC0) == 0x80


def _trimmed(lo: np.ndarray, hi: np.ndarray, solid_from: np.ndarray, solid_to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.where(lo < n, solid_from[np.clip(lo, 0, n - 1)], n)
    b = np.where(hi > 0, solid_to[np.clip(hi - 1, 0, n - 1)] + 1, 0)
    a = np.minimum(a, hi)
    return a, np.maximum(np.minimum(b, hi), a)


def scan_field(field: str | None) -> list[str]:
    """The values of one field, read character by character by the same rules."""
    if field is None:
        return []
    blank = lambda c: c.isspace() or c == "﻿"
    trim = lambda s: s.strip().strip("﻿").strip()
    solid = [k for k, c in enumerate(field) if not blank(c)]
    if not solid:
        return []
    s, k, n = field, solid[0], solid[-1] + 1
    pairs = dict(zip(_OPEN.decode(), _CLOSE.decode(), strict=True))
    if n - k >= 2 and pairs.get(s[k]) == s[n - 1] and _closes_last(s[k:n], s[k], s[n - 1]):
        k, n = k + 1, n - 1
    out = []
    # slashes in a run with a blank, a delimiter or an end of the field on either side
    ends = lambda x: not k <= x < n or blank(s[x]) or s[x] in ";,|"
    slashes = {x for run in re.finditer("/+", s[k:n]) if ends(k + run.start() - 1) or ends(k + run.end()) for x in range(k + run.start(), k + run.end())}
    while k < n:
        while k < n and (blank(s[k]) or s[k] in ";,|" or k in slashes):
            k += 1
        if k >= n:
            break
        if s[k] in "\"'":
            mark, value, k = s[k], [], k + 1
            while k < n:
                if s[k] == mark:
                    if k + 1 < n and s[k + 1] == mark:
                        k += 1
                    else:
                        break
                value.append(s[k])
                k += 1
            k += 1
            while k < n and s[k] == "/":
                k += 1
            if trim("".join(value)):
                out.append(trim("".join(value)))
            continue
        first = k
        while k < n and s[k] not in ";,|\t\n\r" and k not in slashes and not (blank(s[k]) and k + 1 < len(s) and blank(s[k + 1])):
            k += 1
        if trim(s[first:k]):
            out.append(trim(s[first:k]))
    return out


def _closes_last(s: str, a: str, b: str) -> bool:
    depth = 0
    for k, c in enumerate(s):
        depth += (c == a) - (c == b)
        if depth == 0:
            return k == len(s) - 1
    return False
