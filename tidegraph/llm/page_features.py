"""Content and link features of pages, for whole Arrow batches.

The bytes of a batch are translated and cut into words by Arrow, words become codes of the batch's dictionary, and every feature is a sum, a
count of distinct codes or a sorted window over all pages at once. Only the distinct words of a batch are looked up in the lexicon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 20
PIECE_BYTES = 2 << 20
LEXICAL = ("filler_windows", "filler_half", "mean_odds", "low_odds", "spam_words", "page_words")
PLAIN = (
    "number_words", "distinct_words", "distinct_pairs", "top_word", "links", "link_text", "tags", "sentence_ends", "words_a_line", "words_an_item", "numbered_items", "log_words",
)
FEATURES = LEXICAL + PLAIN
#: A link or an address of a site: a scheme, a mark of one, an address with a path or port, or one under an ending that words don't have.
_LINK = r"://|www\.|href|[a-z0-9-]\.[a-z]{2,}(:[0-9]+)?/[a-z0-9]|\.(com|org|net|info|biz|test|example|invalid)\b"
#: ASCII punctuation parts words; bytes beyond ASCII stay in them.
_TO_WORDS = np.array([32 if c < 128 and not chr(c).isalnum() else c for c in range(256)], np.uint8)
_PARTS_ITEMS = np.isin(np.arange(256), np.frombuffer(b"\n;,|\t\r", np.uint8))
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \x0b\x0c", np.uint8))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of pieces of about ``PIECE_BYTES``, or of one page if that is larger."""
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PIECE_BYTES, side="right")))
        yield begin, end - begin
        begin = end


class Pages:
    """The words of the pages of a piece: their codes, pages and the dictionary."""

    def __init__(self, texts: pa.Array):
        self.raw = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
        self.n = len(self.raw)
        self.off = np.frombuffer(self.raw.buffers()[1], np.int64)[self.raw.offset : self.raw.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        size = int(self.off[-1] - self.off[0])
        self.data = np.frombuffer(self.raw.buffers()[2], np.uint8)[self.off[0] : self.off[-1]] if size else np.zeros(0, np.uint8)
        self.off = self.off - self.off[0]
        spaced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.off.astype(np.int64)), pa.py_buffer(_TO_WORDS[self.data])])
        self.page, self.code, self.words = _coded(spaced.cast(pa.large_string()))
        self.count = np.bincount(self.page, minlength=self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.page, weights=values, minlength=self.n)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Page and code of each word between blanks, and the words by code."""
    lists = pc.ascii_split_whitespace(texts)
    page, flat = np.asarray(pc.list_parent_indices(lists)), lists.flatten()
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return page[some], np.asarray(coded.indices).astype(np.int64), coded.dictionary


def lexical(p: Pages, odds: dict[bytes, float]) -> np.ndarray:
    """The features that rest on the log odds of words, by page."""
    known = np.array([odds.get(w, 0.0) for w in p.words.cast(pa.large_binary()).to_pylist()])
    score = known[p.code] if len(p.code) else np.zeros(0)
    some = np.flatnonzero(p.count)
    out = np.zeros((p.n, len(LEXICAL)))
    if not len(some):
        return out
    n = p.count[some]
    windows = np.maximum(1, n // WINDOW)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(some)), windows)
    nth = np.arange(len(of)) - (np.cumsum(windows) - windows)[of]
    begin = first[of] + nth * n[of] // windows[of]
    mean = np.add.reduceat(score, begin) / np.diff(np.append(begin, len(score)))
    share = lambda hit: np.bincount(of[hit], minlength=len(some)) / windows
    low = mean[np.lexsort((mean, of))][np.cumsum(windows) - windows + 3 * windows // 10]
    sums = [p.sums(v)[some] / n for v in (score, score > 1, score < -1)]
    out[some] = np.stack([share(mean > 0.3), share(mean > 0.7), sums[0], low, sums[1], sums[2]], axis=1)
    return out


def plain(p: Pages) -> np.ndarray:
    """The features that need no lexicon, by page; all 0 for a page without words."""
    n = np.maximum(p.count, 1)
    log_n = np.maximum(np.log1p(n), 1e-9)
    digit = np.asarray(pc.utf8_is_digit(p.words)) if len(p.words) else np.zeros(0, bool)
    unique = max(1, len(p.words))
    once, times = _distinct(p.page * unique + p.code)
    of = once // unique
    distinct = np.bincount(of, minlength=p.n)
    top = np.zeros(p.n)
    top[distinct > 0] = np.maximum.reduceat(times, (np.cumsum(distinct) - distinct)[distinct > 0]) if len(times) else 0
    same = p.page[1:] == p.page[:-1]
    pairs = _distinct(((p.page[1:] * unique + p.code[1:]) * unique + p.code[:-1])[same])[0] // unique // unique
    tokens_page, token, tokens = _coded(p.raw)
    link = np.asarray(pc.match_substring_regex(tokens, _LINK)) if len(tokens) else np.zeros(0, bool)
    size = np.asarray(pc.binary_length(tokens)) if len(tokens) else np.zeros(0)
    on_link = link[token] if len(token) else np.zeros(0, bool)
    links = np.bincount(tokens_page[on_link], minlength=p.n)
    link_text = np.bincount(tokens_page[on_link], weights=size[token[on_link]], minlength=p.n)
    count = lambda *marks: sum(_marks(p, *m) for m in marks)
    items, numbered = _items(p)
    out = np.stack([
        p.sums(digit[p.code] if len(p.code) else np.zeros(0)) / n, np.log1p(distinct) / log_n, np.log1p(np.bincount(pairs, minlength=p.n)) / log_n, top / n,
        links / n, link_text / np.maximum(np.diff(p.off), 1), count((b"#", 0), (b"tag:", 3), (b"sku", 1)) / n, count((b". ", 0), (b".\n", 0), (b"? ", 0)) / n,
        np.minimum(1, n / (1 + count((b"\n", 0))) / 50), np.minimum(1, n / items / 25), numbered / items, np.log1p(n),
    ], axis=1)
    out[p.count == 0] = 0
    return out


def _marks(p: Pages, mark: bytes, rare: int) -> np.ndarray:
    """How often ``mark``, whose byte ``rare`` is seldom, stands in each page."""
    at = np.flatnonzero(p.data == mark[rare]) - rare
    at = at[(at >= 0) & (at + len(mark) <= len(p.data))]
    for k, byte in enumerate(mark):
        at = at[p.data[at + k] == byte]
    page = np.searchsorted(p.off, at, "right") - 1
    return np.bincount(page[at + len(mark) <= p.off[page + 1]], minlength=p.n)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def _items(p: Pages) -> tuple[np.ndarray, np.ndarray]:
    """How many items (parted by line ends, ``; , |``, bullets and dashes or slashes between blanks) a page has, and how many begin with a digit."""
    d, page = p.data, np.repeat(np.arange(p.n), np.diff(p.off))
    parts = _PARTS_ITEMS[d]
    if len(d) > 2:
        here = page[:-2] == page[2:]
        parts[1:-1] |= here & (d[:-2] == 32) & (d[2:] == 32) & ((d[1:-1] == 0x2D) | (d[1:-1] == 0x2F))
        parts[2:] |= here & (d[:-2] == 0xE2) & (d[1:-1] == 0x80) & (d[2:] == 0xA2)
    heads, seps = p.off[:-1][np.diff(p.off) > 0], np.flatnonzero(parts)
    begin, of = np.concatenate([heads, seps + 1]), page[np.concatenate([heads, seps])]
    # the first byte of an item that isn't blank, if the page has one there
    solid = np.append(np.flatnonzero(~_BLANK[d]), len(d))
    at = np.append(d, 0)[solid[np.searchsorted(solid, begin)]]
    same = np.append(page, -1)[solid[np.searchsorted(solid, begin)]] == of
    return 1 + np.bincount(page[parts], minlength=p.n), np.bincount(of[same & (at >= 48) & (at <= 57)], minlength=p.n)
