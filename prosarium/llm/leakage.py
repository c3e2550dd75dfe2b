"""Evaluation items that leak into documents.

Words are hashed with weights into 64-bit SimHash fingerprints of item-sized windows: about as many
words as the least part of the item that counts as a leak. Every window of a document is looked up in
a multi-index of the items' windows: BLOCKS groups of bits, of which by the pigeonhole principle one
differs in at most RADIUS // BLOCKS bits, so every fingerprint within RADIUS is found. What is found
is a candidate alignment of a document and an item; candidates are checked exactly, first by the weight
of the item's shingles within reach, then by aligning the word sequences.

Fingerprints of texts that differ in every fifth word may lie further apart than any radius that can be
indexed. For these worst cases the runs of words that such a leak must leave untouched are looked up, too.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import TAG, spread

LEAST = 0.4  # part of an item's words that a leak holds
CHANGED = 0.2  # part of a stretch's words that may be changed, added or missing
RADIUS = 7
BLOCKS = 4
BITS = 64 // BLOCKS
BLOCK_WORDS = 400_000  # words of items whose index one pass over the documents carries
CHUNK_WORDS = 150_000  # words of documents worked on at once

_MARKUP = re.compile(rf"{TAG}|<\|\w+\|>")
#: Letters that are written as two (fixed values); accents go by decomposition.
_TWO = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d"}
#: Characters that are words by themselves.
_ONE_EACH = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_ONE_EACH}]|[^\W_{_ONE_EACH}]+")


@cache
def _unseen() -> frozenset[str]:
    """Combining marks and invisible characters beyond ASCII."""
    return frozenset(chr(c) for c in range(0xA0, 0xE01F0) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf", "Cc"))


def words_of(text: str) -> list[str]:
    """Words without case, accents, punctuation, white space, mark-up and invisible characters; in
    Chinese and Japanese each character is one."""
    text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        for mark in _unseen().intersection(text):  # few in any text
            text = text.replace(mark, "")
        for one, two in _TWO.items():
            text = text.replace(one, two)
    else:
        text = text.lower()
    return _WORD.findall(text)


def _bits(word: str) -> np.ndarray:
    """+1 or -1 for each of 64 bits, the same in every process."""
    h = (zlib.crc32(word.encode()) << 32) | zlib.crc32(b"\x01" + word.encode())
    h = (h * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    h = (h * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 32
    return np.unpackbits(np.array([h], ">u8").view(np.uint8)).astype(np.int16) * 2 - 1


def running_sums(vectors: np.ndarray, rows: int = 256) -> np.ndarray:
    """Sums of the words' weighted bit vectors (n x 64) before each word and before the end; all parts of
    `rows` words are summed side by side, as numpy is slow along the first axis."""
    n = len(vectors)
    parts = np.zeros((-(-n // rows) * rows + 1, 64), np.int32)
    parts[1 : n + 1] = vectors
    side = parts[1:].reshape(-1, rows, 64)
    for i in range(1, rows):
        side[:, i] += side[:, i - 1]
    side[1:] += np.cumsum(side[:-1, -1], axis=0)[:, None]
    return parts[: n + 1]


def fingerprints(sums: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of `width` words, from their running sums."""
    if len(sums) <= width:
        return np.zeros(0, np.uint64)
    return np.packbits(sums[width:] > sums[:-width], axis=1).view(">u8").ravel().astype(np.uint64)


@dataclass
class Items:
    """Index of a block of items."""

    ids: list[int]
    words: list[list[str]]
    vocabulary: dict[str, int] = field(init=False)
    weights: np.ndarray = field(init=False)
    codes: list[np.ndarray] = field(init=False)
    index: dict[int, _Index] = field(init=False)
    runs: dict[int, _Runs] = field(init=False)

    def __post_init__(self) -> None:
        seen: dict[str, set[int]] = {}
        for i, ws in enumerate(self.words):
            for w in ws:
                seen.setdefault(w, set()).add(i)
        self.vocabulary = {w: i + 1 for i, w in enumerate(seen)}  # 0: a word of no item
        # Rare words weigh more; odd numbers, so that no sum of bits is zero in windows of odd width.
        n = len(self.words)
        self.weights = np.array([5, *(1 + 2 * int(np.log2(n / len(seen[w]) + 1)) for w in seen)], np.int16)
        self.codes = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in self.words]
        self.vectors = np.zeros((len(seen) + 1, 64), np.int16)
        for w, k in self.vocabulary.items():
            self.vectors[k] = _bits(w) * self.weights[k]
        sized: dict[int, list[tuple[int, np.ndarray]]] = {}
        short: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, c in enumerate(self.codes):
            if len(c):
                sums = running_sums(self.vectors[c])
                for windows, width in ((sized, window_width(len(c))), (short, run_width(len(c)))):
                    windows.setdefault(width, []).append((i, fingerprints(sums, width)))
        self.index = {w: _Index(found) for w, found in sized.items()}
        self.runs = {w: _Runs(found) for w, found in short.items()}
        size = len(seen) + 1
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.least_hits = np.array([least_hits(len(c)) for c in self.codes], np.int64)
        self.bands = int(CHANGED * self.lengths.max(initial=0) + 1e-9) // 8 + 1  # bands of 8 diagonals that a leak's changes can reach
        # Two-word shingles of items, each item's in order of place, and their weights: rare ones weigh more.
        by_item = [c[:-1].astype(np.int64) * size + c[1:] for c in self.codes]
        self.shingles, spread_over = np.unique(np.concatenate([*(np.unique(g) for g in by_item), np.zeros(0, np.int64)]), return_counts=True)
        self.places = [np.searchsorted(self.shingles, g) for g in by_item]
        self.shingle_weights = np.append(1 + np.round(4 * np.log2(n / spread_over)).astype(np.int64) if n else np.zeros(0, np.int64), 0)
        self.least_weights = [least_weights(self.shingle_weights[g], len(c)) for g, c in zip(self.places, self.codes)]

    def shingle_codes(self, codes: np.ndarray) -> np.ndarray:
        """Number of the shingle that starts at each word; the last number for those of no item."""
        none = len(self.shingles)
        if none == 0 or len(codes) < 2:
            return np.full(len(codes), none, np.int64)
        key = codes[:-1].astype(np.int64) * (len(self.vocabulary) + 1) + codes[1:]
        at = np.minimum(np.searchsorted(self.shingles, key), none - 1)
        return np.append(np.where(self.shingles[at] == key, at, none), none)


@cache
def stretches(words: int) -> list[tuple[int, int]]:
    """(k, e): lengths of leaks of an item and the changes they may hold, from the least length on, each
    time one more change is allowed. Lengths between have the changes of the one before and keep more."""
    out: list[tuple[int, int]] = []
    for k in range(max(1, int(np.ceil(LEAST * words - 1e-9))), max(1, words) + 1):
        e = int(CHANGED * k + 1e-9)
        if not out or e > out[-1][1]:
            out.append((k, e))
    return out


def window_width(words: int) -> int:
    """Width of an item's windows: the least length of a leak, rounded down to a ladder of widths with
    ratio 3/2, so that a document is fingerprinted in few widths however many lengths the items have."""
    least, width = stretches(words)[0][0], 1
    while (wider := max(width + 1, width * 3 // 2)) <= least:
        width = wider
    return width


def run_width(words: int) -> int:
    """Longest run that the changes must leave untouched in a leak of any length."""
    return max(1, min(-(-(k - e) // (e + 1)) for k, e in stretches(words)))


def least_hits(words: int) -> int:
    """Fewest runs of run_width without a change in a leak of any length: k - w + 1 but for w per change."""
    w = run_width(words)
    return max(1, min(k - w + 1 - w * e for k, e in stretches(words)))


def least_weights(weights: np.ndarray, words: int) -> np.ndarray:
    """For each of an item's stretches() the least weight of shingles that a leak of this length keeps, wherever it
    begins: e changes take 2e shingles at most, in the worst case the heaviest."""
    out = []
    for k, e in stretches(words):
        if k - 1 <= 2 * e:
            out.append(0)
            continue
        parts = np.sort(np.lib.stride_tricks.sliding_window_view(weights, k - 1), axis=1)
        out.append(int(parts[:, : k - 1 - 2 * e].sum(axis=1).min()))
    return np.array(out, np.int64)


class _Runs:
    """Places of item windows by fingerprint."""

    def __init__(self, found: list[tuple[int, np.ndarray]]):
        prints = np.concatenate([f for _, f in found])
        item = np.concatenate([np.full(len(f), i, np.int64) for i, f in found])
        place = np.concatenate([np.arange(len(f)) for _, f in found])
        self.prints, inverse = np.unique(prints, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.item, self.place = item[order], place[order]
        self.begin = np.searchsorted(inverse[order], np.arange(len(self.prints) + 1))

    def equal(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, number in self.prints) of equal fingerprints."""
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        who = np.flatnonzero(self.prints[at] == prints)
        return who, at[who]

    def places(self, who: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in prints, item, place in item) of pairs (place in prints, number in self.prints)."""
        lo, n = self.begin[which], self.begin[which + 1] - self.begin[which]
        rows = _spans(lo, n)
        return np.repeat(who, n), self.item[rows], self.place[rows]

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.places(*self.equal(prints))


class _Index(_Runs):
    """Fingerprints of item windows, found by any of BLOCKS groups of bits within RADIUS // BLOCKS bits."""

    def __init__(self, found: list[tuple[int, np.ndarray]]):
        super().__init__(found)
        near = np.array([sum(1 << b for b in flipped) for k in range(RADIUS // BLOCKS + 1) for flipped in combinations(range(BITS), k)], np.int64)
        self.blocks = []
        for b in range(BLOCKS):
            part = (self._part(self.prints, b)[:, None] ^ near).ravel()
            o = np.argsort(part, kind="stable")
            self.blocks.append(((o // len(near)).astype(np.int32), np.searchsorted(part[o], np.arange((1 << BITS) + 1)).astype(np.int32)))

    @staticmethod
    def _part(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * BITS) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in prints, item, place in item) of all windows within RADIUS bits."""
        pairs = []
        for b, (order, begin) in enumerate(self.blocks):
            part = self._part(prints, b)
            lo, n = begin[part], begin[part + 1] - begin[part]
            who = np.repeat(np.arange(len(prints), dtype=np.int32), n)
            which = order[_spans(lo, n)]
            close = np.flatnonzero(np.bitwise_count(prints[who] ^ self.prints[which]) <= RADIUS)
            pairs.append(who[close].astype(np.int64) * len(self.prints) + which[close])
        pairs = np.unique(np.concatenate(pairs))
        return self.places(pairs // len(self.prints), pairs % len(self.prints))


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges [lo, lo + n) one after the other."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Scanner:
    """Finds (document number, item number) pairs in batches of documents."""

    def __init__(self, items: Items):
        self.items = items
        self.others: dict[str, np.ndarray] = {}

    def scan(self, docs: list[list[str]]) -> list[tuple[int, int]]:
        it = self.items
        lengths = np.array([len(d) for d in docs], np.int64)
        n = int(lengths.sum())
        if not n or not it.index:
            return []
        start = np.cumsum(lengths) - lengths
        flat = list(chain.from_iterable(docs))
        codes = np.array(list(map(it.vocabulary.get, flat, repeat(0))), np.int32)
        # Words of no item get a row of their own each, after the items' words.
        outside = np.flatnonzero(codes == 0)
        unknown = [flat[i] for i in outside.tolist()]
        extra = {w: k for k, w in enumerate(dict.fromkeys(unknown))}
        rows = codes.astype(np.int64)
        rows[outside] = len(it.vectors) + np.array(list(map(extra.__getitem__, unknown)), np.int64)
        if len(self.others) > 200_000:
            self.others = {}
        more = np.zeros((len(extra), 64), np.int16)
        for w, k in extra.items():
            v = self.others.get(w)
            if v is None:
                v = self.others[w] = _bits(w) * it.weights[0]
            more[k] = v
        vectors = np.concatenate([it.vectors, more]) if len(extra) else it.vectors
        owner = np.repeat(np.arange(len(docs)), lengths)
        sums = running_sums(vectors[rows])
        keys = []
        for width, index in [*it.index.items(), *it.runs.items()]:
            prints = fingerprints(sums, width)
            whole = np.flatnonzero(owner[: len(prints)] == owner[width - 1 :])  # windows within one document
            who, item, place = index.find(prints[whole])
            at = whole[who]
            # One candidate per document, item and band of diagonals.
            diagonal = at - start[owner[at]] - place
            band = (diagonal + (1 << 30)) // 8
            key, hits = np.unique((owner[at] * len(it.ids) + item) * (1 << 31) + band, return_counts=True)
            if not isinstance(index, _Index):
                # All runs that a leak keeps lie within reach of its diagonal.
                near = sum(_at(key, hits, key + k) for k in range(-it.bands, it.bands + 1))
                key = key[near >= it.least_hits[(key >> 31) % len(it.ids)]]
            keys.append(key)
        key = np.unique(np.concatenate(keys))
        if not len(key):
            return []
        pair, diagonal = key >> 31, ((key & ((1 << 31) - 1)) * 8) - (1 << 30)
        doc, item = pair // len(it.ids), pair % len(it.ids)
        good = self._weigh(codes, start, lengths, doc, item, diagonal)
        at_once: dict[tuple[int, int], list[int]] = {}
        for d, i, diag in zip(doc[good].tolist(), item[good].tolist(), diagonal[good].tolist()):
            at_once.setdefault((d, i), []).append(diag)
        pairs, spans = [], []
        for (d, i), diags in at_once.items():
            doc = codes[start[d] : start[d] + lengths[d]]
            for lo, hi in self._spans(len(doc), i, diags):
                pairs.append((d, i))
                spans.append((it.codes[i], doc[lo:hi]))
        return sorted({p for p, ok in zip(pairs, hold_stretches(spans)) if ok})

    def _weigh(self, codes: np.ndarray, start: np.ndarray, lengths: np.ndarray, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Similarity by weighted shingles, as a necessary condition: within reach of the candidate's diagonal a stretch of
        k words with e changes keeps shingles of the weight in Items.least_weights and k - e of the item's words in
        k + e words, as words may be added; a candidate needs them for some k."""
        it = self.items
        out = np.zeros(len(doc), bool)
        shingles, words = np.append(it.shingle_codes(codes), len(it.shingles)), np.append(codes, 0)
        order = np.lexsort((item, it.lengths[item]))
        for mine in np.split(order, np.flatnonzero(np.diff(it.lengths[item[order]])) + 1):
            n = int(it.lengths[item[mine[0]]]) if len(mine) else 0
            reach = int(CHANGED * n) + 9
            size = n + 2 * reach
            # Parts of bounded size, with the words and shingles of few items as tables.
            fresh = np.cumsum(np.append(True, np.diff(item[mine]) != 0)) - 1 if len(mine) else mine
            part_of = np.maximum(np.arange(len(mine)) * size // 4_000_000, fresh * (len(it.vectors) + len(it.shingles)) // 16_000_000)
            for part in np.split(mine, np.flatnonzero(np.diff(part_of)) + 1):
                if not len(part):
                    continue
                items, who = np.unique(item[part], return_inverse=True)
                has_word, weight = np.zeros((len(items), len(it.vectors)), bool), np.zeros((len(items), len(it.shingles) + 1), np.int32)
                for row, i in enumerate(items):
                    has_word[row, it.codes[i]] = True
                    weight[row, it.places[i]] = it.shingle_weights[it.places[i]]
                at = (diagonal[part] - reach)[:, None] + np.arange(size)
                inside = (at >= 0) & (at < lengths[doc[part]][:, None])
                at = np.where(inside, at + start[doc[part]][:, None], len(codes))
                lengths_of = stretches(n)
                single = _sums(has_word[who[:, None], words[at]])
                # What has too few words or shingles in all has too few in any part.
                some = np.flatnonzero(single[:, -1] >= min(k - e for k, e in lengths_of))
                pairs = _sums(weight[who[some][:, None], shingles[at[some]]])
                least = np.stack([it.least_weights[i] for i in items])[who[some]]
                enough = pairs[:, -1] >= least.min(axis=1)
                some, pairs, least = some[enough], pairs[enough], least[enough]
                if not len(some):
                    continue
                single = single[some]
                for j, (k, e) in enumerate(lengths_of):
                    w = min(size, k + e)
                    out[part[some]] |= (_densest(pairs, w) >= least[:, j]) & (_densest(single, w) >= k - e)
        return out

    def _spans(self, size: int, i: int, diagonals: list[int]) -> list[tuple[int, int]]:
        """Parts of a document to align with item i; neighbouring bands come together, in parts that overlap
        by more than a leak can take, so that no part grows with the document."""
        n = int(self.items.lengths[i])
        reach = int(CHANGED * n) + 9
        spans: list[tuple[int, int]] = []
        for d in sorted(diagonals):
            lo, hi = max(0, d - reach), min(size, d + 8 + n + reach)
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], hi)
            else:
                spans.append((lo, hi))
        leak = n + 2 * reach
        return [(at, min(hi, at + 4 * leak)) for lo, hi in spans for at in range(lo, max(lo + 1, hi - leak), 3 * leak)]


def _sums(hit: np.ndarray) -> np.ndarray:
    """Hits or weights before each place and before the end, by row."""
    total = np.zeros((hit.shape[0], hit.shape[1] + 1), np.int32)
    np.cumsum(hit, axis=1, out=total[:, 1:])
    return total


def _densest(total: np.ndarray, width: int) -> np.ndarray:
    """Most hits in any `width` neighbouring places, by row, from their sums."""
    return (total[:, width:] - total[:, :-width]).max(axis=1)


def hold_stretches(pairs: list[tuple[np.ndarray, np.ndarray]], together: int = 64) -> list[bool]:
    """Exact check of (item words, document words): some stretch of at least LEAST of the item's words
    stands in the document, in order, with at most CHANGED of the stretch's words changed, added or missing.

    A local alignment (a match earns 1, a change, addition or omission costs 1) gives the best chain of
    matching words; every part of the chain is then held against both limits. Pairs of like
    size are aligned together, row by row. Where no part holds but the score would do for some
    stretch, all other chains are looked at, too.
    """
    out = [False] * len(pairs)
    order = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        # Long documents are aligned alone, so that the scores stay within some MB.
        take = max(1, min(together, 4_000_000 // (max(len(pairs[k][0]) for k in order[at : at + together]) * len(pairs[order[min(at + together, len(order)) - 1]][1]) + 1)))
        batch = order[at : at + take]
        at += take
        for k, chain in zip(batch, _chains([pairs[k][0] for k in batch], [pairs[k][1] for k in batch])):
            n = len(pairs[k][0])
            out[k] = _within_limits(chain, n) or (_score(chain) >= min(length - 2 * e for length, e in stretches(n)) and _any_stretch(*pairs[k]))
    return out


def _chains(items: list[np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """Places (item, document) of the matching words of each pair's best local alignment."""
    size, n, m = len(items), max(map(len, items)), max(map(len, docs))
    a, b = np.full((size, n), -2, np.int32), np.full((size, m), -1, np.int32)
    for k, (x, y) in enumerate(zip(items, docs)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    score = np.zeros((n + 1, size, m + 1), np.int32)
    steps = np.arange(m + 1, dtype=np.int32)
    for r in range(1, n + 1):
        row = score[r]
        np.maximum(score[r - 1, :, :-1] + np.where(b == a[:, r - 1 : r], np.int32(1), np.int32(-1)), score[r - 1, :, 1:] - 1, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        # Additions cost 1 each along the row: a running maximum of row + place, minus place.
        np.maximum(np.maximum.accumulate(row + steps, axis=1) - steps, 0, out=row)
    flat = score.transpose(1, 0, 2).reshape(size, -1).argmax(axis=1)
    r, c = flat // (m + 1), flat % (m + 1)
    who = np.arange(size)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        live = (r > 0) & (c > 0)
        live[live] = score[r[live], who[live], c[live]] > 0
        who, r, c = who[live], r[live], c[live]
        if not len(who):
            break
        s = score[r, who, c]
        same = a[who, r - 1] == b[who, c - 1]
        across = s == score[r - 1, who, c - 1] + np.where(same, 1, -1)
        down = ~across & (s == score[r - 1, who, c] - 1)
        hit = across & same
        found.append((who[hit], r[hit] - 1, c[hit] - 1))
        r, c = r - (across | down), c - ~down
    if not found:
        return [np.zeros((0, 2), np.int64)] * size
    owner, i, j = (np.concatenate([f[k] for f in found])[::-1] for k in range(3))
    return [np.stack([i[owner == k], j[owner == k]], axis=1) for k in range(size)]


def _within_limits(chain: np.ndarray, n: int) -> bool:
    if not len(chain):
        return False
    changes = np.concatenate([[0], np.cumsum(np.maximum(np.diff(chain[:, 0]), np.diff(chain[:, 1])) - 1)])
    length = chain[None, :, 0] - chain[:, None, 0] + 1
    wrong = changes[None, :] - changes[:, None]
    return bool(((length >= LEAST * n - 1e-9) & (wrong <= CHANGED * length + 1e-9)).any())


def _score(chain: np.ndarray) -> int:
    return 2 * len(chain) - 1 - int(np.maximum(np.diff(chain[:, 0]), np.diff(chain[:, 1])).sum()) if len(chain) else 0


def _any_stretch(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any chain of matching words is within the limits: from every item word that could begin
    one, the fewest changes to every match that could end it, row by row for all beginnings at once."""
    n, size = len(a), len(b)
    steps, far = np.arange(size + 1, dtype=np.int32), np.int32(1 << 28)
    least = stretches(n)[0][0]
    together = max(1, 4_000_000 // (size + 1))
    for first in range(0, n - least + 1, together):
        until = min(first + together, n - least + 1)
        cost = np.zeros((0, size + 1), np.int32)  # by beginning and words of b so far
        begun = np.zeros(0, np.int64)
        for i in range(first, n):
            same = b == a[i]
            length = i - begun + 1
            ends = cost[:, :-1][:, same].min(axis=1, initial=far)
            if ((length >= least) & (ends <= CHANGED * length + 1e-9)).any() or (least == 1 and same.any()):
                return True
            new = np.full_like(cost, far)
            np.minimum(cost[:, :-1] + np.where(same, np.int32(0), np.int32(1)), cost[:, 1:] + 1, out=new[:, 1:])
            if i < until:
                new = np.concatenate([new, np.where(np.append(False, same), np.int32(0), far)[None]])
                begun = np.append(begun, i)
            # Additions cost 1 each along the row.
            cost = np.minimum.accumulate(new - steps, axis=1) + steps
            live = cost.min(axis=1) <= CHANGED * (n - begun) + 1e-9
            cost, begun = cost[live], begun[live]
            if i >= until and not len(begun):
                break
    return False


def _at(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the wanted keys, 0 for those that aren't there; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def leaked_items(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc, item: one row per document and item that it gives away.

    Items are read in blocks of at most about `block_words` words, whose index is broadcast; the
    documents are scanned once per block, whole texts, without any shuffle. The number of blocks
    follows the items' total length, so any number of items can be given. Items and documents
    whose text is null, empty or without words have no rows; equal items are all reported; repeated
    documents are all scanned. One long text is aligned only around its candidates.
    """
    # A word and its space take two characters at least, but for scripts whose characters are words.
    most = (F.length(item_text) + F.regexp_count(item_text, F.lit(f"[{_ONE_EACH}]"))) / 2
    total = items.agg(F.coalesce(F.sum(most), F.lit(0))).first()[0]
    blocks = int(total) // block_words + 1
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b).where(F.col(item_text).isNotNull()).select(item, item_text).collect()
        known = Items([int(r[0]) for r in rows], [words_of(r[1]) for r in rows])
        part = _scan(documents, doc, text, known, item)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(documents: DataFrame, doc: str, text: str, items: Items, item: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([(doc, pa.int64()), (item, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scanner = Scanner(known)
        ids: list[int] = []
        docs: list[list[str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, size
            found = scanner.scan(docs)
            batch = pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in found], pa.int64()), pa.array([known.ids[i] for _, i in found], pa.int64())], schema=schema)
            ids, docs, size = [], [], 0
            return batch

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(k)
                docs.append(words_of(t.as_py()))
                size += len(docs[-1])
                if size > CHUNK_WORDS:
                    yield flush()
        yield flush()

    return spread(documents.where(F.length(text) > 0).select(F.col(doc).cast("long"), F.col(text)), doc).mapInArrow(run, f"{doc} long, {item} long")
