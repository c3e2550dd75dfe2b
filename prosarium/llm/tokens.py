"""Token ids by a byte-level BPE vocabulary, merged in numpy rounds over many words at once."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import spread

#: The split of byte-level BPE into words (fixed value). White space is Unicode White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

LONG_WORD = 512  # bytes; longer words are merged one by one through a heap, which is as exact
MEMORY = 400_000  # words whose ids a worker remembers
ROUND_BYTES = 2_000_000  # bytes that one call of the rounds works on
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Merges:
    """Pair keys (left << 32 | right) in ascending order with the rank and the id of each, and the 256 bytes' ids."""

    keys: np.ndarray
    ranks: np.ndarray
    ids: np.ndarray
    bytes: np.ndarray

    @staticmethod
    def load(path: str) -> Merges:
        """From a tokenizers JSON file of kind BPE with a ByteLevel pre-tokenizer."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys, ids = left << 32 | right, np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        # Byte-level BPE writes a byte as itself where it is a printable character, else as the next free one from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        return Merges(keys[order], order.astype(np.int64), ids[order], np.array([vocab[names[b]] for b in range(256)], np.int64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no merge) and merged ids of pair keys, by binary search."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE), self.ids[at]


def merge_words(words: list[bytes], m: Merges) -> list[list[int]]:
    """Ids of each word. All words' symbols lie in one flat array; a round merges, in every word, all
    places of its lowest-ranked pair, until no word has a pair left."""
    out: list[list[int]] = [[]] * len(words)
    short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = _merge_long(w, m)
    if not short:
        return out
    lengths = np.array([len(words[i]) for i in short])
    symbols = m.bytes[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
    owner = np.repeat(np.arange(len(short)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        ranks, ids = m.find(np.r_[symbols[:-1] << 32 | symbols[1:], 0])
        ranks[np.r_[starts[1:] - 1, len(symbols) - 1]] = NONE  # pairs across words
        sizes = np.diff(np.r_[starts, len(symbols)])
        best = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
        ended = best == NONE
        if ended.any():
            done.append((owner[ended], symbols[ended]))
        places = np.flatnonzero((ranks == best) & ~ended)
        if len(places):
            # Of overlapping places (a pair of equal symbols in a row), every second from the left is merged.
            run = np.flatnonzero(np.r_[True, np.diff(places) != 1])
            first = np.repeat(places[run], np.diff(np.r_[run, len(places)]))
            places = places[(places - first) % 2 == 0]
        symbols[places] = ids[places]
        keep = ~ended
        keep[places + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    who, what = np.concatenate([o for o, _ in done]), np.concatenate([s for _, s in done])
    order = np.argsort(who, kind="stable")
    who, what = who[order], what[order]
    for i, ids in zip(short, np.split(what, np.searchsorted(who, np.arange(1, len(short))))):
        out[i] = ids.tolist()
    return out


def _merge_long(word: bytes, m: Merges) -> list[int]:
    """A very long word, pair by pair in order of rank and place."""
    sym = m.bytes[np.frombuffer(word, np.uint8)].tolist()
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks, _ = m.find(np.array(sym[:-1], np.int64) << 32 | np.array(sym[1:], np.int64))
    heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def look(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            r, i = m.find(np.array([a << 32 | b], np.int64))
            known[a, b] = int(r[0]), int(i[0])
        return known[a, b]

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = look(a, b)[1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := look(sym[i], sym[k])[0]) != NONE:
                heapq.heappush(heap, (r, i, sym[i], sym[k]))
        if (h := before[i]) >= 0 and (r := look(sym[h], sym[i])[0]) != NONE:
            heapq.heappush(heap, (r, h, sym[h], sym[i]))
    return [s for s in sym if s >= 0]


class Encoder:
    """Encodes texts and remembers the ids of words."""

    def __init__(self, merges: Merges):
        self.merges, self.words, self.split = merges, {}, regex.compile(SPLIT)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = []
        todo: list[list[str]] = []
        size = 0
        for t in texts:
            todo.append(self.split.findall(t) if t else [])
            size += len(t or "")
            if size > ROUND_BYTES:
                out += self._encode(todo)
                todo, size = [], 0
        return out + self._encode(todo)

    def _encode(self, docs: list[list[str]]) -> list[list[int]]:
        if len(self.words) > MEMORY:
            self.words = {}
        new = list(dict.fromkeys(w for w in chain.from_iterable(docs) if w not in self.words))
        self.words.update(zip(new, merge_words([w.encode() for w in new], self.merges)))
        look = self.words.__getitem__
        return [list(chain.from_iterable(map(look, d))) for d in docs]


_ENCODERS: dict[int, Encoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """key, ids ARRAY<INT>: the ids of every text without special tokens, whose strings are ordinary text.

    `vocabulary` is the path of a byte-level BPE file at the driver; its merges (a few MB, whatever
    the corpus) are broadcast. Null and empty texts have empty lists. Rows are independent of each
    other, repeated rows are encoded again. A worker keeps the ids of at most MEMORY words.
    """
    merges = Merges.load(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(merges)
    stamp = hash((len(merges.keys), int(merges.keys.sum()), int((merges.keys * merges.ranks).sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(stamp) or _ENCODERS.setdefault(stamp, Encoder(shared.value))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return spread(df.select(F.col(key).cast("long"), F.col(text)), key).mapInArrow(run, f"{key} long, ids array<int>")
