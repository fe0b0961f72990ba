"""Token counts by rank-synchronous merging over ragged arrays.

The pre-tokens of a block of texts, each distinct one once, lie one after another in numpy
arrays of symbols. In each round every sequence applies its own pair of lowest rank, the
leftmost of equals, all at the same time; a sequence without a pair left counts its
symbols. A character outside the vocabulary counts as its UTF-8 bytes.

Vocabulary: a sentencepiece BPE model with byte fallback and the identity normaliser. No
piece spans the place before a blank that follows another character, nor a line feed, so
texts are cut there (the constructor checks that).
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm import common

SPACE = "▁"
#: Sequences longer than this merge on a heap, as one merge a round would take them quadratic time.
LONG = 400
CACHE_WORDS = 600_000
_PRETOKEN = re.compile("\n| +[^ \n]*|[^ \n]+")
#: Ranks lie above places in one number; a pair without a merge has a rank beyond all.
_PLACES, _NONE = np.int64(1 << 36), np.int64(1 << 26)


class MergeCounter:
    def __init__(self, path: str, cache: int = CACHE_WORDS) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces) or library.encode(" a  ½ﬁ ", out_type=str)[-1] != SPACE:
            raise ValueError("the vocabulary's pieces span blanks, or its normaliser changes texts")
        self.symbols: dict[str, int] = {}
        for p in pieces:
            self.symbols.setdefault(p, len(self.symbols))
        self.known = len(self.symbols)
        for p in pieces:
            for c in p:
                self.symbols.setdefault(c, len(self.symbols))
        scores = sorted(set(pieces.values()), reverse=True)
        rank_of = {x: i for i, x in enumerate(scores)}
        n = self.n = len(self.symbols)
        pairs: dict[int, tuple[int, int]] = {}
        for p, score in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (rank_of[score], self.symbols[p])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        # a table by hash of the pair, for one look-up without a search
        self.bits = 21
        slots = np.full(1 << self.bits, len(self.keys), np.int64)
        where = self._slot(self.keys)
        slots[where] = np.arange(len(self.keys))
        self.slots = slots
        self.clashing = np.unique(where[slots[where] != np.arange(len(self.keys))])
        self.clash = np.zeros(1 << self.bits, bool)
        self.clash[self.clashing] = True
        self.cache, self.counts = cache, {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each pair in the table of merges; its end for none."""
        keys = left * self.n + right
        slot = self._slot(keys)
        found = self.slots[slot]
        hit = self.keys[np.minimum(found, len(self.keys) - 1)] == keys
        again = np.flatnonzero(~hit & self.clash[slot])
        found[~hit] = len(self.keys)
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            found[again] = np.where(self.keys[at] == keys[again], at, len(self.keys))
        found[(left < 0) | (right < 0)] = len(self.keys)
        return found

    def _symbols(self, word: str) -> list[int]:
        get = self.symbols.get
        # a character of no piece: less the bytes that it falls back to
        return [get(c) if c in self.symbols else -len(c.encode()) for c in word]

    def _weight(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of a symbol that survives. A character that only longer pieces have falls back to its bytes."""
        out = np.where(symbols < 0, -symbols, 1)
        odd = np.flatnonzero(symbols >= self.known)
        if len(odd):
            names = list(self.symbols)
            out[odd] = [len(names[i].encode()) for i in symbols[odd].tolist()]
        return out

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, which is a pre-token with its blanks as U+2581."""
        counts = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            if len(w) > LONG:
                counts[i] = self._one(w)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        flat = np.array([s for i in short for s in self._symbols(words[i])], np.int64)
        owner = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        found = self._pairs(flat, owner)
        while len(flat):
            # each sequence's lowest rank, and its leftmost place
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(self.ranks[found] * _PLACES + np.arange(len(flat)), first)
            live = best < _NONE * _PLACES
            at = best[live] % _PLACES
            lengths = np.diff(first, append=len(flat))
            if not live.all():
                gone = np.repeat(~live, lengths)
                np.add.at(counts, owner[gone], self._weight(flat[gone]))
            flat[at] = self.merged[found[at]]
            keep = np.repeat(live, lengths)
            keep[at + 1] = False
            # only the pairs on both sides of a merge are new
            changed = np.zeros(len(flat), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            flat, owner, found, changed = flat[keep], owner[keep], found[keep], changed[keep]
            todo = np.flatnonzero(changed)
            if len(todo):
                right = np.minimum(todo + 1, len(flat) - 1)
                new = self._find(flat[todo], flat[right])
                new[(owner[right] != owner[todo]) | (right == todo)] = len(self.keys)
                found[todo] = new
        return counts

    def _pairs(self, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        if not len(flat):
            return np.zeros(0, np.int64)
        found = np.append(self._find(flat[:-1], flat[1:]), len(self.keys))
        found[:-1][owner[:-1] != owner[1:]] = len(self.keys)
        return found

    def _one(self, word: str) -> int:
        """The same merges in the same order for one long sequence."""
        s = self._symbols(word)
        n, after, before = len(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and s[i] >= 0 and s[j] >= 0 and (hit := self.pairs.get(s[i] * self.n + s[j])):
                heapq.heappush(heap, (hit[0], i, s[i], s[j], hit[1]))

        for i in range(n - 1):
            push(i)
        alive = [True] * n
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or s[i] != a or j >= n or s[j] != b:
                continue
            s[i], alive[j], after[i] = to, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return int(self._weight(np.array([x for x, y in zip(s, alive) if y], np.int64)).sum())

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text as the library counts them, without begin or end."""
        if len(self.counts) > self.cache:
            self.counts = {}
        split = [_PRETOKEN.findall(" " + x.replace(SPACE, " ")) if x else [] for x in texts]
        counts = self.counts
        new = list({w for words in split for w in words if w not in counts})
        counts.update(zip(new, self.merge([w.replace(" ", SPACE) for w in new]).tolist()))
        return [sum(map(counts.__getitem__, words)) for words in split]


_loaded: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The worker process's own counter: its table of words lasts from task to task."""
    if path not in _loaded:
        _loaded[path] = MergeCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens; ids may be null or repeat; other
    columns are ignored.
    """

    def work():
        own = counter(model)

        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            found = common.texts(block, "text")
            n = own.count(found)
            return pa.RecordBatch.from_arrays([block.column(0), pa.array([len(x.encode()) for x in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return common.map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", 4 << 20)
