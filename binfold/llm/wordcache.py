"""Ids of whole texts by the tokenizers library, with one library call for each distinct chunk."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from binfold.llm.common import ragged

#: Chunks held at most; the rarer ones are then forgotten, so that memory stays bounded.
CACHE_CHUNKS = 600_000


#: Texts that the library encodes alone: its special strings keep their case, and marks may join the letter before.
_ALONE = r"<\||\p{M}"
#: Bytes of text to look at together: more words repeat in a larger block.
BLOCK = 8 << 20


def _chunks(column: pa.Array) -> pa.Array:
    """Lists of pieces that no token spans. Fewer distinct ones with case and stops set apart: the
    vocabulary is of lower case, and a stop or comma between a letter and a blank is a token of its own."""
    column = pc.ascii_lower(pc.replace_substring(column, "\n", " "))
    return pc.split_pattern(pc.replace_substring_regex(column, r"([a-z])([,.])( |$)", r"\1 \2\3"), " ")


class _Index(dict):
    """Numbers new keys as they are looked up."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordTokenizer:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) does.

    The vocabulary drops white space before its merges, so no token spans a blank or a
    line feed, and a text's ids are those of its chunks, one after another. A chunk may
    hold other white space; the library sees it whole.
    """

    def __init__(self, path: str, cache: int = CACHE_CHUNKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.hits = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the chunks met again and again, half of the table at most."""
        keys = list(self.index)
        order = np.argsort(-self.hits, kind="stable")[: self.cache // 2]
        keep = np.sort(order[self.hits[order] > 1])
        starts, n = self.starts[keep], self.lengths[keep]
        ids = self.ids[ragged(starts, n)]
        self._clear()
        for i in keep.tolist():
            self.index[keys[i]]
        self.index.new = []
        self.ids, self.used = ids, len(ids)
        self.starts, self.lengths, self.hits = np.cumsum(n) - n, n, np.ones(len(keep), np.int64)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        alone = np.fromiter((x.isalpha() for x in new), bool, len(new))
        words, rest = [x for x, y in zip(new, alone.tolist()) if y], [x for x, y in zip(new, alone.tolist()) if not y]
        n = np.zeros(len(new), np.int64)
        joined = self._joined(words)
        if joined is None:
            words, rest, joined, alone = [], new, np.zeros(0, np.uint32), np.zeros(len(new), bool)
        ends = np.flatnonzero(self.ends[joined])
        n[alone] = np.diff(ends, prepend=-1)
        got = [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)]
        n[~alone] = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate([joined, np.fromiter((i for x in got for i in x), np.uint32)])
        order = np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])
        begin = np.zeros(len(new), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        total = len(flat)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, self.used) * 2, np.uint32)])
        self.ids[self.used : self.used + total] = flat
        self.starts = np.concatenate([self.starts, self.used + begin])
        self.lengths = np.concatenate([self.lengths, n])
        self.used += total

    def _joined(self, words: list[str], each: int = 1000) -> np.ndarray | None:
        """Ids of words of letters alone, many in one call: each ends in the one token that marks a word's end."""
        lines = [" ".join(words[i : i + each]) for i in range(0, len(words), each)]
        got = self.library.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter((i for e in got for i in e.ids), np.uint32)
        return ids if int(self.ends[ids].sum()) == len(words) else None

    def encode(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has. `end` is appended to each text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(self.index) > self.cache:
            self._forget()
        alone = np.flatnonzero(pc.match_substring_regex(texts, _ALONE).to_numpy(zero_copy_only=False))
        if len(alone):
            marks = np.zeros(len(texts), bool)
            marks[alone] = True
            singly = [self.library.encode(texts[i].as_py(), add_special_tokens=False).ids for i in alone.tolist()]
            texts = pc.if_else(pa.array(marks), "", texts)
        chunks = _chunks(texts)
        words = chunks.flatten().dictionary_encode()
        known = np.fromiter(map(self.index.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        self._learn()
        inverse = words.indices.to_numpy(zero_copy_only=False)
        seen = np.zeros(len(self.index), np.int64)
        seen[: len(self.hits)] = self.hits
        seen[known] += np.bincount(inverse, minlength=len(known))
        self.hits = seen
        at = known[inverse]
        n = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], n)]
        sums = np.concatenate([[0], np.cumsum(n)])
        edges = chunks.offsets.to_numpy(zero_copy_only=False) - chunks.offsets[0].as_py() if len(chunks) else np.zeros(1, np.int64)
        per = np.diff(sums[edges])
        if len(alone):
            before = np.repeat(np.cumsum(per)[alone], list(map(len, singly)))
            ids = np.insert(ids, before, [i for x in singly for i in x])
            per[alone] = list(map(len, singly))
        if end is not None and len(per):
            ids = np.insert(ids, np.cumsum(per), end)
            per = per + 1
        return ids.astype(np.uint32, copy=False), per


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker process's own tokenizer: its table lasts from task to task."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
