"""Packing documents into windows of at most `limit` tokens by Karmarkar-Karp differencing.

A document's ids are cut into pieces: as many whole windows as it fills, and a rest. Rests
are gathered in groups of bounded size, the longest cut to small pieces, and dealt to
m = ceil(tokens / limit) windows: each rest begins as a partial partition of its own, and the
two partitions of the largest spread are merged again and again with opposing imbalances, the
fullest window of one to the emptiest of the other. If a window exceeds the limit, m rises by
one and the group is dealt anew. What a group has beyond whole windows waits for the next one;
a task's last group ends in windows whose sizes are powers of two, which need no padding.

Null and empty texts have the end id alone. Repeated rows and identifiers are documents of
their own; null identifiers stay null. Other columns are ignored. Window ids are unique and
grow within a task; they aren't dense.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm import common
from binfold.llm.wordcache import BLOCK, word_tokenizer

LIMIT = 4096
#: Rests dealt together: the differencing takes time in proportion to rests times windows.
GROUP = 768
#: The longest rests of a group are cut to pieces of so many tokens, one a window or so, which even the windows out.
GRAIN = 32
#: Tokens that a window of a group may fall short of the limit by, so that the differencing has room.
SLACK = 20


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: indexes of `sizes` in m near-equal windows."""
    # a partition: its windows' sums in ascending order, less the least of them, and the members of each
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(m, np.int64)
        sums[-1] = n
        heap.append((-n, i, sums, {m - 1: (i, None, None)}))
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        members = {int(place[w]): t for w, t in in_a.items()}
        for w, t in in_b.items():
            at = int(place[m - 1 - w])
            members[at] = (None, members[at], t) if at in members else t
        sums = sums[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), tie, sums, members))
        tie += 1
    out: list[list[int]] = [[] for _ in range(m)]
    for w, tree in (heap[0][3] if heap else {}).items():
        todo = [tree]
        while todo:
            i, x, y = todo.pop()
            if i is None:
                todo += [x, y]
            else:
                out[w].append(i)
    return out


def windows(sizes: list[int], limit: int) -> list[list[int]]:
    """As few windows of at most `limit` as the differencing gets to; their number rises while one is too full."""
    m = -(-sum(sizes) // limit)
    while True:
        out = difference(sizes, m)
        if all(sum(sizes[i] for i in w) <= limit for w in out):
            return [sorted(w) for w in out if w]
        m += 1


class Packer:
    """Packs the documents of a task as they come."""

    def __init__(self, limit: int, group: int, first: int) -> None:
        self.limit, self.group, self.window = limit, group, first
        self.rests: list[tuple] = []
        self.rows: list[tuple] = []

    def _piece(self, doc_id: int | None, ids: np.ndarray, start: int, end: int, window: int, offset: int) -> None:
        self.rows.append((doc_id, start, end - start, zlib.crc32(ids[start:end].astype("<u4").tobytes()), len(ids), window, offset))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.limit * self.limit
        for at in range(0, whole, self.limit):
            self._piece(doc_id, ids, at, at + self.limit, self.window, 0)
            self.window += 1
        if whole < len(ids):
            # the rest's ids, and as if they stood at their place in the document
            self.rests.append((doc_id, ids[whole:].copy(), whole, len(ids)))
            if len(self.rests) >= self.group:
                kept = self._set_apart()
                self._deal(self.rests)
                self.rests = kept

    def _set_apart(self) -> list[tuple]:
        """Takes from the rests what they have beyond whole windows with their slack: pieces of the last documents."""
        total = sum(len(r[1]) for r in self.rests)
        spare, out = total - total // self.limit * (self.limit - min(SLACK, self.limit // 8)), []
        while spare > 0:
            doc_id, ids, whole, length = self.rests.pop()
            n = min(len(ids), spare)
            if n < len(ids):
                self.rests.append((doc_id, ids[: len(ids) - n], whole, length))
            out.append((doc_id, ids[len(ids) - n :], whole + len(ids) - n, length))
            spare -= n
        return out

    def _rest(self, rest: tuple, a: int, b: int, offset: int) -> None:
        doc_id, ids, whole, total = rest
        self.rows.append((doc_id, whole + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), total, self.window, offset))

    def _deal(self, rests: list[tuple]) -> None:
        order = sorted(range(len(rests)), key=lambda i: len(rests[i][1]))
        m, grains = -(-sum(len(r[1]) for r in rests) // self.limit), []
        while order and len(grains) < m > 1:
            i = order.pop()
            grains += [(i, a, min(a + GRAIN, len(rests[i][1]))) for a in range(0, len(rests[i][1]), GRAIN)]
        pieces = [(i, 0, len(rests[i][1])) for i in sorted(order)] + grains
        for members in windows([b - a for _, a, b in pieces], self.limit):
            offset = 0
            for i, a, b in (pieces[k] for k in members):
                self._rest(rests[i], a, b, offset)
                offset += b - a
            self.window += 1

    def finish(self) -> None:
        """The last group. What whole windows leave over goes to windows of powers of two."""
        apart = self._set_apart()
        if self.rests:
            self._deal(self.rests)
        spare = sum(len(r[1]) for r in apart)
        room = offset = 0
        while spare:
            room = room or min(1 << spare.bit_length() - 1, 1 << self.limit.bit_length() - 1)
            doc_id, ids, whole, length = apart.pop()
            n = min(len(ids), room - offset)
            self._rest((doc_id, ids, whole, length), 0, n, offset)
            if n < len(ids):
                apart.append((doc_id, ids[n:], whole + n, length))
            offset += n
            if offset == room:
                self.window += 1
                spare, room, offset = spare - room, 0, 0
        self.rests = []


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = LIMIT, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One pass without a shuffle; a task holds the rests of one group. The plan above should
    give a task the same rows if it runs again, as a scan does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, encoder = Packer(limit, group, TaskContext.get().partitionId() << 36), word_tokenizer(tokenizer)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=SCHEMA)

        for block in common.blocks(batches, "text", BLOCK):
            ids, per = encoder.encode(block.column(1), end_id)
            at = 0
            for doc_id, n in zip(block.column(0).to_pylist(), per.tolist()):
                packer.add(doc_id, ids[at : at + n])
                at += n
            if packer.rows:
                yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return common.arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
