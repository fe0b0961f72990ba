"""SentencePiece encoding by sampling without replacement, and decoding.

A text's lattice has a node between any two characters and an edge for each piece of the
vocabulary that spells the characters between two nodes; a character of no piece is an edge
of its UTF-8 byte pieces. An edge weighs as its piece's share of a Zipf law over the model's
piece ranks, to the power `theta`. The forward sums of the lattice give each partial
segmentation, which grows from the end of the text, the whole mass of its completions.

The search is a perturbed A* (Gumbel top-k): the agenda holds disjoint sets of segmentations,
each with the largest perturbed log-probability of its members. That is a Gumbel variable
around the set's log mass, and for a set split off a popped one it is drawn below the popped
value. The best set is popped; its best member is found by walking down the lattice, each edge
in proportion to its mass, and what leaves that path, at any of its nodes, goes back to the
agenda. So the segmentations come out in descending order and never twice. (In terms of
exp(-score) the perturbations are arrival times of a Poisson process, and "below the popped
value" is: an exponential time later.)

With kappa the best score left after k pops, a sample's inclusion probability is
1 - exp(-exp(log_prob - kappa)); if fewer than k segmentations exist all are emitted, with 1.

All numbers are hashes of the row key, the sample, the word and the step, so a row's samples
depend on nothing else. A null key counts as one key; rows that repeat a key and text repeat
its samples. A null or empty text has one segmentation, of no pieces. A text of any length is
one lattice. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm import common
from binfold.llm.common import ragged
from binfold.llm.mergecount import _PRETOKEN, SPACE
from binfold.llm.wordcache import _Index

CACHE_EDGES = 14_000_000
#: Pieces that are spelt together.
SPELT = 200_000
#: The power that flattens the pieces' law: at 1 hardly any but the best segmentation comes up.
THETA = 0.25
#: Words that are walked together: few enough for the processor's own memory.
TOGETHER = 1 << 16
#: Edges of a path's head, at first; and the mass beyond which a path has none.
HEAD, TINY = 64, 1e-40
_U, _ALL = np.uint64, (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, the same on every machine."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def uniform_bits(*parts: np.ndarray | int) -> np.ndarray:
    """64 bits from integers."""
    x = _U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = mix((np.asarray(p).astype(_U) + x) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))
    return x


class _Growing:
    """An array that grows at its end; its room doubles."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, more: np.ndarray) -> np.ndarray:
        """The whole array with `more` at its end."""
        end = self.n + len(more)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = more
        self.n = end
        return self.room[:end]


class Lattices:
    """The lattices of the words met so far, as flat arrays.

    Node n of a word that begins at node b stands behind its first n - b characters. An
    edge ends at its node; A node's edges come in descending order of their shares.
    """

    def __init__(self, path: str, theta: float = THETA, shift: float = 2.7) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        pieces = {library.id_to_piece(i): i for i in ordinary}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the vocabulary's pieces span blanks")
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        #: Marks that no piece has behind a small letter: words end before them there, so fewer are distinct.
        self.stops = "".join(m for m in ",.!?;:%*$" if not any(b == m and a.islower() for p in pieces for a, b in zip(p, p[1:])))
        ranked = sorted(ordinary, key=lambda i: (-library.get_score(i), i))
        self.bytes_id = {int(library.id_to_piece(i)[3:5], 16): i for i in range(library.get_piece_size()) if library.is_byte(i)}
        law = [1 / (r + shift) for r in range(len(ranked) + 1)]
        total = sum(law[:-1]) + 256 * law[-1]
        self.share = {library.id_to_piece(i): ((law[r] / total) ** theta, i) for r, i in enumerate(ranked)}
        self.byte_share = (law[-1] / total) ** theta
        self.surface = [b""] * library.get_piece_size()
        for p, i in pieces.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes_id.items():
            self.surface[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(self.surface), np.uint8)
        self.spelt_n = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        self.spelt_at = np.cumsum(self.spelt_n) - self.spelt_n
        self.byte_ids = np.array([self.bytes_id.get(b, 0) for b in range(256)], np.int32)
        self._trie()
        self._clear()

    def _clear(self) -> None:
        self.known = _Index()
        self.grown = {name: _Growing(kind) for name, kind in (("base", np.int64), ("size", np.int64), ("first", np.int32), ("share_of", np.float64), ("prev", np.int32), ("code", np.int32))}
        self.base, self.size, self.first, self.share_of, self.prev, self.code = (g.add(np.zeros(0, np.int64)) for g in self.grown.values())
        self.n_nodes = 0

    def _trie(self) -> None:
        """The pieces as a trie: a table by hash of (state, character) gives the next state."""
        self.letter = np.full(0x110000, -1, np.int64)
        letters = sorted({c for p in self.pieces for c in p})
        self.letter[list(map(ord, letters))] = np.arange(len(letters))
        self.n_letters = len(letters)
        moves: dict[int, int] = {}
        self.log_share, self.piece = [-np.inf], [-1]
        for p, (share, i) in self.share.items():
            state = 0
            for c in p:
                key = state * self.n_letters + int(self.letter[ord(c)])
                if key not in moves:
                    moves[key] = len(self.piece)
                    self.log_share.append(-np.inf)
                    self.piece.append(-1)
                state = moves[key]
            self.log_share[state], self.piece[state] = math.log(share), i
        self.log_share, self.piece = np.array(self.log_share), np.array(self.piece)
        self.move_keys = np.array(sorted(moves), np.int64)
        self.move_to = np.array([moves[x] for x in self.move_keys.tolist()], np.int64)
        # keys that share a slot are found by binary search
        slot = self._slot(self.move_keys)
        self.slots = np.zeros(1 << 20, np.int64)
        self.slots[slot] = np.arange(len(slot))
        self.shared = np.zeros(1 << 20, bool)
        self.shared[slot[self.slots[slot] != np.arange(len(slot))]] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(44)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in move_keys, or -1."""
        slot = self._slot(keys)
        found = self.slots[slot]
        wrong = self.move_keys[found] != keys
        again = np.flatnonzero(wrong & self.shared[slot])
        found[wrong] = -1
        if len(again):
            at = np.minimum(np.searchsorted(self.move_keys, keys[again]), len(self.move_keys) - 1)
            found[again] = np.where(self.move_keys[at] == keys[again], at, -1)
        return found

    def _edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All edges of the words: first edge of each node, shares, nodes before, codes; nodes count from 0."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        node = np.arange(len(points)) + word  # the node before each character; a word has one node more than characters
        left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
        letters = self.letter[points]
        froms, tos, logs, codes = [], [], [], []
        at, state = np.flatnonzero(letters >= 0), None
        state = np.zeros(len(at), np.int64)
        single = np.zeros(len(points), bool)
        for n in range(1, self.longest + 1):
            keys = state * self.n_letters + letters[at + n - 1]
            found = self._find(keys)
            hit = (found >= 0) & (letters[at + n - 1] >= 0)
            at, state = at[hit], self.move_to[found[hit]]
            whole = self.piece[state] >= 0
            if n == 1:
                single[at[whole]] = True
            froms.append(node[at[whole]])
            tos.append(node[at[whole]] + n)
            logs.append(self.log_share[state[whole]])
            codes.append(self.piece[state[whole]])
            go = left[at] > n
            at, state = at[go], state[go]
            if not len(at):
                break
        odd = np.flatnonzero(~single)
        raw = 1 + (points[odd] > 0x7F) + (points[odd] > 0x7FF) + (points[odd] > 0xFFFF)
        begin, end, log, code = (np.concatenate(x) for x in (froms + [node[odd]], tos + [node[odd] + 1], logs + [raw * math.log(self.byte_share)], codes + [-1 - points[odd]]))
        base = np.concatenate([[0], np.cumsum(size + 1)])
        # the forward sums, for all words at once, place by place
        depth = end - np.repeat(base[:-1], size + 1)[end]
        order = np.argsort(depth << 32 | end)
        begin, end, log, code, depth = begin[order], end[order], log[order], code[order], depth[order]
        sums, mass = np.zeros(int(base[-1])), np.empty(len(end))
        edges = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2) if len(depth) else np.zeros(0))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            to, t = end[a:b], sums[begin[a:b]] + log[a:b]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            n = np.diff(first, append=b - a)
            top = np.maximum.reduceat(t, first)
            w = np.exp(t - np.repeat(top, n))
            here = np.add.reduceat(w, first)
            sums[to[first]] = top + np.log(here)
            mass[a:b] = w / np.repeat(here, n)
        order = np.argsort(end - mass)  # by node, larger shares first
        first = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=int(base[-1])))])
        return first, mass[order], begin[order], code[order], base[:-1], size

    def learn(self, words: list[str]) -> np.ndarray:
        """The number of each word."""
        if len(self.share_of) > CACHE_EDGES:
            self._clear()
        # a word may come twice, from plain texts and from others, but gets one lattice
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new, self.known.new = self.known.new, []
        if new:
            node, old = self.n_nodes, len(self.share_of)
            first, share, prev, code, base, size = self._edges(new)
            self.n_nodes += len(first) - 1
            if old:
                self.grown["first"].n -= 1  # the last node's end is the next one's begin
            for name, more in (("first", first + old), ("share_of", share), ("prev", prev + node), ("code", code), ("base", base + node), ("size", size)):
                setattr(self, name, self.grown[name].add(more))
        return number

    def walk(self, base: np.ndarray, at: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks each word from node `at` back to its base. Returns the edges taken, word by word from the right, and each word's number of them."""
        parts = [self._walk(*(x[i : i + TOGETHER] for x in (base, at, seed, place))) for i in range(0, len(at), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _walk(self, base: np.ndarray, at: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(at), np.int64)
        live = np.flatnonzero(at > base)
        steps, where, step = [], [], 0
        node, to, key = at[live], base[live], uniform_bits(seed[live], place[live])
        while len(live):
            with np.errstate(over="ignore"):
                bits = mix(key + _U((step + 1) * 0x9E3779B97F4A7C15 & _ALL))
            bits >>= _U(11)
            u = bits.astype(np.float64)
            u += 0.5
            u *= 2.0**-53
            edge = self.first[node]
            u -= self.share_of[edge]
            more = np.flatnonzero(u > 0)
            if len(more):  # these take a later edge of their nodes
                e, last, rest = edge[more], self.first[node[more] + 1] - 1, u[more]
                go = np.flatnonzero(e < last)
                while len(go):
                    e[go] += 1
                    rest[go] -= self.share_of[e[go]]
                    go = go[(rest[go] > 0) & (e[go] < last[go])]
                edge[more] = e
            steps.append(edge)
            where.append(live)
            counts[live] += 1
            node = self.prev[edge]
            go = np.flatnonzero(node > to)
            if len(go) < len(live):
                live, to, key, node = live[go], to[go], key[go], node[go]
            step += 1
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for t, (edge, words) in enumerate(zip(steps, where)):
            out[offset[words] + t] = edge
        return out, counts

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """The ids of one path."""
        return self.ids_of([edges])[0]

    def ids_of(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the paths, whose edges go from right to left, one after another, and how many each has."""
        sizes = np.array([len(p) for p in paths], np.int64)
        code = self.code[np.concatenate([p[::-1] for p in paths])] if paths else np.zeros(0, np.int32)
        odd = np.flatnonzero(code < 0)
        if not len(odd):
            return code.astype(np.int32), sizes
        spelt = [chr(-1 - c).encode() for c in code[odd].tolist()]
        n = np.ones(len(code), np.int64)
        n[odd] = list(map(len, spelt))
        out = np.repeat(code, n).astype(np.int32)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return out, np.diff(ends)

    def spell(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes that each run of ids stands for."""
        n = self.spelt_n[ids]
        raw = self.spelt[ragged(self.spelt_at[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)].tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the blank that encoding puts first is taken off again."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


class _Search:
    """One row's agenda."""

    def __init__(self, seed: int) -> None:
        self.seed, self.draws = seed, 0
        self.agenda: list[tuple] = []
        self.paths: list[_Path] = []
        self.times: list[float] = []

    def draw(self) -> float:
        """The next number of the row's own stream."""
        self.draws += 1
        x = (self.seed + self.draws * 0x9E3779B97F4A7C15) & _ALL
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
        return ((x ^ x >> 31) >> 11) * 2.0**-53 + 2.0**-54

    def push(self, after: float, mass: float, region: tuple) -> None:
        if mass > 1e-15:
            heapq.heappush(self.agenda, (after - math.log(self.draw()) / mass, len(self.agenda) + 1000 * len(self.paths), region))


def pretokens(own: Lattices, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each text's words from right to left, and how many each text has."""
    column = pc.replace_substring(pa.array(texts, pa.string()), SPACE, " ")
    odd = pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, "\1")).to_numpy(zero_copy_only=False)
    odd |= np.array([x[:1] == " " for x in texts], bool)
    # most texts have single blanks: marks before blanks and around line feeds give their words
    plain = pc.if_else(pa.array(odd), "", column)
    plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(pa.scalar(""), plain, " "))
    if own.stops:
        plain = pc.replace_substring_regex(plain, rf"(\p{{Ll}})([{re.escape(own.stops)}])", "\\1\1\\2")
    lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\1 "), "\n", "\1\n\1"), "\1")
    words = lists.flatten().dictionary_encode()
    names, index = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(zero_copy_only=False)
    slow = {int(d): _PRETOKEN.findall(" " + texts[d].replace(SPACE, " ")) for d in np.flatnonzero(odd)}
    more = list({w for x in slow.values() for w in x})
    blank = names.index("") if "" in names else None  # what an empty text or one between two marks gives: no word
    if blank is not None:
        del names[blank]
    number = own.learn(names + more)
    of = number[: len(names)]
    if blank is not None:
        of = np.insert(of, blank, -1)
    known = dict(zip(more, number[len(names) :].tolist()))
    flat = of[index] if len(index) else np.zeros(0, np.int64)
    edges = lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()
    sizes = np.diff(np.concatenate([[0], np.cumsum(flat >= 0)])[edges])
    flat = flat[flat >= 0]
    if slow:
        at = np.cumsum(sizes)
        parts, last = [], 0
        for d, x in slow.items():
            parts += [flat[last : at[d]], np.array([known[w] for w in x], np.int64)]
            last, sizes[d] = at[d], len(x)
        flat = np.concatenate([*parts, flat[last:]])
    ends = np.cumsum(sizes)
    return flat[np.repeat(ends - 1, sizes) - (np.arange(len(flat)) - np.repeat(ends - sizes, sizes))], sizes


class _Walk(NamedTuple):
    """The walks of a block's words: edges and their shares, where each word's edges end, and the node each walk began at."""

    edges: np.ndarray
    share: np.ndarray
    ends: np.ndarray
    at: np.ndarray


class _Path:
    """A segmentation: its edges from right to left.

    It has another path's first edges, then an edge that leaves that path, then those of a
    walk. `share`, `suffix` and `leave` are of its head: further on, less than TINY of the
    mass is, so that no member of a set of any weight leaves the path there.
    """

    def __init__(self, walk: _Walk, a: int, b: int, log_prob: float, fork: tuple | None = None) -> None:
        self.walk, self.a, self.fork, self.log_prob = walk, a, fork, log_prob
        self.edges, old = walk.edges[a:b], None
        if fork:
            before, j, edge, share, *_ = fork
            self.edges = np.concatenate([before.edges[:j], [edge], self.edges])
            old = np.concatenate([before.share[:j], [share]])
        n = HEAD
        while True:
            self.share = walk.share[a : min(b, a + n)]
            if fork:
                self.share = np.concatenate([old, self.share])
            mass = self.share.cumprod()
            if a + n >= b or mass[-1] < TINY:
                break
            n *= 4
        #: The mass of all segmentations that go as this one does before each edge.
        self.suffix = np.ones(len(mass))
        self.suffix[1:] = mass[:-1]
        self.leave = self.suffix * (1 - self.share)

    def where(self, own: Lattices, j: int) -> tuple[int, int]:
        """The node that the j-th edge ends at, and its word in the block."""
        if self.fork:
            before, turned, _, _, node, word = self.fork
            if j < turned:
                return before.where(own, j)
            if j == turned:
                return node, word
            j -= turned + 1
        i, ends = self.a + j, self.walk.ends
        word = int(ends.searchsorted(i, "right"))
        begins = i == (ends[word - 1] if word else 0)
        return int(self.walk.at[word] if begins else own.prev[self.walk.edges[i - 1]]), word


def sample(own: Lattices, keys: list[int], texts: list[str], k: int) -> list[list[dict]]:
    """For each text up to k samples: edges from right to left, log_prob, score, log_inclusion."""
    flat, sizes = pretokens(own, texts)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    base, end = own.base[flat], own.base[flat] + own.size[flat]
    place = np.arange(len(flat)) - np.repeat(begin, sizes)
    seeds = mix(np.array([x & _ALL for x in keys], np.uint64) + _U(1))
    rows, spans = [_Search(int(s)) for s in seeds.tolist()], list(zip(begin.tolist(), ends.tolist()))
    for r in rows:
        r.push(0.0, 1.0, (None, 0, {}))
    for turn in range(k):
        at, plans = base.copy(), {}
        for d, r in enumerate(rows):
            if not r.agenda:
                continue
            time, _, (path, low, gone) = heapq.heappop(r.agenda)
            a, b = spans[d]
            if path is None:
                at[a:b] = end[a:b]
                plans[d] = (time, 0, None)
                continue
            p = r.paths[path]
            # the node at which the next best member leaves this path, and by which edge
            mass = p.leave[low:].copy()
            for j, edges in gone.items():
                mass[j - low] -= p.suffix[j] * own.share_of[list(edges)].sum()
            run = np.maximum(mass, 0).cumsum()
            j = low + min(int(run.searchsorted(r.draw() * run[-1], "right")), len(run) - 1)
            node, word = p.where(own, j)
            others = [e for e in range(int(own.first[node]), int(own.first[node + 1])) if e != p.edges[j] and e not in gone.get(j, ())]
            while not others:  # rounding chose a node that has nothing left
                mass[j - low] = 0
                if not (mass > 0).any():
                    break
                j = low + int(np.argmax(mass))
                node, word = p.where(own, j)
                others = [e for e in range(int(own.first[node]), int(own.first[node + 1])) if e != p.edges[j] and e not in gone.get(j, ())]
            if not others:
                continue
            shares = own.share_of[others].cumsum()
            edge = others[min(int(shares.searchsorted(r.draw() * shares[-1], "right")), len(others) - 1)]
            share = float(own.share_of[edge])
            left = dict(gone)
            left[j] = (*gone.get(j, ()), edge)
            r.push(time, float(run[-1] - p.suffix[j] * share), (path, low, left))
            at[word] = own.prev[edge]
            at[word + 1 : b] = end[word + 1 : b]
            plans[d] = (time, math.log(p.suffix[j]) + math.log(share), (p, j, edge, share, node, word))
        edges, counts = own.walk(base, at, np.repeat(seeds, sizes) + _U(turn), place)
        walk = _Walk(edges, own.share_of[edges], np.cumsum(counts), at)
        spot = np.concatenate([[0], walk.ends])
        first, last = spot[begin], spot[ends]
        sums, some = np.zeros(len(rows)), last > first
        if some.any():
            sums[some] = np.add.reduceat(np.log(walk.share), first[some])
        for d, (time, log, fork) in plans.items():
            r, low = rows[d], fork[1] + 1 if fork else 0
            p = _Path(walk, int(first[d]), int(last[d]), log + float(sums[d]), fork)
            r.paths.append(p)
            r.times.append(time)
            r.push(time, float(p.leave[low:].sum()), (len(r.paths) - 1, low, {}))
    out = []
    for r in rows:
        after = r.agenda[0][0] if r.agenda else math.inf
        found = []
        for p, time in zip(r.paths, r.times):
            x = p.log_prob + math.log(after) if after < math.inf else math.inf
            inclusion = 0.0 if x > 4 else (math.log(-math.expm1(-math.exp(x))) if x > -30 else x)
            found.append({"edges": p.edges, "log_prob": p.log_prob, "score": -math.log(time), "log_inclusion": inclusion})
        out.append(found)
    return out


_loaded: dict[tuple, Lattices] = {}


def lattices(path: str, theta: float) -> Lattices:
    if (path, theta) not in _loaded:
        _loaded[path, theta] = Lattices(path, theta)
    return _loaded[path, theta]


def encode(docs: DataFrame, model: str, k: int = 3, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each sample of a document: doc_id, sample (from 1), n_pieces, ids, ids_crc32, log_prob, score, log_inclusion, round_trip.

    round_trip: decoding the ids gives the text. (U+2581 in a text is a blank to the model.)
    """
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, score double, log_inclusion double, round_trip boolean" + ", ids array<int>" * with_ids

    def work():
        own = lattices(model, theta)

        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            keys, found = block.column(0).to_pylist(), common.texts(block, "text")
            drawn = [(doc, i + 1, x) for doc, samples in enumerate(sample(own, [-1 if x is None else x for x in keys], found, k)) for i, x in enumerate(samples)]
            ends = np.cumsum([len(x["edges"]) for *_, x in drawn])
            parts, per, sums, same, begin = [], [], [], [], 0
            while begin < len(drawn):  # some samples at a time, as their bytes are laid out one by one
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SPELT, "right")))
                some = drawn[begin:end]
                ids, sizes = own.ids_of([x["edges"] for *_, x in some])
                raw, at = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(4 * sizes)]).tolist()
                sums += [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                same += [(x[1:] if x[:1] == b" " else x) == found[doc].encode() for x, (doc, *_) in zip(own.spell(ids, sizes), some)]
                per.append(sizes)
                parts.append(ids)
                begin = end
            sizes = np.concatenate(per) if per else np.zeros(0, np.int64)
            columns = [block.column(0).take(pa.array([doc for doc, *_ in drawn], pa.int64())), pa.array([i for _, i, _ in drawn], pa.int32()), pa.array(sizes), pa.array(sums, pa.int64())]
            columns += [pa.array([x[c] for *_, x in drawn], pa.float64()) for c in ("log_prob", "score", "log_inclusion")] + [pa.array(same, pa.bool_())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "score", "log_inclusion", "round_trip", "ids"][: len(columns)])

        return step

    return common.map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", work, schema, 1 << 20)


def decode(samples: DataFrame, model: str, ids_col: str = "ids", theta: float = THETA) -> DataFrame:
    """Adds the column `decoded`; null ids stay null."""

    @F.pandas_udf("string")
    def text(ids):
        own = lattices(model, theta)
        return ids.map(lambda x: None if x is None else own.decode(list(x)))

    return samples.withColumn("decoded", text(F.col(ids_col)))
