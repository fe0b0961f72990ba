"""Toxicity by maximum-scoring segments over token log-odds.

Learning, from labelled rows whose crc32(identifier as text) mod 5 isn't 0 (a bounded sample
of them, each distinct text once). Tokens are words in lower case, and their prefixes of 4 to
7 letters, which words of one stem share. For each token, in how many documents of either
label it is, under Dirichlet priors in proportion to its share of all documents, gives the
log-odds and their variance; a token counts with the lower bound of its log-odds, if that
bound is positive enough, and any other word scores a penalty. Of a word and its prefixes
the best counts.

Scoring: a word's scores in a row; one linear scan finds every maximal scoring segment
(Ruzzo and Tompa's algorithm, over runs of equal sign). Extreme-value calibration (Karlin
and Altschul): with lambda and K from labelled clean documents, a segment of score S in a
document of n words has an expectation E = K n exp(-lambda S) by chance; segments with E
below 1 are the significant passages. -ln E of the best passage and the sum over all of
them, through a logistic curve that the rows of remainder 4 fit, give the score.

Labels, language, source and identifier are never inputs of a score. A null or empty text
has no words and a score near 0. Null or repeated identifiers are documents of their own (a
null one isn't held out); a label that is null or lacks an identifier is left out; of
repeated labels the largest counts; an identifier's texts count once each, up to the bound.
A text of any length is scanned whole. An empty table gives an empty result. Without labels of both kinds all scores are 0. Other
columns are ignored by `score` and kept by `reject`.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm import common

#: Labelled rows to learn from at most: those of the smallest hashes.
LABELLED = 20_000
#: Tokens that a model holds at most, by their bounds.
TOKENS = 50_000
PREFIXES = range(4, 8)
PRIOR, FLOOR, DEVIATIONS, LEAST, PENALTY = 10.0, 0.5, 1.64, 1.0, 1.0
#: Scores of labelled clean documents are counted in steps of 1 / GRID, and as MOST from there on.
GRID, MOST = 64, 256


def tokens_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a block, each word's number among them, and how many words each text has."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    index = flat.indices.to_numpy(zero_copy_only=False)
    filled = np.fromiter((bool(x) for x in names), bool, len(names))[index] if len(index) else np.zeros(0, bool)
    edges = lists.offsets.to_numpy(zero_copy_only=False) - (lists.offsets[0].as_py() if len(lists) else 0)
    return names, index[filled], np.diff(np.concatenate([[0], np.cumsum(filled)])[edges])


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in linear time.

    Candidates wait in a list, each with the sum left of it and the sum at its right end. A
    new one joins with the nearest candidate of a smaller left sum if its own right sum is larger.
    """
    kept: list[list] = []  # begin, end, left sum, right sum
    below: list[int] = []  # of each candidate: the nearest one before it with a smaller left sum
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        new = [i, i + 1, total, total + x]
        total += x
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = below[j]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                below.append(j)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:], below[j:]
    return [(a, b, right - left) for a, b, left, right in kept]


class Model:
    """Token bounds, lambda and K, and the curve. Small, and sent with the tasks."""

    def __init__(self, tokens: dict[str, float]) -> None:
        self.tokens = tokens
        self.rate, self.level = 1.0, 1.0
        self.curve = [-30.0, 0.0, 0.0]

    def word(self, w: str) -> float:
        get = self.tokens.get
        best = max((get(t, 0.0) for t in tokens_of(w)), default=0.0)
        return best if best > 0 else -PENALTY

    def passages(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Of each text: its number of words and its maximal segments, in words."""
        names, index, sizes = words_of(texts)
        known = np.fromiter(map(self.word, names), np.float64, len(names))
        scores = known[index]
        out, at = [], 0
        hits = np.flatnonzero(scores > 0)
        bounds = np.searchsorted(hits, np.concatenate([[0], np.cumsum(sizes)]))
        for d, n in enumerate(sizes.tolist()):
            mine = hits[bounds[d] : bounds[d + 1]] - at
            if not len(mine):
                out.append((n, []))
                at += n
                continue
            # runs of words above 0, and the gaps between them
            cut = np.flatnonzero(np.diff(mine) > 1) + 1
            first, last = mine[np.concatenate([[0], cut])], mine[np.concatenate([cut - 1, [len(mine) - 1]])]
            value = np.add.reduceat(scores[at + mine], np.concatenate([[0], cut]))
            runs = np.empty(2 * len(first) - 1)
            runs[0::2] = value
            runs[1::2] = -PENALTY * (first[1:] - last[:-1] - 1)
            out.append((n, [(int(first[a // 2]), int(last[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(runs.tolist())]))
            at += n
        return out

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, int]:
        """-ln E of the best segment, the sum of -ln E over the significant ones, and their number."""
        base = math.log(self.level * max(n, 1))
        values = [self.rate * s - base for _, _, s in segments]
        good = [v for v in values if v > 0]
        return (max(values) if values else -base - self.rate * PENALTY), sum(good), len(good)

    def probability(self, best: float, total: float) -> float:
        z = self.curve[0] + self.curve[1] * max(-20.0, min(best, 40.0)) + self.curve[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method for a curve with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y, fold) of at most `bound` labelled rows outside the held-out fold, each distinct text once, in a written table."""
    y = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    y = y.withColumn("fold", F.crc32(F.col("k").cast("string")) % 5).where("fold != 0").groupBy("k").agg(F.max("y").alias("y"), F.max("fold").alias("fold"))
    y = y.orderBy(F.xxhash64("k"), "k").limit(bound)
    found = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text")).join(F.broadcast(y), "k")  # at most `bound` rows of numbers
    found = found.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("y").alias("y"), F.min("fold").alias("fold"))
    found = common.written(found, "labelled")
    # an identifier may repeat with any number of texts
    if found.count() > bound:
        last = found.select("h").orderBy("h").limit(bound).agg(F.max("h")).first()[0]  # numbers alone
        few = common.written(found.where(F.col("h") <= last), "labelled")
        common.drop(found)
        found = few
    return found


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = labelled(docs, labels, label, bound, id_col, text_col)
    sizes = {(r["y"], r["last"]): r["n"] for r in rows.groupBy("y", (F.col("fold") == 4).alias("last")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get((1, False), 0), sizes.get((0, False), 0)
    if not n1 or not n0:
        common.drop(rows)
        return Model({})

    def count(batches):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for block in common.blocks(batches, "text"):
            names, index, per = words_of(block.column(0))
            ends = np.cumsum(per)
            for y, n, e in zip(block.column(1).to_pylist(), per.tolist(), ends.tolist()):
                counts[y].update({t for i in set(index[e - n : e].tolist()) for t in tokens_of(names[i])})
        found = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([counts[y][t] for t in part], pa.int64()) for y in (1, 0))], names=["token", "c1", "c0"])

    share = (F.col("c1") + F.col("c0")) / F.lit(n1 + n0)
    odds = F.log((F.col("c1") + F.col("a")) / (F.lit(n1) - F.col("c1") + F.col("b"))) - F.log((F.col("c0") + F.col("a")) / (F.lit(n0) - F.col("c0") + F.col("b")))
    deviation = F.sqrt(1 / (F.col("c1") + F.col("a")) + 1 / (F.col("c0") + F.col("a")))
    counted = common.arrow_map(rows.where("fold != 4").select("text", "y"), count, "token string, c1 long, c0 long").groupBy("token").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).where("c1 >= 3")
    bounds = counted.withColumns({"a": PRIOR * share + FLOOR, "b": PRIOR * (1 - share) + FLOOR}).select("token", (odds - DEVIATIONS * deviation).alias("bound")).where(F.col("bound") > LEAST)
    model = Model({r["token"]: r["bound"] for r in bounds.orderBy(F.desc("bound"), "token").limit(TOKENS).collect()})

    def segments(batches):
        for block in common.blocks(batches, "text"):
            got = model.passages(block.column(0))
            yield pa.RecordBatch.from_arrays([block.column(1), block.column(2), pa.array([n for n, _ in got], pa.int64()), pa.array([[s for *_, s in x] for _, x in got], pa.list_(pa.float64()))], names=["y", "last", "n", "scores"])

    kind = "y int, last boolean, n long, scores array<double>"
    seen = common.written(common.arrow_map(rows.select("text", "y", (F.col("fold") == 4).alias("last")), segments, kind), "toxic-segments")
    clean = seen.where("y = 0")
    words = clean.agg(F.sum("n")).first()[0] or 0
    # clean documents' segment scores by number: at most GRID * MOST of them, however long the texts are
    grid = F.floor(F.least(F.col("s"), F.lit(float(MOST))) * GRID).cast("int")
    held = clean.select(F.explode("scores").alias("s")).groupBy(grid.alias("at")).agg(F.count("*").alias("n"), F.avg(F.least(F.col("s"), F.lit(float(MOST)))).alias("s")).orderBy("at").collect()
    if held:
        scores, times = np.array([r["s"] for r in held]), np.array([r["n"] for r in held], float)
        # lambda: the one positive root of E exp(lambda x) = 1 over the words of clean documents
        low, high = 1e-6, 10.0
        for _ in range(60):
            rate = (low + high) / 2
            chance = (times * np.exp(np.minimum(rate * scores, 50))).sum() + (words - times.sum()) * math.exp(-rate * PENALTY)
            low, high = (rate, high) if chance < words else (low, rate)
        model.rate = low
        middle = int(np.searchsorted(np.cumsum(times), times.sum() / 2))
        model.level = float(times[middle:].sum() * math.exp(model.rate * scores[middle]) / max(words, 1))
    base = F.log(F.lit(model.level) * F.greatest("n", F.lit(1)))
    values = F.transform("scores", lambda x: F.lit(model.rate) * x - base)
    best = F.coalesce(F.array_max(values), -base - F.lit(model.rate * PENALTY))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    # three numbers a labelled text, of which there are at most `bound`
    fit = seen.select("y", "last", best.alias("best"), total.alias("total")).collect()
    common.drop(seen, rows)
    part = [r for r in fit if r["last"]]
    fit = part if len({r["y"] for r in part}) == 2 else fit
    x = np.array([[max(-20.0, min(r["best"], 40.0)), math.log1p(r["total"])] for r in fit])
    model.curve = _logistic(x, np.array([r["y"] for r in fit], float)).tolist()
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_passages int, passages array<struct<begin:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted, n_passages, passages (in words, significant ones)."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 5 == 0, F.lit(False))

    def work():
        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            scores, counts, found = [], [], []
            for n, segments in model.passages(block.column(2)):
                best, total, k = model.evidence(n, segments)
                scores.append(model.probability(best, total))
                counts.append(k)
                base = math.log(model.level * max(n, 1))
                found.append([{"begin": a, "end": b, "score": s} for a, b, s in segments if model.rate * s > base])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(counts, pa.int32()), pa.array(found, kind)], names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"])

        return step

    return common.map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")), "text", work, SCHEMA, 4 << 20)


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    at = docs.columns.index(text_col)

    def work():
        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            keep = [model.probability(*model.evidence(n, s)[:2]) < 0.5 for n, s in model.passages(block.column(at))]
            return block.filter(pa.array(keep, pa.bool_()))

        return step

    return common.map_blocks(docs, text_col, work, docs.schema, 4 << 20)
