"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A word's shape is its run of character classes (capital, small, digit, the other characters
themselves), with repeats marked once; a word that repeats the one before it has a shape of
its own. A document's n-grams are its shapes and pairs of neighbouring shapes, hashed to
buckets. The target model is the smoothed bucket shares of labelled good documents (those
of remainders 1 to 4, a bounded sample), the raw model those of every document.

A document's log importance weight is the sum over its n-grams of log target - log raw. Its
key is the weight plus a Gumbel number seeded by its identifier and text; the k largest keys
are a sample without replacement in proportion to the weights. k is the number of documents
that are more likely target than not: with a share p of good ones, raw text is target text
in p of all cases, so a document is with probability p times its weight (1 at most). The k-th
key is found by counting keys in finer and finer bins, never by sorting them in one place.

Words themselves stay out: the target's sample is small beside the vocabulary, and the error of
rare words' ratios adds up in long texts. With hashed words instead of shapes, or beside them,
more good documents of the held-out fold are lost and no more poor ones found (README).

A null or empty text has no n-grams and the weight 0; a text of any length is taken whole. An
empty table gives an empty result. Identifiers may be null or repeat; a
row that repeats identifier and text repeats its key, and equal keys at the edge are all
kept. Without good labels every document is kept. Other columns are ignored by `weigh` and
`resample` and kept by `keep_sample`.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm import common
from binfold.llm.toxicity import LABELLED, labelled

BUCKETS = 1 << 16
#: Added to a bucket's count in the target text and to the count that raw text lets expect there.
SMOOTH = 2.0
_DIGITS, _REPEAT = re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    word = _DIGITS.sub("9", word)
    return _REPEAT.sub(r"\1+", "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word))


def ngrams(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams, text by text, and how many n-grams each text has. `known` has the hashes of words' shapes."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    if len(known) > 1_000_000:
        known.clear()
    for w in names:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(shape(w))
    hashes = np.fromiter((known[w] for w in names), np.uint64, len(names))
    index = flat.indices.to_numpy(zero_copy_only=False)
    filled = np.fromiter((bool(x) for x in names), bool, len(names))[index] if len(index) else np.zeros(0, bool)
    edges = lists.offsets.to_numpy(zero_copy_only=False) - (lists.offsets[0].as_py() if len(lists) else 0)
    per = np.diff(np.concatenate([[0], np.cumsum(filled)])[edges])
    index = index[filled]
    doc = np.repeat(np.arange(len(per)), per)
    h = hashes[index]
    if len(index):
        same = np.zeros(len(index), bool)
        same[1:] = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
        h[same] = np.uint64(1)
    with np.errstate(over="ignore"):
        one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        inside = doc[1:] == doc[:-1]
        two = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[1:] ^ np.uint64(0x5851F42D4C957F2D))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48))[inside]
    grams = np.concatenate([one, two]).astype(np.int64)
    owner = np.concatenate([doc, doc[1:][inside]])
    order = np.argsort(owner, kind="stable")
    return grams[order], np.bincount(owner, minlength=len(per))


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket comes up, over all rows; each task sends its sums alone."""

    def count(batches):
        total, known = np.zeros(BUCKETS, np.int64), {}
        for block in common.blocks(batches, "text", 4 << 20):
            total += np.bincount(ngrams(block.column(0), known)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    counts = common.arrow_map(texts.select(F.col(text_col).alias("text")), count, "bucket long, n long")
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


class Ratio:
    """log target - log raw of each bucket, and the share of good documents."""

    def __init__(self, target: np.ndarray, raw: np.ndarray, good: float) -> None:
        expected = raw * (target.sum() / max(raw.sum(), 1))
        self.log = np.log((target + SMOOTH) / (expected + SMOOTH))
        self.good = good


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Ratio | None:
    rows = labelled(docs, labels, label, bound, id_col, text_col)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes.get(1):
        return None
    target = bucket_counts(rows.where("y = 1"))
    common.drop(rows)
    return Ratio(target, bucket_counts(docs, text_col), sizes[1] / sum(sizes.values()))


def _weights(block: pa.RecordBatch, at: int, ratio: Ratio, known: dict) -> np.ndarray:
    grams, per = ngrams(block.column(at), known)
    # each document's sum by itself, so that it doesn't depend on the block
    return np.bincount(np.repeat(np.arange(len(per)), per), ratio.log[grams], len(per)).astype(np.float64)  # integers for a block without n-grams


def _gumbel(seed: pa.Array) -> np.ndarray:
    x = seed.to_numpy(zero_copy_only=False).view(np.uint64)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(-np.log(u))


def _seed(id_col: str, text_col: str):
    """64 bits from identifier and text; null counts as a value of its own."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit("")), F.lit(17))


def weigh(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, log_weight, key."""

    def work():
        known: dict[str, int] = {}

        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            w = _weights(block, 2, ratio, known)
            return pa.RecordBatch.from_arrays([block.column(0), pa.array(w), pa.array(w + _gumbel(block.column(1)))], names=["doc_id", "log_weight", "key"])

        return step

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), _seed(id_col, text_col).alias("seed"), F.col(text_col).alias("text"))
    return common.map_blocks(source, "text", work, "doc_id long, log_weight double, key double", 4 << 20)


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, exactly: the bin that holds it is cut into bins until it holds one value."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    left = k
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        inside = values.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        rows = sorted(inside.groupBy(at).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect(), key=lambda r: -r["bin"])  # at most `bins` rows
        for r in rows:
            if left <= r["n"]:
                low, high = r["a"], r["b"]
                break
            left -= r["n"]
    return high


def edge(weights: DataFrame, ratio: Ratio) -> float:
    """The least key in the sample."""
    k = weights.where(F.col("log_weight") + F.lit(math.log(ratio.good)) >= math.log(0.5)).count()
    return kth_largest(weights, "key", k) if k else math.inf


def resample(docs: DataFrame, ratio: Ratio | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, log_weight, key, kept."""
    if ratio is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("key"), F.lit(True).alias("kept"))
    weights = common.written(weigh(docs, ratio, id_col, text_col), "weights")
    return weights.withColumn("kept", F.col("key") >= F.lit(edge(weights, ratio)))


def keep_sample(docs: DataFrame, ratio: Ratio | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the sample, with all their columns; their keys are computed a second time rather than joined."""
    if ratio is None:
        return docs
    weights = common.written(weigh(docs, ratio, id_col, text_col), "weights")
    least, names = edge(weights, ratio), [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*names)
    source = plain.withColumn("_seed", _seed(names[docs.columns.index(id_col)], names[at]))

    def work():
        known: dict[str, int] = {}

        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            key = _weights(block, at, ratio, known) + _gumbel(block.column(len(names)))
            return block.filter(pa.array(key >= least)).select(names)

        return step

    return common.map_blocks(source, names[at], work, plain.schema, 4 << 20).toDF(*docs.columns)
