"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact links.

A document's words are the runs of other characters than ASCII white space, in lower case
(A to Z); its set holds its distinct shingles of k words, as 64-bit hashes, or its whole
sequence as one if it has fewer. Two sets are linked if their Jaccard similarity reaches the
threshold, and documents that links connect form a component.

1. One pass hashes each text to its set's size, digest and MinHash signature. Documents with
   the same set become one node, however many they are.
2. Nodes meet in buckets, a bucket for each band of the signature. The bands are chosen so
   that a pair at the threshold misses all of them with a probability below 1e-6.
3. In a bucket each node is a candidate with one pivot. Signatures are compared a batch at a
   time: under a uniform prior the similarity's posterior after m of n matches is Beta(m + 1,
   n - m + 1), and a pair is given up as soon as the posterior probability that it reaches the
   threshold falls below `miss`. Survivors are confirmed on the full sets, recomputed from the texts.
4. Links give components. Only buckets whose nodes are still in several go on, with their
   pivot's other ones. The nodes outside a pivot's largest component are verified against all
   others that share a bucket with them, block by block; pairs within a component need no test.

So pairs are never rows but for those with a pivot and for links, and no link between components is left out.
A key that many rows share (a pivot, a bucket, a text, a component) is dealt to several tasks.
Tables are removed as soon as what follows from them is written.

Texts that are null or have no words have an empty set and are linked with nothing. A null
identifier counts as larger than any other. Rows that repeat an identifier are documents of
their own. Other columns are ignored by `components` and kept by `keep_one`, which decides by
identifier and text: of rows with a component's smallest identifier those with the text of the
least hash stay, and of a component without identifiers one row. A text of any length is
one set; a block holds one long text at least. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from binfold.llm import common
from binfold.llm.common import ragged

PERMUTATIONS = 128
BATCH = 32
#: Nodes and bytes of a block at most, or about.
BLOCK_NODES, BLOCK_BYTES = 1024, 8 << 20
_U = np.uint64


def bands_for(threshold: float, permutations: int = PERMUTATIONS, miss: float = 1e-6) -> tuple[int, int]:
    """Bands and rows: the longest rows whose chance to miss a pair at the threshold is below `miss`."""
    for rows in range(12, 0, -1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands < miss:
            return bands, rows
    raise ValueError("the threshold needs more permutations")


def least_matches(threshold: float, miss: float, permutations: int = PERMUTATIONS, batch: int = BATCH) -> list[tuple[int, int]]:
    """For each number n of values compared: the fewest matches with which a pair goes on."""
    out = []
    for n in range(batch, permutations + 1, batch):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after another, and how many each has."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    known = np.fromiter((digest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    index = words.indices.to_numpy(zero_copy_only=False)
    filled = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, bool)
    edges = lists.offsets.to_numpy(zero_copy_only=False) - (lists.offsets[0].as_py() if len(lists) else 0)
    per = np.diff(np.concatenate([[0], np.cumsum(filled)])[edges])
    w = known[index[filled]]
    begin = np.cumsum(per) - per
    n = np.where(per >= k, per - k + 1, (per > 0).astype(np.int64))
    at = ragged(begin, n)
    doc = np.repeat(np.arange(len(per)), n)
    span = np.repeat(np.minimum(per, k), n)
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            here = span > i
            if here.all():
                h = _mix(h * _U(3) + w[at + i])
            elif here.any():
                h[here] = _mix(h[here] * _U(3) + w[at[here] + i])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(per))


def _factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(0, 1 << 63, permutations, np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, permutations, np.uint64)


def signatures(sets: np.ndarray, sizes: np.ndarray, permutations: int) -> np.ndarray:
    """The MinHash values of each set that isn't empty."""
    some = sizes[sizes > 0]
    out = np.empty((len(some), permutations), np.uint32)
    if len(some):
        first = np.cumsum(some) - some
        with np.errstate(over="ignore"):
            for i, (a, b) in enumerate(zip(*_factors(permutations))):
                out[:, i] = np.minimum.reduceat(((sets * a + b) >> _U(32)).astype(np.uint32), first)
    return out


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col)))


def digest(docs: DataFrame, k: int, permutations: int = PERMUTATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, digest of the set, signature (null for an empty set)."""

    def work():
        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            sets, sizes = shingle_sets(block.column(1), k)
            values = iter(signatures(sets, sizes, permutations))
            ends = np.cumsum(sizes)
            keys = [hashlib.blake2b(sets[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), sizes.tolist())]
            found = [next(values).tobytes() if n else None for n in sizes.tolist()]
            return pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "text_key", "n_shingles", "digest", "signature"])

        return step

    return common.map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key")), "text", work, "doc_id long, text_key binary, n_shingles long, digest binary, signature binary")


def _banded(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(node, digest, doc_id, text_key, size, values, bands): each signature as numbers, and a hash of each of its bands."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            h = np.full((batch.num_rows, bands), 7, np.uint64) + np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
            with np.errstate(over="ignore"):
                for i in range(rows):
                    h = _mix(h * _U(5) + values[:, i : bands * rows : rows].astype(np.uint64))
            lists = (pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(t)) for x, t in ((values.view(np.int32), pa.int32()), (h.view(np.int64), pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *lists], names=["node", "digest", "doc_id", "text_key", "size", "values", "bands"])

    return common.arrow_map(nodes.select("node", "digest", "doc_id", "text_key", "size", "signature"), run, "node long, digest binary, doc_id long, text_key binary, size long, values array<int>, bands array<long>")


def _possible(x: str, y: str, numerator: int, denominator: int, miss: float, permutations: int) -> str:
    """SQL: the sizes of the sets x and y allow the threshold, and no batch of their signatures rules it out."""
    tests, done, sums = [f"{denominator} * least({x}.size, {y}.size) >= {numerator} * greatest({x}.size, {y}.size)"], 0, []
    for n, least in least_matches(numerator / denominator, miss, permutations):
        sums.append(f"size(filter(zip_with(slice({x}.values, {done + 1}, {n - done}), slice({y}.values, {done + 1}, {n - done}), (p, q) -> p = q), z -> z))")
        tests.append(f"{' + '.join(sums)} >= {least}")
        done = n
    return " AND ".join(tests)


def _row_key() -> Column:
    """A text's row by text and identifier, which may be null."""
    return F.concat("text_key", F.coalesce(F.col("doc_id").cast("string").cast("binary"), F.lit(b"")))


def _sets(near: DataFrame, known: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the full sets of the nodes in near (node, digest, doc_id, text_key), from the texts, in a written table."""

    def full(batches):
        for block in common.blocks(batches, "text"):
            sets, sizes = shingle_sets(block.column(0), k)
            ends = np.cumsum(sizes)
            found = [sets[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
            same = [hashlib.blake2b(x, digest_size=16).digest() == y for x, y in zip(found, block.column(2).to_pylist())]
            keep = [i for i, x in enumerate(same) if x]
            yield pa.RecordBatch.from_arrays([block.column(1).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.binary())], names=["node", "shingles"])

    # by the text too: an identifier, or its lack, may be common to many
    rows = docs.withColumn("text_key", _text_key("text")).select(_row_key().alias("row_key"), "text")
    wanted = near.select(_row_key().alias("row_key"), "node", "digest")
    hot = common.hot_keys(known.select(_row_key().alias("row_key")), "row_key")
    text = common.spread_join(rows, wanted, "row_key", hot).select("text", "node", "digest")
    # an identifier may repeat with the same text
    return common.written(common.arrow_map(text, full, "node long, shingles binary").dropDuplicates(["node"]), "neardup-sets")


def _similar(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether two sorted sets' intersection over union reaches numerator / denominator."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return denominator * both >= numerator * (len(x) + len(y) - both)


def _exact(pairs: DataFrame, sets: DataFrame, hot: list[tuple], numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. hot: the b that many have."""

    def confirm(batches):
        for block in common.blocks(batches, "x"):
            keep = []
            for i, (x, y) in enumerate(zip(block.column(2).to_pylist(), block.column(3).to_pylist())):
                if _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), numerator, denominator):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([block.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    both = common.spread_join(pairs.join(sets.toDF("a", "x"), "a"), sets.toDF("b", "y"), "b", hot).select("a", "b", "x", "y")
    return common.arrow_map(both, confirm, "a long, b long")


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has a link: root is the least node that it reaches.

    Large-star and small-star in turn, each a group's minimum and a join, until the links stand still.
    """
    now = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    seen, n = None, now.count()

    def hot(rows: DataFrame) -> list[tuple]:
        return common.hot_keys(rows, "u", common.FEW_THIN) if 2 * n > common.FEW_THIN else []

    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each larger neighbour goes to the least one
        larger = both.where("v > u")
        large = common.spread_join(larger, least, "u", hot(larger)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.spread_join(large, least, "u", hot(large)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
        watch = Observation()
        old, now = now, common.written(small.distinct().observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
        common.drop(old)
        if watch.get == seen:
            break
        seen, n = watch.get, watch.get["n"]
    out = common.written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct()), name)
    common.drop(now)
    return out


def _cross(buckets: DataFrame, hot: list[tuple], roots: DataFrame, signed: DataFrame, sets: DataFrame, numerator: int, denominator: int, miss: float, permutations: int) -> DataFrame:
    """Links (a, b) between components inside the buckets (node, band, bucket, pivot; hot: those of many nodes): as many as connect what links connect.

    A pivot's nodes are cut into blocks, those of its largest component apart from the others.
    A block of the others meets itself and every other block once, and only links leave a
    meeting. A pair counts with the pivot of the first band that it shares, if its sizes allow
    the threshold, no batch of signatures rules it out and the full sets confirm it.
    """
    full = common.written(buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "neardup-rooted")
    several = full.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    own = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("band") % 63)).alias("own")
    groups = common.written(common.spread_join(full, several, "bucket", hot).groupBy("pivot", "node", "root").agg(own), "neardup-groups")
    common.drop(full)
    sizes = groups.groupBy("pivot", "root").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("pivot").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).select("pivot", F.col("top.root").alias("top"), F.col("top.n").alias("in_top"), (F.col("all") - F.col("top.n")).alias("others"))
    tops = common.written(tops, "neardup-tops")
    heavy = sets.join(groups.select("node").distinct(), "node").agg(F.avg(F.length("shingles"))).first()[0] or 0
    most = max(1, min(BLOCK_NODES, int(BLOCK_BYTES / (heavy + 1024))))
    # blocks from 1 on hold a largest component's nodes, those from -1 down the others
    hot = common.hot_keys(tops.select("pivot", (F.col("in_top") + F.col("others")).alias("n")), "pivot")
    placed = common.spread_join(groups, tops, "pivot", hot).withColumn("block", F.expr(f"CAST(CASE WHEN root = top THEN 1 + pmod(xxhash64(node), ceil(in_top / {most})) ELSE -1 - pmod(xxhash64(node), ceil(others / {most})) END AS INT)"))
    mixed = placed.select("pivot", "block", "node", "root", "own").join(signed, "node").join(sets, "node")
    lists = mixed.groupBy("pivot", "block").agg(F.collect_list(F.struct("node", "root", "size", "own", "values", "bands", "shingles")).alias("list"))
    blocks = common.written(lists, "neardup-blocks")
    steps = least_matches(numerator / denominator, miss, permutations)
    held = blocks.select("pivot", "block")
    # (pivot, x, y): rows without lists, at most the number of blocks for each block of others
    meetings = held.where("block < 0").toDF("pivot", "x").join(held.toDF("pivot", "y"), "pivot").where("y > 0 OR y <= x")
    common.drop(groups, tops)
    both = meetings.repartition(common.parallelism(buckets.sparkSession)).join(blocks.select("pivot", F.col("block").alias("x"), F.col("list").alias("xs")), ["pivot", "x"])
    # a block that meets itself is sent once
    other = blocks.select(F.col("pivot").alias("p"), F.col("block").alias("z"), F.col("list").alias("ys"))
    alone, two = both.where("x = y").select("xs", F.lit(None).cast(dict(blocks.dtypes)["list"]).alias("ys")), both.where("x != y").join(other, (F.col("pivot") == F.col("p")) & (F.col("y") == F.col("z"))).select("xs", "ys")

    def columns(block: pa.StructArray) -> tuple:
        node, root, size, own, values, bands, found = (pc.struct_field(block, c) for c in ("node", "root", "size", "own", "values", "bands", "shingles"))
        wide = (x.flatten().to_numpy().reshape(len(block), -1) for x in (values, bands))
        return (*(x.to_numpy() for x in (node, root, size, own)), *wide, [np.frombuffer(x, np.uint64) for x in found.to_pylist()])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                itself = not batch.column(1)[i].is_valid
                xn, xr, xz, xo, xv, xb, a = columns(batch.column(0)[i].values)
                yn, yr, yz, _, yv, yb, b = (xn, xr, xz, xo, xv, xb, a) if itself else columns(batch.column(1)[i].values)
                able = (xr[:, None] != yr) & (denominator * np.minimum(xz[:, None], yz) >= numerator * np.maximum(xz[:, None], yz))
                if itself:
                    able = np.triu(able, 1)
                mine = np.zeros_like(able)
                for k in range(xb.shape[1]):
                    first = able & (xb[:, k, None] == yb[:, k])
                    mine |= first & ((xo >> k % 63 & 1) == 1)[:, None]
                    able &= ~first
                p, q = np.nonzero(mine)
                matches, done = np.zeros(len(p), np.int64), 0
                for n, least in steps:
                    matches += (xv[p, done:n] == yv[q, done:n]).sum(axis=1)
                    keep = matches >= least
                    p, q, matches, done = p[keep], q[keep], matches[keep], n
                # likelier pairs first; those that links of this block connect already need no test
                above: dict[int, int] = {}

                def top(r: int) -> int:
                    while r in above:
                        r = above[r]
                    return r

                good = []
                for k in np.argsort(-matches, kind="stable").tolist():
                    u, v = top(int(xr[p[k]])), top(int(yr[q[k]]))
                    if u != v and _similar(a[p[k]], b[q[k]], numerator, denominator):
                        above[max(u, v)] = min(u, v)
                        good.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(xn[p[good]], pa.int64()), pa.array(yn[q[good]], pa.int64())], names=["a", "b"])

    found = common.written(common.arrow_map(alone.union(two), run, "a long, b long"), "neardup-links")
    common.drop(blocks)
    return found


def components(docs: DataFrame, k: int = 5, numerator: int = 4, denominator: int = 5, miss: float = 1e-6, permutations: int = PERMUTATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest identifier reachable), kept."""
    full = _rows(docs, k, numerator, denominator, miss, permutations, id_col, text_col)
    return full.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _rows(docs: DataFrame, k: int = 5, numerator: int = 4, denominator: int = 5, miss: float = 1e-6, permutations: int = PERMUTATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_key, n_shingles, component_id, single (it stands for its component, or has no words)."""
    threshold = numerator / denominator
    bands, rows = bands_for(threshold, permutations)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = common.written(digest(docs, k, permutations), "neardup-docs")
    nodes = known.where("digest IS NOT NULL").groupBy("digest").agg(_first_row().alias("row"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    nodes = nodes.select("digest", "row.doc_id", "row.text_key", "size", "signature")
    nodes = common.written(_banded(nodes.withColumn("node", F.monotonically_increasing_id()), bands, rows), "neardup-nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = common.written(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "neardup-shared")
    crowded = common.hot_keys(shared, "bucket")
    # only nodes that share a bucket with another go on
    buckets = common.written(common.spread_join(buckets, shared.select("bucket", "pivot"), "bucket", crowded), "neardup-buckets")
    common.drop(shared)
    pairs = common.written(buckets.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "neardup-pairs")
    near = nodes.join(buckets.select("node").distinct(), "node")
    signed = common.written(near.select("node", "size", "values", "bands"), "neardup-signed")
    sets = _sets(near.select("node", "digest", "doc_id", "text_key"), known, docs, k)
    # with its bucket's pivot: sequential verification, then the exact one
    x, y = (signed.select(F.col("node").alias(c), F.struct("size", "values").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    hot = common.hot_keys(pairs, "b")
    alive = common.spread_join(pairs.join(x, "a"), y, "b", hot).where(_possible("x", "y", numerator, denominator, miss, permutations)).select("a", "b")
    alive = common.written(alive, "neardup-alive")
    links = common.written(_exact(alive, sets, hot, numerator, denominator), "neardup-links")
    common.drop(pairs, alive)
    # so far: a node's root is the least pivot that it is linked with, or that pivot's root, or that one's
    least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = least
    for _ in range(2):
        above = least.toDF("_node", "_root")
        roots = roots.join(above, roots["root"] == above["_node"], "left").select("node", F.coalesce("_root", "root").alias("root"))
    roots = common.written(roots, "neardup-roots")
    # two nodes of a bucket have its pivot in common: what is left is in buckets that hold several components
    common.let_go(docs.sparkSession)
    left = _cross(buckets, crowded, roots, signed, sets, numerator, denominator, miss, permutations)
    common.drop(buckets, roots, signed, sets)
    common.let_go(docs.sparkSession)
    roots = connected(links.union(left))
    common.drop(links, left)
    rooted = common.written(nodes.select("node", "digest", "doc_id", "text_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "neardup-rooted")
    common.drop(nodes, roots)
    least = rooted.groupBy("root").agg(_first_row().alias("top"))
    of = common.spread_join(rooted.select("root", "digest"), least, "root", common.hot_keys(rooted, "root")).select("digest", F.col("top.doc_id").alias("component_id"), F.col("top.text_key").alias("top_key"))
    full = common.spread_join(known.select("doc_id", "text_key", "n_shingles", "digest"), of, "digest", common.hot_keys(known, "digest"), "left").withColumn("component_id", F.expr("CASE WHEN digest IS NULL THEN doc_id ELSE component_id END"))
    out = full.select("doc_id", "text_key", "n_shingles", "component_id", F.expr("digest IS NULL OR (doc_id <=> component_id AND text_key = top_key)").alias("single"))
    out = common.written(out, "neardup-result")
    common.drop(known, rooted)
    return out


def _first_row() -> Column:
    """The least identifier's row; a null one comes last, equal ones go by text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One document of each component, with the smallest identifier, and all rows without words. Rows that repeat an identifier and its text go or stay together."""
    rows = _rows(docs, id_col=id_col, text_col=text_col, **parameters)
    gone = common.written(rows.where("NOT single").select(_row_key().alias("_gone")).distinct(), "neardup-gone")
    common.drop(rows)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own_id, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    plain = docs.toDF(*names).withColumn("_key", _text_key(names[docs.columns.index(text_col)]))
    key = F.concat("_key", F.coalesce(own_id.cast("long").cast("string").cast("binary"), F.lit(b"")))
    stay = plain.join(gone, key == F.col("_gone"), "left_anti")
    # without identifier, copies of a component's one text are left
    bare = F.coalesce(own_id.cast("long").isNull() & text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return stay.where(~bare).union(stay.where(bare).dropDuplicates(["_key"])).select(names).toDF(*docs.columns)
