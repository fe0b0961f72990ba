"""Exact top-k by inner product with an M-tree: paged metric nodes, best-first search.

Components become integers floor(256 x). With one more coordinate, sqrt(M - |x|^2) where M is
the largest squared norm, all vectors lie on a sphere, and the squared distance to a query
(whose added coordinate is 0) is |q|^2 + M - 2 q.x: the largest inner products are the nearest
vectors of a metric space. Scores are exact: products of doubles where no sum can leave their
53 bits, Python integers beyond (cut to the range of a long). Distances have a margin.

Index. Routing vectors are a bounded sample, one for each page's worth of rows (MOST_PIVOTS at
most, by the smallest hashes); every vector belongs to its nearest one. The rows are sorted by
routing vector, distance from it, a hash of the vector, vec_id and row, range by range, and cut
into pages: rings around a routing vector, however many a vector or identifier has. The driver
gets a bounded sample of these keys, which hold no vectors. Each page is an M-tree in
plain columns: nodes with a routing object, a covering radius and the distance to the parent's
object, leaves with each row's distance to the leaf's object.

Search. A query first goes to the innermost page of its nearest routing vector; its k-th score
there bounds the answer. Then it goes to those pages alone whose ring can hold a vector as
good. A page meets queries in blocks: a heap of nodes by their least possible distance to a
query that still needs them, and the stored distance to the parent and the triangle inequality
rule out nodes, and rows of a leaf, before any distance to them is computed; what is left of a
leaf meets what is left of the block in one product. The pages' leaf meets what is left of the block in one product. The pages' answers, k for a query at
most, are merged. Pages and blocks always meet by a sort-merge join: a block is one row to
Spark, whose guess of its size would have it broadcast them all.

Of rows with one and the same vector, those beyond the smallest identifiers can't be answers
for k below KNOWN_K: pages that hold nothing else are kept in the index but not searched.

Vectors that are null, empty or hold a null or non-finite component (also after multiplying)
take no part, as rows with a null vec_id don't. Vectors of different lengths meet as if the
shorter one went on with zeros. Ties go to the smaller vec_id. A query's own row is every row
with its vec_id. Rows that repeat a vec_id and vector count once each as candidates of other
queries and once as a query; a vec_id with several vectors gets the k best answers that all of
them have together. An empty table has no index and no answers. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.llm import common

#: Routing vectors and their bytes at most: they go to every task.
MOST_PIVOTS, PIVOT_BYTES = 4096, 8 << 20
#: Keys that the driver samples for the ranges of the pages: three times as many at most, or three a range.
SAMPLED = 60_000
#: Rows and bytes of a page, rows of a leaf, queries of a block at most.
PAGE, PAGE_BYTES, FAN, BLOCK = 8192, 8 << 20, 128, 512
#: Up to this k, pages of copies beyond as many identifiers aren't searched.
KNOWN_K = 64
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def build_tree(x: np.ndarray, fan: int = FAN) -> dict:
    """An M-tree over the rows of x: flat arrays of nodes, leaves hold rows.

    Made from above: a node's rows are dealt to their nearest of a few routing objects, far
    from each other, until a leaf's worth is left.
    """
    nodes: dict[str, list] = {"object": [], "radius": [], "to_parent": [], "children": [], "rows": [], "row_dist": []}

    def add(rows: np.ndarray, parent: int) -> int:
        center = x[rows].mean(axis=0)
        obj = int(rows[np.argmin(((x[rows] - center) ** 2).sum(axis=1))])
        dist = np.sqrt(((x[rows] - x[obj]) ** 2).sum(axis=1))
        nodes["object"].append(obj)
        nodes["radius"].append(float(dist.max()))
        nodes["to_parent"].append(0.0 if parent < 0 else float(np.sqrt(((x[obj] - x[nodes["object"][parent]]) ** 2).sum())))
        nodes["children"].append(None)
        nodes["rows"].append(rows)
        nodes["row_dist"].append(dist)
        return len(nodes["object"]) - 1

    todo = [add(np.arange(len(x)), -1)]
    for me in todo:  # grows: level by level, a node's children side by side
        rows, dist = nodes["rows"][me], nodes["row_dist"][me]
        if len(rows) <= fan or not dist.max() > 0:
            continue
        near, owner, at = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), int(np.argmax(dist))
        for s in range(min(8, -(-len(rows) // fan) + 1)):
            d = ((x[rows] - x[rows[at]]) ** 2).sum(axis=1)
            owner[d < near] = s
            near = np.minimum(near, d)
            at = int(np.argmax(near))
            if not near[at] > 0:
                break
        parts = [rows[owner == s] for s in range(int(owner.max()) + 1)]
        nodes["children"][me] = [add(p, me) for p in parts if len(p)]
        nodes["rows"][me] = nodes["row_dist"][me] = None
        todo += nodes["children"][me]
    return nodes


#: A page's tree as columns. Of a leaf, begin and end count rows, else nodes; rows lie in the order of their leaves.
TREE = (("object", pa.int32()), ("radius", pa.float64()), ("to_parent", pa.float64()), ("begin", pa.int32()), ("end", pa.int32()), ("leaf", pa.bool_()))


def _flat(tree: dict) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The order of the rows, the columns of the nodes, and each row's distance to its leaf's object."""
    leaf = np.array([c is None for c in tree["children"]])
    order = np.concatenate([r for r in tree["rows"] if r is not None])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin, end, done = np.zeros(len(leaf), np.int64), np.zeros(len(leaf), np.int64), 0
    for i, kids in enumerate(tree["children"]):
        if kids is None:
            begin[i], done = done, done + len(tree["rows"][i])
            end[i] = done
        else:
            begin[i], end[i] = kids[0], kids[-1] + 1
    columns = {"object": place[tree["object"]], "radius": np.array(tree["radius"]), "to_parent": np.array(tree["to_parent"]), "begin": begin, "end": end, "leaf": leaf}
    return order, columns, np.concatenate([d for d in tree["row_dist"] if d is not None])


def inner(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of x and rows of q, as integers."""
    if exact:
        return (x @ q.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape) for m in (x, q))
    return np.clip(a @ b.T, _LEAST, _MOST).astype(np.int64)


class Best:
    """The k best (score, vec_id) of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.last_score, self.last_id = floor.copy(), np.full(n, _MOST)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        good = (score > self.last_score[query]) | (score == self.last_score[query]) & (vec_id <= self.last_id[query])
        if not good.any():
            return
        query, score, vec_id = (np.concatenate([x, y[good]]) for x, y in ((self.query, query), (self.score, score), (self.id, vec_id)))
        order = np.lexsort((vec_id, -score.astype(float), query)) if np.abs(score).max() < _EXACT else np.array(sorted(range(len(query)), key=lambda i: (query[i], -int(score[i]), vec_id[i])))
        query, score, vec_id = query[order], score[order], vec_id[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        full = rank == self.k - 1
        self.last_score[query[full]], self.last_id[query[full]] = score[full], vec_id[full]
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], vec_id[keep]


def search_page(page: dict, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int, m: float) -> Best:
    """The k best rows of a page for each query of a block that reach its floor, without rows of its own identifier."""
    x, ids = page["x"], page["ids"]
    norms, q_norms = (x * x).sum(axis=1), (q * q).sum(axis=1)
    exact = math.sqrt(norms.max()) * math.sqrt(q_norms.max(initial=0)) < _EXACT
    reach = q_norms + m
    margin = 1e-6 * (1 + np.sqrt(reach))
    best = Best(len(q), k, floor)

    def limit(i: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(reach[i] - 2.0 * best.last_score[i], 0)) + margin[i]

    def distance(rows: np.ndarray | slice, i: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(reach[i][:, None] - 2.0 * (q[i] @ x[rows].T), 0))

    every = np.arange(len(q))
    d = distance(page["object"][:1], every)[:, 0]
    low = np.maximum(d - page["radius"][0], 0)
    agenda = [(float(low.min(initial=np.inf)), 0, every, d, low)]
    while agenda:
        _, node, i, d, low = heapq.heappop(agenda)
        open_ = low <= limit(i)
        i, d = i[open_], d[open_]
        if not len(i):
            continue
        a, b, far = int(page["begin"][node]), int(page["end"][node]), limit(i)
        if page["leaf"][node]:
            near = np.abs(d[:, None] - page["row_dist"][a:b]) <= far[:, None]
            rows, who = np.flatnonzero(near.any(axis=0)), np.flatnonzero(near.any(axis=1))
            if len(rows):
                scores = inner(x[a + rows], q[i[who]], exact).T
                query = np.repeat(i[who], len(rows))
                vec_id = np.tile(ids[a + rows], len(who))
                scores = scores.ravel()
                fit = (scores >= best.last_score[query]) & (vec_id != q_ids[query])
                best.add(query[fit], scores[fit], vec_id[fit])
            continue
        maybe = np.abs(d[:, None] - page["to_parent"][a:b]) - page["radius"][a:b] <= far[:, None]
        kids, who = np.flatnonzero(maybe.any(axis=0)), np.flatnonzero(maybe.any(axis=1))
        if len(kids):
            all_d = distance(page["object"][a + kids], i[who])
            for c, dc in zip((a + kids).tolist(), all_d.T):
                low = np.maximum(dc - page["radius"][c], 0)
                mine = maybe[who, c - a] & (low <= far[who])
                if mine.any():
                    heapq.heappush(agenda, (float(low[mine].min()), c, i[who][mine], dc[mine], low[mine]))
    return best


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, norm, row): the usable vectors as doubles of integer value in a binary column, their squared norms, and a number of the row."""
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= 2.0**1000 / 256))
    found = table.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    wide = found.agg(F.max(F.size("v"))).first()[0] or 0

    def flat(batches):
        for b in batches:
            if not b.num_rows:
                continue
            per = b.column(1).value_lengths().to_numpy()
            values = np.floor(b.column(1).flatten().to_numpy().astype(np.float64) * 256)
            v = np.zeros((b.num_rows, wide))
            v[np.repeat(np.arange(b.num_rows), per), common.ragged(np.zeros(len(per), np.int64), per)] = values
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array((v * v).sum(axis=1)), b.column(2)], names=["vec_id", "x", "norm", "row"])

    return common.arrow_map(found.withColumn("row", F.monotonically_increasing_id()), flat, "vec_id long, x binary, norm double, row long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _augment(x: np.ndarray, m: float) -> np.ndarray:
    return np.column_stack([x.astype(np.float64), np.sqrt(np.maximum(m - (x * x).sum(axis=1), 0))])


class Index:
    """Pages in a written table; on the driver M, and of each routing vector (MOST_PIVOTS at most) the vector, its ring and its innermost page."""

    def __init__(self, pages: DataFrame, pivots: np.ndarray, rings: dict[int, tuple[float, float, int]], m: float) -> None:
        self.pages, self.pivots, self.rings, self.m = pages, pivots, rings, m


PAGES = "page long, pivot int, lo double, hi double, idle boolean, first_id long, ids array<long>, x binary, row_dist array<double>, object array<int>, radius array<double>, to_parent array<double>, begin array<int>, end array<int>, leaf array<boolean>"
_PAGE_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), *(pa.list_(t) for _, t in TREE)]


def build_index(rows: DataFrame, pivots: int = MOST_PIVOTS, page: int = PAGE) -> Index | None:
    """rows: (vec_id, x, norm, row), in a written table at best. None if there is no vector."""
    n, m, wide = rows.agg(F.count("*"), F.max("norm"), F.max(F.length("x"))).first()
    if not n:
        return None
    page = max(1, min(page, PAGE_BYTES // wide))
    want = max(1, min(pivots, PIVOT_BYTES // wide, -(-n // page)))
    # vectors of one in so many hashes, each once: a common one doesn't fill the sample
    h = F.xxhash64("x")
    some = rows.where(F.pmod(h, F.lit(max(1, n // (8 * want)))) == 0).select("x").distinct().orderBy(h, "x").limit(want).collect()
    p = np.array([np.frombuffer(r["x"], np.float64) for r in some or rows.select("x").limit(1).collect()])
    p_aug = _augment(p, m)
    p_norms = (p_aug * p_aug).sum(axis=1)

    def route(batches):
        for whole in batches:
            step = max(1, (4 << 20) // len(p))
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                aug = _augment(_matrix(b.column(1)), m)
                d = np.maximum((aug * aug).sum(axis=1)[:, None] + p_norms - 2 * aug @ p_aug.T, 0)
                near = d.argmin(axis=1)
                # equal vectors have equal distances, wherever in a block they stand
                dist = np.sqrt(((aug - p_aug[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near, pa.int32()), pa.array(dist)], names=["vec_id", "x", "row", "pivot", "dist"])

    routed = common.written(common.arrow_map(rows.select("vec_id", "x", "row"), route, "vec_id long, x binary, row long, pivot int, dist double"), "mtree-routed")
    # the vector's hash for the vector: should two vectors share it, their copies mix, and fewer pages are idle
    keys = ("pivot", "dist", "h", "vec_id", "row")
    ranges = common.parallelism(rows.sparkSession)
    dealt = routed.withColumn("h", F.xxhash64("x")).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        copies: tuple = None, 0, None  # the last row's vector, how many identifiers of it came so far, and the last of them

        def made() -> pa.RecordBatch:
            nonlocal number, copies
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            raw, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
            order, tree, row_dist = _flat(build_tree(_augment(x, m)))
            pure, last = len(set(raw)) == 1, raw[-1]
            before, of = (copies[1], copies[2]) if copies[0] == last else (0, None)
            idle = pure and before > KNOWN_K
            of_last = np.unique(ids[[r == last for r in raw]])  # in ascending order, as the rows of a vector are
            copies = last, before + len(of_last) - (of == of_last[0]), int(of_last[-1])
            dist = batch.column(4).to_numpy()
            values = [number, batch.column(3)[0].as_py(), float(dist.min()), float(dist.max()), idle, int(ids.min()), ids[order], x[order].tobytes(), row_dist, *(tree[c] for c, _ in TREE)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PAGE_TYPES)], names=[c.split()[0] for c in PAGES.split(", ")])

        for batch in batches:
            pivot, at = batch.column(3).to_numpy(), 0
            while at < batch.num_rows:
                if held and held[0].column(3)[0].as_py() != pivot[at]:
                    yield made()
                room = page - sum(b.num_rows for b in held)
                end = min(at + room, at + int(np.searchsorted(pivot[at:], pivot[at], "right")))
                held.append(batch.slice(at, end - at))
                if end - at == room:
                    yield made()
                at = end
        if held:
            yield made()

    conf, sampled = rows.sparkSession.conf, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    usual = conf.get(sampled)
    conf.set(sampled, str(max(1, min(int(usual), SAMPLED // ranges))))
    try:
        pages = common.written(common.arrow_map(dealt.select("vec_id", "x", "row", "pivot", "dist"), cut, PAGES), "mtree-pages")
    finally:
        conf.set(sampled, usual)
    inmost = F.min(F.struct("lo", "first_id", "page")).alias("first")
    rings = {r["pivot"]: (r["first"]["lo"], r["hi"], r["first"]["page"]) for r in pages.groupBy("pivot").agg(inmost, F.max("hi").alias("hi")).collect()}  # a row for each routing vector
    return Index(pages, p, rings, m)


def _search_pages(index: Index, asked: DataFrame, k: int, block: int) -> DataFrame:
    """asked: (page, query, query_id, x, floor). (query, query_id, score, vec_id): each page's k best."""
    per = asked.groupBy("page").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = asked.join(per, "page").groupBy("page", F.pmod(F.xxhash64("query"), "blocks").alias("block"))
    blocks = dealt.agg(F.collect_list(F.struct("query", "query_id", "x", "floor")).alias("queries"))
    columns = ["ids", "x", "row_dist", *(c for c, _ in TREE)]
    # a page's blocks stream by its one row
    work = blocks.select("page", "queries").hint("merge").join(index.pages.select("page", *columns), "page").select(*columns, "queries")
    m = index.m

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                page = {c: batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j, c in enumerate(columns) if c != "x"}
                page["x"] = np.frombuffer(batch.column(1)[i].as_py(), np.float64).reshape(len(page["ids"]), -1)
                asked = batch.column(len(columns))[i].values
                query, q_ids, q, floor = (asked.field(j) for j in range(4))
                floor = np.array([_LEAST if f is None else f for f in floor.to_pylist()], np.int64)
                best = search_page(page, _matrix(q), q_ids.to_numpy(), floor, k, m)
                at = pa.array(best.query)
                yield pa.RecordBatch.from_arrays([query.take(at), q_ids.take(at), pa.array(best.score), pa.array(best.id)], names=["query", "query_id", "score", "vec_id"])

    return common.arrow_map(work, run, "query long, query_id long, score long, vec_id long")


def search(index: Index, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """queries: (vec_id, x, norm, row). A row for each answer: query_id, rank, vec_id, score."""
    p, rings, m = index.pivots, index.rings, index.m
    held = np.array(sorted(rings), np.int64)
    lo, hi = (np.array([rings[i][j] for i in held.tolist()]) for j in (0, 1))
    inmost = np.array([rings[i][2] for i in held.tolist()], np.int64)

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + m - 2.0 * (x @ p[held].T), 0))

    def steps(batches):
        for whole in batches:
            step = max(1, (2 << 20) // len(held))
            yield from (whole.slice(i, step) for i in range(0, whole.num_rows, step))

    def home(batches):
        for b in steps(batches):
            page = inmost[distances(_matrix(b.column(2))).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(page)], names=["query", "query_id", "x", "page"])

    def pages(batches):
        for b in steps(batches):
            x = _matrix(b.column(2))
            d, norms = distances(x), (x * x).sum(axis=1)
            floor = np.array([-math.inf if f is None else f for f in b.column(3).to_pylist()], float)
            reach = np.sqrt(np.maximum(norms + m - 2.0 * floor, 0)) * (1 + 1e-6) + 1e-3 + 1e-6 * np.sqrt(m)
            at, pivot = np.nonzero((d - hi <= reach[:, None]) & (lo - d <= reach[:, None]))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array(held[pivot], pa.int32()), pa.array(d[at, pivot]), pa.array(reach[at])], names=["query", "query_id", "x", "floor", "pivot", "d", "reach"])

    every = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "x")
    every = common.written(common.arrow_map(every.groupBy("query_id", "x").agg(F.min("query").alias("query")).select("query", "query_id", "x"), home, "query long, query_id long, x binary, page long"), "mtree-queries")
    first = _search_pages(index, every.withColumn("floor", F.lit(None).cast("long")), k, block)
    floors = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    bound = every.join(floors, "query", "left").select("query", "query_id", "x", "floor")
    planned = common.arrow_map(bound, pages, "query long, query_id long, x binary, floor long, pivot int, d double, reach double")
    wanted = index.pages.select("page", "pivot", "lo", "hi", "idle")
    wanted = (wanted.where("NOT idle") if k < KNOWN_K else wanted).select("page", "pivot", "lo", "hi")
    asked = planned.join(wanted, "pivot").where("d - hi <= reach AND lo - d <= reach").select("page", "query", "query_id", "x", "floor")
    found = _search_pages(index, common.written(asked, "mtree-asked"), k, block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
