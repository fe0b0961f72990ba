import numpy as np
import pytest

from binfold.llm import common, mtree
from binfold.llm.queries import op4_mtree_topk


def brute(rows, every, k=5):
    rows = [(i, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = set()
    for i, q in rows:
        if i % every == 0:
            scores = x @ q
            best = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist()) if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op4_mtree_topk(spark, sf_dir).collect()}
    assert got == brute(rows, 50)


@pytest.mark.parametrize("n", [1, 3, 700])
def test_ties_nulls_and_odd_rows(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(n)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(300 if n > 3 else 2)]
    bad = [(None, [1.0] * 4), (5000, None), (5001, [1.0, None, 1.0, 1.0]), (5002, [float("nan")] * 4), (5003, [float("inf")] * 4), (5004, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, x string")
    v = mtree.vectors(frame)
    index = mtree.build_index(v, pivots=8, page=64)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.search(index, v.where("vec_id % 5 = 0"), block=16).collect()}
    assert got == brute([(i, np.array(v, np.float32).tolist()) for i, v in rows], 5)


def test_empty_table(spark):
    assert mtree.build_index(mtree.vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))) is None


def test_far_pages_are_not_searched():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (200, 8)) + 1000 * s for s in (-1, 1)])
    m = int((x * x).sum(axis=1).max())
    aug = mtree._augment(x, m)
    tree = mtree.build_tree(aug)
    covered = [i for r in tree["rows"] if r is not None for i in r.tolist()]
    assert sorted(covered) == list(range(400))
    for node, kids in enumerate(tree["children"]):
        if kids is None:
            d = np.sqrt(((aug[tree["rows"][node]] - aug[tree["object"][node]]) ** 2).sum(axis=1))
            assert d.max() <= tree["radius"][node] + 1e-9


def test_repeated_identifiers_with_other_vectors(spark):
    """An identifier's rows are its own, whatever their vectors; its answers are the best of all its vectors'."""
    rng = np.random.default_rng(4)
    rows = [(i % 40, [float(v) for v in rng.normal(size=4)]) for i in range(400)] + [(i, [2.0, 2.0, 2.0, 2.0]) for i in range(40)] * 2
    v = mtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = mtree.build_index(v, pivots=6, page=32)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.search(index, v.where("vec_id % 5 = 0")).collect()}
    x = [(i, np.floor(np.array(w) * 256).astype(int)) for i, w in rows]
    want = set()
    for i in range(0, 40, 5):
        vectors = {tuple(w.tolist()) for j, w in x if j == i}
        best = sorted((-int(w @ np.array(q)), j) for q in vectors for j, w in x if j != i)[:5]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert got == want


def test_lengths_that_differ_and_large_components(spark):
    """A shorter vector goes on with zeros; sums beyond 53 bits stay exact."""
    rows = [(i, [float((i * 7919) % 1000) * 1e7 + j for j in range(2 + i % 3)]) for i in range(60)]
    v = mtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = mtree.build_index(v, pivots=3, page=16)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.search(index, v.where("vec_id % 20 = 0")).collect()}
    x = {i: [int(np.floor(256 * c)) for c in w] for i, w in rows}
    score = lambda a, b: min(max(sum(p * q for p, q in zip(x[a], x[b])), -(1 << 63)), (1 << 63) - 1)
    want = set()
    for i in range(0, 60, 20):
        best = sorted((-score(i, j), j) for j in x if j != i)[:5]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert got == want


def test_copies_beyond_the_smallest_identifiers_are_indexed_but_idle(spark):
    rows = [(i, [1.0, 0.0]) for i in range(500)] + [(500 + i, [0.1 * i, 1.0]) for i in range(50)]
    v = mtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).coalesce(1)
    index = mtree.build_index(v, pivots=2, page=40)
    pages = index.pages.collect()
    assert sum(len(r["ids"]) for r in pages) == 550 and any(r["idle"] for r in pages)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.search(index, v.where("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, 50)


def test_one_identifier_repeated_over_many_pages(spark):
    """Pages of one identifier's copies don't make the next identifiers' ones idle."""
    rows = [(3, [1.0, 0.0])] * 800 + [(i, [1.0, 0.0]) for i in (10, 11, 12, 13, 14, 15)]
    v = mtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).coalesce(1)
    index = mtree.build_index(v, pivots=1, page=8)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in mtree.search(index, v.where("vec_id = 3")).orderBy("rank").collect()]
    assert got == [(3, i + 1, 10 + i) for i in range(5)]


def test_no_vectors_pass_through_the_driver(spark):
    """Neither the ranges of the pages nor the search send vectors or blocks of queries to the driver: its results hold at 2 MB."""
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 512)).tolist())]
    v = common.written(mtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vectors")
    conf, limit = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    usual = conf.get(limit, "1g")
    conf.set(limit, "2m")
    try:
        index = mtree.build_index(v, pivots=8, page=100)
        found = common.written(mtree.search(index, v.where("vec_id % 20 = 0"), block=16), "found").collect()
    finally:
        conf.set(limit, usual)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found}
    assert got == brute(rows, 20)
    assert spark.conf.get("spark.sql.execution.rangeExchange.sampleSizePerPartition") == "100"


def test_blocks_are_not_broadcast(spark):
    """A block is one row to Spark, which takes it for a small one; all of them don't fit the driver."""
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(600, 8)).tolist())]
    v = common.written(mtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vectors")
    found = mtree.search(mtree.build_index(v, pivots=4, page=64), v.where("vec_id % 10 = 0"), block=8)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == brute(rows, 10)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and not any("collect_list" in x for x in plan.split("BroadcastExchange")[1:])


def test_routing_vectors_have_a_bound_in_bytes(spark, monkeypatch):
    rows = [(i, [float(i % 17), float(i)]) for i in range(300)]
    v = common.written(mtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vectors")
    monkeypatch.setattr(mtree, "PIVOT_BYTES", 5 * 16)
    index = mtree.build_index(v, page=4)
    assert len(index.pivots) <= 5
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.search(index, v.where("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, 50)
