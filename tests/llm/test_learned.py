import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from binfold.llm import resample, toxicity


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def planted(spark, n=600):
    """Clean and toxic rows of invented words; insults stand in passages of toxic ones."""
    rng = np.random.default_rng(6)
    words, insults = ["w" + "".join(rng.choice(list("abcdefg"), 4)) for _ in range(300)], ["zork", "blarg", "fnord"]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, int(rng.integers(10, 120))))
        bad = i % 4 == 0
        if bad:
            at = int(rng.integers(len(text)))
            text[at:at] = list(rng.choice(insults, 4))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_toxicity(spark, larger):
    docs, labels = planted(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    test = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in test]) > 0.97
    hit = next(r for r in test if r["toxic"] and r["predicted"])
    text = docs.where(F.col("doc_id") == hit["doc_id"]).first()["text"].split()
    p = max(hit["passages"], key=lambda p: p["score"])
    assert {"zork", "blarg", "fnord"} & set(text[p["begin"] : p["end"]])
    docs, labels = larger
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9


def test_held_out_labels_are_not_read(spark):
    docs, labels = planted(spark, 300)
    twisted = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda y: sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.train(docs, y)).collect())
    assert rows(labels) == rows(twisted)


def test_toxicity_of_odd_rows(spark, odd, none, labels):
    model = toxicity.train(*planted(spark, 200))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(r["predicted"] == 0 for r in got)
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.score(none, model).count() == 0 == toxicity.reject(none, model).count()
    unlabelled = labels.where("false")
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, unlabelled)).collect()} == {toxicity.Model({}).probability(-20, 0)}
    nulls = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.train(odd, nulls) is not None


def test_importance_sample(spark, larger):
    docs, labels = larger
    ratio = resample.fit(docs, labels)
    rows = resample.resample(docs, ratio).join(labels, "doc_id").collect()
    good, poor = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([r["kept"] for r in good]) > 0.99 and np.mean([r["kept"] for r in poor]) < 0.05
    kept = {r["doc_id"] for r in resample.resample(docs, ratio).where("kept").collect()}
    sample = resample.keep_sample(docs, ratio)
    assert sample.columns == docs.columns and {r["doc_id"] for r in sample.collect()} == kept


def test_the_weight_is_the_ratio_of_the_models(spark):
    docs = spark.createDataFrame([(1, "Aa bb. cc"), (2, "AA!! BB!!"), (3, "")], "doc_id long, text string")
    target, raw = resample.bucket_counts(docs.where("doc_id = 1")), resample.bucket_counts(docs)
    assert target.sum() == 5 and raw.sum() == 8
    ratio = resample.Ratio(target, raw, 0.5)
    expected = raw * (5 / 8)
    for r in resample.weigh(docs, ratio).collect():
        counts = resample.bucket_counts(docs.where(F.col("doc_id") == r["doc_id"]))
        want = (counts * np.log((target + 2.0) / (expected + 2.0))).sum()
        assert math.isclose(r["log_weight"], want, abs_tol=1e-9)


def test_gumbel_numbers_draw_in_proportion(spark):
    # of rows with weights 1 to 4, the largest key picks each in proportion
    rows = [(i, f"t{i}") for i in range(20_000)]
    seeds = spark.createDataFrame(rows, "doc_id long, text string").select(resample._seed("doc_id", "text").alias("s")).toArrow()["s"].combine_chunks()
    keys = resample._gumbel(seeds).reshape(-1, 4) + np.log([1, 2, 3, 4])
    share = np.bincount(keys.argmax(axis=1), minlength=4) / len(keys)
    assert np.abs(share - np.array([0.1, 0.2, 0.3, 0.4])).max() < 0.03


@pytest.mark.parametrize("k", [1, 2, 77, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(size=700), rng.normal(size=300) * 1e6]), 2).tolist()
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert resample.kth_largest(df, "v", k, bins=16) == sorted(x, reverse=True)[k - 1]


def test_sampling_odd_rows(spark, odd, none, labels):
    y = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    ratio = resample.fit(odd, y)
    assert resample.resample(odd, ratio).count() == odd.count()
    assert resample.keep_sample(odd, ratio).columns == odd.columns
    assert resample.fit(odd, labels.where("false")) is None
    assert resample.keep_sample(odd, None).count() == odd.count() == resample.resample(odd, None).where("kept").count()
    assert resample.resample(none, ratio).count() == 0 == resample.keep_sample(none, ratio).count()


def plain_words(text):
    return [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(" ") if w]


def test_the_model_against_a_plain_version(spark):
    """Token bounds by counting, lambda as a root, best segments by all sums, and the score from them, for each text."""
    docs, labels = planted(spark, 400)
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    model = toxicity.train(docs, labels)
    learn = [i for i in texts if fold[i] in (1, 2, 3)]
    n = {v: sum(y[i] == v for i in learn) for v in (0, 1)}
    counts = {0: {}, 1: {}}
    for i in learn:
        words = set(plain_words(texts[i]))
        for t in words | {w[:k] + "*" for w in words for k in range(4, 8) if k < len(w)}:
            counts[y[i]][t] = counts[y[i]].get(t, 0) + 1
    bounds = {}
    for t, c1 in counts[1].items():
        c0 = counts[0].get(t, 0)
        share = (c1 + c0) / (n[0] + n[1])
        a, b = 10 * share + 0.5, 10 * (1 - share) + 0.5
        odds = math.log((c1 + a) / (n[1] - c1 + b)) - math.log((c0 + a) / (n[0] - c0 + b))
        bound = odds - 1.64 * math.sqrt(1 / (c1 + a) + 1 / (c0 + a))
        if c1 >= 3 and bound > 1:
            bounds[t] = bound
    assert model.tokens.keys() == bounds.keys() and all(math.isclose(model.tokens[t], b, rel_tol=1e-9) for t, b in bounds.items())

    def scores(text):
        out = []
        for w in plain_words(text):
            best = max(bounds.get(t, 0.0) for t in [w, *(w[:k] + "*" for k in range(4, 8) if k < len(w))])
            out.append(best if best > 0 else -1.0)
        return out

    clean, words = [], 0
    for i in texts:
        if fold[i] and not y[i]:
            clean += [v for *_, v in toxicity.maximal_segments(scores(texts[i]))]
            words += len(plain_words(texts[i]))
    if clean:
        chance = sum(math.exp(model.rate * v) for v in clean) + (words - len(clean)) * math.exp(-model.rate)
        assert model.rate > 9.9 or math.isclose(chance, words, rel_tol=1e-3)
    for r in toxicity.score(docs, model).collect():
        s = scores(texts[r["doc_id"]])
        sums = [sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)]
        base = math.log(model.level * max(len(s), 1))
        best = max(model.rate * max(sums) - base if max(sums) > 0 else -base - model.rate, -20)
        assert max(p["score"] for p in r["passages"]) == pytest.approx(max(sums)) if r["passages"] else best <= 1e-9
        total = sum(max(0, model.rate * v - base) for *_, v in toxicity.maximal_segments(s))
        z = model.curve[0] + model.curve[1] * max(-20.0, min(best, 40.0)) + model.curve[2] * math.log1p(total)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), abs=1e-9)


def test_an_identifier_with_more_texts_than_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, "toxic", 50, "doc_id", "text").count() == 50


def test_importance_sample_against_a_plain_version(spark, larger):
    """Weights, k and the kept set from the definition: words to shapes, shapes and pairs to buckets, counts to ratios."""
    import xxhash

    docs, labels = larger
    docs = docs.where("doc_id % 3 = 0").union(docs.sparkSession.createDataFrame([(10**9, None), (10**9 + 1, "")], "doc_id long, text string").join(docs.drop("doc_id", "text").limit(1)).select(*docs.columns))
    rows = docs.select("doc_id", "text", resample._seed("doc_id", "text").alias("seed")).collect()
    mask = (1 << 64) - 1

    def grams(text):
        words = [w for w in resample.re.split(r"[ \t\n\v\f\r]+", text or "") if w]
        h = [1 if i and words[i] == words[i - 1] else xxhash.xxh3_64_intdigest(resample.shape(w)) for i, w in enumerate(words)]
        one = [(x * 0x9E3779B97F4A7C15 & mask) >> 48 for x in h]
        two = [((x * 0xC2B2AE3D27D4EB4F + (z ^ 0x5851F42D4C957F2D)) * 0x9E3779B97F4A7C15 & mask) >> 48 for x, z in zip(h, h[1:])]
        return one + two

    assert [resample.shape(w) for w in ("Hello", "AAA", "a1234b", "x--y!!", "***", "")] == ["Aa+", "A+", "a9a", "a-+a!+", "*+", ""]
    y = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None and not held_out(r["doc_id"]):
            y[r["doc_id"]] = max(y.get(r["doc_id"], 0), r["quality"])
    texts = {}
    for r in rows:
        if r["doc_id"] in y and r["text"] is not None:
            texts[r["text"]] = max(texts.get(r["text"], 0), y[r["doc_id"]])
    target, raw = np.zeros(1 << 16), np.zeros(1 << 16)
    for t, good in texts.items():
        if good:
            np.add.at(target, np.array(grams(t), int), 1)
    for r in rows:
        np.add.at(raw, np.array(grams(r["text"]), int), 1)
    share = sum(texts.values()) / len(texts)
    log = np.log((target + 2) / (raw * target.sum() / raw.sum() + 2))
    weight = {r["doc_id"]: float(log[np.array(grams(r["text"]), int)].sum()) for r in rows}
    gumbel = {r["doc_id"]: -math.log(-math.log((((r["seed"] & mask) >> 11) + 0.5) * 2.0**-53)) for r in rows}
    k = sum(w + math.log(share) >= math.log(0.5) for w in weight.values())
    best = sorted(weight, key=lambda i: -(weight[i] + gumbel[i]))[:k]
    got = resample.resample(docs, resample.fit(docs, labels)).collect()
    for r in got:
        assert r["log_weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-6)
        assert r["key"] == pytest.approx(weight[r["doc_id"]] + gumbel[r["doc_id"]], abs=1e-6)
    assert {r["doc_id"] for r in got if r["kept"]} == set(best)
