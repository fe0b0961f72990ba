import re

import corpus_pipeline
from binfold.llm import neardup, packing, pii, queries
from binfold.llm.common import written
from tests.llm.test_documents import brute_components


def test_stages_by_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf_dir), name))
    documents, clean, good, single, masked, packed = (x.collect() for x in seen)
    assert all(x.columns == docs.columns for x in seen[:5])
    ids = lambda rows: {r["doc_id"] for r in rows}
    # filters: most labelled rows go as their labels say
    gone = ids(documents) - ids(clean)
    assert sum(labels[i]["toxic"] for i in gone if i in labels) >= 0.7 * len([i for i in gone if i in labels])
    poor = ids(clean) - ids(good)
    known = [labels[i]["quality"] for i in poor if i in labels]
    assert sum(known) <= 0.1 * max(len(known), 1)
    # near duplicates: the least identifier of each component, by all pairs
    rows = [(r["doc_id"], r["text"]) for r in good]
    want = {int(s[1:-1].split(", ")[0]) for s in brute_components(rows, 5, 4, 5) if s[1:-1].split(", ")[0] == s[1:-1].split(", ")[2]}
    assert ids(single) == want
    # personal data: other characters stay, e-mail addresses are gone
    assert ids(masked) == ids(single)
    for r in masked:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r["text"]) and r["n_chars"] == len(r["text"])
    # packing: every document's tokens once
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {r["doc_id"]: r["doc_tokens"] for r in packed} and tokens.keys() == ids(masked)
    assert sorted(map(tuple, packed)) == sorted(map(tuple, queries.pipeline(spark, sf_dir).collect()))


def test_stages_on_odd_rows(spark, odd, none, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == none.columns
    assert packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_operators_of_the_stages():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {re.sub(r"^(op\d+_).*", r"\1", n) for n in queries.queries()}
    assert neardup.keep_one and pii.redact
