"""The thin queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from binfold.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import lattice

    return lattice.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import sstable

    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op3_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import mergecount

    return mergecount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import mtree
    from binfold.llm.common import written

    rows = written(mtree.vectors(table(spark, sf_dir, "embeddings")), "mtree-vectors")
    index = mtree.build_index(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return mtree.search(index, rows.where("vec_id % 50 = 0"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import resample

    docs = table(spark, sf_dir, "documents")
    return resample.resample(docs, resample.fit(docs, table(spark, sf_dir, "labels")))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("passages")


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import pii

    return pii.scan(table(spark, sf_dir, "documents"))


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import jpeg

    return jpeg.features(jpeg.encode(table(spark, sf_dir, "documents")))


def op9_differencing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm import neardup

    return neardup.components(table(spark, sf_dir, "documents"), k=3, numerator=85, denominator=100)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """The registered queries by name."""
    return {name: f for name, f in globals().items() if name == "pipeline" or name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against plain versions in tests/llm."""
    from binfold.llm.sql import ORACLES

    return dict(ORACLES)
