"""What the operators of this subpackage share: tables, scratch space, Arrow blocks."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from binfold.sources.workspace import fresh

#: Bytes of text that a Python worker looks at together.
BLOCK_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a worker.
ARROW_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by the reader that knows the path's scheme."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: a cut in the lineage that outlives any executor."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes written tables whose readers have all been written themselves."""
    for t in tables:
        place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files behind finished steps: it does when the driver collects their handles."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of one key that a task may well take, however small the table; the same for rows of a few numbers.
FEW, FEW_THIN = 256, 10_000


def hot_keys(df: DataFrame, key: str, few: int = FEW) -> list[tuple]:
    """(key, parts) of the keys that have more rows than a task's even share: as many parts as shares. At most a row for each partition of a shuffle.

    df may have a column n: the number of rows that it stands for.
    """
    n, seen = parallelism(df.sparkSession), Observation()
    rows = F.sum("n") if "n" in df.columns else F.count("*")
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(rows.alias("n")).observe(seen, F.sum("n").alias("rows"))
    top = counts.orderBy(F.desc("n")).limit(n).collect()
    share = max(few, (seen.get["rows"] or 0) / n)
    return [(r[key], math.ceil(r["n"] / share)) for r in top if r["n"] > share]


def spread_join(big: DataFrame, small: DataFrame, key: str, hot: list[tuple], how: str = "inner") -> DataFrame:
    """big.join(small, key), where small has few rows for a key and big may have many: the rows of hot_keys() go to several tasks.

    Rows whose key is null match none, and in a left join are spread too.
    """
    if not hot and how != "left":
        return big.join(small, key, how)
    known = big.sparkSession.createDataFrame(hot, f"{key} {dict(big.dtypes)[key]}, _parts int")  # a row for each partition at most
    parts = F.coalesce("_parts", F.lit(1))
    by_row: Column = F.pmod(F.xxhash64(*(c for c in big.columns if c != key)), parts)
    if how == "left":
        by_row = F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(*big.columns), F.lit(parallelism(big.sparkSession)))).otherwise(by_row)
    many = big.join(F.broadcast(known), key, "left").withColumn("_part", by_row.cast("int")).drop("_parts")
    few = small.join(F.broadcast(known), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return many.join(few, [key, "_part"], how).drop("_part")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes: an executor holds a few for each of its cores, outside its heap.

    A session that sets spark.sql.execution.arrow.maxBytesPerBatch below 64 MB keeps its own.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, ARROW_BYTES)
    return df.mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that `column` holds about `limit` bytes; one longer value is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float)))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_blocks(df: DataFrame, column: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Runs a worker over each block of a partition. `work` is called once in a task, so that models load there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for block in blocks(batches, column, limit):
            step = step or work()
            out = step(block)
            if out is not None and out.num_rows:
                yield out

    return arrow_map(df, run, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    if not len(s):
        return out[:0]
    at = np.zeros(len(s), dtype=np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)
