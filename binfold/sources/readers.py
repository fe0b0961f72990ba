"""Sources: Parquet, CSV, packed binary files and arrays in memory."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: numpy type and Spark type by the name of a packed file's numbers.
PACKED = {"double": ("<f8", T.DoubleType()), "float": ("<f4", T.FloatType()), "int32": ("<i4", T.IntegerType()), "int64": ("<i8", T.LongType())}
_NUMBERS = {"double", "float", "int", "bigint"}


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    for c in columns:
        if c not in kinds:
            raise ValueError(f"no column {c!r}; there are {', '.join(kinds)}")
        if kinds[c] not in _NUMBERS:
            raise TypeError(f"column {c!r} is {kinds[c]}; columns are double, float, int or bigint")
    return df.select(*(F.col(f"`{c}`") for c in columns))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The columns alone are read."""
    return _numbers(spark.read.parquet(path), columns)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], schema: str | None = None) -> DataFrame:
    """Comma-separated with a header. Without a schema, types are inferred in a pass of their own."""
    reader = spark.read.option("header", True)
    return _numbers(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path), columns)


def _packed(data_type: str) -> tuple[str, T.DataType, int]:
    if data_type not in PACKED:
        raise ValueError(f"data type {data_type!r}; there are {', '.join(PACKED)}")
    kind, out = PACKED[data_type]
    return kind, out, np.dtype(kind).itemsize


def unpacked(files: DataFrame, data_type: str, column: str = "value") -> DataFrame:
    """files: (path, content), packed numbers in a row. One column of all numbers."""
    kind, out, width = _packed(data_type)

    def unpack(batches):
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                if len(raw) % width:
                    raise ValueError(f"{name}: {len(raw)} bytes aren't a multiple of {width}")
                for at in range(0, len(raw), width << 20):
                    yield pd.DataFrame({column: np.frombuffer(raw[at : at + (width << 20)], kind)})

    return files.select("path", "content").mapInPandas(unpack, T.StructType([T.StructField(column, out)]))


#: Bytes of a packed file that a task reads at a time; a longer file is read in ranges.
RANGE = 256 << 20


def read_binary(spark: SparkSession, path: str, data_type: str, column: str = "value", part: int = RANGE) -> DataFrame:
    """Packed little-endian numbers without a header: one column. A trailing part of a number is an error.

    Files up to `part` bytes are rows of Spark's own reader. Longer ones are cut to ranges,
    which tasks read by their offsets, from a file system that pyarrow knows.
    """
    kind, out, width = _packed(data_type)

    def unpack_ranges(batches):
        from pyarrow import fs

        for batch in batches:
            for name, length, begin in zip(batch["path"], batch["length"], batch["begin"]):
                if length % width:
                    raise ValueError(f"{name}: {length} bytes aren't a multiple of {width}")
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as source:
                    for at in range(begin, min(begin + step, length), width << 20):
                        raw = source.read_at(min(width << 20, begin + step - at, length - at), at)
                        yield pd.DataFrame({column: np.frombuffer(raw, kind)})

    step = max(1, part // width) * width
    files, schema = spark.read.format("binaryFile").load(path), T.StructType([T.StructField(column, out)])
    short = unpacked(files.where(F.col("length") <= part).select("path", "content"), data_type, column)
    # names and lengths alone: the contents of long files aren't read here
    long = files.where(F.col("length") > part).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("begin"))
    return short.union(long.repartition("path", "begin").mapInPandas(unpack_ranges, schema))


def from_arrays(spark: SparkSession, *arrays: Sequence[float] | np.ndarray) -> DataFrame:
    """One to four arrays of one length as columns x, y, z, w."""
    arrays = tuple(np.asarray(a) for a in arrays)
    if not 1 <= len(arrays) <= 4:
        raise ValueError("one to four arrays")
    if len({len(a) for a in arrays}) > 1:
        raise ValueError("arrays differ in length")
    names, kinds = "xyzw"[: len(arrays)], {"f8": "double", "f4": "float", "i4": "int", "i8": "bigint"}
    schema = ", ".join(f"{n} {kinds.get(a.dtype.str[1:], 'double')}" for n, a in zip(names, arrays))
    return spark.createDataFrame(pd.DataFrame(dict(zip(names, arrays))), schema)


def read_npy(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """A .npy array, or the named (or all) arrays of an .npz archive, on the driver."""
    loaded = np.load(path)
    return from_arrays(spark, *([loaded[n] for n in names or loaded.files] if hasattr(loaded, "files") else [loaded]))


def read(spark: SparkSession, path: str, file_type: str, columns: Sequence[str] = (), data_type: str | None = None) -> DataFrame:
    """By the kind of file: parquet, csv or binary; binary ones need a data type and have no columns to choose."""
    if file_type == "binary":
        if data_type is None:
            raise ValueError("a binary file needs a data type")
        return read_binary(spark, path, data_type)
    if not columns:
        raise ValueError("name the columns")
    if file_type == "parquet":
        return read_parquet(spark, path, columns)
    if file_type == "csv":
        return read_csv(spark, path, columns)
    raise ValueError(f"file type {file_type!r}; there are parquet, csv, binary")
