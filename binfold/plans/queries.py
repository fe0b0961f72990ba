"""The registered histogram queries: one for each operator, over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.operators import many_axes, one_axis
from binfold.operators.histogram import Histogram, build, merge
from binfold.operators.many_axes import LINEAR, MULTIPLICATIVE, Axis
from binfold.plans import sql
from binfold.sources import readers, tables, wire
from binfold.sources.workspace import fresh

PRICE, BALANCE = ("lineitem", "l_extendedprice"), ("customer", "c_acctbal")
#: Columns of lineitem by number of axes; discounts and taxes have zeros.
COLUMNS = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]
#: A table with every special kind.
SPECIALS = "(SELECT CAST(column0 AS DOUBLE) AS v FROM (VALUES ('nan'), ('inf'), ('-inf'), ('-inf'), ('0.0'), ('-0.0'), ('0.0'), ('1.5'), ('-2.5'), ('-2.5'), ('5e-324'), ('1e300'), (NULL)) s(column0))"
_SPECIAL_VALUES = [math.nan, math.inf, -math.inf, -math.inf, 0.0, -0.0, 0.0, 1.5, -2.5, -2.5, 5e-324, 1e300, None]
BOXES = [[(10000.0, 20000.0), (0.02, 0.05)], [(-math.inf, math.inf), (-math.inf, math.inf)], [(1.0, 2.0), (3.0, 4.0)], [(1024.0, 65536.0), (0.0, 0.0625)]]
BOX3 = [[(10000.0, 40000.0), (0.02, 0.08), (0.01, 0.05)]]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(columns: tuple[str, str], layout: str, query: Callable[[Histogram], DataFrame], by: tuple[str, ...] = ()) -> Query:
    return lambda spark, d: query(build(_table(spark, d, columns[0]), columns[1], layout, by))


def _lines(n: int, layout: str, query: Callable[[Histogram], DataFrame]) -> Query:
    return lambda spark, d: query(build(_table(spark, d, "lineitem"), COLUMNS[:n], layout))


def _special(layout: str, query: Callable[[Histogram], DataFrame]) -> Query:
    return lambda spark, d: query(build(spark.createDataFrame([(v,) for v in _SPECIAL_VALUES], "v double"), "v", layout))


def _rows(h: Histogram) -> DataFrame:
    return h.df


def _grid(axes: list[tuple]) -> Callable[[Histogram], DataFrame]:
    cut = [Axis(-math.inf if a is None else a, math.inf if b is None else b, n, MULTIPLICATIVE if s == "mult" else LINEAR) for a, b, n, s in axes]
    return lambda h: many_axes.grid(h, cut)


def _registry() -> dict[str, tuple[Query, str]]:
    out: dict[str, tuple[Query, str]] = {}
    for letter in "TFP":
        out[f"build_1dx{letter.lower()}"] = (_on(PRICE, f"1Dx{letter}", _rows), sql.build(*PRICE[:1], [PRICE[1]], f"1Dx{letter}"))
    for n in (2, 3, 4):
        for letter in "FP":
            out[f"build_{n}dx{letter.lower()}"] = (_lines(n, f"{n}Dx{letter}", _rows), sql.build("lineitem", COLUMNS[:n], f"{n}Dx{letter}"))
    out["build_integers"] = (_on(("lineitem", "l_linenumber"), "1DxP", _rows), sql.build("lineitem", ["l_linenumber"], "1DxP"))
    out["build_specials"] = (_special("1DxF", _rows), sql.build(SPECIALS, ["v"], "1DxF"))

    def parts(n: int, layout: str) -> Query:
        def query(spark: SparkSession, d: str) -> DataFrame:
            lines = _table(spark, d, "lineitem")
            cut = [lines.where((F.col("l_orderkey") % n) == i) for i in range(n)]
            return merge([build(x, COLUMNS[: int(layout[0])], layout) for x in cut]).df

        return query

    def stored(n: int, layout: str, parts: int) -> Query:
        """Histograms of so many parts are stored, each in a table of its own, and merged from there in one read."""

        def query(spark: SparkSession, d: str) -> DataFrame:
            h = build(_table(spark, d, "lineitem").withColumn("part", F.pmod("l_orderkey", F.lit(parts))), COLUMNS[:n], layout, ["part"])
            folder = fresh(spark, "parts")
            paths = [f"{folder}/{i}" for i in range(parts)]
            for i, path in enumerate(paths):
                tables.write_histogram(Histogram(h.config, h.df.where(F.col("part") == i).drop("part")), path)
            return tables.merge_stored(spark, paths).df

        return query

    for n in (1, 2, 3, 4):
        for letter in "TFP" if n == 1 else "FP":
            out[f"merge_stored_{n}dx{letter.lower()}"] = (stored(n, f"{n}Dx{letter}", 5), sql.build("lineitem", COLUMNS[:n], f"{n}Dx{letter}"))

    def specials_merged(spark: SparkSession, d: str) -> DataFrame:
        h, path = build(spark.createDataFrame([(v,) for v in _SPECIAL_VALUES], "v double"), "v", "1DxP"), fresh(spark, "specials")
        tables.write_histogram(h, f"{path}/a")
        tables.write_histogram(h, f"{path}/b")
        return tables.merge_stored(spark, [f"{path}/a", f"{path}/b"]).df

    out["merge_stored_specials"] = (specials_merged, sql.build(f"(SELECT * FROM {SPECIALS} UNION ALL SELECT * FROM {SPECIALS})", ["v"], "1DxP"))
    out["special_counts_1d"] = (_special("1DxP", Histogram.specials), sql.special_counts(SPECIALS, ["v"], "1DxP"))
    out["observations_1d"] = (_special("1DxP", Histogram.trie_count), sql.observations(SPECIALS, ["v"], "1DxP"))
    for n in (2, 3, 4):
        out[f"special_counts_{n}d"] = (_lines(n, f"{n}DxP", Histogram.specials), sql.special_counts("lineitem", COLUMNS[:n], f"{n}DxP"))
        out[f"observations_{n}d"] = (_lines(n, f"{n}DxF", Histogram.trie_count), sql.observations("lineitem", COLUMNS[:n], f"{n}DxF"))

    def binary_form(n: int, layout: str) -> Query:
        """Through the binary form: the buffer's rows are read again."""

        def query(spark: SparkSession, d: str) -> DataFrame:
            h = build(_table(spark, d, "lineitem"), COLUMNS[:n], layout)
            data = wire.encode(h.config, [r.asDict() for r in h.df.toLocalIterator()])
            return spark.createDataFrame([(data,)], "content binary").mapInPandas(wire.unpacked(h.config), wire.schema(h.config))

        return query

    for n, letter in ((1, "T"), (1, "F"), (1, "P"), (2, "P"), (3, "P"), (4, "P")):
        out[f"binary_form_{n}dx{letter.lower()}"] = (binary_form(n, f"{n}Dx{letter}"), sql.build("lineitem", COLUMNS[:n], f"{n}Dx{letter}"))

    def from_csv(spark: SparkSession, d: str) -> DataFrame:
        path = fresh(spark, "csv")
        _table(spark, d, "lineitem").select(*COLUMNS[:2]).write.option("header", True).csv(path)
        return build(readers.read(spark, path, "csv", COLUMNS[:2]), COLUMNS[:2], "2DxP").df

    def from_packed(spark: SparkSession, d: str) -> DataFrame:
        import numpy as np

        made = fresh(spark, "packed")
        values = np.array([r[0] for r in _table(spark, d, "customer").select(BALANCE[1]).where(f"{BALANCE[1]} IS NOT NULL").toLocalIterator()], "<f8")
        spark.createDataFrame([(values.tobytes(),)], "content binary").select(F.hex("content").alias("value")).write.text(made)
        # Spark's own writers make text: the packed bytes come back from it, and go the way of a file's
        raw = spark.read.text(made).select(F.lit(made).alias("path"), F.unhex("value").alias("content"))
        return build(readers.unpacked(raw, "double", BALANCE[1]), BALANCE[1], "1DxP").df

    def from_memory(spark: SparkSession, d: str) -> DataFrame:
        rows = _table(spark, d, "customer").select(BALANCE[1]).where(f"{BALANCE[1]} IS NOT NULL").toPandas()
        return build(readers.from_arrays(spark, rows[BALANCE[1]].to_numpy()), "x", "1DxP").df

    out["source_csv"] = (from_csv, sql.build("lineitem", COLUMNS[:2], "2DxP"))
    out["source_packed"] = (from_packed, sql.build(BALANCE[0], [BALANCE[1]], "1DxP"))
    out["source_arrays"] = (from_memory, sql.build(BALANCE[0], [BALANCE[1]], "1DxP"))
    for n in (1, 2, 4):
        out[f"export_rows_{n}d"] = (_lines(n, f"{n}DxP", tables.export_rows), sql.export_rows("lineitem", COLUMNS[:n], f"{n}DxP"))
    out["grouped_grid"] = (lambda spark, d: many_axes.grid(build(_table(spark, d, "lineitem"), COLUMNS[:2], "2DxP", ["l_returnflag"]), [Axis(1000, 50000, 5), Axis(0, 0.1, 3)]), sql.grouped_grid("lineitem", COLUMNS[:2], "2DxP", [(1000, 50000, 5, "linear"), (0, 0.1, 3, "linear")], "l_returnflag"))
    out["merge_pair"] = (parts(2, "1DxP"), sql.build("lineitem", COLUMNS[:1], "1DxP"))
    out["merge_nway"] = (parts(8, "2DxF"), sql.build("lineitem", COLUMNS[:2], "2DxF"))

    def percentiles(ps: list[float]) -> Callable[[Histogram], DataFrame]:
        return lambda h: one_axis.percentile(h, ps)

    for p in (50, 90, 99):
        out[f"percentile_{p}"] = (_on(PRICE, "1DxP", percentiles([p])), sql.percentile(*PRICE, "1DxP", [p]))
    out["percentile_bounds"] = (_on(BALANCE, "1DxF", percentiles([0, 1, 5, 50, 100])), sql.percentile(*BALANCE, "1DxF", [0, 1, 5, 50, 100]))
    out["grouped_percentile"] = (_on(PRICE, "1DxF", percentiles([25, 50]), ("l_returnflag", "l_linestatus")), sql.percentile(*PRICE, "1DxF", [25, 50], ["l_returnflag", "l_linestatus"]))
    # -0.0 is left out: it equals 0.0 to SQL
    out["percentile_specials"] = (_special("1DxP", percentiles([5, 20, 45, 90, 99, 101])), sql.percentile(SPECIALS, "v", "1DxP", [5, 20, 45, 90, 99, 101]))
    at = [-500.5, 0.0, 0.5, 1234.5, 9000.25]
    out["cdf_step"] = (_on(BALANCE, "1DxF", lambda h: one_axis.cdf(h, at)), sql.cdf(*BALANCE, "1DxF", at, False))
    out["cdf_interp"] = (_on(BALANCE, "1DxT", lambda h: one_axis.cdf(h, at, True)), sql.cdf(*BALANCE, "1DxT", at, True))
    for k in (1, 5, 15):
        out[f"topk_{k}"] = (_on(PRICE, "1DxF", lambda h, k=k: one_axis.top_k(h, k)), sql.top_k(*PRICE, "1DxF", k))
    for name, source in (("", BALANCE), ("_specials", None)):
        for what, f, make, oracle in (
            ("min_count", one_axis.min_count, sql.extreme_count, "min"),
            ("max_count", one_axis.max_count, sql.extreme_count, "max"),
            ("min_value", one_axis.min_value, sql.extreme_value, "min"),
            ("max_value", one_axis.max_value, sql.extreme_value, "max"),
        ):
            query = _on(source, "1DxF", f) if source else _special("1DxF", f)
            if source or "value" in what:
                out[what + name] = (query, make(*(source or (SPECIALS, "v")), "1DxF", oracle))
    out["boundary_1d"] = (_on(BALANCE, "1DxP", many_axes.boundaries), sql.boundaries(BALANCE[0], [BALANCE[1]], "1DxP"))
    for n in (2, 3, 4):
        out[f"boundary_{n}d"] = (_lines(n, f"{n}DxP", many_axes.boundaries), sql.boundaries("lineitem", COLUMNS[:n], f"{n}DxP"))
    grids = {
        "grid_2d": (2, [(1000, 50000, 5, "linear"), (0, 0.1, 3, "linear")]),
        "grid_3d": (3, [(5000, 80000, 4, "linear"), (0.01, 0.09, 3, "linear"), (-0.01, 0.05, 2, "linear")]),
        "grid_4d": (4, [(0, 100000, 3, "linear"), (0, 0.1, 2, "linear"), (0, 0.08, 2, "linear"), (1, 50, 4, "linear")]),
        "grid_mult": (2, [(1000, 100000, 6, "mult"), (0.01, 0.1, 4, "mult")]),
        "grid_inf": (2, [(None, None, 4, "linear"), (None, 0.05, 3, "linear")]),
    }
    for name, (n, axes) in grids.items():
        out[name] = (_lines(n, f"{n}DxP", _grid(axes)), sql.grid("lineitem", COLUMNS[:n], f"{n}DxP", axes))
    out["bbox_2d"] = (_lines(2, "2DxP", lambda h: many_axes.count_boxes(h, BOXES[:1])), sql.boxes("lineitem", COLUMNS[:2], "2DxP", BOXES[:1]))
    out["bbox_3d"] = (_lines(3, "3DxP", lambda h: many_axes.count_boxes(h, BOX3)), sql.boxes("lineitem", COLUMNS[:3], "3DxP", BOX3))
    out["bbox_batch"] = (_lines(2, "2DxP", lambda h: many_axes.count_boxes(h, BOXES)), sql.boxes("lineitem", COLUMNS[:2], "2DxP", BOXES))
    return out


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in _registry().items()}
