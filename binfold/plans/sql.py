"""DuckDB SQL for the registered histogram queries, written from the definitions alone."""

from __future__ import annotations

from collections.abc import Sequence

from binfold.functions.configs import config

AXES = "xyzw"


def _suffix(dims: int, i: int) -> str:
    return "" if dims == 1 else f"_{AXES[i]}"


def bins(source: str, columns: Sequence[str], layout: str, by: Sequence[str] = ()) -> str:
    """CTEs up to `hist`: a row for each populated bin."""
    c = config(layout)
    p, n = c.precision, len(columns)
    width = p + (3 if c.fast_nd else 4)
    keep = "".join(f"{b}, " for b in by)
    raw = ", ".join(f"CAST(CAST({col} AS DOUBLE) AS BIT)::BIGINT AS b{i}" for i, col in enumerate(columns))
    some = " AND ".join(f"{col} IS NOT NULL" for col in columns)
    cut = ", ".join(f"b{i}, ((b{i} >> 52) & 2047) - 1023 AS e{i}, b{i} & 4503599627370495 AS m{i}" for i in range(n))
    negative = "<= 0" if c.fast_nd else "< 0"
    # the fold of exponent 0 in n-D Fast layouts is negative; it is told apart below
    folded = ", ".join(f"b{i}, e{i}, m{i}, CASE WHEN e{i} {negative} THEN -e{i} - 1 ELSE e{i} END AS d{i}" for i in range(n))
    mk = ", ".join(f"b{i}, e{i}, m{i}, d{i}, CASE WHEN d{i} < 0 OR e{i} = 1024 THEN -1 ELSE d{i} * 4503599627370496 + m{i} END AS k{i}" for i in range(n))
    top = ", ".join(f"b{i}, e{i}, m{i}, k{i}, CASE WHEN k{i} > 0 THEN length(bin(k{i})) - 1 ELSE 0 END AS f{i}" for i in range(n))
    out = []
    for i in range(n):
        s = _suffix(n, i)
        size = f"(b{i} & 9223372036854775807)"
        zero = f"CASE WHEN b{i} < 0 THEN 'nzero' ELSE 'pzero' END" if n == 1 else "'zero'"
        out.append(f"CASE WHEN {size} = 0 THEN {zero} WHEN e{i} < 1024 THEN 'fin' WHEN m{i} > 0 THEN 'nan' WHEN b{i} < 0 THEN 'ninf' ELSE 'pinf' END AS kind{s}")
        if c.fast_nd:
            field = f"CASE WHEN k{i} < 0 THEN {(1 << p) - 1} WHEN k{i} = 0 THEN {7 << p} ELSE (least(61 - f{i}, 7) << {p}) | ((k{i} >> greatest(f{i} - 5, 50)) & {(1 << p) - 1}) END"
        else:
            field = f"CASE WHEN k{i} = 0 THEN {15 << p} WHEN 61 - f{i} >= 15 THEN {15 << p} | ((k{i} >> {47 - p}) & {(1 << p) - 1}) ELSE ((61 - f{i}) << {p}) | ((k{i} >> greatest(f{i} - {p}, 0)) & {(1 << p) - 1}) END"
        signs = f"CASE WHEN b{i} < 0 THEN {2 << width} ELSE 0 END + CASE WHEN e{i} < 0 THEN {1 << width} ELSE 0 END"
        out.append(f"CASE WHEN {size} <> 0 AND e{i} < 1024 THEN CAST(({field}) + {signs} AS INTEGER) END AS code{s}")
    keys = ", ".join([*by, *(f"{k}{_suffix(n, i)}" for i in range(n) for k in ("kind", "code"))])
    return f"""q1 AS (SELECT {keep}{raw} FROM {source} WHERE {some}),
q2 AS (SELECT {keep}{cut} FROM q1), q3 AS (SELECT {keep}{folded} FROM q2), q4 AS (SELECT {keep}{mk} FROM q3), q5 AS (SELECT {keep}{top} FROM q4),
q6 AS (SELECT {keep}{", ".join(out)} FROM q5),
hist AS (SELECT {keys}, count(*) AS count FROM q6 GROUP BY {keys})"""


def table(bits: int) -> str:
    """CTEs up to `tab`: every bin's code, position, value, neighbours and native interval."""
    p = bits - 6
    return f"""t1 AS (SELECT CAST(range AS BIGINT) AS code, (range >> {p}) & 15 AS z, range & {(1 << p) - 1} AS p, (range >> {p + 4}) & 1 AS small, range >> {p + 5} AS neg FROM range({1 << bits})),
t2 AS (SELECT *, CASE WHEN z <> 15 THEN {1 << p} | p ELSE p END AS stream, z + CASE WHEN z <> 15 THEN 1 ELSE 0 END + {p} - 10 AS rest FROM t1),
t3 AS (SELECT *, CASE WHEN rest >= 0 THEN stream >> greatest(rest, 0) ELSE stream << greatest(-rest, 0) END AS ex, CASE WHEN rest > 0 THEN (stream & ((1 << greatest(rest, 0)::INTEGER) - 1)) / pow(2.0, rest) ELSE 0.0 END AS frac FROM t2),
t4 AS (SELECT code, neg, frac, greatest(least(CASE WHEN small = 1 THEN 1022 - ex ELSE 1023 + ex END, 2046), 0) AS be FROM t3),
t5 AS (SELECT CAST(code AS INTEGER) AS code, CASE WHEN neg = 1 THEN -1 ELSE 1 END * CASE WHEN be = 0 THEN frac * pow(2.0, -1022) ELSE (1 + frac) * pow(2.0, be - 1023) END AS value FROM t4),
tab AS (SELECT code, value, row_number() OVER w - 1 AS pos, coalesce(lead(value) OVER w, CAST('inf' AS DOUBLE)) AS nxt, coalesce(lag(value) OVER w, CAST('-inf' AS DOUBLE)) AS prv,
  CASE WHEN value < 0 THEN coalesce(lag(value) OVER w, CAST('-inf' AS DOUBLE)) ELSE value END AS lo, CASE WHEN value < 0 THEN value ELSE coalesce(lead(value) OVER w, CAST('inf' AS DOUBLE)) END AS hi FROM t5 WINDOW w AS (ORDER BY value, code))"""


def ordered(source: str, column: str, layout: str, by: Sequence[str] = ()) -> str:
    """CTEs up to `ord`: the rows of a one-dimensional histogram but NaN, with their order and bounds."""
    bits = config(layout).bits
    zero, keep = 4 << bits - 1, "".join(f"{b}, " for b in by)
    special = "WHEN 'ninf' THEN CAST('-inf' AS DOUBLE) WHEN 'pinf' THEN CAST('inf' AS DOUBLE) WHEN 'nzero' THEN CAST('-0.0' AS DOUBLE) WHEN 'pzero' THEN 0.0"
    fields = ", ".join(f"CASE kind {special} ELSE {f} END AS {g}" for f, g in (("value", "value"), ("nxt", "nxt"), ("lo", "lo"), ("hi", "hi")))
    return f"""WITH {bins(source, [column], layout, by)}, {table(bits)},
ord AS (SELECT {keep}kind, count, pos, CAST(CASE kind WHEN 'ninf' THEN {-(1 << 40)} WHEN 'pinf' THEN {1 << 40} WHEN 'nzero' THEN {zero - 2} WHEN 'pzero' THEN {zero - 1} ELSE pos * 4 END AS BIGINT) AS ord, {fields}
  FROM hist LEFT JOIN tab USING (code) WHERE kind <> 'nan')"""


def build(source: str, columns: Sequence[str], layout: str, by: Sequence[str] = ()) -> str:
    return f"WITH {bins(source, columns, layout, by)} SELECT * FROM hist"


def percentile(source: str, column: str, layout: str, percents: Sequence[float], by: Sequence[str] = ()) -> str:
    keep, last = "".join(f"{b}, " for b in by), (1 << config(layout).bits) - 1
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    names = ", ".join([*by, "percentile"])
    inf = "CAST('-inf' AS DOUBLE)"
    values = ", ".join(f"(CAST({p} AS DOUBLE))" for p in percents)
    everyone = f"(SELECT DISTINCT {', '.join(by)} FROM ord) g, " if by else ""
    return f"""{ordered(source, column, layout, by)},
r1 AS (SELECT *, sum(count) OVER ({part} ORDER BY ord) AS cum, sum(count) OVER ({part}) AS total FROM ord),
r2 AS (SELECT *, percentile / 100 * total AS rnk FROM r1, (VALUES {values}) v(percentile)),
r3 AS (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY ord) AS rn FROM r2 WHERE rnk > 0 AND cum >= rnk),
r4 AS (SELECT {keep}percentile, CASE WHEN kind <> 'fin' OR pos = {last} THEN value ELSE value + (rnk - (cum - count)) / count * (nxt - value) END AS value, lo, hi FROM r3 WHERE rn = 1),
every AS (SELECT {keep}percentile FROM {everyone}(VALUES {values}) v(percentile))
SELECT {keep}percentile, coalesce(value, {inf}) AS value, coalesce(lo, {inf}) AS lower, coalesce(hi, {inf}) AS upper FROM every LEFT JOIN r4 USING ({names})"""


def cdf(source: str, column: str, layout: str, values: Sequence[float], interpolate: bool) -> str:
    part = "sum(CASE WHEN kind = 'fin' AND probe >= value AND probe < nxt THEN (probe - value) / (nxt - value) * count ELSE 0.0 END)" if interpolate else "0.0"
    return f"""{ordered(source, column, layout)}
SELECT probe AS "at", (CAST(coalesce(sum(CASE WHEN kind = 'fin' AND probe >= nxt OR kind = 'ninf' OR kind IN ('pzero', 'nzero') AND probe >= 0 THEN count END), 0) AS DOUBLE) + {part}) / sum(count) AS cdf
FROM ord, (VALUES {", ".join(f"(CAST({v} AS DOUBLE))" for v in values)}) v(probe) GROUP BY probe"""


_ROW = "value AS lower, nxt AS upper, count, ord"


def top_k(source: str, column: str, layout: str, k: float) -> str:
    return f"""{ordered(source, column, layout)},
r AS (SELECT *, coalesce(sum(count) OVER (ORDER BY ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(count) OVER () AS total FROM ord)
SELECT {_ROW} FROM r WHERE above < greatest(floor(total * CAST({k} AS DOUBLE) / 100), 1)"""


def extreme_count(source: str, column: str, layout: str, f: str) -> str:
    return f"{ordered(source, column, layout)} SELECT {_ROW}, value = nxt AS special FROM ord WHERE count = (SELECT {f}(count) FROM ord)"


def extreme_value(source: str, column: str, layout: str, f: str) -> str:
    return f"{ordered(source, column, layout)} SELECT {_ROW} FROM ord WHERE ord = (SELECT {f}(ord) FROM ord)"


def special_counts(source: str, columns: Sequence[str], layout: str) -> str:
    """A record counts once for each axis that is special."""
    kinds = [f"kind{_suffix(len(columns), i)}" for i in range(len(columns))]

    def total(*names: str) -> str:
        return f"CAST(coalesce(sum(count * ({' + '.join(f'CAST({k} IN ({', '.join(map(repr, names))}) AS INTEGER)' for k in kinds)})), 0) AS BIGINT)"

    return f"WITH {bins(source, columns, layout)} SELECT {total('pinf')} AS pos_inf, {total('ninf')} AS neg_inf, {total('pzero', 'zero')} AS pos_zero, {total('nzero')} AS neg_zero, {total('nan')} AS nan FROM hist"


def observations(source: str, columns: Sequence[str], layout: str) -> str:
    where = " WHERE kind = 'fin'" if len(columns) == 1 else ""
    return f"WITH {bins(source, columns, layout)} SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS observations FROM hist{where}"


def export_rows(source: str, columns: Sequence[str], layout: str) -> str:
    """boundaries() with the names of the exported files."""
    named = ", ".join(f'{a}_{e} AS "{a}-{e}"' for a in AXES[: len(columns)] for e in ("min", "max"))
    return f"SELECT {named}, counts FROM ({boundaries(source, columns, layout)}) b"


def _special(field: str, kind: str) -> str:
    return f"CASE {kind} WHEN 'pinf' THEN CAST('inf' AS DOUBLE) WHEN 'ninf' THEN CAST('-inf' AS DOUBLE) WHEN 'zero' THEN 0.0 WHEN 'nan' THEN CAST('nan' AS DOUBLE) ELSE {field} END"


def boundaries(source: str, columns: Sequence[str], layout: str) -> str:
    n = len(columns)
    head = f"WITH {bins(source, columns, layout)}, {table(config(layout).bits)}"
    if n == 1:
        return f"{head} SELECT lo AS x_min, hi AS x_max, count AS counts FROM hist JOIN tab USING (code)"
    out = ", ".join(f"{_special(f't{a}.{f}', f'kind_{a}')} AS {a}_{g}" for a in AXES[:n] for f, g in (("lo", "min"), ("hi", "max")))
    joins = " ".join(f"LEFT JOIN tab t{a} ON t{a}.code = code_{a}" for a in AXES[:n])
    return f"{head} SELECT {out}, count AS counts FROM hist {joins}"


def _axis(name: str, spec: tuple) -> str:
    """CTEs up to part_<name> (id, ends, flags) and look_<name> (kind, code, id) for (min, max, steps, scaling), ends finite or None for the data's extent.

    An axis is a list of atoms in ascending order: -inf, bins, zero, +inf. Each has a label,
    atoms of one label are a partition; zero takes that of its neighbours, if they have one for it.
    """
    low, high, steps, scaling = spec
    low_end = f"(SELECT lo_{name} FROM extent)" if low is None else f"CAST({low} AS DOUBLE)"
    high_end = f"(SELECT hi_{name} FROM extent)" if high is None else f"CAST({high} AS DOUBLE)"
    measure = "ln(lo / span_lo) / ln(span_hi / span_lo)" if scaling == "mult" else "(lo - span_lo) / (span_hi - span_lo)"
    infinite = [("-1.0", "-inf", "ninf", "neg_inf", low), ("10000.0", "inf", "pinf", "pos_inf", high)]
    others = "".join(f" UNION ALL SELECT {at}, 'i{k}', '{kind}', -1, CAST('{v}' AS DOUBLE), CAST('{v}' AS DOUBLE), true, true, '{k}'" for at, v, kind, k, end in infinite if end is None)
    return f"""
d_{name} AS (SELECT {low_end} AS a, {high_end} AS b),
touch_{name} AS (SELECT pos, code, value, lo, hi, lo >= a AND hi <= b AS whole FROM tab, d_{name} WHERE CASE WHEN value < 0 THEN hi >= a AND lo < b ELSE hi > a AND lo <= b END),
span_{name} AS (SELECT min(lo) AS span_lo, max(hi) AS span_hi, count(*) AS bins FROM touch_{name} WHERE whole),
label_{name} AS (SELECT *, CASE WHEN NOT whole THEN 'edge' || pos WHEN bins = 1 OR {steps} = 1 THEN 's0' ELSE 's' || CAST(greatest(0, least({steps} - 1, floor({measure} * CAST({steps} AS DOUBLE)))) AS BIGINT) END AS label FROM touch_{name}, span_{name}),
cut_{name} AS (SELECT label, min(pos) AS p, min(lo) AS s, max(hi) AS e, arg_min(value, pos) >= 0 AS si, arg_max(value, pos) < 0 AS ei FROM label_{name} GROUP BY label),
home_{name} AS (SELECT label FROM cut_{name} WHERE s = 0 OR (s < 0 AND (e > 0 OR e = 0 AND ei)) ORDER BY s <> 0, p LIMIT 1),
zero_{name} AS (SELECT coalesce((SELECT label FROM home_{name}), 'zero') AS label FROM d_{name} WHERE a <= 0 AND b >= 0),
atom_{name}(place, label, kind, code, s, e, si, ei, k) AS (SELECT CAST(pos AS DOUBLE), label, 'fin', code, lo, hi, value >= 0, value < 0, 'finite' FROM label_{name}
  UNION ALL SELECT 2047.5, label, 'zero', -1, 0.0, 0.0, true, true, 'finite' FROM zero_{name}{others}),
part_{name} AS (SELECT row_number() OVER (ORDER BY place) - 1 AS id, * FROM (SELECT label, min(place) FILTER (kind <> 'zero' OR label = 'zero') AS place, coalesce(min(s) FILTER (kind <> 'zero'), 0.0) AS s, coalesce(max(e) FILTER (kind <> 'zero'), 0.0) AS e,
  coalesce(arg_min(si, place) FILTER (kind <> 'zero'), true) AS si, coalesce(arg_max(ei, place) FILTER (kind <> 'zero'), true) AS ei, min(k) AS k, label LIKE 'edge%' AS edge FROM atom_{name} GROUP BY label)),
look_{name} AS (SELECT kind, code, id FROM atom_{name} JOIN part_{name} USING (label))"""


def grid(source: str, columns: Sequence[str], layout: str, axes: Sequence[tuple]) -> str:
    names = AXES[: len(columns)]
    extent = ", ".join(f"{f}(CASE kind_{a} WHEN 'zero' THEN 0.0 ELSE t{a}.value END) AS {g}_{a}" for a in names for f, g in (("min", "lo"), ("max", "hi")))
    joins = " ".join(f"LEFT JOIN tab t{a} ON t{a}.code = code_{a}" for a in names)
    parts = ",".join(_axis(a, s) for a, s in zip(names, axes))
    ids = ", ".join(f"l{a}.id AS i_{a}" for a in names)
    looks = " ".join(f"JOIN look_{a} l{a} ON l{a}.kind = kind_{a} AND l{a}.code = coalesce(code_{a}, -1)" for a in names)
    cells = ", ".join(f"part_{a} p{a}" for a in names)
    out = ", ".join(f"p{a}.s AS {a}_start, p{a}.e AS {a}_end, p{a}.k AS {a}_kind, p{a}.si AS {a}_start_inclusive, p{a}.ei AS {a}_end_inclusive, p{a}.edge AS {a}_is_edge" for a in names)
    number = "0"
    for a in names:
        number = f"({number}) * (SELECT count(*) FROM part_{a}) + p{a}.id"
    on = " AND ".join(f"c.i_{a} = p{a}.id" for a in names)
    return f"""WITH {bins(source, columns, layout)}, {table(12)},
extent AS (SELECT {extent} FROM hist {joins}),{parts},
c AS (SELECT {ids}, sum(count) AS n FROM hist {looks} GROUP BY ALL)
SELECT {out}, CAST(coalesce(c.n, 0) AS BIGINT) AS count, CAST({number} AS BIGINT) AS cell FROM (SELECT 1) one, {cells} LEFT JOIN c ON {on}"""


def grouped_grid(source: str, columns: Sequence[str], layout: str, axes: Sequence[tuple], by: str) -> str:
    """Populated cells of each group: the grid of each group's rows, for finite axes of two columns."""
    one = grid(f"(SELECT * FROM {source} WHERE {by} = '{{g}}')", columns, layout, axes)
    return " UNION ALL ".join(f"SELECT '{g}' AS {by}, * FROM ({one.replace('{g}', g)}) WHERE count > 0" for g in "ANR")


def boxes(source: str, columns: Sequence[str], layout: str, wanted: Sequence[Sequence[tuple[float, float]]]) -> str:
    names, last = AXES[: len(columns)], (1 << 12) - 1

    def number(v: float) -> str:
        return f"CAST('{v}' AS DOUBLE)"

    rows = ", ".join("(" + ", ".join([str(i), *(number(v) for pair in b for v in pair)]) + ")" for i, b in enumerate(wanted))
    named = ", ".join(["box_id", *(f"{a}_{e}" for a in names for e in ("a", "b"))])
    positions = ", ".join(f"t{a}.pos AS {a}, t{a}.value AS v{a}" for a in names)
    joins = " ".join(f"JOIN tab t{a} ON t{a}.code = code_{a}" for a in names)
    inside = " AND ".join(f"v{a} BETWEEN {a}_a AND {a}_b" for a in names)
    near = " AND ".join(f"{a} BETWEEN greatest(lo_{a} - 1, 0) AND least(hi_{a} + 1, {last})" for a in names)
    spans = ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in names)

    def at(e: str) -> str:
        return f"(SELECT value FROM tab WHERE pos = {e})"

    out = ", ".join(f"{at(f'lo_{a}')} AS safe_{a}_min, {at(f'hi_{a}')} AS safe_{a}_max, CASE WHEN n > 0 THEN {at(f'greatest(lo_{a} - 1, 0)')} END AS total_{a}_min, CASE WHEN n > 0 THEN {at(f'least(hi_{a} + 1, {last})')} END AS total_{a}_max" for a in names)
    return f"""WITH {bins(source, columns, layout)}, {table(12)},
cells AS (SELECT {positions}, count FROM hist {joins}),
box({named}) AS (VALUES {rows}),
safe AS (SELECT box_id, sum(count) AS n, {spans} FROM box JOIN cells ON {inside} GROUP BY box_id),
total AS (SELECT box_id, sum(count) AS m FROM safe JOIN cells ON {near} GROUP BY box_id)
SELECT CAST(box.box_id AS BIGINT) AS box_id, CAST(coalesce(n, 0) AS BIGINT) AS safe_count, CAST(coalesce(m, 0) AS BIGINT) AS total_count, {out} FROM box LEFT JOIN safe USING (box_id) LEFT JOIN total USING (box_id)"""
