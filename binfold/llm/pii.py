"""Personal data in texts, with DataFrame functions alone.

Regular expressions propose spans; validators confirm them: Luhn for cards, mod 97 for
IBANs, the range of an address's parts, the number of a phone number's digits; words near a
span raise its score. Base spans (email, ip, card, phone) are the leftmost ones that don't
overlap, per kind, whose match is valid. The method adds, where their score reaches the
threshold and no base span covers them:

    iban    confirmed by mod 97
    phone   an international number inside a longer run of digits, or a national one near a word that names phones
    card    a confirmed card that touches a longer run of digits and separators, near a word that names cards

The patterns repeat possessively and begin where a run begins, so they take neither deep
recursion nor quadratic time on very long runs. Positions are code points from 0. A text is
split at a pattern's matches; the pieces' lengths, summed over pages of PAGE of them and then
within a page, are positions, and the pieces beside a match are what stands near it. So a text
is never searched from its beginning again for each span, however long it is and however many it has.

Null and empty texts have no spans. An empty table gives an empty result. Identifiers may be null or repeat. Other columns are
ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the contract, written so that a failed start isn't tried again inside the same run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
LONG_PHONE = r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
HOME_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"
EXACT_CARD = r"(?<![0-9-])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9-])"

OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Words that name the kind, in the four languages of the corpora.
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mailto|contact|kontakt|courriel|correo)",
    "ip": r"(?i)\b(?:ip|address|host|server|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|cell|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil)",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)",
}
#: Score of a proposed and confirmed span by kind, what a word near it adds, and from where a span counts.
START = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "long": 0.6, "home": 0.3, "exact": 0.4}
NEAR, THRESHOLD, REACH = 0.3, 0.6, 48
RANK = {"email": 0, "ip": 1, "card": 2, "phone": 3, "iban": 4}

#: Pieces, spans or thousands of characters that are gone through one by one behind a sum over whole pages.
PAGE = 512

_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_MOD97 = """(aggregate(split(concat(substring(regexp_replace({m}, ' ', ''), 5), substring(regexp_replace({m}, ' ', ''), 1, 4)), ''), 0,
    (r, c) -> CASE WHEN c = '' THEN r WHEN c < 'A' THEN (r * 10 + CAST(c AS INT)) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END) = 1)"""
#: Kind, name in START, pattern, the text that has a match at all, and the validator of a match {m}.
BASE = [
    ("email", "email", EMAIL, "contains(t, '@')", "true"),
    ("ip", "ip", IP, r"rlike(t, '[0-9]\\.[0-9]')", "rlike({m}, '{octets}')"),
    ("card", "card", CARD, r"rlike(t, '[0-9](?:[\\x20-]?[0-9]){11}')", f"luhn_check({_DIGITS})"),
    ("phone", "phone", PHONE, "contains(t, '+')", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]
ADDED = [
    ("phone", "long", LONG_PHONE, "contains(t, '+')", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ("phone", "home", HOME_PHONE, r"rlike(t, '[0-9]{3}[.-][0-9]{4}')", "true"),
    ("card", "exact", EXACT_CARD, r"rlike(t, '[0-9]{4}[\\x20-][0-9]{4}')", f"luhn_check({_DIGITS})"),
    ("iban", "iban", IBAN, "rlike(t, '[A-Z]{2}[0-9]{2}')", _MOD97),
]
_TYPE = "array<struct<start:int,rank:int,`end`:int,kind:string,score:double>>"


def _literal(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _pages(array: str, before: int = 0, after: int = 0) -> str:
    """SQL: an array as an array of pages, with some items before and after each. (slice() copies its whole array, so single items take theirs from a page.)"""
    return f"transform(sequence(0, (size({array}) - 1) div {PAGE}), c -> slice({array}, greatest(c * {PAGE} - {before}, 0) + 1, {PAGE + after} + least(c * {PAGE}, {before})))"


def _totals(pages: str, start: str, step: str) -> str:
    """SQL: for each page, `step` (of s and the page v) over all pages before it. Few pages, so their array may grow one by one."""
    return f"aggregate({pages}, named_struct('s', {start}, 'out', CAST(array() AS array<int>)), (a, v) -> named_struct('s', {step.format(s='a.s')}, 'out', concat(a.out, array(a.s))), a -> a.out)"


def _with_spans(t: DataFrame, kind: str, name: str, pattern: str, has: str, valid: str) -> DataFrame:
    """Adds _<name>: the valid matches of a pattern in the column t, as an array of spans."""
    p, q, n, sums, near = _literal(pattern), f"_q_{name}", f"_n_{name}", f"_s_{name}", f"_r_{name}"
    at = "(2 * s.i + 1)"
    valid = valid.replace("{m}", f"{q}[2 * i + 1]").replace("{octets}", _literal(OCTETS))
    # text, match, text, ..., text, nothing: match i is at 2 i + 1
    t = t.withColumn(q, F.expr(f"CASE WHEN {has} THEN flatten(zip_with(split(t, '{p}', -1), regexp_extract_all(t, '{p}', 0), (a, m) -> array(a, coalesce(m, '')))) ELSE CAST(array() AS array<string>) END"))
    some = f"size({q}) > 2"
    t = t.withColumn(n, F.expr(f"transform({q}, x -> length(x))"))
    t = t.withColumn(n, F.expr(f"CASE WHEN {some} THEN {_pages(n)} END"))
    t = t.withColumn(sums, F.expr(f"CASE WHEN {some} THEN {_totals(n, '0', 'aggregate(v, {s}, (x, y) -> x + y)')} END"))
    # what ends and what begins each piece: a match has 5 characters or more, so 10 of them and what is between reach far enough
    t = t.withColumn(near, F.expr(f"CASE WHEN {some} THEN transform({q}, x -> named_struct('a', right(x, {REACH}), 'b', left(x, {REACH // 2}))) END"))
    t = t.withColumn(near, F.expr(f"CASE WHEN {some} THEN {_pages(near, 20, 14)} END"))
    page, place = f"{at} div {PAGE}", f"({at} % {PAGE} + least({at} div {PAGE} * {PAGE}, 20))"
    before = f"right(array_join(transform(slice({near}[{page}], greatest(1, {place} - 19), least(20, {place})), x -> x.a), ''), {REACH})"
    after = f"left(array_join(transform(slice({near}[{page}], {place} + 2, 12), x -> x.b), ''), {REACH // 2})"
    start = f"{sums}[{page}] + aggregate(slice({n}[{page}], 1, {at} % {PAGE}), 0, (x, y) -> x + y)".replace("s.i", "i")
    spans = f"""CASE WHEN {some} THEN transform(
        transform(filter(sequence(0, size({q}) div 2 - 2), i -> {valid}), i -> named_struct('i', i, 'start', {start})),
        s -> named_struct('start', s.start, 'rank', {RANK[kind]}, 'end', s.start + length({q}[{at}]), 'kind', '{kind}',
            'score', {START[name]}D + CASE WHEN rlike(concat({before}, {q}[{at}], {after}), '{_literal(WORDS[kind])}') THEN {NEAR}D ELSE 0D END)) END"""
    return t.withColumn(f"_{name}", F.expr(f"coalesce({spans}, CAST(array() AS {_TYPE}))")).drop(q, n, sums, near)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns _base and _all: arrays of spans (start, rank, end, kind, score), sorted."""
    t = docs.withColumn("t", F.coalesce(F.col(text_col), F.lit("")))
    for pattern in BASE + ADDED:
        t = _with_spans(t, *pattern)
    t = t.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_{x[1]}") for x in BASE))))
    # an added span counts from the threshold on, if it overlaps no base span or added span of an earlier pattern
    t = t.withColumn("_all", F.col("_base"))
    for _, name, *_ in ADDED:
        # most are base spans themselves; the others meet pages of sorted spans, and the spans of those that they overlap
        t = t.withColumn(f"_{name}", F.expr(f"filter(_{name}, x -> x.score >= {THRESHOLD})"))
        t = t.withColumn("_new", F.expr(f"CASE WHEN size(_{name}) = 0 THEN CAST(array() AS array<bigint>) ELSE array_except(transform(_{name}, x -> x.start * 4294967296L + x.`end`), transform(_all, x -> x.start * 4294967296L + x.`end`)) END"))
        t = t.withColumn("_pages", F.expr(f"CASE WHEN size(_new) > 0 AND size(_all) > 0 THEN transform({_pages('_all')}, v -> named_struct('a', v[0].start, 'b', array_max(transform(v, x -> x.`end`)), 'v', v)) END"))
        # named outside the lambda too, so that the optimizer doesn't put the pages' own expression into it
        alone = "CASE WHEN _pages IS NULL THEN _new ELSE filter(_new, k -> NOT exists(_pages, g -> g.a < k % 4294967296L AND shiftright(k, 32) < g.b AND exists(g.v, y -> shiftright(k, 32) < y.`end` AND y.start < k % 4294967296L))) END"
        t = t.withColumn("_new", F.expr(alone))
        keep = f"CASE WHEN size(_new) = size(_{name}) THEN _{name} ELSE filter(_{name}, x -> array_contains(_new, x.start * 4294967296L + x.`end`)) END"
        t = t.withColumn("_all", F.expr(f"CASE WHEN size(_new) = 0 THEN _all ELSE array_sort(concat(_all, {keep})) END"))
    return t.drop("_new", "_pages", *(f"_{x[1]}" for x in BASE + ADDED))


_JOINED = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.`end`)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, top_score.

    Counts are of base spans.
    """
    found = find(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return found.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(_base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(F.expr(_JOINED.format("_base")), 256).alias("base_sha256"),
        F.expr(_JOINED.format("_all")).alias("spans"),
        F.size("_all").cast("long").alias("n_spans"),
        F.expr("array_max(transform(_all, x -> x.score))").alias("top_score"),
    )


#: Characters of a piece that a text is cut to before parts of it are taken.
CUT = 4096


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; each span of a text gives way to its kind in angle brackets, overlapping ones to that of the first. Texts without spans stay as they are, null ones too."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    t = find(own).withColumn("_cuts", F.expr(f"CASE WHEN size(_all) > 0 THEN regexp_extract_all(t, '(?s).{{1,{CUT}}}', 0) END"))
    # how far the spans before each one reach: those that begin behind that are masked, the others are in a mask already
    t = t.withColumn("_ends", F.expr("CASE WHEN size(_all) > 0 THEN transform(_all, x -> x.`end`) END"))
    t = t.withColumn("_ends", F.expr(f"CASE WHEN size(_all) > 0 THEN {_pages('_ends')} END"))
    t = t.withColumn("_reach", F.expr(f"CASE WHEN size(_all) > 0 THEN {_totals('_ends', '0', 'greatest({s}, array_max(v))')} END"))
    t = t.withColumn("_open", F.expr(f"""CASE WHEN size(_all) > 0 THEN filter(transform(_all, (x, i) -> named_struct('kind', x.kind, 'start', x.start,
        'from', greatest(_reach[i div {PAGE}], coalesce(array_max(slice(_ends[i div {PAGE}], 1, i % {PAGE})), 0)))), x -> x.start >= x.`from`) END"""))

    def part(a: str, b: str) -> str:
        """SQL: the characters from a up to b."""
        return f"CASE WHEN {b} > {a} THEN array_join(transform(sequence({a} div {CUT}, ({b} - 1) div {CUT}), c -> substring(_cuts[c], greatest({a} - c * {CUT}, 0) + 1, least({b} - c * {CUT}, {CUT}) - greatest({a} - c * {CUT}, 0))), '') ELSE '' END"

    masked = f"CASE WHEN size(_all) = 0 THEN text ELSE concat(array_join(transform(_open, x -> concat({part('x.`from`', 'x.start')}, '<', upper(x.kind), '>')), ''), {part('greatest(_reach[size(_reach) - 1], array_max(_ends[size(_ends) - 1]))', 'length(t)')}) END"
    return t.withColumn("_masked", F.expr(masked)).select(*(F.col("_masked").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
