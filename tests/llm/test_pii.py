import hashlib
import re

import pytest

from binfold.llm import pii

TEXTS = [
    None,
    "",
    "mail a.b@c.de, x@y.z@d.ef_q@g.hi and a@b no",
    "é😀 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 12.34.56.78",
    "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111111 4111111111111111",
    "+1 (826) 555-4081 190.137.223.204 du +1 (058) 555-3468 ndble +12 3",
    "IBAN DE89 3704 0044 0532 0130 00. and GB82WEST12345698765432 XX00AAAA11112222",
    "call me (509) 555-6973 or 509 555-6973; code 123 456-7890",
    "9" * 30000 + " x" + "a" * 30000 + "@b." + "1.2.3." * 5000 + " +" + "1 " * 9000,
    "1 2 " * 20000 + "a@b" + ".c" * 20000,
]


def brute(text):
    t = text or ""
    out = []
    for rank, (kind, p) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(p, t):
            digits = [int(c) for c in m[0] if c.isdigit()]
            ok = True
            if kind == "ip":
                ok = all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                twice = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
                ok = 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def check(rows):
    for r in rows:
        base = brute(r["text"])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) - {""} <= set(r["spans"].split(","))


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = pii.scan(docs).join(docs, "doc_id").collect()
    assert len(rows) == len(TEXTS)
    check(rows)
    by = {r["doc_id"]: r for r in rows}
    assert "iban:5:32" in by[6]["spans"].split(",") and sum("iban" in x for x in by[6]["spans"].split(",")) == 2
    assert "phone:0:17" in by[5]["spans"].split(",")
    assert by[0]["spans"] == by[1]["spans"] == ""


def test_addresses_with_zero_parts(spark):
    texts = ["a 10.0.0.1 b 127.0.0.1, 192.168.0.1", "0.0.0.0 1.00.2.3 10.020.000.0255", "256.0.0.1 0.0.0.256 0.0.0300.0", "0" * 4000 + ".0.0." + "0" * 4000, "0" * 4000 + "256.0.0.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.scan(docs).join(docs, "doc_id").orderBy("doc_id").collect()
    check(rows)
    assert [r["n_ip"] for r in rows] == [3, 3, 0, 1, 0]
    assert pii.redact(docs.limit(1)).first()["text"] == "a <IP> b <IP>, <IP>"


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(pii.scan(docs).join(docs, "doc_id").collect())


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = pii.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_redact(spark):
    rows = [(1, "mail a.b@c.de 😀 now", "x", 5), (2, None, None, None), (2, None, None, None), (3, "clean", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, _all int")
    got = sorted(pii.redact(docs.withColumnRenamed("_all", "n")).collect(), key=str)
    assert sorted(str(r["text"]) for r in got) == ["None", "None", "clean", "mail <EMAIL> 😀 now"]
    assert got[0].asDict().keys() == {"doc_id", "text", "t", "n"}


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    assert pii.scan(spark.createDataFrame([], schema)).collect() == []


def test_many_spans_in_a_long_text(spark):
    """Very many spans of all kinds in one text: positions, context and masks hold, in about linear time."""
    parts = ["mail {0}@b.de, ", "ip 10.0.{1}.7; ", "call +1 (826) 555-4081 ", "card 4111 1111 1111 1111. ", "call (509) 555-6973 or ", "IBAN DE89 3704 0044 0532 0130 00 é😀 ", "lorem ipsum dolor sit amet " * 9]
    text = "".join(parts[i % len(parts)].format(i, i % 256) for i in range(24_000))
    docs = spark.createDataFrame([(1, text), (2, text[:5000]), (3, None)], "doc_id long, text string")
    rows = pii.scan(docs).join(docs, "doc_id").collect()
    check(rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_spans"] > 18_000 and by[1]["spans"].startswith(by[2]["spans"].rsplit(",", 1)[0])
    spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in by[1]["spans"].split(","))]
    want, at = [], 0
    for a, b, k in spans:
        if a >= at:
            want += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[1] == "".join(want) + text[at:] and masked[3] is None


def test_what_stands_near_is_read_across_spans(spark):
    """Words that name a kind count up to 48 characters before a span, over other spans too, and no farther."""
    near, far = "phone 1.2.3.4 5.6.7.8 509-555-6973", "phone " + "1.2.3.4 " * 6 + "509-555-6973"
    rows = {r["doc_id"]: r["spans"] for r in pii.scan(spark.createDataFrame([(1, near), (2, far), (3, "509-555-6973 is my phone"), (4, "509-555-6973 is not quite what names a phone")], "doc_id long, text string")).collect()}
    assert "phone:22:34" in rows[1] and "phone" not in rows[2].replace("phone:22:34", "") and "phone" in rows[3] and rows[4] == ""
