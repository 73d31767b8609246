import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lethe.functions.spans import find_spans
from lethe.operators import resolve
from lethe.operators.detect import detect, rules
from lethe.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(con.sql(ORACLES[name]).df())


def test_spans_equal_those_of_re(spark):
    random.seed(1)
    texts = ["".join(random.choices("aΑά😀1 2-\n,.@", k=random.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for value, prefix in ((r"\d+", ""), (r"[aΑά]+", r"\d\s*"), (r"\w+@\w+", "")):
        got = {r["i"]: [(s["start"], s["end"], s["text"]) for s in r["s"]] for r in df.select("i", find_spans(F.col("t"), value, prefix).alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(m.start(2), m.end(2), m[2]) for m in re.finditer(f"({prefix})({value})", t) if m[2]]


def test_golden_cases(spark):
    cases = [
        ("με Α.Φ.Μ. 037173570", "afm_checksum", [("037173570", 1.0)]),
        ("αρ. πρωτ. 34519/2026 και", "protocol_number", [("34519", 0.85)]),
        ("αρ. πρωτ. 34519/30-03-2026 και", "protocol_number", [("34519", 0.85)]),
        ("ΑΤΑΚ 00610643353, 00610643361 και 01188179990", "atak", [("00610643353", 1.0), ("00610643361", 1.0), ("01188179990", 1.0)]),
        ("Α.Χ.Κ. 76/19062, 77/19063", "axk", [("76/19062", 1.0), ("77/19063", 1.0)]),
        ("αριθμό ειδοποίησης 2221792/15-03-2026", "notice_number", [("2221792", 1.0)]),
        ("υπ' αρ. 231/2020", "address_number", []),
        ("οδός Διομήδους αρ. 1,", "address_number", [("1", 0.8)]),
        ("τιμολογίου Επαμεινώνδα", "invoice_number", []),
    ]
    for text, rule, expected in cases:
        got = detect(spark.createDataFrame([(text,)], "text string"), rules(rule)).orderBy("start").collect()
        assert [(r["text"], r["confidence"]) for r in got] == expected, text


def test_resolution_of_the_worked_example_and_masking(spark):
    # Tiers 2, 7 and 5.
    rows = [(1, 0, 10, "REDACT", "ACT_NUMBER", 0.85, "deterministic"), (1, 3, 5, "PRESERVE", "MONEY", 0.95, "deterministic"), (1, 8, 14, "REDACT", "ACT_NUMBER", 0.9, "llm_pass2")]
    spans = spark.createDataFrame([(*r, "d", "") for r in rows], "u int, start int, end int, action string, category string, confidence double, origin string, detector string, reason string")
    plan = resolve.resolve(spans, ["u"])
    assert sorted((r["start"], r["end"], r["action"]) for r in plan.collect()) == [(0, 3, "REDACT"), (3, 5, "PRESERVE"), (5, 8, "REDACT"), (8, 14, "REDACT")]
    units = spark.createDataFrame([(1, "αβγδεζηθικλμνξο"), (2, None), (3, "")], "u int, text string")
    assert {r["u"]: r["text"] for r in resolve.mask(units, plan, ["u"]).collect()} == {1: "...δε.........ο", 2: None, 3: ""}


def test_review_spans_are_refused(spark):
    spans = spark.createDataFrame([(1, 0, 2, "REVIEW", "PHONE", 0.9, "deterministic", "d", "")], "u int, start int, end int, action string, category string, confidence double, origin string, detector string, reason string")
    with pytest.raises(Exception, match="REVIEW"):
        resolve.resolve(spans, ["u"]).collect()
