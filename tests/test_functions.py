import math

import pytest
from pyspark.sql import functions as F

from provenor.functions import (
    csv_guard, erfc, extract_id, finite_or_null, id_parts, label_group, neg_log10, norm_key, not_blank, similarity, two_sided_p,
)


def test_erfc_is_exact(spark):
    xs = [i / 37.0 for i in range(0, 990)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y"))
    for r in df.collect():
        want = math.erfc(r.x)
        assert r.y == pytest.approx(want, rel=5e-14, abs=1e-320)


def test_two_sided_p(spark):
    ts = [0.0, 1.96, -1.96, 3.0, 60.0, None, float("nan"), float("inf"), float("-inf")]
    got = [r.p for r in spark.createDataFrame([(t,) for t in ts], "t double").select(two_sided_p(F.col("t")).alias("p")).collect()]
    assert got[0] == 1.0
    assert got[1] == got[2] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-13)
    assert got[3] == pytest.approx(math.erfc(3 / math.sqrt(2)), rel=1e-13)
    assert got[4] == 0.0
    assert got[5:] == [None, None, None, None]


@pytest.mark.parametrize("text,want", [
    ("Solid Tissue Normal", "normal"), ("Primary Tumor", "tumor"), ("Recurrent", "tumor"), (None, "other"), ("Primary normal", "normal"),
    ("Metastatic", "tumor"), ("Blood", "other"),
])
def test_label_group(spark, text, want):
    df = spark.createDataFrame([(text, None)], "a string, b string")
    assert df.select(label_group("a", "b").alias("g")).first().g == want


def test_id_parts(spark):
    df = spark.createDataFrame([("ENSG00000000002.3_PAR_Y",), ("ENSG00000000001.5",), ("ENSG3",)], "g string")
    flag, base = id_parts("g")
    got = [tuple(r) for r in df.select(flag, base).collect()]
    assert got == [(True, "ENSG00000000002"), (False, "ENSG00000000001"), (False, "ENSG3")]


def test_keys_and_ids(spark):
    df = spark.createDataFrame([(" tp 53 ", "9606.ENSP00000269305.4", "  ")], "k string, p string, b string")
    r = df.select(
        norm_key("k").alias("a"), norm_key("k", strip_inner=True).alias("b"), extract_id("p", r"(ENSP[0-9]+(?:\.[0-9]+)?)").alias("c"),
        extract_id("k", r"(ENSP[0-9]+)").alias("d"), not_blank("b").alias("e"), not_blank("k").alias("f"),
    ).first()
    assert tuple(r) == ("TP 53", "TP53", "ENSP00000269305.4", None, False, True)


def test_neg_log10(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1e-100,), (0.01,)], "p double")
    got = [tuple(r) for r in df.select(neg_log10("p"), neg_log10("p", plot_cap=60.0)).collect()]
    assert got == [(300.0, 60.0), (None, None), (pytest.approx(100.0), 60.0), (pytest.approx(2.0), pytest.approx(2.0))]


def test_guards(spark):
    df = spark.createDataFrame([("=1+1",), ("-5",), ('x"y',), (None,)], "v string")
    assert [r[0] for r in df.select(csv_guard("v")).collect()] == ["'=1+1", "'-5", 'x"y', ""]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,), (None,)], "v double")
    assert [r[0] for r in odd.select(finite_or_null("v")).collect()] == [None, None, 1.5, None]
    assert [r[0] for r in spark.createDataFrame([(-0.5,), (0.25,), (1.5,)], "d double").select(similarity("d")).collect()] == [1.0, 0.75, 0.0]
