import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.functions import text as T
from meterlake.functions import timeseries as ts
from meterlake.functions.labels import choice, select_series, without_fixtures
from meterlake.operators import checks, vector as V

T0 = datetime(2024, 1, 1)


def values(spark, sql_type, rows, use):
    df = spark.createDataFrame([(r,) for r in rows], f"v {sql_type}")
    return [r[0] for r in df.select(use(F.col("v"))).collect()]


def test_safe_text_and_numbers(spark):
    assert values(spark, "string", [None, " ", "a/b c", "naïve;x", "y" * 200], T.safe_text) == ["unknown", "unknown", "a/b c", "na_ve_x", "y" * 160]
    assert values(spark, "string", ["12", "1.5x", None], T.safe_int) == [12, 0, 0]
    assert values(spark, "boolean", [True, None], T.safe_int) == [1, 0]
    assert values(spark, "string", ["Yes ", "0", None], T.is_true) == [True, False, False]


def test_digests(spark):
    key = b"k" * 80
    assert values(spark, "string", ["abc", "é"], lambda c: T.hmac_sha256(c, key)) == [hmac.new(key, x.encode(), hashlib.sha256).hexdigest() for x in ("abc", "é")]
    assert values(spark, "string", ["k"], lambda c: T.trace_id(c, F.lit("s"))) == [hashlib.sha256(b"trace:k:s").hexdigest()[:32]]


def test_canonical_json_and_sizes(spark):
    doc = {"b": [1, {"z": "é", "a": None}], "a": "x"}
    want = json.dumps(doc, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert values(spark, "string", [json.dumps(doc), "not json"], T.canonical_json) == [want, "not json"]
    assert values(spark, "string", [want], T.utf8_size) == [len(want.encode())]


def test_one_hot_is_upper_inclusive(spark):
    assert values(spark, "int", [256, 257, 999999], T.one_hot) == [[1, 0, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 1]]


def test_clamp_keeps_null(spark):
    assert values(spark, "double", [None, -1.0, 7.0], lambda c: T.clamp(c, 0.0, 5.0)) == [None, 0.0, 5.0]


def test_urls_and_ids(spark):
    assert values(spark, "string", ["http://h:1/v1/traces/", "http://h:1/x"], T.url_base) == ["http://h:1", "http://h:1/x"]
    assert values(spark, "string", ["http://127.0.0.1:1/", "http://[::1]:4318", "https://example.com", None], T.is_loopback) == [True, True, False, False]
    assert values(spark, "string", ["a.b-1", "A", None], T.is_logical_id) == [True, False, False]
    key, value = T.key_value(F.lit("a=b=c"))
    assert spark.range(1).select(key, value).first()[:] == ("a", "b=c")


def series(spark, points, **labels):
    rows = [("m", *labels.values(), T0 + timedelta(seconds=s), float(v)) for s, v in points]
    return spark.createDataFrame(rows, ", ".join(["metric string", *(f"{k} string" for k in labels), "ts timestamp", "value double"]))


def test_increase_with_restart_and_extrapolation(spark):
    s = series(spark, [(0, 100), (60, 10), (120, 14), (180, 2)], a="x")
    end = T0 + timedelta(seconds=180)
    # left-open: the sample at 0 is outside a range of 180 seconds
    assert ts.increase(s, end, "180 seconds", extrapolate=False).first().value == 4 + 2
    assert ts.increase(s, end, "181 seconds", extrapolate=False).first().value == 10 + 4 + 2
    # 3 samples over 120 s in a range of 180 s: 60 s before the first are within 1.1 times the distance, and to zero it is 200 s
    assert ts.increase(s, end, "180 seconds", extrapolate=True).first().value == pytest.approx(6 * (120 + 60) / 120)
    assert ts.rate(s, end, "180 seconds", extrapolate=False).first().value == pytest.approx(6 / 180)
    assert ts.increase(s, T0, "10 seconds").count() == 0


def test_extrapolation_stops_at_zero(spark):
    s = series(spark, [(100, 1), (200, 11)], a="x")
    got = ts.increase(s, T0 + timedelta(seconds=200), "200 seconds", extrapolate=True).first().value
    assert got == pytest.approx(10 * (100 + 10) / 100)


def test_instant_and_grid(spark):
    s = series(spark, [(0, 1), (100, 2), (200, 5), (310, 9)], a="x")
    assert ts.instant(s, T0 + timedelta(seconds=320), "5 minutes").first().value == 9
    assert ts.instant(s, T0 + timedelta(seconds=700), "5 minutes").count() == 0
    grid = {(r.ts - T0).total_seconds(): r.value for r in ts.increase_on_grid(s, T0, T0 + timedelta(seconds=600), "200 seconds", extrapolate=False).collect()}
    assert grid == {200.0: 3.0}
    assert ts.freshness(s, T0 + timedelta(seconds=320)).first().value == 10
    assert ts.freshness(s.limit(0), T0).count() == 0


def test_histogram_quantile(spark):
    rows = [("a", "10", 5.0), ("a", "20", 10.0), ("a", "+Inf", 10.0), ("b", "10", 1.0), ("b", "+Inf", 10.0), ("c", "10", 0.0), ("c", "+Inf", 0.0), ("d", "+Inf", 3.0)]
    got = {r.g: r.value for r in ts.histogram_quantile(0.95, spark.createDataFrame(rows, "g string, le string, value double"), ["g"]).collect()}
    assert got == {"a": pytest.approx(19.0), "b": 10.0}


def test_matchers_treat_missing_as_empty(spark):
    df = spark.createDataFrame([("m", None, 1.0), ("m", "probe-fixture", 2.0), ("m", "live", 4.0)], "metric string, service_namespace string, value double")
    assert without_fixtures(df).agg(F.sum("value")).first()[0] == 5
    assert select_series(df, "m", ne={"service_namespace": ""}).count() == 2
    assert select_series(df, "m", re={"service_namespace": choice(["live"])}).count() == 1
    assert select_series(df, "m", eq={"absent": ""}).count() == 3
    assert select_series(df, "m", re={"service_namespace": "liv"}).count() == 0


def test_vector_sets(spark):
    left = spark.createDataFrame([("a", None, 1.0), ("b", "x", 2.0)], "k string, j string, value double")
    right = spark.createDataFrame([("a", "", 10.0), ("c", "x", 30.0)], "k string, j string, value double")
    assert sorted((r.k, r.value) for r in V.vec_or(left, right).collect()) == [("a", 1.0), ("b", 2.0), ("c", 30.0)]
    assert [r.k for r in V.vec_unless(left, right, ["k", "j"]).collect()] == ["b"]
    assert [r.k for r in V.vec_and(left, right, ["k", "j"]).collect()] == ["a"]
    assert [r.value for r in V.vec_binop(left, right, ["k", "j"], lambda a, b: b - a).collect()] == [9.0]
    assert V.fold(left.limit(0)).count() == 0
    assert V.ratio(left, F.lit(False)).count() == 0


def test_checks(spark):
    rubric = spark.createDataFrame(
        [("a", "CATEGORICAL", [("x", 1.0), ("x", 0.0)]), ("b", "FREEFORM", None), ("b", "FREEFORM", None), ("c", "CATEGORICAL", [("y", 1.0)]), ("d", "WHAT", None)],
        "name string, type string, labels array<struct<label:string,score:double>>",
    )
    faults = sorted((r.name, r.fault) for r in checks.rubric_faults(rubric, ["a", "b", "c", "d"]).collect())
    assert faults == [("a", "repeated label"), ("b", "repeated name"), ("b", "repeated name"), ("d", "unknown type")]
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    have = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "k string, v int")
    assert sorted((r.k, r.state) for r in checks.config_diff(want, have, ["k"], ["v"]).collect()) == [("a", "missing"), ("c", "drifted"), ("d", "not_assigned")]
