"""Folds over ordered rows: null keys, nulls and ties, empty tables."""

from rostrum.operators import relational as R
from rostrum.operators import spatial as S
from rostrum.streaming import streams as T


def test_null_keys_and_empty_tables(spark):
    calls = spark.createDataFrame([(None, 0.0, 1), (None, 1.0, 2), (1, 0.0, 3), (1, 0.0, 4), (1, 61.0, 5)], "user_id long, s double, event_id long").selectExpr("user_id", "timestamp_seconds(s) AS ts", "event_id")
    got = {r.event_id: r.allowed for r in T.rate_limit(calls, 1, 60).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True} and T.rate_limit(calls.limit(0), 1, 60).count() == 0
    day = {r.event_id: r.allowed for r in T.daily_budget(calls, 1, 60, per_day=2).collect()}
    assert day == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_segments_and_places_with_nulls(spark):
    parts = spark.createDataFrame([(1, 1, 0.0, 1.0, None), (1, 2, 1.0, 2.0, "ab"), (1, 3, 2.0, None, "cd"), (2, 1, 0.0, 1.0, None)], "m int, o int, s double, e double, t string")
    got = [(r.m, r.part, r.start, r.end, r.text) for r in R.merge_segments(parts, "m", "o", "s", "e", "t", 2).orderBy("m", "part").collect()]
    assert got == [(1, 0, 0.0, 2.0, "ab"), (1, 1, 2.0, None, "cd"), (2, 0, 0.0, 1.0, None)]
    places = spark.createDataFrame([("a", 0.0), ("a", None), ("a", 5.0), ("a", 10.0), (None, 3.0)], "l string, x double")
    assert sorted((r.l or "", r.x) for r in S.thin_along(places, "l", "x", 10.0).collect()) == [("", 3.0), ("a", 0.0), ("a", 10.0)]
