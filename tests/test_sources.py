"""Landed files, cached layers and composite operators."""

import gzip
import json
from datetime import date

from pyspark.sql import functions as F

from rostrum.operators import civic_ops as C
from rostrum.sources import files as L


def test_files(spark, tmp_path):
    spark.createDataFrame([(1.0, 1.0, "a"), (9.0, 1.0, "b")], "x double, y double, name string").write.parquet(str(tmp_path / "p"))
    assert [r.name for r in L.in_box(spark, str(tmp_path / "p"), (0, 0, 5, 5), ["name"]).collect()] == ["a"]
    listed = spark.createDataFrame([("release/2026-05-01.0/x",), ("release/2026-06-01.0/y",), ("other/9",)], "path string")
    assert L.latest_release(listed, "release/").first().release == "2026-06-01.0"
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("geocode,n\n0510,3\n")
    assert [tuple(r) for r in L.text_csv(spark, str(tmp_path / "c.csv.gz"), "geocode string, n int").collect()] == [("0510", 3)]
    (tmp_path / "m.json").write_text(json.dumps({"merges": [{"source": "a", "target": "b"}, {"source": "c", "target": "d", "force_cross_type": True}]}, indent=1))
    assert [tuple(r) for r in L.curated_merges(spark, str(tmp_path / "m.json")).collect()] == [("a", "b", False), ("c", "d", True)]
    (tmp_path / "wiki/sub").mkdir(parents=True)
    (tmp_path / "wiki/sub/a.md").write_text("---\ntitle: T\n---\nhello\n")
    page = L.bundle(spark, str(tmp_path / "wiki")).first()
    assert (page.path, page.meta, page.body) == ("sub/a.md", {"title": "T"}, "hello\n")
    assert L.candidate(spark.createDataFrame([(1,)], "PIN int"), ["parcel", "pin"]) == "PIN"
    assert L.settings(spark, '{"rate": {"value": 1.5}}').first().value == 1.5


def test_build_if_missing(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert L.build_if_missing(spark, str(tmp_path / "layer"), build, "census", "2026").count() == 3
    assert built == [1] and spark.read.json(str(tmp_path / "layer.manifest")).first().vintage == "2026"


def test_weekday_trips(spark):
    week = "monday int, tuesday int, wednesday int, thursday int, friday int"
    got = L.weekday_trips(spark.createDataFrame([("s1",), ("s2",)], "stop_id string"), spark.createDataFrame([("t1", "w"), ("t2", "x")], "trip_id string, service_id string"), spark.createDataFrame([("t1", "s1"), ("t1", "s1"), ("t2", "s1")], "trip_id string, stop_id string"), spark.createDataFrame([("w", 1, 1, 1, 1, 1), ("x", 1, 0, 0, 0, 0)], f"service_id string, {week}"))
    assert {r.stop_id: r.n_trips for r in got.collect()} == {"s1": 1, "s2": 0}


def test_people_pages_markers(spark):
    people = spark.createDataFrame([("Ann B. Lee", ["Mayor"]), ("Bo Day", ["Councilmember"]), ("Cy Day", ["Councilmember"])], "name string, titles array<string>")
    got = {(r.slug, r.alias) for r in C.seeded_people(people).collect()}
    assert got == {("ann-lee", "Ann Lee"), ("ann-lee", "Lee"), ("ann-lee", "Mayor Lee"), ("bo-day", "Bo Day"), ("cy-day", "Cy Day")}
    e = spark.createDataFrame([(1, "Oak Trail")], "entity_id long, name string")
    u = spark.createDataFrame([(1, 2, date(2026, 1, 2), "later"), (1, 1, date(2026, 1, 1), "first")], "entity_id long, update_id long, meeting_date date, update_text string")
    page = C.rendered(e, u).first()
    assert page.path == "entities/oak-trail.md" and page.body == "---\ntitle: Oak Trail\n---\n- 2026-01-01: first\n- 2026-01-02: later\n"
    pages = spark.createDataFrame([("p", "has {{metric:a.b}} and {{metric:gone}}")], "path string, body string")
    assert {(r.key, r.value) for r in C.markers(pages, spark.createDataFrame([("a.b", 3.0)], "key string, value double")).collect()} == {("a.b", 3.0), ("gone", None)}


def test_notes_and_modules(spark):
    notes = C.consistency(spark.createDataFrame([(1, 100.0, 2.0, 0.1), (2, 10.0, 2.0, 0.9), (3, 10.0, 0.0, 0.2)], "site long, walk_dollars double, walk_trips double, uplift double")).orderBy("site").collect()
    assert [r.notes for r in notes] == [["dollars for a walk trip"], ["corridor uplift"], []]
    seen = C.evaluate("development", spark.range(1), {"economic": lambda s, p: s.select(F.lit("jobs").alias("metric"), F.lit(2.0).alias("value")), "fiscal": lambda s, p: p["economic"].select(F.lit("net").alias("metric"), (F.col("value") * 3).alias("value"))})
    assert seen["fiscal"].first().value == 6
