"""Tables in zip feeds and landed layer pages."""

import json
import os
import zipfile

import pytest
from rostrum.sources import bundles, feeds, files


def test_tables_of_two_zip_feeds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "BATCH", 2)
    for name, stops in (("cue", ["a,Old Town,38.5", "b,\"Main, West\",", "c,,38.7"]), ("metro", ["x,Hall,1.5"])):
        with zipfile.ZipFile(f"{tmp_path}/{name}.zip", "w") as z:
            z.writestr("feed/stops.txt", "﻿stop_id,stop_name,stop_lat\r\n" + "\r\n".join(stops) + "\r\n")
            z.writestr("trips.txt", "service_id,trip_id\nwk,t1\nsa,t2\n" if name == "cue" else "service_id,trip_id\nwk,t9\n")
            z.writestr("calendar.txt", "service_id,monday,tuesday,wednesday,thursday,friday\nwk,1,1,1,1,1\nsa,0,0,0,0,0\n")
            z.writestr("stop_times.txt", "trip_id,stop_id\nt1,a\nt2,a\nt1,b\n" if name == "cue" else "trip_id,stop_id\nt9,x\n")
    spark.dataSource.register(feeds.ZipTable)
    read = lambda member, schema: spark.read.format("zip_table").schema(schema).option("member", member).load(f"file://{tmp_path}")
    stops = read("stops.txt", "feed string, stop_id string, stop_name string, stop_lat double, zone string")
    assert stops.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, stops.collect())) == [("cue", "a", "Old Town", 38.5, None), ("cue", "b", "Main, West", None, None), ("cue", "c", "", 38.7, None), ("metro", "x", "Hall", 1.5, None)]
    week = read("calendar.txt", "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int").distinct()
    out = files.weekday_trips(stops, read("trips.txt", "service_id string, trip_id string"), read("stop_times.txt", "trip_id string, stop_id string"), week)
    assert {r.stop_id: r.n_trips for r in out.collect()} == {"a": 1, "b": 1, "c": 0, "x": 1}
    assert read("shapes.txt", "shape_id string").count() == 0


def test_landed_layers_push_filters_to_the_scan(spark, tmp_path):
    page = lambda layer, at, zones: (layer, at, json.dumps({"features": [{"attributes": {"pin": f"{layer} {at + k}", "zone": z, "acres": at + k / 10}} for k, z in enumerate(zones)]}))
    rows = [page("parcels", 3 * i, ["CR", "R1", None]) for i in range(20)] + [page("zones", 0, ["CR", "PD"])]
    feeds.land_layers(spark.createDataFrame(rows, "layer string, offset long, json string"), "pin:string,zone:string,acres:double", f"{tmp_path}/layers", "acres", 3)
    every = feeds.layers(spark, f"{tmp_path}/layers")
    own = every.where("layer = 'parcels' and zone = 'CR' and acres >= 50").select("pin")
    assert sorted(r.pin for r in own.collect()) == ["parcels 51", "parcels 54", "parcels 57"] and every.count() == 62
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "EqualTo(zone,CR), GreaterThanOrEqual(acres,50.0)" in plan and "ReadSchema: struct<pin:string,zone:string,acres:double>" in plan
    feeds.land_layers(spark.createDataFrame([page("zones", 0, ["PD"])], "layer string, offset long, json string"), "pin:string,zone:string,acres:double", f"{tmp_path}/layers", "acres", 3)
    assert {r.layer: r["count"] for r in feeds.layers(spark, f"{tmp_path}/layers").groupBy("layer").count().collect()} == {"parcels": 60, "zones": 1}
    with pytest.raises(Exception, match="layer query failed"):
        feeds.land_layers(spark.createDataFrame([("x", 0, '{"error": "no such layer"}')], "layer string, offset long, json string"), "pin:string,zone:string,acres:double", f"{tmp_path}/bad", "acres", 3)


def test_only_changed_pages_are_written(spark, tmp_path):
    folder = f"file://{tmp_path}/bundle"
    pages = lambda *rows: spark.createDataFrame(rows, "path string, body string")
    first = bundles.write_changed(pages(("a.md", "one"), ("sub/b.md", "zwei ü"), ("c.md", "")), folder)
    assert sorted(r.path for r in first.collect()) == ["a.md", "c.md", "sub/b.md"]
    (tmp_path / "bundle/own.md").write_text("not ours")
    times = {p: os.stat(tmp_path / "bundle" / p).st_mtime_ns for p in ("a.md", "sub/b.md", "c.md")}
    again = bundles.write_changed(pages(("a.md", "one"), ("sub/b.md", "zwei ü!"), ("c.md", ""), ("d/e/f.md", "new")), folder)
    assert sorted(r.path for r in again.collect()) == ["d/e/f.md", "sub/b.md"]
    assert [os.stat(tmp_path / "bundle" / p).st_mtime_ns == times[p] for p in ("a.md", "c.md", "sub/b.md")] == [True, True, False]
    assert (tmp_path / "bundle/sub/b.md").read_text() == "zwei ü!" and (tmp_path / "bundle/own.md").read_text() == "not ours"
    assert bundles.write_changed(pages(("a.md", "one")), folder).count() == 0
    with pytest.raises(Exception, match="no body"):
        bundles.write_changed(pages(("a.md", "changed"), ("z.md", None)), folder)
    with pytest.raises(ValueError, match="twice"):
        bundles.write_changed(pages(("y.md", "1"), ("y.md", "2")), folder)
    assert (tmp_path / "bundle/a.md").read_text() == "one" and not os.path.exists(tmp_path / "bundle/y.md")
    assert not [x for x in os.listdir(tmp_path / "bundle") if x.startswith(".")]
