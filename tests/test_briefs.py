"""Briefs, the directory, sites, layers, wildcards and streamed snapshots against plain versions."""

import fnmatch
import json
import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rostrum.operators import briefs as B
from rostrum.operators import layers as L
from rostrum.operators import patterns as W
from rostrum.operators import sites as T
from rostrum.sources import parse as P
from rostrum.streaming import streams as S

RINGS = "array<array<struct<x:double,y:double>>>"


def test_brief_tells_what_an_agenda_is_about(spark):
    entities = spark.createDataFrame([(1, "courthouse-plaza", "Courthouse Plaza", "project", "approved"), (2, "jo-lee", "Jo Lee Smith", "person", None), (3, "oak", "Oak", "topic", None), (4, "trail", "Snyder Trail", "project", None), (5, "quiet", "Quiet Topic", "topic", None)], "entity_id int, slug string, name string, entity_type string, current_status string")
    aliases = spark.createDataFrame([(1, "the plaza"), (4, "George Snyder Trail")], "entity_id int, alias string")
    meetings = spark.createDataFrame([(1, date(2026, 1, 1)), (2, date(2026, 2, 1))], "meeting_id int, meeting_date date")
    updates = spark.createDataFrame([(1, 1, 1, "first"), (2, 1, 2, "second"), (3, 1, 2, "third"), (4, 4, 1, "dug"), (5, 2, 1, "p"), (6, 3, 1, "short")], "update_id int, entity_id int, meeting_id int, update_text string")
    projects = spark.createDataFrame([(1, 1, "Courthouse-Plaza"), (2, 4, "Trail"), (3, 1, "Other")], "project_id int, entity_id int, external_slug string")
    evaluations = spark.createDataFrame([(1, "synthesized"), (2, "extracted")], "project_id int, status string")
    text = "Call to order\n7. Public hearing on COURTHOUSE Plaza and the plaza\n8. George Snyder Trail, Jo Lee Smith, Quiet Topic, oak"
    upcoming = spark.createDataFrame([("a", text), ("b", "nothing"), ("c", None), ("d", "")], "event_id string, agenda_text string")
    got = {r.event_id: r for r in B.meeting_briefs(upcoming, entities, aliases, updates, meetings, projects, evaluations).collect()}
    assert [(t.slug, t.update_count, t.last_seen, t.agenda_context, t.latest_update.text, t.evaluation_slug) for t in got["a"].topics] == [
        ("courthouse-plaza", 3, date(2026, 2, 1), "7. Public hearing on COURTHOUSE Plaza and the plaza", "third", "Courthouse-Plaza"),
        ("trail", 1, date(2026, 1, 1), "8. George Snyder Trail, Jo Lee Smith, Quiet Topic, oak", "dug", None),
    ]
    assert [(got[k].has_agenda_text, got[k].topics) for k in "bcd"] == [(True, []), (False, []), (False, [])] and "_n" not in got["a"].topics[0]


def test_keeping_in_order_is_the_greedy_pass(spark):
    rng = random.Random(5)
    for n, m in ((40, 60), (30, 10), (25, 250)):
        pairs = {tuple(rng.sample(range(n), 2)) for _ in range(m)} | {(k, k + 1) for k in range(8)}
        kept = []
        for k in range(n):
            if not any((k, j) in pairs or (j, k) in pairs for j in kept):
                kept.append(k)
        got = B.kept_in_order(spark.range(n).select(F.col("id").alias("node")), spark.createDataFrame(sorted(pairs), "a long, b long"))
        assert sorted(r.node for r in got.collect()) == kept
    assert B.kept_in_order(spark.range(3).select(F.col("id").alias("node")), spark.createDataFrame([], "a long, b long")).count() == 3


def test_directory_suppresses_what_says_the_same(spark):
    projects = spark.createDataFrame([(1, "Davies", "Davies Property", "Private", None, "Under Review", None, None, None), (2, "Plaza", "Courthouse Plaza", "City", None, None, None, None, 9)], "project_id int, external_slug string, name string, project_type string, division string, official_status string, description string, requests string, entity_id int")
    names = ["Davies proposal", "Blenheim Boulevard multimodal project", "Blenheim Boulevard", "Project proposal", "City Hall roof", "Courthouse Plaza", "City Hall roof repair", "City Hall", "City Hall"]
    rows = [(k, f"e{k}", n, "project", None) for k, n in enumerate(names, 4)] + [(50, "e50", "Some Topic", "topic", None)]
    entities = spark.createDataFrame(rows, "entity_id int, slug string, name string, entity_type string, current_status string")
    evaluations = spark.createDataFrame([(2, "synthesized")], "project_id int, status string")
    got = B.directory(projects, entities, evaluations).orderBy("place").collect()
    assert [(r.source, r.name, r.entity_id, r.has_evaluation) for r in got] == [("official", "Courthouse Plaza", 9, True), ("official", "Davies Property", None, False), ("meetings", "Blenheim Boulevard", 6, False), ("meetings", "City Hall", 11, False)]
    assert [r.name for r in B.directory(projects, entities, evaluations, project_type="City").collect()] == ["Courthouse Plaza"]
    assert [r.name for r in B.directory(projects, entities, evaluations, q="roof").orderBy("place").collect()] == ["City Hall roof"]


def square(x, y, d=100.0):
    return [[(x, y), (x + d, y), (x + d, y + d), (x, y + d)]]


def test_sites_by_the_first_way_that_answers(spark):
    parcels = spark.createDataFrame([("57 4 02 015", square(0.0, 0.0)), ("57 4 02 016", square(0.0, 110.0)), ("57 4 02 017", square(500.0, 0.0))], f"pin string, rings {RINGS}")
    kind = "project string, slug string, name string, pins array<string>, x double, y double, geo_x double, geo_y double"
    projects = spark.createDataFrame([
        ("pins", "pins-slug", "P", ["57  4 02 015", " 57 4 02 016 ", "1 1"], 550.0, 50.0, None, None),
        ("place", "place-slug", "P", ["nothing"], 50.0, 160.0, 50.0, 50.0),
        ("address", "address-slug", "P", None, None, None, 50.0, 50.0),
        ("map by url", "map-slug", "Q", [], 9999.0, 0.0, None, None),
        ("map by name", "no-such-slug", "Democracy  Lane!", None, None, None, None, None),
        ("short", "ab", "R", None, None, None, None, None),
        ("none", None, None, None, None, None, None, None),
    ], kind)
    reviews = spark.createDataFrame([(1, "x", "https://t.org/Map-Slug?b=2", 550.0, 50.0), (2, "democracy lane", None, 50.0, 50.0), (0, "democracy lane", None, None, None), (3, "y", "https://t.org/ab", 50.0, 160.0), (4, "z", "https://t.org/abc", 50.0, 50.0)], "review int, name string, url string, x double, y double")
    got = {r.project: (r.method, r.pins, r.acres and round(r.acres * 43560), r.note) for r in T.resolved_sites(projects, parcels, reviews).collect()}
    assert got == {
        "pins": ("document_pins", ["57 4 02 015", "57 4 02 016"], 20000, None), "place": ("address_geocode", ["57 4 02 016"], 10000, None), "address": ("address_geocode", ["57 4 02 015"], 10000, None),
        "map by url": ("review_map", ["57 4 02 017"], 10000, None), "map by name": ("review_map", ["57 4 02 015"], 10000, None), "short": ("review_map", ["57 4 02 016"], 10000, None),
        "none": (None, None, None, "no usable parcel numbers, place or review map entry"),
    }


def plain_simplified(pts, tolerance):
    def gap(p, a, b):
        dx, dy = b[1] - a[1], b[2] - a[2]
        t = max(0.0, min(1.0, ((p[1] - a[1]) * dx + (p[2] - a[2]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(p[1] - a[1] - t * dx, p[2] - a[2] - t * dy)

    def keep(i, j):
        if j - i < 2:
            return set()
        d, k = max((gap(pts[k], pts[i], pts[j]), -k) for k in range(i + 1, j))
        return {-k} | keep(i, -k) | keep(-k, j) if d > tolerance else set()

    return {pts[0][0], pts[-1][0]} | {pts[k][0] for k in keep(0, len(pts) - 1)} if pts else set()


def test_simplified_lines(spark):
    rng = random.Random(6)
    lines = {k: [(n, float(n), rng.uniform(0, 10)) for n in range(rng.choice([1, 2, 3, 60]))] for k in range(8)}
    lines[20] = [(0, 0.0, 0.0), (1, 5.0, 0.0), (2, 5.0, 5.0), (3, 0.0, 0.0)]  # closed
    lines[21] = [(n, float(n), float(n % 2)) for n in range(9)]  # equally far corners
    rows = [(k, *p) for k, line in lines.items() for p in line]
    table = spark.createDataFrame([*rows, (0, 500, None, 1.0)], "line int, n int, x double, y double")
    for tolerance in (0.5, 3.0):
        got = {k: set() for k in lines}
        for r in L.simplified(table, "line", "n", tolerance).collect():
            got[r.line].add(r.n)
        assert got == {k: plain_simplified(v, tolerance) for k, v in lines.items()}


def test_layers_keep_the_largest_within_the_budget(spark):
    rows = [("a", k, float(k % 5), 1.0 + k / 3, 2.0) for k in range(60)] + [("b", 1, 3.0, 0.0, 0.0), ("c", 1, None, 0.0, 0.0), ("d", 1, 0.5, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "layer_of string, id int, trips double, x double, y double")
    json_ = L.feature("LineString", F.array(F.struct("x", "y"), F.struct(F.lit(9.123456789).alias("x"), F.col("y"))), ["trips"], 5)
    own = table.withColumn("j", json_)
    fit = L.within_budget(own, ["layer_of"], "trips", "id", "j", 1200, 1.0)
    out = {r.layer_of: r for r in L.collections(fit, ["layer_of"], "trips", "id", "j", 1200).collect()}
    assert set(out) == {"a", "b"} and len(out["a"].layer.encode()) <= 1200
    features = json.loads(out["a"].layer)["features"]
    order = sorted((r for r in rows if r[0] == "a" and r[2] >= 1), key=lambda r: (-r[2], r[1]))
    assert [f["geometry"]["coordinates"][0][0] for f in features] == [round(r[3], 5) for r in order[: len(features)]]
    assert features[0]["geometry"]["coordinates"][1][0] == 9.12346 and len(features) == out["a"].n
    longer = {"type": "FeatureCollection", "features": [*features, features[-1]]}
    assert len(json.dumps(longer, separators=(",", ":"))) > 1200 - 2
    with pytest.raises(Exception, match="over 100 bytes"):
        L.collections(own, ["layer_of"], "trips", "id", "j", 100).collect()


def test_wildcards(spark):
    rng = random.Random(7)
    values = ["".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 7))) for _ in range(120)] + ["(a.b)", "a\nb", "$1", None, "ab", "ab"]
    patterns = ["".join(rng.choice("ab1 *?") for _ in range(rng.randint(0, 5))) for _ in range(80)] + ["*", "?", "", "**", "?*?", "(a.b)", "(*)", "$1", "$*", "a?b", None, "ab", "ab"]
    got = sorted((r.i, r.k) for r in W.pattern_join(spark.createDataFrame(list(enumerate(values)), "i int, v string"), spark.createDataFrame(list(enumerate(patterns)), "k int, p string"), "v", "p").collect())
    assert got == sorted((i, k) for i, v in enumerate(values) for k, p in enumerate(patterns) if v is not None and p is not None and fnmatch.fnmatchcase(v, p)) and len(got) > 300


def test_streamed_snapshots_add_up_to_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(8)
    schema = "source string, version timestamp, events array<struct<event_id:string,title:string,agenda_text:string>>"
    at = datetime(2026, 1, 1)
    snaps = [(s, at + timedelta(hours=h), [(f"e{k}", f"title {k} {h // 4}", rng.choice([None, f"text {k} {h}"])) for k in rng.sample(range(6), rng.randint(0, 5))]) for s in ("one", "two") for h in range(6)]
    own = [[x for x in snaps if x[1] <= at + timedelta(hours=2)], [x for x in snaps if x[1] > at + timedelta(hours=2)]]
    files = [own[0], own[1] + own[0][:3], own[1][:2] + own[0][1:2]]  # repeated ones, and late ones after newer ones
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = S.snapshot_changes(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert not query.isActive and query.exception() is None
    changes = spark.read.parquet(f"{tmp_path}/out")
    last = changes.groupBy("source", "event_id").agg(F.max_by(F.struct("change", "title", "agenda_text"), "version").alias("c")).where("c.change <> 'removed'")
    got = {(r.source, r.event_id, r.c.title, r.c.agenda_text) for r in last.collect()}
    want = {tuple(r) for r in S.snapshot_of(spark.createDataFrame(snaps, schema)).collect()}
    newest = {(s, e, t) for s, v, events in snaps for e, t, _ in events if v == at + timedelta(hours=5)}
    assert got == want and {x[:3] for x in want} == newest and changes.where("change = 'removed'").count() > 0


# project pages


def test_project_list_takes_articles_of_its_containers_only(spark):
    article = lambda slug: f'<article><a href="/Property-Business/Development/Projects/{slug}"><h2 class="list-item-title"><span><img src="/i/coral-city-project-icon.png"></span> {slug} </h2><p>About it.</p></a></article>'
    page = f'<div>{article("Before")}</div><div class="list-item-container item-no-date"><div>{article("One")}</div></div><p>x</p><div class="list-item-container"><br>{article("Two")}</div>{article("After")}'
    got = P.project_list(spark.createDataFrame([(1, page), (2, None), (3, "<div>")], "page_id int, html string"), "https://t.org").collect()
    assert [(r.slug, r.project_type, r.detail_url) for r in got] == [("One", "City Project", "https://t.org/Property-Business/Development/Projects/One"), ("Two", "City Project", "https://t.org/Property-Business/Development/Projects/Two")]


def test_project_detail_reads_its_main_part_and_falls_back_on_the_list(spark):
    page = "<nav><li>Project type Menu</li><li>Project schedule Menu</li><img src='/menu.png'></nav><div class='wide content-main'><div><li>Project type Private Development</li></div><img src='/a.png'></div><li>Project division Footer</li><h2>Requests</h2><p>A rezoning.</p>"
    listed = spark.createDataFrame([(1, "List summary.", "City Project"), (2, "Only this.", "City Project")], "page_id int, description string, project_type string")
    got = {r.page_id: r for r in P.project_detail(spark.createDataFrame([(1, page), (2, "<p>bare</p>")], "page_id int, html string"), "https://t.org", listed=listed).collect()}
    assert (got[1].project_type, got[1].official_status, got[1].division, got[1].description, got[1].image_url) == ("Private Development", None, None, "List summary.", "https://t.org/a.png")
    assert (got[2].project_type, got[2].description, got[2].requests) == ("City Project", "Only this.", None)


def test_page_forms_of_a_paged_listing(spark):
    page = """<form action="/x"><input type="hidden" name="state" value="abc"><input name="q" value=""><input type="submit" name="search" value="Search"><select name="sort"><option value="a">A</option><option value="b" selected>B</option></select>
      <textarea name="note"></textarea><input value="unnamed"><div class="seamless-pagination"><div><select name="pager$page"><option value="1">1</option><option value="2">2</option><option value="3">3</option></select></div><input type="submit" name="pager$go" value="Go"></div></form>"""
    got = {r.page: r.fields for r in P.page_forms(spark.createDataFrame([(1, page), (2, "<form></form>"), (3, "no form"), (4, None)], "page_id int, html string")).collect()}
    fields = {"state": "abc", "q": "", "sort": "b", "note": "", "pager$go": "Go"}
    assert got == {2: fields | {"pager$page": "2"}, 3: fields | {"pager$page": "3"}}


def test_chains_in_a_circle_are_an_error_and_long_ones_end(spark):
    from rostrum.operators.identity import chase

    chain = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(200, 200), (300, 200)], "source int, target int")
    assert {r.source: r.target for r in chase(chain).collect()} == {k: 70 for k in range(70)} | {200: 200, 300: 200}
    with pytest.raises(ValueError, match="circle"):
        chase(spark.createDataFrame([(1, 2), (2, 1), (5, 6)], "source int, target int"))
    with pytest.raises(ValueError, match="circle"):
        chase(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "source int, target int"))


def test_a_budget_of_one_lets_one_through(spark):
    at = datetime(2026, 1, 1)
    calls = spark.createDataFrame([("a", 1, at), ("b", 1, at), ("c", None, at), ("c", None, at), ("d", 7, None)], "user_id string, event_id long, ts timestamp_ntz")
    assert sum(r.allowed for r in S.daily_budget(calls, 5, 60, per_day=1).collect()) == 1
    assert sum(r.allowed for r in S.daily_budget(calls, 1, 60, per_day=9).collect()) == 3
    assert S.daily_budget(calls, 5, 60, per_day=9).count() == 5
