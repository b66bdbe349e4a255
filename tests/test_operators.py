"""Known answers, invariants and edges of the operators."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators import graph as G
from rostrum.operators import identity as I
from rostrum.operators import mentions as M
from rostrum.operators import models as Z
from rostrum.operators import relational as R
from rostrum.operators import report as Q
from rostrum.operators import spatial as S
from rostrum.operators import upsert as K
from rostrum.sources import parse as P
from rostrum.streaming import streams as T


def one(spark, column, **values):
    row = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "slug"), [("Catherine S. Read", "catherine-read"), ("D. Thomas Ross", "thomas-ross"), ("Jon R. Stehle, Jr.", "jon-stehle-jr"), ("Ordinance 2026-04", "ordinance-2026-04"), ("The George Snyder Trail", "george-snyder-trail"), ("the", ""), ("José Ñandú", "jose-nandu")])
def test_slugify(spark, name, slug):
    assert one(spark, X.slugify(F.lit(name))) == slug


@pytest.mark.parametrize(("slug", "want"), [("george-snyder-trail-project", "george-snyder-trail"), ("urban-forest-master-plan-ufmp", "urban-forest-master-plan"), ("blenheim-blvd-multimodal", "blenheim-boulevard-multimodal"), ("jermantown-road-improvement-project", "jermantown-road-improvements"), ("proposed-fy26-budget", "fy26-budget"), ("proposed-budget", "proposed-budget"), ("trail-project", "trail-project"), ("oak-masterplan", "oak-master-plan")])
def test_normalize_slug(spark, slug, want):
    assert one(spark, X.normalize_slug(F.lit(slug))) == want


def test_bases(spark):
    slugs = spark.createDataFrame([("courthouse-plaza-redevelopment-fy26",), ("one-two",), ("board-of-review",)], "slug string")
    got = {(r.slug, r.depth): r.base for r in I.bases(slugs).collect()}
    assert got == {("courthouse-plaza-redevelopment-fy26", 1): "courthouse-plaza-redevelopment", ("courthouse-plaza-redevelopment-fy26", 2): "courthouse-plaza", ("board-of-review", 1): "board-of"}


def test_resolve(spark):
    entities = spark.createDataFrame([(1, "courthouse-plaza", "project"), (2, "jon-stehle", "person")], "entity_id long, slug string, entity_type string")
    aliases = spark.createDataFrame([(2, "Councilmember Stehle")], "entity_id long, alias string")
    names = spark.createDataFrame([("Courthouse Plaza Project", "project"), ("Courthouse Plaza Redevelopment", "project"), ("councilmember stehle", "person"), ("New Thing Here", "topic"), ("...", "topic"), ("Jon R. Stehle", "person")], "name string, entity_type string")
    got = {r.name: (r.entity_id, r.how) for r in I.resolve(names, entities, aliases).collect()}
    assert got == {"Courthouse Plaza Project": (1, "slug"), "Courthouse Plaza Redevelopment": (1, "base"), "councilmember stehle": (2, "alias"), "New Thing Here": (None, "create"), "Jon R. Stehle": (2, "slug")}


def test_hot_topics(spark):
    day = lambda n: date(2026, 7, n)
    meetings = spark.createDataFrame([(1, day(1), "city_council"), (2, day(2), "city_council"), (3, date(2026, 1, 1), "city_council")], "meeting_id long, meeting_date date, body string")
    chunks = spark.createDataFrame([(1, 1, "the Snyder Trail is here", 0.0, 100.0), (2, 2, "SNYDER TRAIL again", 0.0, 50.0), (3, 2, "courthouse plaza and Read", 0.0, 60.0), (4, 3, "snyder trail", 0.0, 900.0), (5, 2, "nothing", None, None)], "chunk_id long, meeting_id long, text string, start_seconds double, end_seconds double")
    names = spark.createDataFrame([(1, "topic", "Snyder Trail", "the trail"), (2, "topic", "Courthouse Plaza", None), (3, "person", "Catherine Read", "Read")], "entity_id long, entity_type string, name string, alias string")
    got = [(r.entity_id, r.seconds, r.chunk_mentions, r.meetings) for r in M.hot_topics(meetings, chunks, names, n=2).collect()]
    assert got == [(1, 150.0, 2, {1: 100.0, 2: 50.0}), (2, 60.0, 1, {2: 60.0})]
    series = [(r.meeting_id, r.seconds) for r in M.discussion_series(meetings, chunks, names.where("entity_id = 1")).orderBy("meeting_date").collect()]
    assert series == [(3, 900.0), (1, 100.0), (2, 50.0)]


def test_many_names_meet_on_pieces(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["The Oak Street plaza", "oak streets", "nothing", None, "oak", "élan vital, élan"])], "chunk_id long, text string")
    named = M.variants(spark.createDataFrame([(1, "Oak Street", "plaza"), (2, "street", None), (3, "élan v", "xx")], "entity_id long, name string, alias string"))
    few, many = (sorted((r.chunk_id, r.entity_id, r.variant) for r in M.matches(texts, named, most=n).collect()) for n in (100, 0))
    assert few == many == [(0, 1, "oak street"), (0, 2, "street"), (1, 1, "oak street"), (1, 2, "street"), (5, 3, "élan v")]


def test_merge_segments(spark):
    rows = spark.createDataFrame([(1, i, 10.0 * i, 10.0 * i + 10, "x" * 400) for i in range(3)], "m long, o int, s double, e double, t string")
    got = [(r.part, r.start, r.end, len(r.text)) for r in R.merge_segments(rows, "m", "o", "s", "e", "t").orderBy("part").collect()]
    assert got == [(0, 0.0, 20.0, 801), (1, 20.0, 30.0, 400)]


@pytest.mark.parametrize(("raw", "kind"), [("Supermarket", "grocery"), ("Coffee Shop", "restaurant_bar"), ("gas_station", "retail_convenience"), ("clothing", "retail_comparison"), ("Barber", "personal_services"), ("Movie Theater", "entertainment"), ("law office", "office"), ("Public Library", "civic"), ("", "other"), (None, "other"), ("zzz", "other")])
def test_taxonomy(spark, raw, kind):
    assert one(spark, X.taxonomy(F.lit(raw).cast("string"))) == kind


@pytest.mark.parametrize(("name", "want"), [("10501 Main St", "development"), ("2026 Budget", "civic"), ("Oak Townhomes", "development"), ("Noise Ordinance", "civic")])
def test_category(spark, name, want):
    assert one(spark, X.category(F.lit(name))) == want


@pytest.mark.parametrize(("about", "status", "evaluation", "want"), [("261 apartments", "Approved", "synthesized", None), ("261 apartments", "Approved", "computed", "analysis in preparation"), ("a hotel", "Approved", None, "no residential program to model"), ("townhomes", "Pre-application", None, "awaiting submitted plans"), ("a trail", "x", None, "not yet evaluated"), ("apartments", None, None, "not yet evaluated")])
def test_no_analysis_reason(spark, about, status, evaluation, want):
    c = lambda v: F.lit(v).cast("string")
    assert one(spark, X.no_analysis_reason(c(about), c(None), c(status), c(evaluation))) == want


def test_intervals(spark):
    a, b = Z.interval(10, 8, 12), Z.interval(2, 1, 3)
    got = lambda c: tuple(round(v, 9) for v in one(spark, c))
    assert got(Z.add(a, b)) == (12, 9, 15) and got(Z.sub(a, b)) == (8, 5, 11) and got(Z.mul(a, b)) == (20, 8, 36) and got(Z.div(a, b)) == (5, round(8 / 3, 9), 12)
    assert got(Z.power(b, 2.0)) == (4, 1, 9)
    with pytest.raises(Exception, match="range with zero"):
        one(spark, Z.div(a, Z.interval(0, -1, 1)))
    with pytest.raises(Exception, match="isn't positive"):
        one(spark, Z.power(Z.interval(1, 0, 2), 0.5))
    with pytest.raises(ValueError):
        Z.power(a, -1)


def test_huff_closed_form_and_conservation(spark):
    rows = [(1, 1, 4.0, 5.0), (1, 2, 9.0, 10.0), (1, 3, 1.0, 20.0), (2, 1, 0.0, 1.0), (3, 1, 5.0, math.inf), (3, 2, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "origin long, dest long, attractiveness double, walk_min double").withColumn("drive_min", F.col("walk_min")).withColumn("bike_min", F.col("walk_min"))
    p = {(r.origin, r.dest): r.p for r in Z.huff(df, ["origin"], "walk_min").collect()}
    u = [4 * math.exp(-0.5), 9 * math.exp(-1), math.exp(-2)]
    assert [p[1, i] for i in (1, 2, 3)] == pytest.approx([x / sum(u) for x in u]) and p[2, 1] == 0 and p[3, 1] == 0 and p[3, 2] == 1
    modes = {"walk": (0.6, 0.1, "walk_min"), "drive": (0.4, 0.15, "drive_min")}
    assert [r.s for r in Z.joint_modes(df.where("origin = 1"), ["origin"], modes).groupBy("origin").agg(F.sum("p").alias("s")).collect()] == pytest.approx([1.0])
    spend = {c: (100.0, 80.0, 120.0) for c in Z.SPENDING}
    kept = Z.capture(df.where("origin = 1").withColumn("in_city", F.lit(True)), spend).groupBy("category", "slot").agg(F.sum("dollars").alias("d")).collect()
    assert all(r.d == pytest.approx({"value": 100, "low": 80, "high": 120}[r.slot]) for r in kept) and len(kept) == 18


def test_edge_flows_on_a_toy_graph(spark):
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 2, 5.0), (1, 3, 5.0), (1, 4, 20.0)], "u long, v long, minutes double")
    weights = spark.createDataFrame([(0, 9.0), (2, 3.0), (3, 1.0), (7, 5.0)], "node long, weight double")
    got = {(r.u, r.v): round(r.flow, 6) for r in G.edge_flows(edges, 0, weights, 100.0, 0.1).collect()}
    assert got == {(0, 1): 100, (1, 2): 75, (1, 3): 25}


def test_population_near(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 9999.0, 0.0)], "node_id long, x double, y double")
    points = spark.createDataFrame([(1, 0.0, 50.0, 50.0), (2, 100.0, 30.0, 30.0), (3, 100.0, -50.0, 20.0)], "point_id long, x double, y double, pop double")
    assert {r.node_id: r.pop for r in S.population_near(nodes, points, 50.0).collect()} == {1: 50, 2: 50, 3: 0}


def test_chapters_and_carry(spark):
    items = spark.createDataFrame([(1, 1, 10, 100), (1, 2, 40, 100), (1, 3, 100, 100), (2, 4, 0, 50), (3, 5, None, 50)], "m long, i long, s long, d long")
    got = {r.i: (r.seconds, r.lead_in) for r in R.chapters(items, "m", "s", "d", "i").collect()}
    assert got == {1: (30, 10), 2: (60, 10)}


def test_archive(spark):
    page = """<h3>City Council</h3><table class="listingTable"><tr><td headers="Name">Regular &amp; Special</td><td headers="Date">Jul 14,&nbsp;2026</td><td headers="Duration">03h 15m</td><td><a href="//x/MediaPlayer.php?view_id=1&clip_id=77">v</a></td></tr>
    <tr><td headers="Name">Canceled</td><td headers="Date">Jul 1, 2026</td></tr></table><h3>School Board</h3><table class="listingTable"><tr><td headers="Name">x</td><td headers="Date">Jul 1, 2026</td><td>MediaPlayer.php?clip_id=9</td></tr></table>"""
    got = P.parse_archive(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "13").collect()
    assert [(r.clip_id, r.body, r.meeting_type, r.meeting_date, r.title, r.duration_seconds) for r in got] == [("77", "city_council", "council_special", date(2026, 7, 14), "Regular & Special", 11700)]


def test_upcoming_points_links_roster(spark):
    page = """<table id="upcoming"><tr><td headers="EventName">City Council  Meeting</td><td headers="EventDate">July 14, 2026 - 07:00 PM</td><td><a href="/AgendaViewer.php?event_id=5">a</a></td></tr><tr><td headers="EventName">Other</td><td headers="EventDate">In Progress</td><td><a onclick="event_id=6">x</a></td></tr></table>
    <div class="index-point" time="9">1. Call</div><div class="index-point" time="20">a. Sub</div><div class="index-point" time="30">7b) Vote</div><a href="/MetaViewer.php?meta_id=3">One</a><a href="/MetaViewer.php?meta_id=3">Two</a>"""
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    up = {r.event_id: (r.title, r.body, r.starts_at, r.in_progress, r.agenda_url) for r in P.parse_upcoming(df, "1").collect()}
    assert up["5"] == ("City Council Meeting", "city_council", datetime(2026, 7, 14, 19), False, "https://video.example.org/AgendaViewer.php?event_id=5") and up["6"][2:4] == (None, True)
    assert [(r.label, r.seconds) for r in P.parse_index_points(df).orderBy("n").collect()] == [("1", 9), ("1a", 20), ("7b", 30)]
    assert [(r.meta_id, r.label) for r in P.item_links(df).collect()] == [("3", "One")]
    text = "Chair: Ann Lee / Vice-Chair: Bo Day / Commissioners: Cy Fox, Di Roe 1. Pledge of"
    r = P.roster(spark.createDataFrame([(1, text), (2, "none")], "meeting_id long, text string")).orderBy("meeting_id").collect()
    assert (r[0].chair, r[0].vice_chair, r[0].commissioners) == ("Ann Lee", "Bo Day", ["Cy Fox", "Di Roe"]) and r[1].chair is None and r[1].commissioners == []


def test_grid_and_front_matter(spark):
    g = P.json_grid(spark.createDataFrame([(1, '[["a","b"],["1","-666666666"],["x","2.5"]]')], "k long, j string"), "j", ["a", "b"]).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in g] == [(1.0, None), (None, 2.5)]
    f = P.front_matter(spark.createDataFrame([("p", "---\ntitle: A B\ntype: x\n---\nBody\n")], "path string, text string")).first()
    assert f.meta == {"title": "A B", "type": "x"} and f.body == "Body\n"


def test_numbers_in_drafts(spark):
    allowed = spark.createDataFrame([(261.0,), (248.0,), (234.9,), (253.2,), (95.0,), (1469000.0,), (-12.0,)], "value double")
    drafts = spark.createDataFrame([(1, "261 units, 248 homes, 234.9-253.2, 95% and $1.5 million; −12 net"), (2, "costs $4,250,000"), (3, "early-1970s ```99999``` none")], "id long, text string")
    got = Q.untraceable(Q.numbers(drafts), allowed).collect()
    assert {(r.id, r.value) for r in got} == {(2, 4250000.0), (3, 1970.0)}


def test_apply_extraction_is_first_wins(spark):
    x = '{"agenda_items":[{"label":"1","title":"a","votes":[{"description":"v","motion_result":"passed","vote_breakdown":{"Read":"yes"}}],"entities":[{"entity_type":"topic","name":"T","update_text":"one","status_after":"proposed"}]},{"label":"1","title":"copy","entities":[{"name":"T","update_text":"no"}]},{"label":"","title":"b","entities":[{"name":"T","update_text":"two"},{"name":"U"}]}]}'
    got = K.apply_extractions(spark.createDataFrame([(1, x), (2, "{}")], "meeting_id long, json string"))
    assert [(r.label, r.title) for r in got["items"].orderBy("pos").collect()] == [("1", "a"), ("?", "b")]
    assert [(r.name, r.update_text, r.status_after, r.first_label) for r in got["updates"].collect()] == [("T", "[1] one [?] two", "proposed", "1")]
    assert got["votes"].first().vote_breakdown == {"Read": "yes"} and got["mentions"].count() == 3


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, s string")
    new = spark.createDataFrame([(2, "B", "z"), (3, "c", "z")], "id long, v string, s string")
    assert sorted(map(tuple, K.upsert(old, new, ["id"], keep=["s"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]
    assert sorted(map(tuple, K.partial_merge(old, new, ["id"], True).collect())) == [(2, "B", "z"), (3, "c", "z")]
    path = str(tmp_path / "t")
    K.write_groups(old, path, "id")
    K.write_groups(new, path, "id")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["B", "a", "c"]


def test_gate(spark):
    df = spark.range(3)
    assert R.require(df, F.col("id") < 5, "no").count() == 3
    with pytest.raises(Exception, match="too large"):
        R.require(df, F.col("id") < 2, "too large").collect()
    with pytest.raises(ValueError):
        R.checked_query("x")


def test_rate_limit(spark):
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    calls = spark.createDataFrame([(i, 1, at(s)) for i, s in enumerate([0, 1, 2, 3, 11, 12, 13])], "event_id long, user_id long, ts timestamp_ntz")
    got = [r.allowed for r in T.rate_limit(calls, 2, 10).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True, False]


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def drained(df, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / f"cp{mode}{len(df.columns)}")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(str, spark.table("out").collect()))

    late = "100 days"
    assert drained(T.tumbling(stream(), late=late).select("start", "event_type", "n"), "complete") == sorted(map(str, T.tumbling(events).select("start", "event_type", "n").collect()))
    sink = str(tmp_path / "sink")
    for _ in range(2):
        T.ingest_available(spark, src, events.schema.simpleString()[7:-1].replace(":", " "), sink, str(tmp_path / f"c{_}"), "event_id")
    assert spark.read.parquet(sink).count() == events.count()
    limited = drained(T.rate_limit_stream(spark.readStream.schema(events.schema).parquet(src), 3, 7 * 86400), "append")
    assert len(limited) == events.count() and limited == sorted(map(str, T.rate_limit(events, 3, 7 * 86400).select("user_id", "event_id", "allowed").collect()))


def test_digest_round(spark):
    subs = spark.createDataFrame([("a@x.y", 1, True, 10), ("b@x.y", 1, False, 0), ("c@x.y", 2, True, 99)], "email string, entity_id long, confirmed boolean, last_update_id long")
    ups = spark.createDataFrame([(1, 9), (1, 11), (1, 12), (2, 50)], "entity_id long, update_id long")
    sent = T.digests(subs, ups)
    assert [(r.email, r.update_ids) for r in sent.collect()] == [("a@x.y", [11, 12])]
    assert {r.email: r.last_update_id for r in T.advanced(subs, ups, sent).collect()} == {"a@x.y": 12, "b@x.y": 0, "c@x.y": 99}


def test_rest_works_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_nearest_reaches_far_places(spark):
    from rostrum.operators import spatial

    here = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e6, 9e6), (3, None, 0.0)], "a long, x double, y double")
    there = spark.createDataFrame([(7, 1.0, 0.0), (8, -1.0, 0.0)], "b long, x double, y double")
    got = {r.a: (r.b, round(r.d)) for r in spatial.nearest(here, there, "a", "b", 2.0).collect()}
    assert got == {1: (7, 1), 2: (7, 12727921)}
    assert spatial.nearest(here, there.limit(0), "a", "b", 2.0).count() == 0


def test_names_with_marks_and_street_suffixes(spark):
    from pyspark.sql import functions as F

    from rostrum.functions import text as X

    rows = spark.createDataFrame([("Čeněk Őry",), ("É. Zoë Ñandú",), ("J. Łuk Ng",)], "n string").select(X.slugify(F.col("n")), X.display_name(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("cenek-ory", "Čeněk Őry"), ("e-zoe-nandu", "É Zoë Ñandú"), ("uk-ng", "Łuk Ng")]
    joined = spark.createDataFrame([("Ĳssel Ave",), ("ﬁve ½ St",), ("A…B Ⅻ",), (None,)], "n string").select(X.slugify(F.col("n"))).collect()
    assert [r[0] for r in joined] == ["ijssel-ave", "five-12-st", "xii", ""]
    streets = spark.createDataFrame([("Oak Av.",), ("Elm Cir",), ("Ivy Ter",), ("Main Sq",), ("Pine St",)], "n string").select(X.street_key(F.col("n"))).collect()
    assert [r[0] for r in streets] == ["oak avenue", "elm circle", "ivy terrace", "main square", "pine street"]


def test_pairs_are_drawn_by_weight(spark):
    from rostrum.operators import graph

    weights = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0), (4, 6.0)], "node long, weight double")
    rows = graph.sampled_pairs(weights, 2000).collect()
    share = lambda k, c: sum(r[c] == k for r in rows) / len(rows)
    assert len(rows) == 2000 and all(abs(share(k, c) - w) < 0.05 for k, w in ((1, 0.1), (2, 0.3), (3, 0), (4, 0.6)) for c in ("from", "to"))
    assert graph.sampled_pairs(weights.where("weight = 0"), 10).count() == 0


def test_names_with_one_beginning_meet_on_their_rarest_piece(spark):
    texts = spark.range(300).selectExpr("id as chunk_id", "concat('https://x.org/slug-of-', id, '-end') as text")
    named = spark.range(300).selectExpr("id as entity_id", "array(concat('slug-of-', id, '-end')) as variants")
    out = M.matches(texts, named, most=0)
    assert {(r.chunk_id, r.entity_id) for r in out.collect()} == {(k, k) for k in range(300)}
    met = named.select(F.size("variants").alias("n")).count()
    pieces = M.rarest_pieces(texts.withColumn("_low", F.lower("text")), named, "chunk_id", "entity_id")
    assert pieces.count() < 20 * met  # 300 * 300 by the beginning that they share
