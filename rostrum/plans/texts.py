"""Queries over names and texts: identity, classification, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators import identity as I
from rostrum.operators import mentions as M
from rostrum.operators import relational as R
from rostrum.plans.registry import joined, registry
from rostrum.sources import parse as P
from rostrum.sources.tables import load

QUERIES, ORACLES, query = registry()
#: Names with the shapes that the slug rules are about, made from part names and keys.
NAMES = """names0 AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'The ' || p_name || ' Project' WHEN 1 THEN p_name || ' R. ' || p_brand || ', Jr.' WHEN 2 THEN 'A Draft ' || p_name || ' Blvd' WHEN 3 THEN p_name || ' Improvement Project'
    WHEN 4 THEN 'Proposed ' || p_name || ' ' || p_type || ' Masterplan' WHEN 5 THEN p_name || ' fy' || CAST(20 + p_partkey % 9 AS VARCHAR) WHEN 6 THEN CAST(100 + p_partkey AS VARCHAR) || ' ' || p_name || ' Ave' ELSE p_name END AS name, p_type FROM part)"""


def names(s, d):
    p = load(s, d, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    lit = F.lit
    name = F.when(k % 8 == 0, F.concat(lit("The "), n, lit(" Project"))).when(k % 8 == 1, F.concat(n, lit(" R. "), F.col("p_brand"), lit(", Jr."))).when(k % 8 == 2, F.concat(lit("A Draft "), n, lit(" Blvd"))).when(k % 8 == 3, F.concat(n, lit(" Improvement Project")))
    name = name.when(k % 8 == 4, F.concat(lit("Proposed "), n, lit(" "), F.col("p_type"), lit(" Masterplan"))).when(k % 8 == 5, F.concat(n, lit(" fy"), (20 + k % 9).cast("string"))).when(k % 8 == 6, F.concat((100 + k).cast("string"), lit(" "), n, lit(" Ave"))).otherwise(n)
    return p.select(k.alias("id"), name.alias("name"), "p_type")


DISPLAY = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(name, '[,.]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND (length(t) > 1 OR lower(t) IN ('jr', 'sr', 'ii', 'iii', 'iv'))), ' ')"
SLUG = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({DISPLAY}), '^((the|a|an) )+', ''), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-')"


@query(oracle=f"WITH {NAMES} SELECT id, {DISPLAY} AS shown, {SLUG} AS slug FROM names0")
def f01_slugify(s, d):  # F01, F02
    return names(s, d).select("id", X.display_name(F.col("name")).alias("shown"), X.slugify(F.col("name")).alias("slug"))


CANON = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('-' || slug || '-', '-blvd-', '-boulevard-'), '-ave-', '-avenue-'), '-rd-', '-road-'), '-thru-', '-through-'), '-masterplan-', '-master-plan-')"


def normal_sql(source: str) -> str:
    """normal(id, slug): the normalised slug, one suffix at a time."""
    initials = "array_to_string(list_transform(list_filter(t[:-2], lambda x: x NOT IN ('and', 'of', 'the', 'for', 'a', 'an')), lambda x: x[1]), '')"
    acronym = f"(len(t) >= 3 AND length(t[-1]) >= 2 AND t[-1] = {initials})"
    project = "(len(t) >= 3 AND t[-1] IN ('project', 'projects'))"
    lead = "(len(t) > 2 AND t[1] IN ('draft', 'proposed'))"
    return f"""lead0 AS (SELECT id, string_split(trim({CANON}, '-'), '-') AS t FROM {source} UNION ALL SELECT id, t[2:] FROM lead0 WHERE {lead}),
    tail0 AS (SELECT id, t FROM lead0 WHERE NOT {lead} UNION ALL SELECT id, t[:-2] FROM tail0 WHERE {acronym} OR {project}),
    normal AS (SELECT id, array_to_string(CASE WHEN len(t) >= 3 AND t[-1] = 'improvement' THEN list_append(t[:-2], 'improvements') ELSE t END, '-') AS slug FROM tail0 WHERE NOT ({acronym} OR {project}))"""


@query(oracle=f"WITH RECURSIVE {NAMES}, slugs AS (SELECT id, {SLUG} AS slug FROM names0), {normal_sql('slugs')} SELECT id, slug FROM normal")
def f03_normalize_slug(s, d):  # F03-F05, T18
    return names(s, d).select("id", X.normalize_slug(X.slugify(F.col("name"))).alias("slug"))


GENERIC = ", ".join(f"'{w}'" for w in X.GENERIC_TOKENS)


@query(oracle=f"WITH {NAMES} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: x NOT IN ({GENERIC})))), ',') AS tokens FROM names0")
def f06_tokens(s, d):  # F06
    return names(s, d).select("id", joined(F.array_sort(X.distinctive_tokens(F.col("name")))).alias("tokens"))


@query(oracle=f"WITH {NAMES} SELECT id, CASE WHEN (regexp_matches(name, '^\\d{{3,5}}\\s') AND NOT regexp_matches(name, '^(19|20)\\d{{2}}\\s')) OR regexp_matches(name, '{X.DEVELOPMENT_WORDS}') THEN 'development' ELSE 'civic' END AS category FROM names0")
def f07_category(s, d):  # F07, T4, P20
    return names(s, d).select("id", X.category(F.col("name")).alias("category"))


RAW = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' cafe' WHEN 1 THEN NULL WHEN 2 THEN 'Gas-Station ' || p_type WHEN 3 THEN p_type || ' gym' WHEN 4 THEN 'City Hall' ELSE p_name END"


@query(oracle=f"SELECT p_partkey AS id, CASE WHEN raw IS NULL OR raw = '' THEN 'other' " + " ".join(f"WHEN regexp_matches(lower(raw), '{p}') THEN '{n}'" for n, p in X.TAXONOMY) + f" ELSE 'other' END AS kind FROM (SELECT p_partkey, {RAW} AS raw FROM part)")
def f12_taxonomy(s, d):  # F12
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(RAW).alias("raw")).select("id", X.taxonomy(F.col("raw")).alias("kind"))


@query(oracle=f"WITH {NAMES} SELECT id, trim(regexp_replace(replace(replace(lower(name || '''s'), '''', ''), '’', ''), '[^a-z0-9]+', ' ', 'g')) AS key FROM names0")
def f13_name_key(s, d):  # F13
    return names(s, d).select("id", X.name_key(F.concat("name", F.lit("'s"))).alias("key"))


STREET = """CASE x WHEN 'st' THEN 'street' WHEN 'rd' THEN 'road' WHEN 'ave' THEN 'avenue' WHEN 'av' THEN 'avenue' WHEN 'blvd' THEN 'boulevard' WHEN 'dr' THEN 'drive' WHEN 'ln' THEN 'lane'
    WHEN 'pkwy' THEN 'parkway' WHEN 'hwy' THEN 'highway' WHEN 'ct' THEN 'court' WHEN 'pl' THEN 'place' WHEN 'cir' THEN 'circle' WHEN 'ter' THEN 'terrace' WHEN 'sq' THEN 'square' ELSE x END"""


@query(oracle=f"WITH {NAMES} SELECT id, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: {STREET}), ' ') AS street FROM names0")
def f14_street_norm(s, d):  # F14
    return names(s, d).select("id", X.street_key(F.col("name")).alias("street"))


@query(oracle="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 3600 * (o_orderkey % 9) + 60 * (o_orderkey % 60) END AS seconds, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 19 HOUR END AS starts_at FROM orders""")
def f17_durations(s, d):  # F17, D02
    o = load(s, d, "orders")
    k = F.col("o_orderkey")
    long = F.when(k % 4 == 0, F.lit("about two hours")).otherwise(F.format_string("%02dh %02dm", k % 9, k % 60))
    day = F.when(k % 2 == 0, F.date_format("o_orderdate", "MMM d,  yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    at = F.when(k % 3 == 0, "In Progress").otherwise(F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" - 07:00 PM")))
    return o.select(k.alias("id"), X.duration_seconds(long).alias("seconds"), X.archive_date(day).alias("day"), X.meeting_start(at).alias("starts_at"))


@query(oracle="SELECT doc_id, CASE WHEN length(regexp_replace(t, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')) >= 0.85 * length(t) THEN regexp_replace(t, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g') END AS clean FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN repeat(chr(7), 100 + length(text)) || text ELSE chr(1) || text END AS t FROM documents)")
def f19_sanitize(s, d):  # F19
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("\x07"), 100 + F.length("text")), F.col("text"))).otherwise(F.concat(F.lit("\x01"), F.col("text")))
    return load(s, d, "documents").select("doc_id", X.sanitize(t).alias("clean"))


KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(oracle=f"""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({KEY.format('d.text')}, {KEY.format("array_to_string(string_split(b.text, ' ')[1:4], ' ')")})""")
def f22_quote_check(s, d):  # F22, F23
    quotes = load(s, d, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("quote")).where(X.verbatim(F.col("quote"), F.col("quote")))
    named = quotes.select("item_id", F.array(X.quote_key(F.col("quote"))).alias("variants")).where(F.length(F.col("variants")[0]) >= 5)
    docs = load(s, d, "documents").select("doc_id", X.quote_key(F.col("text")).alias("text"))
    return M.matches(docs, named, key="doc_id", entity="item_id").select("item_id", "doc_id")


@query(oracle="SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
def f26_hash(s, d):  # F26
    return load(s, d, "documents").select("doc_id", X.short_hash(F.col("text")).alias("hash"))


@query(oracle="SELECT p_partkey AS id, replace(replace(replace(replace(t, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(10), '\\n') AS escaped FROM (SELECT p_partkey, p_name || '; a, b\\c' || chr(10) || p_type AS t FROM part)")
def f29_ics_escape(s, d):  # F29
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), X.ics_escape(F.concat("p_name", F.lit("; a, b\\c\n"), F.col("p_type"))).alias("escaped"))


@query(oracle="SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_partkey % 7, p_size % 7])), ',') AS cited FROM part")
def f30_citations(s, d):  # F30
    t = F.concat(F.lit("As in ["), (F.col("p_partkey") % 7).cast("string"), F.lit("] and ["), (F.col("p_size") % 7).cast("string"), F.lit("], not [x]."))
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), joined(X.citations(t)).alias("cited"))


@query(oracle="SELECT c_custkey AS id, CASE WHEN x < 0 THEN '−$' ELSE '$' END || CASE WHEN abs(x) >= 1000000 THEN printf('%.1f', abs(x) / 1000000) || 'M' WHEN abs(x) >= 1000 THEN printf('%.0f', abs(x) / 1000) || 'k' ELSE printf('%.0f', abs(x)) END AS shown FROM (SELECT c_custkey, (floor(c_acctbal) + 0.25) * (CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE 1 END) AS x FROM customer)")
def f32_money(s, d):  # F32
    x = (F.floor("c_acctbal") + 0.25) * F.when(F.col("c_custkey") % 3 == 0, 1000).otherwise(1)
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), X.money(x.cast("double")).alias("shown"))


OFFICIAL = "SELECT p_partkey AS id, p_name || ' ' || p_brand || ' Project' AS name FROM part WHERE p_partkey % 10 = 0"
MEETING = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE p_name || ' ' || p_brand END AS name FROM part WHERE p_partkey % 10 <> 0"
TOK = f"list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: x NOT IN ({GENERIC})))"


@query(oracle=f"""WITH o AS (SELECT {TOK} AS t FROM ({OFFICIAL})), m AS (SELECT id, name, {TOK} AS t FROM ({MEETING}))
    SELECT id, name, len(t) = 0 OR EXISTS (SELECT 1 FROM o WHERE len(o.t) > 0 AND (list_has_all(o.t, m.t) OR list_has_all(m.t, o.t))) AS duplicate FROM m""")
def j15_token_dup(s, d):  # J15, U06
    p = load(s, d, "part")
    k, both = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_brand")
    official = p.where(k % 10 == 0).select(k.alias("id"), F.concat(both, F.lit(" Project")).alias("name"))
    return I.token_duplicates(p.where(k % 10 != 0).select(k.alias("id"), F.when(k % 3 == 0, F.col("p_name")).otherwise(both).alias("name")), official)


@query(oracle=f"""WITH RECURSIVE m AS (SELECT p_type AS kind, p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS name, p_partkey AS id FROM part), r AS (SELECT kind, name, {TOK} AS t, row_number() OVER (PARTITION BY kind ORDER BY id) AS n FROM m),
    f AS (SELECT kind, n, name, [t] AS kept, TRUE AS ok FROM r WHERE n = 1 UNION ALL SELECT r.kind, r.n, r.name, CASE WHEN len(list_filter(f.kept, lambda k: list_has_all(k, r.t) OR list_has_all(r.t, k))) > 0 THEN f.kept ELSE list_append(f.kept, r.t) END, len(list_filter(f.kept, lambda k: list_has_all(k, r.t) OR list_has_all(r.t, k))) = 0
      FROM f JOIN r ON r.kind = f.kind AND r.n = f.n + 1) SELECT kind, name FROM f WHERE ok""")
def j16_greedy_suppress(s, d):  # J16
    p = load(s, d, "part")
    own = p.select(F.col("p_type").alias("kind"), F.concat("p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")).alias("name"), F.col("p_partkey").alias("id"))
    return I.greedy_suppress(own, "kind", ["id"])


@query(oracle="""WITH k AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'slug-' || CAST(o_custkey % 300 AS VARCHAR) ELSE 'ALIAS ' || CAST(o_custkey % 400 AS VARCHAR) END AS key FROM orders),
    e AS (SELECT p_partkey AS entity_id, 'slug-' || CAST(p_partkey AS VARCHAR) AS slug FROM part), a AS (SELECT p_partkey % 200 AS entity_id, 'Alias ' || CAST(p_partkey AS VARCHAR) AS alias FROM part)
    SELECT key, coalesce((SELECT entity_id FROM e WHERE slug = key), (SELECT min(entity_id) FROM a WHERE lower(alias) = lower(key))) AS entity_id FROM k""")
def j17_slug_alias_lookup(s, d):  # J17
    o, p = load(s, d, "orders"), load(s, d, "part")
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("slug-"), (F.col("o_custkey") % 300).cast("string"))).otherwise(F.concat(F.lit("ALIAS "), (F.col("o_custkey") % 400).cast("string")))
    e = p.select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("slug-"), F.col("p_partkey").cast("string")).alias("slug"))
    a = p.select((F.col("p_partkey") % 200).alias("entity_id"), F.concat(F.lit("Alias "), F.col("p_partkey").cast("string")).alias("alias"))
    return I.lookup(o.select(key.alias("key")).distinct(), e, a).select("key", "entity_id")


STRIP = ", ".join(f"'{w}'" for w in X.RESOLVE_STRIP)


@query(oracle=f"""WITH RECURSIVE {NAMES}, slugs AS (SELECT id, {SLUG} AS slug FROM names0), {normal_sql('slugs')}, e AS (SELECT min(id) AS entity_id, slug FROM normal WHERE id % 2 = 0 GROUP BY slug), n AS (SELECT DISTINCT names0.name, normal.slug FROM names0 JOIN normal USING (id) WHERE id % 2 = 1 AND normal.slug <> ''),
    b0 AS (SELECT DISTINCT slug, string_split(slug, '-') AS t, 0 AS depth FROM n UNION ALL SELECT slug, t[:-2], depth + 1 FROM b0 WHERE len(t) > 2 AND (t[-1] IN ({STRIP}) OR regexp_matches(t[-1], '^(19|20)\\d{{2}}$|^fy\\d+$'))),
    b AS (SELECT b0.slug, min_by(e.entity_id, b0.depth) AS base FROM b0 JOIN e ON e.slug = array_to_string(b0.t, '-') WHERE depth > 0 GROUP BY 1)
    SELECT name, slug, coalesce(entity_id, base) AS entity_id, CASE WHEN entity_id IS NOT NULL THEN 'slug' WHEN base IS NOT NULL THEN 'base' ELSE 'create' END AS how FROM n LEFT JOIN e USING (slug) LEFT JOIN b USING (slug)""")
def e01_resolve(s, d):  # E01, E02, E03
    own = names(s, d).where("id % 2 = 1").select("name", F.lit("project").alias("entity_type")).distinct()
    e = names(s, d).where("id % 2 = 0").select("id", X.normalize_slug(X.slugify(F.col("name"))).alias("slug")).groupBy("slug").agg(F.min("id").alias("entity_id")).withColumn("entity_type", F.lit("project"))
    return I.resolve(own, e, s.createDataFrame([], "alias string, entity_id long")).select("name", "slug", "entity_id", "how")


@query("updates", """WITH m AS (SELECT p_partkey AS source, p_partkey - p_partkey % 5 AS target FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0 AND p_partkey > 5), x AS (SELECT coalesce(target, entity_id) AS entity_id, meeting_id, update_id, target IS NULL AS own FROM updates LEFT JOIN m ON source = entity_id)
    SELECT entity_id, meeting_id, update_id FROM x QUALIFY row_number() OVER (PARTITION BY entity_id, meeting_id ORDER BY own DESC, update_id) = 1""")
def e04_merge(s, d):  # E04, T7
    k = F.col("p_partkey")
    mapping = load(s, d, "part").where((k % 5 != 0) & (k % 2 == 0) & (k > 5)).select(k.alias("source"), (k - k % 5).alias("target"))
    return I.merge_entities(load(s, d, "updates").select("entity_id", "meeting_id", "update_id"), mapping, ["meeting_id"], ["update_id"])


@query(oracle=f"""WITH RECURSIVE {NAMES}, ents AS (SELECT min(id) AS id, slug, 'topic' AS entity_type FROM (SELECT id, {SLUG} AS slug FROM names0) GROUP BY slug), {normal_sql('ents')}, c AS (SELECT e.id, e.slug, n.slug AS canonical FROM ents e JOIN normal n USING (id) WHERE n.slug <> e.slug), h AS (SELECT slug AS canonical, min(id) AS holder FROM ents GROUP BY 1),
    f AS (SELECT c.*, holder, min(c.id) OVER (PARTITION BY canonical) AS first_id FROM c LEFT JOIN h USING (canonical))
    SELECT id AS entity_id, slug, canonical, CASE WHEN holder IS NULL AND id = first_id THEN 'rename' ELSE 'merge' END AS action, CASE WHEN holder IS NULL AND id = first_id THEN NULL ELSE coalesce(holder, first_id) END AS target FROM f""")
def e05_dedupe(s, d):  # E05
    e = names(s, d).select("id", X.slugify(F.col("name")).alias("slug")).groupBy("slug").agg(F.min("id").alias("entity_id")).withColumn("entity_type", F.lit("topic"))
    return I.dedupe_plan(e)


@query(oracle="WITH RECURSIVE m AS (SELECT p_partkey AS source, CASE WHEN p_partkey % 4 = 0 THEN p_partkey - 4 ELSE p_partkey - 1 END AS target FROM part WHERE p_partkey % 16 <> 0), f AS (SELECT source, target FROM m UNION ALL SELECT f.source, m.target FROM f JOIN m ON f.target = m.source) SELECT source, target FROM f WHERE target NOT IN (SELECT source FROM m)")
def e06_merge_chains(s, d):  # E06: batches follow chains to their end
    k = F.col("p_partkey")
    return I.chase(load(s, d, "part").where(k % 16 != 0).select(k.alias("source"), F.when(k % 4 == 0, k - 4).otherwise(k - 1).alias("target")))


@query(oracle="SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '<[^>]*>', chr(10), 'g'), '[ \\t\\r]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)) AS text FROM pages")
def s16_html_text(s, d):  # S16
    return load(s, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(oracle="SELECT page_id, len(regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def s06_page_links(s, d):  # S06, F18
    return load(s, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('(?i)<a [^>]*href="([^"]*)"'), 1)).alias("links"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.parse_url("url", F.lit("HOST")).alias("host"))


ARCHIVE = "concat('<h3>City Council</h3><table class=\"listingTable\"><tr><td headers=\"Name\">', title, CASE meeting_id % 3 WHEN 0 THEN ' Special' WHEN 1 THEN ' Work Session' ELSE ' Regular' END, ' meeting</td><td headers=\"Date\">', {day}, '</td><td headers=\"Duration\">', {hours}, 'h 30m</td><td><a href=\"MediaPlayer.php?view_id=1&clip_id=', CAST(meeting_id AS STRING), '\">Video</a></td></tr></table><h3>School Board</h3><table class=\"listingTable\"><tr><td headers=\"Name\">x</td></tr></table>')"


@query("meetings", "SELECT meeting_id AS page_id, CAST(meeting_id AS VARCHAR) AS clip_id, 'city_council' AS body, CASE meeting_id % 3 WHEN 0 THEN 'council_special' WHEN 1 THEN 'council_work_session' ELSE 'council_regular' END AS meeting_type, meeting_date, title || CASE meeting_id % 3 WHEN 0 THEN ' Special' WHEN 1 THEN ' Work Session' ELSE ' Regular' END || ' meeting' AS title, CAST(3600 * (meeting_id % 6) + 1800 AS BIGINT) AS duration_seconds FROM meetings")
def s03_archive(s, d):  # S03, F15, W06
    page = F.expr(ARCHIVE.format(day="date_format(meeting_date, 'MMMM d, yyyy')", hours="CAST(meeting_id % 6 AS STRING)"))
    pages = load(s, d, "meetings").select(F.col("meeting_id").alias("page_id"), page.alias("html"))
    return P.parse_archive(pages, "1").select("page_id", "clip_id", "body", "meeting_type", "meeting_date", "title", F.col("duration_seconds").cast("long").alias("duration_seconds"))


@query("meetings items", "SELECT meeting_id AS page_id, item_no - 1 AS n, CASE WHEN item_no % 3 = 1 THEN CAST(item_no AS VARCHAR) ELSE CAST(item_no - (item_no - 1) % 3 AS VARCHAR) || chr(CAST(96 + (item_no - 1) % 3 AS INTEGER)) END AS label, start_seconds AS seconds FROM items")
def s05_index_points(s, d):  # S05
    i = load(s, d, "items")
    name = F.when(F.col("item_no") % 3 == 1, F.col("item_no").cast("string")).otherwise(F.chr(96 + (F.col("item_no") - 1) % 3))
    div = F.concat(F.lit('<div class="index-point" time="'), F.col("start_seconds").cast("string"), F.lit('">'), name, F.lit(". <b>"), F.col("title"), F.lit("</b></div>"))
    pages = i.groupBy(F.col("meeting_id").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", div.alias("x")))), lambda r: r["x"]), "\n").alias("html"))
    return P.parse_index_points(pages).select("page_id", F.col("n").cast("long").alias("n"), "label", F.col("seconds").cast("long").alias("seconds"))


@query(oracle="SELECT e.event_id, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k FROM events e")
def n01_json_flatten(s, d):  # N01, N07, S12
    return load(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(oracle="WITH l AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z]+ing\\b'))) AS link FROM documents), p AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS path FROM documents) SELECT link, count(*) AS n FROM l WHERE link NOT IN (SELECT path FROM p) GROUP BY 1")
def e22_lint_links(s, d):  # E22, J32, U05
    docs = load(s, d, "documents")
    links = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([a-z]+ing\b)"), 1))).alias("link"))
    paths = docs.select(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("link")).distinct()
    return links.join(paths, "link", "left_anti").groupBy("link").agg(F.count(F.lit(1)).alias("n"))


@query(oracle="SELECT conv_id, turn, length(text) AS n, left(text, 300) AS excerpt FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def l08_excerpts(s, d):  # L08
    own = load(s, d, "conversations").where("role = 'assistant'")
    return R.latest_by(own, ["conv_id"], [F.col("turn").desc()], 2).select("conv_id", "turn", F.length("text").alias("n"), F.left("text", F.lit(300)).alias("excerpt"))
