"""Semi-structured inputs to rows, by expressions: archive pages, index points, rosters, JSON grids, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as X

#: Archive sections in scope.
SECTIONS = {"City Council": "city_council", "Community Development": "community_development"}


def strip_tags(html: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"&nbsp;|\s+", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def cell(row: Column, header: str) -> Column:
    """Text of a table row's cell by its headers attribute, null without one."""
    found = F.nullif(F.regexp_extract(row, rf'(?is)<td[^>]*headers="{header}[^"]*"[^>]*>(.*?)</td>', 1), F.lit(""))
    return strip_tags(found)


def parse_archive(pages: DataFrame, view_id: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """Meetings of archive pages: the last section header holds for the tables after it; rows without a recording, a date or
    a body in scope are dropped."""
    parts = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<h3\b[^>]*>.*?</h3>|<table\b[^>]*listingTable[^>]*>.*?</table>)"), 1)).alias("part_no", "part"))
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    heading = F.when(F.col("part").rlike("(?i)^<h3"), F.coalesce(F.try_element_at(names, strip_tags(F.col("part"))), F.lit("")))
    w = Window.partitionBy(key).orderBy("part_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where(~F.col("part").rlike("(?i)^<h3"))
    rows = rows.select(key, "section", "part_no", F.posexplode(F.regexp_extract_all("part", F.lit(r"(?is)(<tr\b.*?</tr>)"), 1)).alias("row_no", "row"))
    r = F.col("row")
    clip = F.nullif(F.regexp_extract(r, r"""MediaPlayer\.php\?[^"']*clip_id=(\d+)""", 1), F.lit(""))
    title = F.coalesce(cell(r, "Name"), F.left(strip_tags(r), F.lit(120)))
    out = rows.select(key, "part_no", "row_no", clip.alias("clip_id"), F.lit(view_id).alias("view_id"), title.alias("title"), X.meeting_kind(F.col("section"), title).alias("_k"), X.archive_date(cell(r, "Date")).alias("meeting_date"), X.duration_seconds(cell(r, "Duration")).alias("duration_seconds"), "row")
    return out.where("clip_id is not null and _k is not null and meeting_date is not null").select(key, "part_no", "row_no", "clip_id", "view_id", "_k.body", "_k.meeting_type", "meeting_date", "title", "duration_seconds")


def parse_upcoming(pages: DataFrame, view_id: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """Events of the upcoming table: id, title, start (null when it can't be read), whether it is under way, agenda link."""
    table = F.regexp_extract(html, r'(?is)<table[^>]*id="upcoming"[^>]*>(.*?)</table>', 1)
    rows = pages.select(key, F.explode(F.regexp_extract_all(table, F.lit(r"(?is)(<tr\b.*?</tr>)"), 1)).alias("row"))
    r = F.col("row")
    event = F.nullif(F.regexp_extract(r, r"event_id=(\d+)", 1), F.lit(""))
    when = cell(r, "EventDate")
    live = F.contains(F.lower(F.coalesce(when, F.lit(""))), F.lit("in progress"))
    title = cell(r, "EventName")
    low = F.lower(title)
    body = F.when(low.startswith("city council"), "city_council").when(low.startswith("planning commission"), "planning_commission")
    agenda = F.nullif(F.regexp_extract(r, r'(?i)href="([^"]*AgendaViewer\.php[^"]*)"', 1), F.lit(""))
    out = rows.select(key, event.alias("event_id"), F.lit(view_id).alias("view_id"), title.alias("title"), body.alias("body"), F.when(~live, X.meeting_start(when)).alias("starts_at"), live.alias("in_progress"), X.absolute_url(agenda, "https://video.example.org").alias("agenda_url"))
    return out.where("event_id is not null and title is not null")


def parse_index_points(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, n, label, seconds, text) of index points; a bare letter belongs to the last number before it."""
    points = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?is)(<div[^>]*class="index-point"[^>]*>.*?</div>)'), 1)).alias("n", "div"))
    points = points.select(key, "n", F.regexp_extract("div", r'time="(\d+)"', 1).alias("t"), strip_tags(F.col("div")).alias("text")).where("t <> '' and text <> ''")
    number = F.nullif(F.regexp_extract("text", r"^\s*(\d+)([a-z])?[.)]\s", 1), F.lit(""))
    letter = F.regexp_extract("text", r"^\s*(\d+)([a-z])?[.)]\s", 2)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(number, ignorenulls=True).over(w)
    bare = F.nullif(F.regexp_extract("text", r"(?i)^\s*([a-z])[.)]\s", 1), F.lit(""))
    label = F.when(number.isNotNull(), F.concat(number, letter)).otherwise(F.lower(F.concat(last, bare)))
    return points.select(key, "n", label.alias("label"), F.col("t").cast("int").alias("seconds"), "text")


def item_links(pages: DataFrame, base: str = "https://video.example.org", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, meta_id, url, label): links of item documents, the first of each meta_id."""
    from rostrum.operators.relational import latest_by

    links = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?is)(<a\b[^>]*href="[^"]*MetaViewer\.php[^"]*"[^>]*>.*?</a>)'), 1)).alias("n", "a"))
    url = X.absolute_url(F.regexp_extract("a", r'(?i)href="([^"]*)"', 1), base)
    out = links.select(key, "n", F.nullif(F.regexp_extract(url, r"meta_id=(\d+)", 1), F.lit("")).alias("meta_id"), url.alias("url"), strip_tags(F.col("a")).alias("label")).where("meta_id is not null")
    return latest_by(out, [key, "meta_id"], [F.col("n")]).drop("rank", "n")


def json_grid(rows: DataFrame, column: str, names: list[str], sentinel: float = -666666666) -> DataFrame:
    """A JSON array of arrays, whose first row is a header, as rows of doubles by name; the sentinel and what isn't a number
    are null."""
    grid = F.from_json(column, "array<array<string>>")
    out = rows.withColumn("_g", grid).withColumn("_h", F.get("_g", F.lit(0))).select("*", F.posexplode("_g").alias("_n", "_r")).where("_n > 0")
    value = lambda c: F.get("_r", (F.array_position("_h", c) - 1).cast("int"))
    number = lambda c: F.when(value(c).try_cast("double") > sentinel, value(c).try_cast("double"))
    return out.select(*[c for c in rows.columns if c != column], F.col("_n").alias("row_no"), *[number(c).alias(c) for c in names])


def front_matter(pages: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """(key, meta, body): the lines "name: value" between the leading --- lines, and what follows."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?", 1)
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\w[\w-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w[\w-]*):", 1).alias("key"), F.trim(F.regexp_replace(x, r"^\w[\w-]*:", "")).alias("value")))
    return pages.select(key, F.map_from_entries(pairs).alias("meta"), body.alias("body"))


def roster(agendas: DataFrame, text: str = "text", key: str = "meeting_id") -> DataFrame:
    """(key, chair, vice_chair, commissioners) of one-line commission headers."""
    pattern = r"(?i)Chair:\s*([^/\n]+?)\s*/\s*Vice-?\s?Chair:\s*([^/\n]+?)\s*/\s*Commissioners?:\s*([^\n]+)"
    head = F.left(F.col(text), F.lit(3000))
    part = lambda i: F.nullif(F.trim(F.regexp_extract(head, pattern, i)), F.lit(""))
    names = F.transform(F.split(part(3), ","), lambda c: F.trim(F.regexp_replace(c, r"\s+\d+[.)]\s.*$", "")))
    names = F.filter(names, lambda c: c.rlike(r"^[A-Z][A-Za-z.'’\-]*( [A-Z][A-Za-z.'’\-]*)+$") & (F.length(c) < 50))
    return agendas.select(key, part(1).alias("chair"), part(2).alias("vice_chair"), F.coalesce(names, F.array().cast("array<string>")).alias("commissioners"))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of the first tag that has it, null without one."""
    return F.nullif(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def within(html: Column, tag: str, opening: str) -> Column:
    """What stands inside the outermost elements `tag` whose opening tag matches the pattern, an array in page order. An element
    ends where as many closing tags of its name as opening ones have passed; one that is never closed goes on to the end."""
    pieces = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(?:(?!</?{tag}\b).)*+|</{tag}\s*>(?:(?!</?{tag}\b).)*+"), 0)
    state = "struct<depth:int,inside:int,found:array<array<string>>>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inside"), F.array().cast("array<array<string>>").alias("found")).cast(state)

    def step(s: Column, piece: Column) -> Column:
        closing = F.startswith(piece, F.lit("</"))
        depth = s["depth"] + F.when(closing, -1).otherwise(1)
        begins = (s["inside"] == 0) & ~closing & F.rlike(F.regexp_extract(piece, r"(?s)^(<[^>]*>)", 1), F.lit(opening))
        ends = closing & (depth < s["inside"])
        rest = F.regexp_replace(piece, r"(?s)^<[^>]*>", "")
        last = F.size(s["found"])
        grown = F.concat(F.slice(s["found"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.element_at(s["found"], -1), F.array(piece))))
        found = F.when(begins, F.concat(s["found"], F.array(F.array(rest)))).when((s["inside"] > 0) & ~ends, grown).otherwise(s["found"])
        inside = F.when(begins, depth).when(ends, 0).otherwise(s["inside"])
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), inside.alias("inside"), found.alias("found")).cast(state)

    return F.transform(F.aggregate(pieces, start, step, lambda s: s["found"]), lambda parts: F.array_join(parts, ""))


def project_list(pages: DataFrame, base: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, n, slug, name, detail_url, project_type, description) of the articles inside the directory's containers that link to
    a project; articles elsewhere on the page aren't taken. The icon in the title tells the city's own projects from private
    ones."""
    listed = F.array_join(within(F.col(html), "div", r"(?i)class=[\"'][^\"']*\blist-item-container\b"), "\n")
    items = pages.select(key, F.posexplode(F.regexp_extract_all(listed, F.lit(r"(?is)(<article\b.*?</article>)"), 1)).alias("n", "item"))
    url = X.absolute_url(F.nullif(F.regexp_extract("item", r"""(?is)<a\b[^>]*href=["']([^"']*/Development/Projects/[^"']*)["']""", 1), F.lit("")), base)
    title = F.regexp_extract("item", r"""(?is)<(\w+)[^>]*class=["'][^"']*list-item-title[^"']*["'][^>]*>(.*?)</\1>""", 2)
    icon = F.lower(F.regexp_extract(title, r"(?is)(<img\b[^>]*>)", 1))
    kind = F.when(F.contains(icon, F.lit("city-project")), "City Project").otherwise("Private Development")
    about = F.nullif(strip_tags(F.regexp_extract("item", r"(?is)<p\b[^>]*>(.*?)</p>", 1)), F.lit(""))
    slug = F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1)
    out = items.select(key, "n", slug.alias("slug"), strip_tags(title).alias("name"), url.alias("detail_url"), kind.alias("project_type"), about.alias("description"))
    return out.where("detail_url is not null and name <> ''")


def page_forms(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, page, fields): the posts that fetch a directory's further pages, from 2 to the last that its pager offers: every
    field of the page's form but its buttons, with the pager's own set to the page and its Go button pressed. A page without
    a pager or without the button has none."""
    tags = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), 0)
    form = F.coalesce(F.get(within(F.col(html), "form", ""), F.lit(0)), F.lit(""))
    pager = F.array_join(within(F.col(html), "div", r"(?i)class=[\"'][^\"']*\bseamless-pagination\b"), "")
    own = pages.select(key, form.alias("form"), pager.alias("pager"))
    given = lambda t: attribute(t, "name").isNotNull()
    pair = lambda t, v: F.struct(attribute(t, "name").alias("key"), F.coalesce(v, F.lit("")).alias("value"))
    button = lambda t: F.coalesce(F.lower(attribute(t, "type")).isin("submit", "button", "image"), F.lit(False))
    inputs = F.transform(F.filter(tags("form", r"(?is)<input\b[^>]*>"), lambda t: given(t) & ~button(t)), lambda t: pair(t, attribute(t, "value")))
    areas = F.transform(F.filter(tags("form", r"(?is)<textarea\b[^>]*>"), given), lambda t: pair(t, F.lit("")))
    head = lambda x: F.regexp_extract(x, r"(?s)^(<[^>]*>)", 1)
    chosen = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(?is)(<option\b[^>]*\bselected\b[^>]*>)", 1), F.lit("")), F.regexp_extract(x, r"(?is)(<option\b[^>]*>)", 1))
    selects = F.transform(F.filter(tags("form", r"(?is)<select\b.*?</select>"), lambda x: given(head(x))), lambda x: pair(head(x), attribute(chosen(x), "value")))
    numbers = F.filter(F.transform(tags("pager", r"(?is)<option\b[^>]*>"), lambda o: F.regexp_extract(o, r"(?is)value\s*=\s*[\"'](\d+)[\"']", 1).try_cast("int")), lambda x: x.isNotNull())
    go = F.get(F.filter(tags("pager", r"(?is)<input\b[^>]*>"), lambda t: (F.lower(attribute(t, "type")) == "submit") & (attribute(t, "value") == "Go")), F.lit(0))
    read = own.select(key, F.concat(inputs, areas, selects).alias("f"), attribute(F.regexp_extract("pager", r"(?is)(<select\b[^>]*>)", 1), "name").alias("page_field"), attribute(go, "name").alias("go_field"), F.coalesce(F.array_max(numbers), F.lit(1)).alias("last"))
    read = read.where("page_field is not null and go_field is not null and last > 1").select("*", F.explode(F.sequence(F.lit(2), F.col("last"))).alias("page"))
    others = F.filter("f", lambda x: (x["key"] != F.col("page_field")) & (x["key"] != F.col("go_field")))
    last_of = F.filter(others, lambda x, i: ~F.exists(F.slice(others, i + 2, F.size(others)), lambda y: y["key"] == x["key"]))  # of a name that comes twice the last counts
    fields = F.concat(last_of, F.array(F.struct(F.col("page_field").alias("key"), F.col("page").cast("string").alias("value")), F.struct(F.col("go_field").alias("key"), F.lit("Go").alias("value"))))
    return read.select(key, "page", F.map_from_entries(fields).alias("fields"))


def project_detail(pages: DataFrame, base: str, html: str = "html", key: str = "page_id", listed: DataFrame | None = None) -> DataFrame:
    """A row for each project page: facts of the lists in its main part (`main`, or a div of class content-main), and what stands
    under its headings; null for what it hasn't, or what the row of `listed` (key, project_type, description) says.

    documents are the (label, url) of links under headings with "plan" or "document" in them; a place is read from the first
    pair of decimal numbers under Location, and the address is what stands before it."""
    page = F.col(html)
    main = F.concat(within(page, "main", ""), within(page, "div", r"(?i)class=[\"'][^\"']*\bcontent-main\b"))
    main = F.array_join(main, "\n")
    facts = F.transform(F.regexp_extract_all(main, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1), strip_tags)
    fact = lambda name: F.nullif(F.trim(F.regexp_replace(F.element_at(F.filter(F.concat(F.array(F.lit(f"{name} ")), F.col("facts")), lambda x: x.startswith(f"{name} ")), -1), f"^{name} ", "")), F.lit(""))
    pattern = r"(?is)<h[23]\b[^>]*>(.*?)</h[23]>(.*?)(?=<h[23]\b|</main>|\z)"
    parts = F.arrays_zip(F.transform(F.regexp_extract_all(page, F.lit(pattern), 1), lambda h: F.lower(strip_tags(h))).alias("label"), F.regexp_extract_all(page, F.lit(pattern), 2).alias("body"))
    own = pages.select(key, main.alias("_main"), facts.alias("facts"), parts.alias("parts"))

    def body(label: str) -> Column:
        return F.element_at(F.filter(F.concat(F.array(F.struct(F.lit("").alias("label"), F.lit(None).cast("string").alias("body"))), F.col("parts")), lambda p: (p["label"] == "") | (p["label"] == label)), -1)["body"]

    text = lambda label: F.nullif(strip_tags(body(label)), F.lit(""))
    links = F.flatten(F.transform(F.filter("parts", lambda p: p["label"].rlike("plan|document")), lambda p: F.regexp_extract_all(p["body"], F.lit(r"(?is)(<a\b[^>]*href=[^>]*>.*?</a>)"), 1)))
    documents = F.transform(links, lambda a: F.struct(strip_tags(a).alias("label"), X.absolute_url(attribute(a, "href"), base).alias("url")))
    timeline = F.filter(F.transform(F.regexp_extract_all(body("project"), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1), strip_tags), lambda t: t != "")
    place = r"(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)"
    number = lambda i: F.regexp_extract(text("location"), place, i).try_cast("double")
    address = F.trim(F.regexp_replace(F.regexp_replace(text("location"), rf"\s*{place}.*$", ""), r"\s*View Map.*$", ""))
    contact = text("contact details")
    email = F.nullif(F.regexp_extract(contact, r"[\w.+-]+@[\w-]+\.gov", 0), F.lit(""))
    phone = F.nullif(F.regexp_extract(contact, r"\(\d{3}\)\s*\d{3}-\d{4}", 0), F.lit(""))
    planner = F.trim(F.replace(F.replace(contact, F.coalesce(email, F.lit(""))), F.coalesce(phone, F.lit(""))), F.lit(" ,"))
    image = F.nullif(F.regexp_extract("_main", r"""(?is)<img\b[^>]*src=["']([^"']*)["']""", 1), F.lit(""))
    out = {"project_type": fact("Project type"), "division": fact("Project division"), "official_status": fact("Project schedule"), "official_timeline": timeline, "description": text("background"), "requests": F.coalesce(text("requests"), text("potential requests")), "documents": documents, "lat": number(1), "lng": number(2), "address": F.nullif(address, F.lit("")), "planner_email": email, "planner_phone": phone, "planner_name": F.nullif(planner, F.lit("")), "applicant": F.nullif(F.trim(F.replace(text("applicant"), F.lit("Applicant's Representative:"))), F.lit("")), "image_url": X.absolute_url(image, base)}
    detail = own.select(key, *[c.alias(n) for n, c in out.items()])
    if listed is None:
        return detail
    names = [c for c in listed.columns if c != key]
    return detail.join(listed.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left").select(key, *[F.coalesce(c, f"_{c}").alias(c) if c in names else c for c in out])


def paged_features(pages: DataFrame, attributes: str, page_size: int, text: str = "json", layer: str = "layer", offset: str = "offset") -> DataFrame:
    """(layer, offset, n, attributes...) of landed pages of a layer's features, in page order up to the first short page
    that doesn't say that there is more, or the first empty one; a page with an error fails the query."""
    kind = f"error string, exceededTransferLimit boolean, features array<struct<attributes:struct<{attributes}>,properties:struct<{attributes}>>>"
    own = pages.select(layer, offset, F.from_json(text, kind).alias("p"))
    own = own.where(F.when(F.col("p.error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("layer query failed: "), F.col("p.error"))).cast("boolean")))
    n = F.coalesce(F.size("p.features"), F.lit(0))
    last = (n <= 0) | ((n < page_size) & ~F.coalesce(F.col("p.exceededTransferLimit"), F.lit(False)))
    before = Window.partitionBy(layer).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)
    read = own.withColumn("_over", last).withColumn("_past", F.coalesce(F.max("_over").over(before), F.lit(False))).where("not _past")
    rows = read.select(layer, offset, F.posexplode("p.features").alias("n", "f"))
    return rows.select(layer, offset, "n", F.coalesce("f.attributes", "f.properties").alias("_a")).select(layer, offset, "n", "_a.*")
