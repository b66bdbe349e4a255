"""Text functions as column expressions: identity, classification, parsing, rendering."""

from __future__ import annotations

import json
import unicodedata

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and patterns that give the same results as the reference.
PERSON_SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
ARTICLES = ("the", "a", "an")
TOKEN_CANON = {"blvd": ("boulevard",), "ave": ("avenue",), "rd": ("road",), "thru": ("through",), "masterplan": ("master", "plan")}
LEADING_STRIP = ("draft", "proposed")
CREATE_STRIP = ("project", "projects")
RESOLVE_STRIP = (*CREATE_STRIP, "program", "development", "redevelopment", "update", "updates", "review", "process", "zoning", "initiative")
ACRONYM_STOPWORDS = ("and", "of", "the", "for", "a", "an")
GENERIC_TOKENS = ("project", "projects", "improvement", "improvements", "development", "redevelopment", "application", "proposal", "amendment", "meeting", "phase", "i", "ii", "the", "of", "and", "at", "to", "city", "fairfax", "aka", "va", "llc", "lp")
DEVELOPMENT_WORDS = r"(?i)\b(redevelopments?|developments?|mixed.use|townhomes?|townhouses?|apartments?|multifamily|residential|subdivisions?|rezoning|rezone|zoning|special use|site plan|gdp|shopping centers?|hotels?|storage|drive.through|drive.thru|carwash|car wash|restaurants?|retail|office building|sidewalks?|trails?|intersections?|roadway|road diet|streetscape|pump stations?|sewer|stormwater|outfall|bus stops?|pedestrian|bicycle|bike|multimodal|paving|dredging|landscape|park renovation|undergrounding|extension|connector)\b"
RESIDENTIAL_HINTS = ("dwelling", "residential", "apartment", "townhome", "townhouse", "condominium", "multifamily", "multi-family", "senior living")
CORRIDOR_HINTS = ("bike lane", "bicycle lane", "cycle track", "shared use path", "shared-use path", "trail", "greenway", "multimodal", "multi-modal", "streetscape")
TAXONOMY = (
    ("grocery", r"supermarket|grocer|food.?store|farmers.?market"),
    ("restaurant_bar", r"restaurant|cafe|coffee|bar\b|pub\b|brewery|bakery|fast.?food|food.?court|ice.?cream|dessert|deli|dining|pizzeria|steakhouse|taqueria|diner"),
    ("retail_convenience", r"convenience|gas.?station|fuel|pharmacy|drug.?store|liquor|newsagent|vape|tobacco"),
    ("retail_comparison", r"cloth|apparel|fashion|shoe|jewel|furniture|electronic|department.?store|sporting|sports.?goods|book.?store|bookshop|toy|hobby|antique|thrift|home.?goods|hardware|garden.?cent|appliance|mattress|bicycle.?shop|gift|florist|pet.?store|mall\b|shopping"),
    ("personal_services", r"salon|barber|beauty|nail|spa\b|laundry|dry.?clean|tailor|bank\b|credit.?union|atm\b|insurance|real.?estate.?agen|repair|dentist|veterinar|optician|gym|fitness|yoga|massage|child.?care|tutoring"),
    ("entertainment", r"cinema|movie|theat|museum|gallery|bowling|arcade|casino|night.?club|music.?venue|stadium|amusement|karaoke|billiard|entertainment"),
    ("office", r"office|coworking|company|corporate|consult|lawyer|attorney|account|engineer|architect|tech.?startup|it.?service|employment.?agen"),
    ("civic", r"school|library|city.?hall|townhall|town.?hall|court.?house|post.?office|church|temple|mosque|synagogue|worship|community.?cent|government|university|college|police|fire.?station|hospital|clinic|park\b|recreation|civic"),
)
STREET_SUFFIXES = {"st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "pkwy": "parkway", "hwy": "highway", "ct": "court", "pl": "place", "cir": "circle", "ter": "terrace", "sq": "square"}


def _marked() -> tuple[str, str]:
    """Letters with marks, and the letter or digit that compatibility decomposition leaves of each in a slug."""
    found = [(chr(c), [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) for c in range(0xC0, 0x2200)]
    plain = [(c, x[0]) for c, x in found if len(x) == 1 and x[0].isascii() and x[0].isalnum()]
    return "".join(c for c, _ in plain), "".join(x for _, x in plain)


ACCENTED = _marked()


def _joined() -> dict[str, str]:
    """Signs that compatibility decomposition spells with several ASCII characters, as ligatures and fractions."""
    found = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii()) for c in range(0xA0, 0x10000)}
    return {k: v for k, v in found.items() if len(v) > 1}


JOINED = _joined()


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def spelled(text: Column) -> Column:
    """text with ligatures, fractions and the like spelled out."""
    signs = F.from_json(F.lit(json.dumps(JOINED)), "map<string,string>")
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(signs, c), c))
    return F.when(text.rlike("[" + "".join(JOINED) + "]"), F.array_join(each, "")).otherwise(text)


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(name, "[,.]", " "), r"\s+"), lambda t: t != "")


def display_name(name: Column) -> Column:
    """A name without one-letter initials, unless they have marks or are suffixes."""
    return F.array_join(F.filter(name_tokens(name), lambda t: (F.length(t) > 1) | (F.translate(t, *ACCENTED) != t) | F.lower(t).isin(*PERSON_SUFFIXES)), " ")


def slugify(name: Column) -> Column:
    def without_articles(tokens: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(tokens, lambda t: F.when(F.lower(t).isin(*ARTICLES), "x").otherwise("y")), "y"), F.lit(0)).cast("int")
        return F.when(first == 0, F.lit("")).otherwise(F.array_join(F.slice(tokens, F.greatest(first, F.lit(1)), F.size(tokens)), "-"))

    slug = bind(name_tokens(F.translate(display_name(spelled(name)), *ACCENTED)), without_articles)
    slug = F.regexp_replace(F.regexp_replace(F.lower(slug), "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(slug, "^-|-$", "")


def canonical_tokens(slug: Column) -> Column:
    """A slug's tokens with spelling drift undone, and without leading revision words while more than two remain."""
    out = F.split(slug, "-")
    canon = F.create_map(*[x for k, v in TOKEN_CANON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = F.flatten(F.transform(out, lambda t: F.coalesce(F.try_element_at(canon, t), F.array(t))))
    drop = lambda t, _: F.when((F.size(t) > 2) & F.get(t, F.lit(0)).isin(*LEADING_STRIP), F.slice(t, F.lit(2), F.size(t))).otherwise(t)
    return bind(out, lambda ts: F.aggregate(ts, ts, drop))


def strip_acronym(tokens: Column) -> Column:
    """tokens without the last one where it spells the initials of the others."""
    last = F.element_at(tokens, -1)
    initials = F.array_join(F.transform(F.filter(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: ~t.isin(*ACRONYM_STOPWORDS)), lambda t: F.left(t, F.lit(1))), "")
    return F.when((F.size(tokens) >= 3) & (F.length(last) >= 2) & (last == initials), F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)


def normalize_slug(slug: Column) -> Column:
    """Canonical slug of a thing that isn't a person: suffix words and acronym twins go until nothing changes."""

    def step(t: Column, _: Column) -> Column:
        return bind(strip_acronym(t), lambda s: F.when((F.size(s) >= 3) & F.element_at(s, -1).isin(*CREATE_STRIP), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s))

    def plural(t: Column) -> Column:
        fixed = F.concat(F.slice(t, F.lit(1), F.size(t) - 1), F.array(F.lit("improvements")))
        return F.array_join(F.when((F.size(t) >= 3) & (F.element_at(t, -1) == "improvement"), fixed).otherwise(t), "-")

    return bind(bind(canonical_tokens(slug), lambda ts: F.aggregate(ts, ts, step)), plural)


def is_year_token(token: Column) -> Column:
    return token.rlike(r"^(19|20)\d{2}$|^fy\d+$")


def distinctive_tokens(name: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1)), F.array(*map(F.lit, GENERIC_TOKENS)))


def category(name: Column) -> Column:
    """development for an address (not a year) or built-environment words, else civic."""
    address = name.rlike(r"^\d{3,5}\s") & ~name.rlike(r"^(19|20)\d{2}\s")
    return F.when(address | name.rlike(DEVELOPMENT_WORDS), "development").otherwise("civic")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def no_analysis_reason(description: Column, requests: Column, official_status: Column, eval_status: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(requests, F.lit(""))))
    return (
        F.when(eval_status == "synthesized", F.lit(None).cast("string"))
        .when(eval_status.isNotNull(), "analysis in preparation")
        .when(contains_any(text, CORRIDOR_HINTS), "not yet evaluated")
        .when(~contains_any(text, RESIDENTIAL_HINTS), "no residential program to model")
        .when(F.lower(F.coalesce(official_status, F.lit(""))).startswith("pre-app") | F.contains(text, F.lit("potential")), "awaiting submitted plans")
        .otherwise("not yet evaluated")
    )


def taxonomy(raw: Column) -> Column:
    """First rule that the lower-cased category matches, else other."""
    out = F.when(raw.isNull() | (raw == ""), "other")
    for name, pattern in TAXONOMY:
        out = out.when(F.lower(raw).rlike(pattern), name)
    return out.otherwise("other")


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "['’]", ""), "[^a-z0-9]+", " "))


def street_key(name: Column) -> Column:
    """Street name with its abbreviated words spelled out."""
    full = F.create_map(*[F.lit(x) for kv in STREET_SUFFIXES.items() for x in kv])
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +"), lambda t: t != "")
    return F.array_join(F.transform(words, lambda t: F.coalesce(F.try_element_at(full, t), t)), " ")


def duration_seconds(text: Column) -> Column:
    """'03h 15m' in seconds; null unless hours and minutes are given."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"(\d+)h\s*(\d+)m", i), F.lit("")).cast("int")
    return 3600 * part(1) + 60 * part(2)


def archive_date(text: Column) -> Column:
    """'Jul 14, 2026' or 'July 14, 2026' as a date, null where it is neither."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(F.try_to_timestamp(clean, F.lit("MMM d, yyyy")), F.try_to_timestamp(clean, F.lit("MMMM d, yyyy"))).cast("date")


def meeting_kind(section: Column, title: Column) -> Column:
    """(body, meeting_type) of an archive row, null where it is out of scope."""
    t = F.lower(title)
    kind = F.when(F.contains(t, F.lit("retreat")), "council_retreat").when(F.contains(t, F.lit("special")), "council_special").when(F.contains(t, F.lit("work session")), "council_work_session").when(F.contains(t, F.lit("regular")), "council_regular").otherwise("council_meeting")
    pair = lambda b, k: F.struct(b.alias("body"), k.alias("meeting_type"))
    return F.when(section == "city_council", pair(F.lit("city_council"), kind)).when((section == "community_development") & F.contains(t, F.lit("planning commission")), pair(F.lit("planning_commission"), F.lit("planning_commission")))


def document_kind(label: Column) -> Column:
    low = F.lower(label)
    return F.when(F.contains(low, F.lit("reporter")) | F.contains(low, F.lit("action")), "actions_report").when(F.contains(low, F.lit("minutes")), "minutes").otherwise("other")


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def meeting_start(text: Column) -> Column:
    """'July 14, 2026 - 07:00 PM' as a time without zone, null where it isn't one."""
    return F.try_to_timestamp(text, F.lit("MMMM d, yyyy - hh:mm a")).cast("timestamp_ntz")


def sanitize(text: Column, least: float = 0.85) -> Column:
    """text without control characters, null where under `least` of it is printable."""
    clean = F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")
    return F.when(F.length(text) == 0, F.lit("")).when(F.length(clean) >= least * F.length(text), clean)


def html_to_text(html: Column) -> Column:
    """Tags to line breaks, without scripts, styles and blank lines."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", "\n"), r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n+", "\n"), F.lit("\n"))


def quote_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def verbatim(quote: Column, corpus: Column, most: int = 15) -> Column:
    """Whether the quote, of at most `most` words, stands in the corpus but for case and punctuation."""
    key = quote_key(quote)
    return (F.length(key) > 0) & (F.size(F.split(key, " ")) <= most) & F.contains(quote_key(corpus), key)


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def ics_escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in (";", ","):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def clip_link(view_id: Column, clip_id: Column, seconds: Column) -> Column:
    """Deep link of a recording, null without one; seconds are cut to whole ones."""
    at = F.coalesce(F.floor(seconds).cast("long"), F.lit(0)).cast("string")
    return F.when(clip_id.isNotNull(), F.concat(F.lit("https://video.example.org/MediaPlayer.php?view_id="), view_id, F.lit("&clip_id="), clip_id, F.lit("&entrytime="), at))


def last_name(name: Column) -> Column:
    return F.lower(F.element_at(F.filter(F.split(name, " +"), lambda t: ~F.lower(F.regexp_replace(t, r"\.", "")).isin(*PERSON_SUFFIXES)), -1))


def agenda_excerpt(text: Column, variant: Column, before: int = 80, after: int = 120) -> Column:
    """Around the variant in the first line that has it, with ellipses where it is cut."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), variant)), F.lit(0))

    def cut(x: Column) -> Column:
        at = F.instr(F.lower(x), variant) - 1
        start, end = F.greatest(F.lit(0), at - before), F.least(F.length(x), at + F.length(variant) + after)
        body = F.trim(F.regexp_replace(F.substring(x, start + 1, end - start), r"\s+", " "))
        return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(x), "…").otherwise(""))

    return bind(line, cut)


def citations(answer: Column) -> Column:
    """Distinct numbers in square brackets, ascending."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))))


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))


def money(x: Column) -> Column:
    """Dollars in millions or thousands with a true minus sign."""
    size = F.abs(x)
    body = F.when(size >= 1e6, F.concat(F.format_string("%.1f", size / 1e6), F.lit("M"))).when(size >= 1e3, F.concat(F.format_string("%.0f", size / 1e3), F.lit("k"))).otherwise(F.format_string("%.0f", size))
    return F.concat(F.when(x < 0, "−$").otherwise("$"), body)


def stage_of(status: Column) -> Column:
    """Lifecycle stage of a status: 0 proposed, 1 under way, 2 decided."""
    return F.when(status == "proposed", 0).when(status.isin("in_progress", "deferred"), 1).when(status.isin("approved", "denied", "withdrawn", "completed"), 2)
