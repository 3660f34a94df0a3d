"""Links of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.sources import table

HREF = """href=["']([^"'#]+)"""


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=["'']([^"''#]+)', 1))), ' ') AS links FROM pages""")
def w_links(spark, d):
    """The different targets of each page, without fragments."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))))
    return table(spark, d, "pages").select("page_id", F.array_join(found, " ").alias("links"))


#: Elements whose content is no text, and references to characters.
NO_TEXT = r"(?is)<!--.*?-->|<(script|style|noscript|svg|iframe)\b.*?</(script|style|noscript|svg|iframe)\s*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def page_text(html):
    """Every text of a page on a line of its own: no markup, white space collapsed, blank lines left out."""
    lines = F.split(F.regexp_replace(F.regexp_replace(html, NO_TEXT, "\n"), r"(?s)<[^>]*>", "\n"), "\n", -1)
    out = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), "\n")
    for code, plain in ENTITIES:
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def _sql_text(c):
    out = f"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '{NO_TEXT}', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
    for code, plain in ENTITIES:
        out = f"replace({out}, '{code}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return out


@query(f"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, md5({_sql_text('html')}) AS v FROM pages")
def w_text(spark, d):
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.md5(page_text(F.col("html")).cast("binary")).alias("v"))


@query(f"""WITH p AS (SELECT page_id, string_split_regex(html, '(?i)<h[1-6][^>]*>') AS parts FROM pages), s AS (SELECT page_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS k FROM p)
    SELECT page_id, CAST(k - 1 AS INTEGER) AS k, {_sql_text("regexp_extract(part, '(?is)^(.*?)</h[1-6]>', 1)")} AS heading, md5({_sql_text("regexp_replace(part, '(?is)^.*?</h[1-6]>', '')")}) AS content FROM s""")
def w_sections(spark, d):
    """The headings of a page, each with the text up to the next one."""
    parts = F.split("html", "(?i)<h[1-6][^>]*>", -1)
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).alias("k", "part"))
    rest = F.regexp_replace("part", r"(?is)\A.*?</h[1-6]>", "")
    return rows.select("page_id", "k", page_text(F.regexp_extract("part", "(?is)^(.*?)</h[1-6]>", 1)).alias("heading"), F.md5(page_text(rest).cast("binary")).alias("content"))


#: Endings of what is no page.
NO_PAGES = "jpg jpeg png gif svg webp css js zip rar 7z mp4 mp3 wav avi mov woff woff2 ttf".split()
_ENDING = rf"(?i)\.({'|'.join(NO_PAGES)})$"
#: What parts of an address are no page of their own: what follows the last slash of its path.
_PAGE = r"^(https?://[^/?#]+)(/(?:[^?#]*/)?)?.*$"


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '{_PAGE}', 2), ''), '/') AS folder, regexp_extract_all(html, 'href=["'']([^"'']+)', 1) AS refs FROM pages),
    l AS (SELECT page_id, host, list_transform(refs, lambda x: regexp_replace(CASE WHEN regexp_matches(x, '^[a-z]+:') THEN x WHEN starts_with(x, '//') THEN concat(scheme, ':', x) WHEN starts_with(x, '/') THEN concat(scheme, '://', host, x) ELSE concat(scheme, '://', host, folder, x) END, '#.*$', '')) AS links FROM p),
    k AS (SELECT page_id, list_filter(links, lambda x: lower(regexp_extract(x, '^https?://([^/?#:]*)', 1)) = host AND host <> '' AND NOT regexp_matches(regexp_replace(x, '[?].*$', ''), '{_ENDING}')) AS links FROM l)
    SELECT page_id, array_to_string(list_sort(list_distinct(links)), ' ') AS links FROM k""")
def w_internal_links(spark, d):
    """Links of a page to its own host, made whole from the page's folder, without fragments and files, each once."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]*)", 1))
    base = F.concat(F.regexp_extract("url", "^(https?)://", 1), F.lit("://"), host)
    folder = F.coalesce(F.nullif(F.regexp_extract("url", _PAGE, 2), F.lit("")), F.lit("/"))
    refs = F.regexp_extract_all("html", F.lit("""href=["']([^"']+)"""), F.lit(1))
    whole = lambda x: F.when(x.rlike("^[a-z]+:"), x).when(x.startswith("//"), F.concat(F.regexp_extract("url", "^(https?)://", 1), F.lit(":"), x)).when(x.startswith("/"), F.concat(base, x)).otherwise(F.concat(base, folder, x))
    links = F.transform(refs, lambda x: F.regexp_replace(whole(x), "#.*$", ""))
    kept = F.filter(links, lambda x: (F.lower(F.regexp_extract(x, "^https?://([^/?#:]*)", 1)) == host) & (host != "") & ~F.regexp_replace(x, "[?].*$", "").rlike(_ENDING))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(kept)), " ").alias("links"))


_ASKED = ["and", "reier", "thing", "der", "les", "html", "example"]
_IN = "[" + ", ".join(f"'{w}'" for w in _ASKED) + "]"


def _overlap(c):
    return f"len(list_intersect(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), {_IN}))"


@query(f"""SELECT page_id, CAST(score AS INTEGER) AS score FROM (SELECT page_id, {_overlap(_sql_text('html'))} + 6 * {_overlap("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} + 4 * {_overlap('url')} AS score FROM pages)""")
def w_relevance(spark, d):
    """Words of a question in a page's text once, in its title six times, in its url four times."""
    wanted = F.array(*[F.lit(w) for w in _ASKED])
    hits = lambda c: F.size(F.array_intersect(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), wanted))
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", (hits(page_text(F.col("html"))) + 6 * hits(title) + 4 * hits(F.col("url"))).alias("score"))
