"""Raw web pages: links, sections, rule-based attributes. Flat markup only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T

LINK_OR_HEADING = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>|<h[1-6][^>]*>(.*?)</h[1-6]>'
SECTION = r"(?is)<(title|h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:title|h[1-6]|p|li)>"
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
# fixed values: the character references that are decoded
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def inner_text(c: Column) -> Column:
    """Markup to text: tags become spaces, references are decoded, spaces squeezed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for ref, ch in ENTITIES:
        out = F.replace(out, F.lit(ref), F.lit(ch))
    return T.squeeze(out)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link on the page ``base``."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(page) > F.length(root), F.regexp_replace(page, r"[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )


def extract_links(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Links of a page in order, one per target, each with the heading it stands under.

    The window runs over the markup of one page, which is one input row.
    """
    html = F.regexp_replace("html", HIDDEN, "")

    def group(i: int) -> Column:
        return F.regexp_extract_all(html, F.lit(LINK_OR_HEADING), F.lit(i))

    items = pages.select(id, "url", F.posexplode(F.arrays_zip(group(1).alias("href"), group(2).alias("text"), group(3).alias("heading"))).alias("pos", "m"))
    heading = F.when((F.col("m.href") == "") & (F.col("m.heading") != ""), inner_text(F.col("m.heading")))
    w = Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).filter("m.href <> ''")
    rows = rows.select(id, "pos", resolve_url(F.col("url"), F.col("m.href")).alias("link"), inner_text(F.col("m.text")).alias("text"), "heading")
    first = rows.groupBy(id, "link").agg(F.min_by(F.struct("pos", "text", "heading"), "pos").alias("r"))
    return first.select(id, "link", "r.*")


def extract_sections(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """(id, pos, tag, text) for title, headings, paragraphs and list items; blank ones dropped."""
    html = F.regexp_replace("html", HIDDEN, "")
    tags = F.regexp_extract_all(html, F.lit(SECTION), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(SECTION), F.lit(2))
    rows = pages.select(id, "url", F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("body"))).alias("pos", "m"))
    rows = rows.select(id, "url", "pos", F.lower("m.tag").alias("tag"), inner_text(F.col("m.body")).alias("t")).filter("t <> ''")
    return rows.select(id, "url", "pos", "tag", F.when(F.col("tag") == "li", F.concat(F.lit("- "), F.col("t"))).otherwise(F.col("t")).alias("text"))


def page_text(sections: DataFrame, id: str = "page_id") -> DataFrame:
    """Sections of each page as lines of one text."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return sections.groupBy(id).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def repeated_lines(sections: DataFrame, id: str = "page_id") -> DataFrame:
    """Lines that several pages of one site share."""
    site = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    per_page = sections.select(site.alias("site"), "text", id).distinct()
    return per_page.groupBy("site", "text").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1")


def extract_attributes(docs: DataFrame, id: str, text: str, rules: dict[str, list[tuple[str, int]]], list_separator: str | None = None) -> DataFrame:
    """Rule table applied to documents: (id, attribute, value), the first rule that finds
    something decides.

    ``rules``: attribute -> (pattern, group) in order of priority. The rules are code, so they run
    as one expression per row. With a separator a value is split and its repeats dropped.
    """
    found = []
    for name, options in rules.items():
        hit = F.coalesce(*[F.nullif(T.squeeze(F.regexp_extract(text, p, g)), F.lit("")) for p, g in options])
        found.append(F.struct(F.lit(name).alias("attribute"), hit.alias("value")))
    out = docs.select(id, F.explode(F.array(*found)).alias("r")).select(id, "r.*").filter("value IS NOT NULL")
    if list_separator is None:
        return out
    items = F.array_distinct(F.filter(F.transform(F.split("value", list_separator), lambda x: F.trim(x)), lambda x: x != ""))
    return out.select(id, "attribute", F.explode(items).alias("value"))
