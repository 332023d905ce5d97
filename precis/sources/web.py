"""Corpus extraction from stored web pages.

A job over ``pages(page_id, url, html)``: every operator is a column
expression, so extraction is map-only and scales with the number of pages; there
is no crawler (pages are an input table).  Elements are found by folding the tags
of a page with their nesting depth; embedded JSON is parsed as VARIANT, and a page
whose JSON is malformed or incomplete is told apart as a reject.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.udf import LazyPandasUDF

# Site address and listing base of the scraped site layout.
SITE = "https://www.ted.com"
LISTING_BASE = "https://www.ted.com/talks"

# HTML entities decoded by the built-in (oracle-checkable)
# decoder; "&amp;" goes last so "&amp;lt;" decodes once, to "&lt;".
BASIC_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                  ("&nbsp;", " "), ("&amp;", "&")]

# Fields of the ld+json block, and where cues lie in the page data.
LDJSON_FIELDS = ["transcript", "description", "name", "duration", "uploadDate"]
CUE_PARAGRAPHS = "$.props.pageProps.transcriptData.translation.paragraphs"
# The element of a listing that holds a link, and its class.
LINK_TAG, LINK_CLASS = "div", "media__image"

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_SKIPPED = r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag (quoted or not), entities decoded;
    NULL without it."""
    found = rf"""(?is)^<\w+(?:[^>]*?)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
    raw = F.regexp_extract(tag, found, 1)
    bare = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(F.length(raw) > 0, html_unescape_basic(bare))


def element_links(html: Column, tag: str = LINK_TAG, css_class: str | None = LINK_CLASS) -> Column:
    """array<string>: for every ``tag`` element (of class ``css_class``, if given)
    in document order the href of the first link inside it, at whatever depth;
    elements without a link are left out.

    The page's tags are folded with the nesting depth of ``tag``: an element that
    still waits for its link is open until its own end tag.  Comments, scripts and
    style sheets are skipped; elements left open reach to the end of the page."""
    names = "|".join(dict.fromkeys([tag, "a"]))
    tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?is){_SKIPPED}|</?(?:{names})\b{_ATTRS}>"), F.lit(0)),
                    lambda t: t.rlike(rf"(?i)^</?(?:{names})\b"))
    known = F.transform(tags, lambda t, i: F.struct(
        i.alias("i"), t.rlike(rf"(?i)^<{tag}\b").alias("opens"), t.rlike(rf"(?i)^</{tag}\b").alias("closes"),
        F.when(t.rlike(r"(?i)^<a\b"), attribute(t, "href")).alias("href"),
        (F.array_contains(F.split(F.coalesce(attribute(t, "class"), F.lit("")), r"\s+"), css_class)
         if css_class else F.lit(True)).alias("fits")))
    none = F.array().cast("array<struct<i:int,depth:int,href:string>>")
    start = F.struct(F.lit(0).alias("depth"), none.alias("waiting"), none.alias("done"))

    def step(state: Column, t: Column) -> Column:
        depth = state["depth"]
        entry = F.struct(t["i"].alias("i"), (depth + 1).alias("depth"), F.lit(None).cast("string").alias("href"))
        opened = F.struct((depth + 1).alias("depth"), F.when(t["fits"], F.concat(state["waiting"], F.array(entry)))
                          .otherwise(state["waiting"]).alias("waiting"), state["done"].alias("done"))
        closed = F.struct(F.greatest(depth - 1, F.lit(0)).alias("depth"),
                          F.filter(state["waiting"], lambda w: w["depth"] < depth).alias("waiting"), state["done"].alias("done"))
        linked = F.struct(depth.alias("depth"), none.alias("waiting"), F.concat(state["done"], F.transform(
            state["waiting"], lambda w: F.struct(w["i"].alias("i"), w["depth"].alias("depth"), t["href"].alias("href")))).alias("done"))
        return F.when(t["opens"], opened).when(t["closes"], closed).when(
            t["href"].isNotNull() & (F.size(state["waiting"]) > 0), linked).otherwise(state)

    found = F.aggregate(known, start, step, lambda s: s["done"])
    return F.transform(F.array_sort(found), lambda d: d["href"])


def page_links(pages: DataFrame, tag: str = LINK_TAG, css_class: str | None = LINK_CLASS) -> DataFrame:
    """B1: href of the first <a> inside every matching element, in document
    order.  -> (page_id, link_no, href)."""
    return pages.select("page_id", F.posexplode(element_links(F.col("html"), tag, css_class)).alias("link_no", "href"))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated one time, however often ``use``
    names it: inside a higher-order function an expression is evaluated anew at
    each of its places, and nested places multiply."""
    return F.transform(F.array(value), use)[0]


def first_element(html: Column, tag: str) -> Column:
    """Markup inside the first ``tag`` element, its end tag being the one at the
    same depth; NULL without one."""
    bare = F.regexp_replace(html, rf"(?is){_SKIPPED}", "")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, p: Column) -> Column:
        opens, closes = p["opens"], p["closes"]
        at, started = s["at"] + 1, (s["first"] > 0) | opens
        depth = F.when(opens, s["depth"] + 1).when(closes & (s["first"] > 0), s["depth"] - 1).otherwise(s["depth"])
        return F.struct(at.alias("at"), depth.alias("depth"), F.when((s["first"] == 0) & opens, at).otherwise(s["first"]).alias("first"),
                        F.when(started & closes & (depth == 0) & (s["last"] == 0), at).otherwise(s["last"]).alias("last"))

    def inner(pieces: Column) -> Column:
        tags = F.transform(pieces, lambda p: F.struct(p.rlike(rf"(?i)^<{tag}\b").alias("opens"), p.rlike(rf"(?i)^</{tag}\b").alias("closes")))
        return once(F.aggregate(tags, zero, step), lambda x: F.when(x["first"] > 0, F.regexp_replace(F.array_join(F.slice(
            pieces, F.greatest(x["first"], F.lit(1)), F.when(x["last"] > 0, x["last"]).otherwise(F.size(pieces) + 1) - x["first"]), ""),
            rf"(?is)^<{tag}\b{_ATTRS}>", "")))

    return once(F.split(bare, rf"(?i)(?=</?{tag}\b)", -1), inner)


def listing_url(topics: Column, page: Column, base: str = LISTING_BASE) -> Column:
    """B2: base?page=n&topics[]=t1&topics[]=t2..."""
    return F.concat(F.lit(base + "?page="), page.cast("string"),
                    F.array_join(F.transform(topics, lambda t: F.concat(F.lit("&topics[]="), t)), ""))


def transcript_url(href: Column, site: str = SITE) -> Column:
    """Drop "?language=en", add "/transcript"; site prefix on relative links."""
    absolute = F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href)
    return F.concat(F.replace(absolute, F.lit("?language=en"), F.lit("")), F.lit("/transcript"))


def html_unescape_basic(s: Column) -> Column:
    """B5 (built-in subset): the common named/numeric entities."""
    for ent, ch in BASIC_ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _html.unescape(t))


html_unescape = LazyPandasUDF(_unescape, "string")
html_unescape.__doc__ = "B5: full HTML5 entity decoding (Arrow-batched stdlib html.unescape)."


def page_topics(html: Column, container: str = "aside") -> Column:
    """Text nodes of the first <ul> inside the first ``container`` element,
    joined by ","; NULL where one of them is missing."""
    block = first_element(first_element(html, container), "ul")
    return once(block, lambda b: F.when(F.length(b) > 0, F.array_join(
        F.regexp_extract_all(b, F.lit(">([^<]+)<"), F.lit(1)), ",")))


def page_speaker(html: Column) -> Column:
    """The rendered <title> tag up to the first ":", minus "<title>"."""
    tag = F.regexp_extract(html, r"(?s)<title>.*?</title>", 0)
    tag = F.when(F.length(tag) > 0, tag).otherwise(F.lit("None"))
    return F.substring(F.split(tag, ":", -1)[0], 8, 1 << 30)


def script_data(html: Column, attr: str, value: str) -> Column:
    """Content of the first script whose ``attr`` is ``value``; NULL without it."""
    block = F.regexp_extract(html, rf"(?s)<script[^>]*{attr}=\"{value}\"[^>]*>(.*?)</script>", 1)
    return F.when(F.length(block) > 0, block)


def string_field(variant: Column, path: str) -> Column:
    """The string at ``path`` of a VARIANT; NULL if it is missing or no string."""
    found = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(variant, path, "string"))


def parse_json(raw: Column) -> Column:
    """``raw`` as VARIANT; NULL if it is malformed.  The parser stops after the
    first value, so what may follow it is tested by parsing ``raw`` inside an
    object and inside a list: only one whole value is right in both."""
    inside = [F.try_parse_json(F.concat(F.lit(a), raw, F.lit(b))) for a, b in (('{"x":', "}"), ("[", "]"))]
    return F.when(inside[0].isNotNull() & inside[1].isNotNull(), F.try_parse_json(raw))


def ldjson(html: Column) -> Column:
    """The ld+json block as VARIANT; NULL if there is none or it is malformed."""
    return parse_json(script_data(html, "type", r"application/ld\+json"))


def ldjson_fields(html: Column, topics: Column, unescape=html_unescape) -> Column:
    """The ld+json block's transcript, description, name, duration and
    uploadDate, each HTML-unescaped; all-or-nothing: malformed JSON, a field that
    is missing or no string, or missing topics make every field NULL."""
    js = ldjson(html)
    ok = topics.isNotNull()
    for f in LDJSON_FIELDS:
        ok = ok & string_field(js, f"$.{f}").isNotNull()
    return F.when(ok, F.struct(*[unescape(string_field(js, f"$.{f}")).alias(f) for f in LDJSON_FIELDS],
                               topics.alias("topics")))


def reject_reason(html: Column, topics: Column) -> Column:
    """Why a page yields no corpus row, in the order in which its parts are read;
    NULL for a complete page."""
    js = ldjson(html)
    reason = F.when(script_data(html, "type", r"application/ld\+json").isNull(), "no ld+json").when(js.isNull(), "malformed json") \
        .when(topics.isNull(), "no topics")
    for f in LDJSON_FIELDS:
        reason = reason.when(string_field(js, f"$.{f}").isNull(), f"no {f}")
    return reason


def cue_transcript(raw_json: Column) -> Column:
    """Every cue text of every paragraph followed by one space; NULL if the
    JSON is malformed, has no paragraphs, or a cue has no text."""
    paras = F.try_variant_get(parse_json(raw_json), CUE_PARAGRAPHS, "array<variant>")
    cues = F.flatten(F.transform(paras, lambda p: F.try_variant_get(p, "$.cues", "array<variant>")))
    texts = F.transform(cues, lambda c: string_field(c, "$.text"))
    joined = F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit(" "))), "")
    return F.when(F.forall(texts, lambda t: t.isNotNull()), joined)


def next_data(html: Column) -> Column:
    """The page's embedded application JSON (where cue transcripts live)."""
    return script_data(html, "id", "__NEXT_DATA__")


def page_number(url: Column) -> Column:
    return F.regexp_extract(url, r"[?&]page=(\d+)", 1)


def page_select(pages: DataFrame, first: int, last: int, ids: list[int] | None = None) -> DataFrame:
    """Listing pages whose page number is in [first, last] (and, when
    given, page ids picked from a list)."""
    n = page_number(F.col("url"))
    out = pages.filter((F.length(n) > 0) & n.cast("int").between(first, last))
    if ids is not None:
        out = out.filter(F.col("page_id").isin(ids))
    return out


def extract_corpus(pages: DataFrame, container: str = "aside", unescape=html_unescape) -> DataFrame:
    """The 7-column corpus row per page in one select (map-only), with the
    page's id, its transcript address and ``reject``, the reason why the row has
    no fields (NULL for a complete page)."""
    topics = page_topics(F.col("html"), container)
    step = pages.select("page_id", "url", "html", topics.alias("__topics"))
    step = step.withColumn("__f", ldjson_fields(F.col("html"), F.col("__topics"), unescape))
    fields = F.col("__f")
    return step.select(
        "page_id",
        fields["name"].alias("title"), fields["topics"].alias("topics"),
        page_speaker(F.col("html")).alias("speaker"),
        fields["description"].alias("description"), fields["transcript"].alias("transcript"),
        fields["duration"].alias("duration"), fields["uploadDate"].alias("upload_date"),
        transcript_url(F.col("url")).alias("transcript_url"),
        F.when(fields.isNull(), reject_reason(F.col("html"), F.col("__topics"))).alias("reject"))


def split_rejects(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete rows, (page_id, reject) of the others) of ``extract_corpus``."""
    return corpus.filter("reject is null").drop("reject"), corpus.filter("reject is not null").select("page_id", "reject")
