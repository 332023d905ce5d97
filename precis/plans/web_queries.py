"""Registered queries for corpus extraction from ``pages``
and the topic operators that read page topics (C10, C11, F25).

The fixture pages carry their topic list in ``<nav><ul>`` and links in
``<li><a href>`` items; they have no talk markup.  ``talk_pages`` writes it around
every page's own topics and the text of the document with its number: nested link
blocks, ld+json and cue JSON, some of it malformed or incomplete.  The oracles say
what has to be read back, from the documents and the rule of the defects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from precis.functions import text as T
from precis.functions.sql_text import q
from precis.operators import analytics as A
from precis.plans.registry import register
from precis.session import table
from precis.sources import web as W

LINK_RE = r"(?s)<li[^>]*>\s*<a[^>]*href=\"([^\"]*)\""
NAV_RE = r"(?s)<nav[^>]*>.*?<ul[^>]*>(.*?)</ul>"
TITLE_RE = r"(?s)<title>.*?</title>"


def _pages(spark, sf):
    return table(spark, sf, "pages")


def _sql_topics(html: str = "html") -> str:
    block = f"regexp_extract({html}, '{NAV_RE}', 1)"
    return (f"(CASE WHEN length({block}) > 0 THEN "
            f"array_to_string(regexp_extract_all({block}, '>([^<]+)<', 1), ',') END)")


_LINKS_SQL = f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{LINK_RE}', 1) AS hrefs FROM pages)
, x AS (SELECT page_id, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS link_no, unnest(hrefs) AS href FROM l)
"""


@register("page_links", sql=_LINKS_SQL + "SELECT page_id, link_no, href FROM x")
def q_page_links(spark, sf):
    return W.page_links(_pages(spark, sf), "li", None)


#: what a talk page lacks, by page_id % 8 (ld+json) and page_id % 5 (cues)
_WHOLE = "page_id % 8 NOT IN (0, 1, 2, 3, 4)"


def talk_pages(spark, sf):
    """pages with talk markup built from their topics and a document's text."""
    pages = _pages(spark, sf).withColumn("topics", F.split(W.page_topics(F.col("html"), "nav"), ",", -1))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    # dealt out by id, as the work comes after the join: a broadcast of the pages
    # would leave it to the few tasks whose files hold their documents
    both = pages.select("page_id", "url", "topics").join(docs.hint("merge"), "page_id")
    k, m = F.col("page_id") % 8, F.col("page_id") % 5
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    block = F.transform("topics", lambda t, i: F.concat(
        F.lit('<div class="media__message"><a href="/wrong">m</a></div><div id="d" class="media media__image'),
        F.when(i % 2 == 0, " wide").otherwise(""), F.lit('"><div class="frame"><span>x</span>'),
        F.when(i % 3 == 2, '<!-- <a href="/no">n</a> --></div>').otherwise(""),
        F.lit("<a rel='x' href='/talks?a=1&amp;n="), i.cast("string"), F.lit("'>"), safe(t), F.lit("</a>"),
        F.when(i % 3 == 2, "").otherwise("</div>"), F.lit('<a href="/second">z</a></div>')))
    links = F.concat(F.lit('<div class="media__image"><b>no link</b></div>'), F.array_join(block, ""),
                     F.lit('<div class="media__image"><div class="media__image"><a href="/inner">i</a></div></div>'))
    field = lambda name, value: value.alias(name)
    full = F.to_json(F.struct(
        field("name", F.when(k != 4, F.concat(F.lit("Talk &lt;"), F.col("page_id").cast("string"), F.lit("&gt;")))),
        field("description", F.lit("D &amp;amp; E")), field("transcript", safe(F.col("text"))),
        field("uploadDate", F.lit("2020-01-02"))))
    duration = F.when(k == 1, "").when(k == 2, ',"duration":5').otherwise(',"duration":"PT5M"')
    js = F.concat(F.substring(full, F.lit(1), F.length(full) - 1), duration, F.when(k == 0, "").otherwise("}"))
    lines = F.split("text", "\n", -1)
    cues = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.transform(lines, lambda x: F.struct(F.transform(
        F.split(safe(x), r"\. ", -1), lambda c: F.struct(c.alias("text"))).alias("cues"))).alias("paragraphs"))
        .alias("translation")).alias("transcriptData")).alias("pageProps")).alias("props")))
    cues = F.when(m == 0, F.concat(cues, F.lit("]"))).when(m == 1, F.replace(cues, F.lit('{"text":'), F.lit('{"txt":'))).otherwise(cues)
    items = F.array_join(F.transform("topics", lambda t: F.concat(F.lit("<li>"), t, F.lit("</li>"))), "")
    aside = F.when(k == 3, F.lit("<ul><li>not in an aside</li></ul>")).otherwise(F.concat(
        F.lit("<aside><p>x</p><ul class='t'>"), items, F.lit("<li><ul><li>deep</li></ul></li></ul><ul><li>no</li></ul></aside>")))
    html = F.concat(
        F.lit("<html><head><title>Jane Doe: Talk | X</title>"), F.when(k != 7, F.concat(
            F.lit('<script type="application/ld+json">'), js, F.lit("</script>"))).otherwise(F.concat(
                F.lit("<script data-x type=\"application/ld+json\" async>"), js, F.lit("</script>"))),
        F.lit('<script id="__NEXT_DATA__" type="application/json">'), cues, F.lit("</script></head><body>"),
        links, aside, F.lit("</body></html>"))
    return both.select("page_id", "url", html.alias("html"))


_TALKS_SQL = f"""
WITH t AS (SELECT p.page_id, p.url, string_split({_sql_topics('p.html')}, ',') AS topics, d.text
           FROM pages p JOIN documents d ON d.doc_id = p.page_id)
"""


@register("media_links", sql=_TALKS_SQL + """
, l AS (SELECT page_id, list_concat(list_transform(range(0, coalesce(len(topics), 0)), lambda i: '/talks?a=1&n=' || i),
                                    ['/inner', '/inner']) AS hrefs FROM t WHERE topics IS NOT NULL)
SELECT page_id, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS link_no, unnest(hrefs) AS href FROM l""")
def q_media_links(spark, sf):
    """B1: the first link of every div of class media__image, in nested markup."""
    return W.page_links(talk_pages(spark, sf))


@register("listing_url", sql=f"""
SELECT page_id, '{W.LISTING_BASE}?page=' || CAST(page_id AS VARCHAR) ||
       coalesce(array_to_string(list_transform(string_split({_sql_topics()}, ','), lambda t: '&topics[]=' || t), ''), '')
       AS listing_url
FROM pages WHERE {_sql_topics()} IS NOT NULL""")
def q_listing_url(spark, sf):
    """B2: listing URL per page from its topic list."""
    p = _pages(spark, sf).withColumn("topics", W.page_topics(F.col("html"), "nav"))
    return p.filter(F.col("topics").isNotNull()).select(
        "page_id", W.listing_url(F.split("topics", ",", -1), F.col("page_id")).alias("listing_url"))


@register("transcript_url", sql=_LINKS_SQL + f"""
SELECT page_id, link_no,
       replace(CASE WHEN starts_with(href, '/') THEN '{W.SITE}' || href ELSE href END, '?language=en', '')
       || '/transcript' AS transcript_url
FROM x""")
def q_transcript_url(spark, sf):
    links = W.page_links(_pages(spark, sf), "li", None)
    return links.select("page_id", "link_no", W.transcript_url(F.col("href")).alias("transcript_url"))


def _sql_unescape_basic(e: str) -> str:
    for ent, ch in W.BASIC_ENTITIES:
        e = f"replace({e}, {q(ent)}, {q(ch)})"
    return e


_TITLE_INNER = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


@register("html_unescape", sql=f"SELECT page_id, {_sql_unescape_basic(_TITLE_INNER)} AS title FROM pages")
def q_html_unescape(spark, sf):
    """B5 (built-in entity subset, oracle-checked)."""
    inner = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return _pages(spark, sf).select("page_id", W.html_unescape_basic(inner).alias("title"))


@register("html_unescape_full")
def q_html_unescape_full(spark, sf):
    """B5 with the full HTML5 entity table (Arrow-batched stdlib decoder)."""
    inner = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return _pages(spark, sf).select("page_id", W.html_unescape(inner).alias("title"))


@register("page_topics", sql=f"SELECT page_id, {_sql_topics()} AS topics FROM pages")
def q_page_topics(spark, sf):
    return _pages(spark, sf).select("page_id", W.page_topics(F.col("html"), "nav").alias("topics"))


@register("page_speaker", sql=f"""
SELECT page_id, substr(split_part(CASE WHEN length(regexp_extract(html, '{TITLE_RE}', 0)) > 0
       THEN regexp_extract(html, '{TITLE_RE}', 0) ELSE 'None' END, ':', 1), 8) AS speaker FROM pages""")
def q_page_speaker(spark, sf):
    return _pages(spark, sf).select("page_id", W.page_speaker(F.col("html")).alias("speaker"))


_TOPICS_BACK = "array_to_string(list_filter(topics, lambda x: x <> ''), ',') || ',deep'"


@register("ldjson_fields", sql=_TALKS_SQL + f"""
SELECT page_id, CASE WHEN {_WHOLE} THEN 'Talk <' || page_id || '>' END AS title,
       CASE WHEN {_WHOLE} THEN 'D &amp; E' END AS description, CASE WHEN {_WHOLE} THEN text END AS transcript,
       CASE WHEN {_WHOLE} THEN 'PT5M' END AS duration, CASE WHEN {_WHOLE} THEN '2020-01-02' END AS upload_date
FROM t WHERE topics IS NOT NULL""")
def q_ldjson_fields(spark, sf):
    """Fields of the ld+json blocks, whole, incomplete and malformed."""
    p = talk_pages(spark, sf)
    f = W.ldjson_fields(F.col("html"), W.page_topics(F.col("html")), W.html_unescape_basic)
    return p.filter("html is not null").select("page_id", f.alias("f")).select(
        "page_id", F.col("f.name").alias("title"), F.col("f.description").alias("description"),
        F.col("f.transcript").alias("transcript"), F.col("f.duration").alias("duration"),
        F.col("f.uploadDate").alias("upload_date"))


@register("cue_transcript", sql=_TALKS_SQL + """
SELECT page_id, CASE WHEN page_id % 5 NOT IN (0, 1) THEN array_to_string(list_transform(string_split(text, chr(10)),
       lambda x: replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '. ', ' ') || ' '), '') END AS transcript
FROM t WHERE topics IS NOT NULL""")
def q_cue_transcript(spark, sf):
    """Cue texts of the embedded application JSON; malformed JSON and cues
    without text give NULL."""
    p = talk_pages(spark, sf).filter("html is not null")
    return p.select("page_id", W.cue_transcript(W.next_data(F.col("html"))).alias("transcript"))


@register("page_select", sql="""
SELECT page_id, url FROM pages
WHERE length(regexp_extract(url, '[?&]page=(\\d+)', 1)) > 0
  AND CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INTEGER) BETWEEN 1 AND 3""")
def q_page_select(spark, sf):
    """Listing pages 1..3 (page number read from the URL)."""
    return W.page_select(_pages(spark, sf), 1, 3).select("page_id", "url")


SCRAPE_SQL = _TALKS_SQL + f"""
SELECT page_id, CASE WHEN {_WHOLE} THEN 'Talk <' || page_id || '>' END AS title,
       CASE WHEN {_WHOLE} THEN {_TOPICS_BACK} END AS topics, 'Jane Doe' AS speaker,
       CASE WHEN {_WHOLE} THEN 'D &amp; E' END AS description, CASE WHEN {_WHOLE} THEN text END AS transcript,
       CASE WHEN {_WHOLE} THEN 'PT5M' END AS duration, CASE WHEN {_WHOLE} THEN '2020-01-02' END AS upload_date,
       replace(CASE WHEN starts_with(url, '/') THEN '{W.SITE}' || url ELSE url END, '?language=en', '') || '/transcript'
         AS transcript_url,
       CASE page_id % 8 WHEN 0 THEN 'malformed json' WHEN 1 THEN 'no duration' WHEN 2 THEN 'no duration'
         WHEN 3 THEN 'no topics' WHEN 4 THEN 'no name' END AS reject
FROM t WHERE topics IS NOT NULL"""


@register("scrape_frame", sql=SCRAPE_SQL)
def q_scrape_frame(spark, sf):
    """Corpus rows of all talk pages, with the reason of every reject."""
    return W.extract_corpus(talk_pages(spark, sf).filter("html is not null"), unescape=W.html_unescape_basic)


@register("topic_string", sql=f"""
SELECT page_id, replace({_sql_topics()}, ',', ', ') || '.' AS topic,
       'You are an expert on the following topic(s): ' || replace({_sql_topics()}, ',', ', ') || '.' AS persona
FROM pages""")
def q_topic_string(spark, sf):
    """C10 on the page topic lists."""
    t = W.page_topics(F.col("html"), "nav")
    return _pages(spark, sf).select("page_id", T.topic_string(t).alias("topic"),
                                    T.persona_context(t).alias("persona"))


@register("topic_tokens", sql=f"""
SELECT page_id, replace(regexp_replace(lower(t), '^{T.WS}+|{T.WS}+\\z', '', 'g'), ' ', '_') AS topic
FROM (SELECT page_id, unnest(string_split({_sql_topics()}, ',')) AS t FROM pages)""")
def q_topic_tokens(spark, sf):
    """C11: one normalised token per listed topic."""
    t = W.page_topics(F.col("html"), "nav")
    return _pages(spark, sf).select("page_id", F.explode(F.split(t, ",", -1)).alias("t")).select(
        "page_id", T.topic_token(F.col("t")).alias("topic"))


@register("topic_frequency", sql=f"""
, c AS (SELECT replace(regexp_replace(lower(t), '^{T.WS}+|{T.WS}+\\z', '', 'g'), ' ', '_') AS topic, count(*) AS count
       FROM (SELECT unnest(string_split({_sql_topics()}, ',')) AS t FROM pages) GROUP BY 1)
SELECT topic, count, (SELECT count(*) FROM c) AS n_topics, row_number() OVER (ORDER BY topic) AS rank FROM c""".replace(", c AS", "WITH c AS", 1))
def q_topic_frequency(spark, sf):
    """topic counts over all pages."""
    p = _pages(spark, sf).select(W.page_topics(F.col("html"), "nav").alias("topics"))
    return A.topic_frequency(p.filter(F.col("topics").isNotNull()))
