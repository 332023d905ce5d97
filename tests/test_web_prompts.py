"""Web extraction on inline pages and prompt rendering vectors."""

from pyspark.sql import functions as F

from conftest import one
from precis.operators import prompts as P
from precis.sources import web as W

PAGE = ('<html><head><title>Jane Doe: Talk | X</title>'
        '<script type="application/ld+json">{"transcript": "Hi &amp; bye", "description": "D", '
        '"name": "N &lt;1&gt;", "duration": "PT5M", "uploadDate": "2020-01-02T03:04:05Z"}</script>'
        '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"transcriptData":'
        '{"translation":{"paragraphs":[{"cues":[{"text":"a"},{"text":"b"}]},{"cues":[{"text":"c"}]}]}}}}}'
        '</script></head><body><aside><ul><li>AI</li><li>Ethics</li></ul></aside></body></html>')


def test_speaker(spark):
    assert one(spark, W.page_speaker(F.col("h")), h="<title>Jane Doe: Talk | X</title>") == "Jane Doe"
    assert one(spark, W.page_speaker(F.col("h")), h="<title>Plain</title>") == "Plain</title>"


def test_ldjson_and_cues(spark):
    df = spark.createDataFrame([(1, "https://x.org/talks/t?language=en", PAGE)], "page_id long, url string, html string")
    row = W.extract_corpus(df).first()
    assert row["title"] == "N <1>" and row["transcript"] == "Hi & bye" and row["topics"] == "AI,Ethics"
    assert row["upload_date"] == "2020-01-02T03:04:05Z" and row["speaker"] == "Jane Doe"
    assert row["transcript_url"] == "https://x.org/talks/t/transcript"
    assert df.select(W.cue_transcript(W.next_data(F.col("html"))).alias("t")).first()["t"] == "a b c "
    # all-or-nothing: without the topics list every field is NULL
    bare = df.withColumn("html", F.regexp_replace("html", "<aside>.*</aside>", ""))
    assert W.extract_corpus(bare).first()["transcript"] is None


def test_topics_read_the_page_once(spark):
    """The markup is stripped once for the container and once for its list, not
    again at each place that names it."""
    cases = {"<aside><p><aside>x</aside></p><ul class='a>b'><li>A</li><li><ul><li>B</li></ul></li></ul><ul><li>C</li></ul></aside>": "A,B",
             "<ul><li>C</li></ul><!-- <aside> --><ASIDE><UL><li>D</li>": "D", "<aside></aside><aside><ul><li>E</li></ul></aside>": None,
             "</aside><aside><script><ul><li>no</li></ul></script><ul><li>F</li></ul></aside>": "F", "plain": None, "": None}
    df = spark.createDataFrame([*cases.items(), (None, None)], "h string, want string")
    out = df.select("want", W.page_topics(F.col("h")).alias("got"))
    assert all(r["want"] == r["got"] for r in out.collect())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("<style") <= 2


def test_talk_pages_dealt_out_by_id(spark, sf):
    """The pages are built and read after the join, so it must not stay with the
    files of the documents, small as the pages may be."""
    from precis.plans import web_queries as WQ
    for q in (WQ.q_ldjson_fields, WQ.q_media_links, WQ.q_cue_transcript, WQ.q_scrape_frame):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_listing_url(spark):
    got = one(spark, W.listing_url(F.split(F.col("t"), ","), F.lit(2)), t="a,b")
    assert got == "https://www.ted.com/talks?page=2&topics[]=a&topics[]=b"


def test_token_budget(spark):
    df = spark.createDataFrame([("hello there world",)], "t string").select(
        F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"))
    r = P.token_budget(df).first()
    assert r["n_tokens"] == 4 + 1 + 3 + 3 and r["within_budget"]


def test_template_substitute_no_rescan(spark):
    got = one(spark, P.template_substitute(F.col("b"), {"a": F.col("v"), "b": F.lit("B")}),
              b="x ${a} y ${b} ${zz}", v="${b}")
    assert got == "x ${b} y B ${zz}"


def test_chat_messages_suffix(spark):
    msgs = one(spark, P.chat_messages(F.lit("base_prompt"), F.col("t")), t="T")
    assert msgs[0]["content"] == "Summarize the text. Text: ###\nT\n###" + P.MODIFIER_SUFFIX
    msgs = one(spark, P.chat_messages(F.lit("step_by_step"), F.col("t")), t="T")
    assert msgs[0]["content"].endswith("Let's think step by step.")


def test_leave_one_out(spark):
    rows = [(i, f"t{i}", f"s{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "run_id long, text string, prediction string")
    got = {r["run_id"]: (r["ex_inputs"], r["ex_outputs"]) for r in P.leave_one_out(df, 3).collect()}
    assert got[0] == (["t1", "t2", "t3"], ["s1", "s2", "s3"])
    assert got[2] == (["t0", "t1", "t3"], ["s0", "s1", "s3"])
    assert got[5] == (["t0", "t1", "t2"], ["s0", "s1", "s2"])


NESTED = (
    "<!-- <div class='media__image'><a href='/comment'></a></div> --><script>var x = '<div class=\"media__image\"><a href=s>';</script>"
    "<a href='/before'>b</a><DIV class=\"a media__image b\" data-x='>'><p><div><div></div><A rel=x HREF='/1?a=1&amp;b=2'>1</A></div></p><a href='/no'>"
    "</a></DIV><div class='media__imagery'><a href='/other'></a></div><div class='media__image'></div><a href='/after'></a>"
    "<div class='media__image'><div class='media__image'><a name='anchor'></a><a href=/2>2</a></div></div><div class=media__image><a href='/3'>")


def test_element_links_in_nested_markup(spark):
    got = one(spark, W.element_links(F.col("h")), h=NESTED)
    assert got == ["/1?a=1&b=2", "/2", "/2", "/3"]
    assert one(spark, W.element_links(F.col("h"), "li", None), h="<li><b><a href='x'></a></b><li>") == ["x"]
    for empty in ("", "<div class='media__image'>", "no markup", None):
        assert one(spark, W.element_links(F.col("h")), h=empty) in ([], None)


def test_first_element_is_closed_at_its_own_depth(spark):
    html = "<ul><li>out</li></ul><aside id='a>b'><div><aside>in</aside></div><ul><li>A<ul><li>B</li></ul></li></ul></aside><ul><li>no</li></ul>"
    assert one(spark, W.first_element(F.col("h"), "aside"), h=html).startswith("<div><aside>in</aside></div><ul>")
    assert one(spark, W.page_topics(F.col("h")), h=html) == "A,B"
    assert one(spark, W.first_element(F.col("h"), "aside"), h="<p>x</p>") is None
    assert one(spark, W.first_element(F.col("h"), "p"), h="<p>x") == "x"


def test_json_is_whole_or_rejected(spark):
    page = lambda js: PAGE[:PAGE.index("{")] + js + PAGE[PAGE.index("</script>"):]
    good = PAGE[PAGE.index("{"):PAGE.index("</script>")]
    cases = [(good, None), (good + "]", "malformed json"), (good[:-1], "malformed json"), (good + ' , "x": 1', "malformed json"),
             (good.replace('"PT5M"', "5"), "no duration"), (good.replace('"D"', "null"), "no description"), (" ", None)]
    df = spark.createDataFrame([(i, "u", page(js)) for i, (js, _) in enumerate(cases)] + [(99, "u", "<p>x</p>"), (98, "u", None)],
                               "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in W.extract_corpus(df, unescape=W.html_unescape_basic).collect()}
    for i, (_, reason) in enumerate(cases[:-1]):
        assert rows[i]["reject"] == reason and (rows[i]["transcript"] is None) == (reason is not None), i
    assert rows[6]["reject"] == "malformed json" and rows[99]["reject"] == "no ld+json" and rows[98]["reject"] == "no ld+json"
    whole, rejects = W.split_rejects(W.extract_corpus(df, unescape=W.html_unescape_basic))
    assert whole.count() == 1 and rejects.count() == len(rows) - 1
    cue = '{"props":{"pageProps":{"transcriptData":{"translation":{"paragraphs":[{"cues":[{"text":"a"}%s]}]}}}}}'
    assert one(spark, W.cue_transcript(F.col("j")), j=cue % ',{"text":"b"}') == "a b "
    for bad in (cue % ',{"txt":"b"}', cue % ',{"text":5}', (cue % "") + "]", "{}", "", None):
        assert one(spark, W.cue_transcript(F.col("j")), j=bad) is None


def test_unknown_approach_is_an_error(spark):
    import pytest
    df = spark.createDataFrame([("nope", "t")], "approach string, text string")
    with pytest.raises(Exception, match="unknown approach: nope"):
        P.render_prompts(df).collect()
    with pytest.raises(ValueError):
        P.approach_grid(df, plan=[P.plan_row("nope")])


def test_multi_turn_waits_restarts_and_stops(spark):
    hist = spark.createDataFrame([(1, "important_parts", "T"), (2, "follow_up_questions", "T"), (3, "topic", "T"), (4, "improve", "T")],
                                 "run_id int, approach string, text string")
    hist = hist.withColumn("messages", P.chat_messages(F.col("approach"), F.col("text")))
    replies = spark.createDataFrame(
        [(1, 1, "parts"), (1, 2, "done"), (2, 1, "q1"), (2, 3, "early"), (3, 1, "x"), (3, 2, "beyond"), (4, 1, "b"), (4, 1, "a")],
        "run_id int, step int, content string")
    got = {r["run_id"]: r for r in P.multi_turn(hist, replies).collect()}
    assert got[1]["finished"] and got[1]["past"][-1]["content"] == "parts"
    assert "Important parts: ###\nparts\n###" in got[1]["messages"][0]["content"]
    assert [m["role"] for m in got[1]["past"] + got[1]["messages"]] == ["user", "assistant", "user", "assistant"]
    assert (got[2]["step"], got[2]["finished"]) == (1, False)  # the third reply waits for the second
    assert (got[3]["step"], got[3]["finished"], len(got[3]["messages"])) == (1, True, 2)
    assert got[4]["messages"][1]["content"] == "a" and got[4]["messages"][2]["role"] == "user"


def test_token_rules_by_model(spark):
    import pytest
    df = spark.createDataFrame([("hello there",)], "t string").select(
        F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"), "t")
    for model, per in (("gpt-3.5-turbo-16k", 4), ("gpt-4", 3), ("gpt-4-0314", 3)):
        assert P.token_budget(df, model=model).first()["n_tokens"] == per + 1 + 2 + 3
    with pytest.raises(ValueError):
        P.token_budget(df, model="other")
    assert P.completion_budget(df, "t").first()["max_completion"] == P.MAX_TOKENS_COMPLETION - 2 - 3
