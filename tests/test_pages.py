"""Links, cards and structured data of pages; the store of runs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from postforge.functions import html as H
from postforge.operators import runs
from postforge.plans import catalog, page_queries  # noqa: F401  registers its queries

LD = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "FPGA Engineer Intern", "url": "/jobs/7", "description": "<p>Summer 2027 role</p>", "jobLocation": [{"address": {"addressLocality": "London", "addressCountry": "UK"}}]}]}</script>'
CARDS = "".join(f"<div><h3>{t}</h3><p>A role for students who like hard problems, in {p}.</p></div>" for t, p in (("Software Engineer Intern", "London"), ("Quant Researcher", "Chicago")))
ANCHORS = "<a href='/jobs/2'>Quant Researcher, full time</a><a href='/jobs/1'>Software Engineer Intern</a><a href='/jobs/1'>again</a><a href='/careers'>Careers</a>"


def rows(spark, *pages):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_structured_postings_come_before_the_page(spark):
    page = f"<h1>Software Engineer Intern</h1>{LD}<a href='https://boards.example.org/acme/9/apply'>Apply now</a>"
    found = H.candidates(H.page_facts(rows(spark, ("https://acme.com/jobs/1", page), ("https://www.imc.com/careers/jobs/1", page)))).orderBy("page_id").collect()
    assert [(r.title, r.link, r.location, r.season, r.confidence) for r in found] == [("FPGA Engineer Intern", "https://acme.com/jobs/7", "London", "Summer 2027", 0.97), ("Software Engineer Intern", "https://www.imc.com/careers/jobs/1", None, None, 0.9)]
    assert {r.apply_url for r in found} == {"https://boards.example.org/acme/9/apply"}


@pytest.mark.parametrize("place", ['"London"', "null", "[]", '[{"address": "x"}]', "7"])
def test_odd_structured_data_is_no_error(place):
    text = f'{{"@type": "JobPosting", "title": null, "jobLocation": {place}}}'
    assert H.ld_postings([text, "bad", "[" * 100000], "https://a.com/x") == [{"title": "", "body": "", "place": None, "link": "https://a.com/x"}]


def test_references_of_a_title_as_in_its_twin(spark, tmp_path):
    titles = ["of&amp;&amp", "a&lt", "&am", "&amp;lt; &lt;b&gt; &quot;", "x&copy y&#38 z", "a & b", ""]
    pages = [(i, "https://a.com/?x=1&copy=2", f"<title> {t}</title><a href='/?y=1&lt=2'>R&D</a>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    rows = catalog.queries()["q_html_title"](spark, str(tmp_path)).orderBy("page_id").collect()
    view = duckdb.sql(f"select * from read_parquet('{tmp_path}/pages.parquet')").arrow()  # noqa: F841  read by the twin
    twin = duckdb.connect().register("pages", view).execute(catalog.oracle_sql()["q_html_title"] + " order by page_id").fetchall()
    assert [tuple(r) for r in rows] == twin and rows[0].title == "of&&amp"


def test_cards_take_an_anchor_each(spark):
    found = H.candidates(H.page_facts(rows(spark, ("https://acme.com/open-roles", CARDS + ANCHORS), ("https://acme.com/open-roles", CARDS), ("https://acme.com/none", None)))).orderBy("page_id", "title").collect()
    assert [(r.page_id, r.title, r.link, r.confidence) for r in found] == [
        (0, "Quant Researcher", "https://acme.com/jobs/2", 0.8),
        (0, "Software Engineer Intern", "https://acme.com/jobs/1", 0.8),
        (1, "Quant Researcher", "https://acme.com/open-roles", 0.72),
        (1, "Software Engineer Intern", "https://acme.com/open-roles", 0.72),
    ]
    anchors = [{"text": "FPGA engineer", "href": "u"}, {"text": "", "href": "v"}]
    assert H.match_cards(["FPGA engineer", "FPGA engineer", "", "own"], [None, None, None, "w"], anchors) == ["u", None, None, "w"]


def test_links_are_scored(spark):
    links = [("Apply now", "https://a.com/form"), ("News", "https://a.com/blog/engineer"), ("Home", "https://a.com/x"), ("Read", "https://a.com/vacancies/1"), ("Data Engineer", "https://a.com/y")]
    df = spark.createDataFrame([(links, None, "https://a.com/"), (links, "/x", "https://a.com/"), ([("Apply now", "https://a.com/form")], None, "https://a.com/")], "links array<struct<text:string,href:string>>, segment string, url string")
    assert [r.x for r in df.select(H.role_link(F.col("links"), F.col("segment")).alias("x")).collect()] == ["https://a.com/vacancies/1", "https://a.com/x", None]
    assert [r.x for r in df.select(H.apply_link(F.col("links"), F.col("url")).alias("x")).collect()] == [None] * 3


def test_guard_seasons_and_copy(spark):
    cases = [("https://a.com", "unknown", False), ("https://a.com/careers/", "unknown", False), ("https://a.com/careers", "closed", True), ("https://a.com/jobs/1", "unknown", True), ("https://a.com/about-us", "unknown", False), ("", "closed", False), (None, None, False)]
    df = spark.createDataFrame([(u, h) for u, h, _ in cases], "u string, h string")
    assert [r.x for r in df.select(H.role_specific(F.col("u"), F.col("h"), F.lit("https://a.com/About-Us/"), F.lit("https://a.com/")).alias("x")).collect()] == [c[2] for c in cases]
    texts = spark.createDataFrame([("Join SUMMER \n 2027!",), ("interns of 2026",), ("founded 2012",), ("",), (None,)], "t string")
    assert [r.x for r in texts.select(H.season_hint(F.col("t")).alias("x")).collect()] == ["SUMMER 2027", "2026", None, None, None]
    copy = spark.createDataFrame([("Join us",), ("a b c d e f g h i j k",), ("Quant Trader",)], "t string")
    assert [r.x for r in copy.select(H.is_marketing("t").alias("x")).collect()] == [True, True, False]
    assert [r.x for r in copy.select(H.is_editorial(F.concat(F.lit("who we are, life at, tech blog "), "t")).alias("x")).collect()] == [True] * 3


def test_store_of_runs(spark, tmp_path):
    path, kind = str(tmp_path), "job_id string, status string, content_hash string, role_family string, first_seen long"
    run = lambda *r: spark.createDataFrame(list(r), kind)
    assert runs.jobs(spark, path) is None and runs.runs(spark, path).count() == 0
    assert runs.write_run(run(("a", "open", "1", "x", 5), ("b", "open", "1", "x", 5)), path, "p") == {"inserted": 2, "updated": 0, "changed": 0, "kept": 0, "errors": 0}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        runs.write_run(run(("a", "open", "9", "x", 9)).withColumn("first_seen", F.expr("1 div (first_seen - 9)")), path, "p")
    assert {r.job_id: r.content_hash for r in runs.jobs(spark, path).collect()} == {"a": "1", "b": "1"}
    assert runs.write_run(run(("a", "closed", "1", "x", 9), ("c", "open", "1", "x", 9)), path, "p", errors=1) == {"inserted": 1, "updated": 1, "changed": 1, "kept": 1, "errors": 1}
    assert {(r.job_id, r.status, r.first_seen) for r in runs.jobs(spark, path).collect()} == {("a", "closed", 5), ("b", "open", 5), ("c", "open", 9)}
    assert {(r.scan_run_id, r.job_id) for r in runs.snapshots(spark, path).collect()} == {(1, "a"), (1, "b"), (3, "a"), (3, "c")}
    assert {(r.scan_run_id, r.status) for r in runs.runs(spark, path).collect()} == {(1, "completed"), (2, "failed"), (3, "completed_with_errors")}
    assert runs.jobs(spark, path, run=1).count() == 2
