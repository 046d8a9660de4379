"""The crawl's traps, and what detail pages do to listed postings."""

import pytest
from pyspark.sql import functions as F

from postforge.functions import html as H
from postforge.operators import crawl as C

CAPTURED = "url string, final_url string, http_status int, html string"


def read(spark, captured, links, roots=(("a", "r", 0),), **kw):
    pages = spark.createDataFrame([(*c, None, 200, "")[:4] if len(c) == 1 else c for c in captured], CAPTURED)
    table = spark.createDataFrame(links or [("", 0, "")], "url string, position int, href string")
    found = C.crawl(spark.createDataFrame(list(roots), "firm string, url string, position int"), pages, C.by_table(table), **kw)
    return [(r.firm, r.n, r.depth, r.final_url) for r in found.orderBy("firm", "n").collect()]


def page(url, final=None, status=200, html=""):
    return (url, final, status, html)


def test_budget_of_one_reads_the_root_alone(spark):
    assert read(spark, [page("r"), page("x")], [("r", 0, "x")], budget=1, depth=None) == [("a", 1, 0, "r")]
    with pytest.raises(ValueError):
        read(spark, [page("r")], [], budget=0)


def test_cycles_end_and_no_page_is_read_twice(spark):
    captured = [page(u) for u in "rxyz"] + [page("x2", "x"), page("r2", "r")]
    links = [("r", 0, "x2"), ("r", 1, "x"), ("r", 2, "y"), ("x", 0, "r"), ("x", 1, "z"), ("y", 0, "z"), ("z", 0, "r2"), ("z", 1, "z")]
    assert read(spark, captured, links, depth=None) == [("a", 1, 0, "r"), ("a", 2, 1, "x"), ("a", 3, 1, "y"), ("a", 4, 2, "z")]
    assert read(spark, captured, links, depth=1) == [("a", 1, 0, "r"), ("a", 2, 1, "x"), ("a", 3, 1, "y")]


def test_dead_links_cost_nothing_and_gone_pages_lead_nowhere(spark):
    captured = [page("r"), page("x", status=404), page("y"), page("z")]
    links = [("r", 0, "dead"), ("r", 1, "x"), ("r", 2, "y"), ("x", 0, "z")]
    assert read(spark, captured, links, budget=3, depth=None) == [("a", 1, 0, "r"), ("a", 2, 1, "x"), ("a", 3, 1, "y")]
    assert read(spark, captured, links, roots=[("a", "nowhere", 0)]) == []


def test_budgets_are_a_firm_each_and_roots_come_in_order(spark):
    captured = [page(u) for u in ("r", "s", *[f"p{i}" for i in range(50)])]
    links = [("r", i, f"p{49 - i}") for i in range(50)] + [("s", 0, "p7")]
    found = read(spark, captured, links, roots=[("a", "r", 0), ("b", "s", 1), ("b", "r", 0)], budget=4)
    assert found == [("a", 1, 0, "r"), ("a", 2, 1, "p49"), ("a", 3, 1, "p48"), ("a", 4, 1, "p47"), ("b", 1, 0, "r"), ("b", 2, 0, "s"), ("b", 3, 1, "p49"), ("b", 4, 1, "p48")]


def test_the_best_candidate_shares_most_words_and_the_first_wins(spark):
    d = lambda title, pos: (title, None, "", None, 0.9, None, None, "detail", pos)
    kind = "struct<title:string,apply_url:string,body:string,hint:string,confidence:double,location:string,season:string,kind:string,pos:int>"
    detailed = spark.createDataFrame([("p", d("Quant Trader Intern", 2)), ("p", d("Quant Trader", 1)), ("p", d("Trader Quant 2027", 0)), ("q", d("Chef", 0))], f"final_url string, d {kind}")
    listed = spark.createDataFrame([("1", "p", "Quant Trader"), ("2", "p", "Summer Quant Trader Intern"), ("3", "q", "Quant Trader"), ("4", None, "Quant Trader")], "key string, final_url string, title string")
    assert {r.key: r.best.title for r in C.best_matches(listed, detailed).collect()} == {"1": "Trader Quant 2027", "2": "Quant Trader Intern"}


def site(spark, cards, *others):
    block = "".join(f"<div><h3>{t}</h3><p>{text}</p><a href='{href}'>{t}</a></div>" for t, text, href in cards)
    firms = spark.createDataFrame([("acme", "https://acme.com/careers", "https://acme.com")], "firm string, careers_url string, website string")
    return firms, spark.createDataFrame([page("https://acme.com/careers", html=block), *others], CAPTURED)


LONG = "We build systems for markets and research with people who like hard problems."


def test_detail_pages_confirm_move_or_refute(spark):
    cards = [("Software Engineer", LONG, "/jobs/1"), ("Quant Researcher", LONG, "/jobs/2"), ("FPGA Engineer", "This job is closed. " + LONG, "/jobs/3"), ("Data Engineer", LONG, "/jobs/4")]
    detail = lambda i, title, **kw: page(f"https://acme.com/jobs/{i}", html=f"<h1>{title}</h1><p>{LONG}</p>", **kw)
    firms, captured = site(spark, cards, detail(1, "Software Engineer, Core"), detail(2, "Quant Researcher", status=410), detail(3, "Office Analyst"), detail(4, "Trader", final="https://acme.com/talent-community/4"))
    found = {r.title: (r.link, r.hint, r.check) for r in C.career_postings(firms, captured).collect()}
    assert found == {
        "Software Engineer, Core": ("https://acme.com/jobs/1", None, "verified"),
        "FPGA Engineer": ("https://acme.com/careers", "closed", "no_match"),
        "Data Engineer": ("https://acme.com/careers", "closed", "future"),
    }


def test_links_to_whole_sites_are_guarded(spark):
    cards = [("Software Engineer", LONG, "https://acme.com/careers"), ("Quant Researcher", LONG, "https://other.com/"), ("Data Engineer", LONG, "/jobs/4")]
    firms, captured = site(spark, cards)
    assert [(r.title, r.check) for r in C.career_postings(firms, captured).collect()] == [("Data Engineer", "unfetched")]


def test_budget_leaves_only_what_speaks_for_itself(spark):
    cards = [("Software Engineer", LONG, "/jobs/1"), ("Quant Researcher", "Research into the many markets", "/jobs/2"), ("Data Engineer", LONG, "/jobs/3")]
    firms, captured = site(spark, cards, *[page(f"https://acme.com/jobs/{i}", html=f"<h1>{t}</h1>") for i, (t, *_) in enumerate(cards, 1)])
    assert {(r.title, r.check) for r in C.career_postings(firms, captured, budget=2).collect()} == {("Software Engineer", "verified"), ("Data Engineer", "unread")}
    assert C.career_postings(firms.limit(0), captured).count() == 0


def test_terms_are_literal_texts(spark):
    df = spark.createDataFrame([("c++ (core)",), ("c+ core",), (None,)], "t string")
    assert [r.x for r in df.select(H._has(F.col("t"), ("c++", "(co")).alias("x")).collect()] == [True, False, None]
    assert [r.x for r in df.select(H._count(F.col("t"), ("c+", "co", "it's")).alias("x")).collect()][:2] == [2, 2]
