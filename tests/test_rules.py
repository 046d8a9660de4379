"""Golden values and order independence of the core operators."""

import datetime
import json
import random
import time
import zipfile
from difflib import SequenceMatcher
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from postforge.dialect import SPARK
from postforge.functions import html as H
from postforge.functions import rules as R
from postforge.operators import classify, discovery, graph, resolve, state
from postforge.sources import boards, pack, payloads, sinks
from postforge.streaming import actions


def one(spark, expression, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in cols.items()))
    return df.select(F.expr(expression).alias("x")).first().x


def url(spark, value):
    df = spark.createDataFrame([(value,)], "u string")
    for layer in (R.url_parts(SPARK, "u", "p"), R.url_forms(SPARK, "p")):
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df.select(F.expr(R.url_whole(SPARK, "u", "p")).alias("x")).first().x


@pytest.mark.parametrize(
    "given, wanted",
    [("HTTPS://www.Example.com:443//jobs//1/?utm_source=x&b=2&a=1#frag", "https://example.com/jobs/1?a=1&b=2"), ("", ""), (None, ""), ("/relative/path", "/relative/path"), ("http://x.org:80", "http://x.org/")],
)
def test_canonical_url(spark, given, wanted):
    assert url(spark, given) == wanted


def test_slug_clean_and_hash(spark):
    assert one(spark, R.slug(SPARK, "t"), t="Héllo  World!") == "h-llo-world"
    assert one(spark, R.slug(SPARK, "t"), t="***") == "unknown"
    assert one(spark, R.clean(SPARK, "t"), t=" a &amp;  b\n") == "a & b"
    assert one(spark, "substr(sha1('https://example.com/jobs/1'), 1, 12)", t="") == "5164bd4c9425"


def test_season_location_internship(spark):
    parts = R.season_parts(SPARK, "t", "b")
    df = spark.createDataFrame([("Summer Intern", "Starts May 2027"), ("Summer 2026 Intern", "2027"), ("Dev", "")], "t string, b string").select(*[F.expr(e).alias(n) for n, e in parts.items()])
    assert [tuple(r) for r in df.collect()] == [("summer", 2027, 0.7), ("summer", 2026, 0.95), (None, None, 0.0)]
    loc = spark.createDataFrame([("Remote - New York / Chicago; Boston",), ("New York, NY",), ("",)], "l string").withColumn("m", F.expr(R.remote_type(SPARK, "l", "''")))
    assert [(r.x, r.m) for r in loc.select(F.expr(R.locations(SPARK, "l", "m")).alias("x"), "m").collect()] == [(["New York", "Chicago", "Boston"], "remote"), (["New York, NY"], None), ([], None)]
    kinds = R.program_type(SPARK, "t", "''")["title_program"]
    assert [one(spark, kinds, t=t) for t in ("International Staging Lead", "Co-op Developer", "Werkstudentin Data")] == [None, "co_op", "internship"]


def test_status_list(spark):
    s = R.status(SPARK, "t", "s")
    cases = [("apply now", "greenhouse", "open"), ("", "greenhouse", "likely_open"), ("this job is closed", "greenhouse", "closed"), ("applications for summer 2026 are now closed. check back next year", "custom_page", "coming_soon"), ("", "workday", "unknown"), ("log in to view", "lever", "requires_login")]
    assert [one(spark, s, t=t, s=src) for t, src, _ in cases] == [w for _, _, w in cases]


def test_fpga_title_scores_as_worked_out_by_hand(spark):
    df = spark.createDataFrame([("fpga engineer intern", "", "")], "title_f string, body_f string, department_f string")
    row = classify.classify(df).first()
    assert (row.role_family, row.role_score, row.role_margin, row.role_confidence) == ("fpga_engineer", 5, 2, 0.6)


def test_classifier_against_a_scalar_version(spark):
    from postforge.functions import fixed as K

    rng = random.Random(4)
    words = [w for s, m, _ in K.ROLE_FAMILIES.values() for w in (*s, *m)] + list(K.ROLE_NEGATIVES) + ["intern", "the"]
    rows = [(" ".join(rng.sample(words, rng.randint(0, 3))), " ".join(rng.sample(words, rng.randint(0, 5))), rng.choice(words)) for _ in range(150)]

    def scalar(t, b, dep):
        scored = []
        for family, kws, _, exempt, pref in classify.family_table():
            mt, mb, score, hits, strong = [], [], 0, 0, False
            for kw, s in kws:
                if kw in t and not any(kw in m for m in mt):
                    mt.append(kw)
                    score += (7 if t == kw else 5) if s else 3
                    strong |= s
                    hits += 1
                elif kw in b and not any(kw in m for m in mb):
                    mb.append(kw)
                    score += 2 if s else 1
                    hits += 1
            neg = 0 if exempt else sum(k in t or k in b or k in dep for k in K.ROLE_NEGATIVES)
            scored.append((score - 3 * neg, strong, bool(mt), pref, family, hits, hits + neg > 0))
        top = max(scored)
        if top[0] < 3 or not top[5]:
            return "other" if top[6] else "unknown"
        return top[4]

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, title_f string, body_f string, department_f string")
    got = {r.i: r.role_family for r in classify.classify(df).collect()}
    assert got == {i: scalar(*r) for i, r in enumerate(rows)}


@pytest.mark.parametrize("finish", [0, 400_000])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH_EDGES", finish)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300) if i % 50] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(5, 5)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_title_ratio(spark):
    df = spark.createDataFrame([("software engineer intern", "software engineering intern"), ("tide", "diet")], "a string, b string")
    got = [r.x for r in df.select(resolve.title_ratio("a", "b").alias("x")).collect()]
    assert got == [100 * SequenceMatcher(None, a, b).ratio() for a, b in (("software engineer intern", "software engineering intern"), ("tide", "diet"))]


LOG = [(1, "j", "saved", None, None), (2, "j", "application_status", "interviewing", None), (3, "j", "notes", "x", None), (4, "j", "application_status", "ignored", "why"), (5, "k", "applied", "false", None), (6, "k", "reviewed", None, None)]


def log_frame(spark):
    at = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, j, t, v, n, at + datetime.timedelta(hours=i), at) for i, j, t, v, n in LOG], actions.LOG_SCHEMA)


def test_fold(spark):
    rows = {r.job_id: r for r in state.fold_actions(log_frame(spark)).collect()}
    assert (rows["j"].application_status, rows["j"].saved, rows["j"].applied, rows["j"].ignored, rows["j"].notes) == ("ignored", False, False, True, "why")
    assert (rows["k"].application_status, rows["k"].applied, rows["k"].reviewed) == ("applied", False, True)


def test_streamed_fold_equals_batch(spark, tmp_path):
    log_frame(spark).repartition(3).write.parquet(str(tmp_path / "log"))
    query = actions.start_fold(actions.read_log(spark, str(tmp_path / "log")), "folded", str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    batch = state.fold_actions(log_frame(spark))
    assert sorted(map(tuple, spark.table("folded").select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_discovery(spark, tmp_path):
    queries = lambda **k: [r.query for r in discovery.discovery_frame(spark, **k).orderBy("position").collect()]
    found = queries()
    assert len(found) == 60 and found[0] == '"Summer 2027" "Software Engineer Intern"'
    assert len({q.lower() for q in queries(exhaustive=True)}) == 250
    own = queries(season=" summer 2027 ", role="Own Role", domain="gree", limit=100)
    assert own[0] == '"Summer 2027" "Own Role"' and '"2027" "Own Role"' in own and 'site:greenhouse.io "Summer 2027" "Own Role"' in own and not any("lever" in q for q in own)
    assert queries(season="", domain="LEVER", limit=3) == found[:3]
    with pytest.raises(ValueError):
        queries(domain="nowhere")
    discovery.write_queries(discovery.discovery_frame(spark, limit=2), str(tmp_path / "q.txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "q.txt")).collect()) == sorted(found[:2])
    with pytest.raises(ValueError):
        discovery.write_queries(discovery.discovery_frame(spark, limit=2), str(tmp_path / "q"), "xml")


def test_captured_boards(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name, text in (("a", '{"company_id": "acme", "payload": {"jobs": [1]}}'), ("b", "{oops"), ("c", '{"company_name": "x"}'), ("d", '{"company_id": "d", "company_name": "Dee", "payload": []}')):
        (tmp_path / "b" / f"{name}.json").write_text(text)
    rows = {r.file[-6]: r for r in boards.captured_boards(spark, str(tmp_path)).collect()}
    assert (rows["a"].company_id, rows["a"].company_name, rows["a"].payload, rows["a"].error) == ("acme", "acme", '{"jobs":[1]}', None)
    assert rows["b"].error == "not JSON" and rows["c"].error == "missing: company_id, payload" and rows["c"].company_name is None
    assert (rows["d"].company_name, rows["d"].payload) == ("Dee", "[]")


def test_page_parsing(spark):
    page = "<title>Acme | Careers</title><h1>Software Engineer Intern</h1><script>x</script><ul><li><a href='/jobs/1#a'>FPGA Engineer Intern</a> in London, a role for students who like hardware.</li></ul>"
    facts = H.parse_page(page, "https://acme.com/careers")
    assert facts["anchors"] == [{"text": "FPGA Engineer Intern", "href": "https://acme.com/jobs/1"}] and len(facts["blocks"]) == 1 and "x" not in facts["text"].split()
    assert H.parse_page(None)["text"] == "" and H.parse_page("<div><a")["blocks"] == []
    assert H.job_postings(['{"@graph": [{"@type": ["JobPosting"], "title": "T", "jobLocation": {"address": {"addressLocality": "L", "addressCountry": "C"}}}]}', "bad"]) == [{"title": "T", "description": None, "location": "L, C", "url": None}]
    df = spark.createDataFrame([(1, "https://acme.com/jobs/9", page), (2, "https://acme.com/x", None)], "page_id long, url string, html string")
    found = H.candidates(H.page_facts(df)).collect()
    assert [(r.page_id, r.title, r.kind) for r in found] == [(1, "Software Engineer Intern", "detail")]
    assert H.verified(H.candidates(H.page_facts(df)), H.page_facts(df)).first().check == "verified"


def test_end_tags_may_be_left_out():
    items = H.parse_page("<ul><li>One<li>Two <b>bold<ol><li>inner</ol><li>Three</ul><p>para one<p>para two<div>after</div>")["items"]
    assert items == ["One", "inner", "Two bold inner", "Three", "para one", "para two"]
    jobs = "".join(f"<li><a href='/j/{i}'>FPGA Engineer Intern {i}</a> a role for students who like hardware in London" for i in range(3))
    blocks = H.parse_page(f"<ul>{jobs}</ul>", "https://a.com")["blocks"]
    assert [(b["title"], b["href"]) for b in blocks] == [(f"FPGA Engineer Intern {i}", f"https://a.com/j/{i}") for i in range(3)]


def test_parsing_takes_time_in_proportion():
    def seconds(n):
        page = "<div>" * n + "<li>item <a>link" * n + "</b>" * n
        began = time.process_time()
        assert len(H.parse_page(page)["items"]) == n
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 12 * max(seconds(2000), 0.02)


def test_slugs_and_coordinates(spark):
    df = spark.createDataFrame([("Jane Street", "https://boards.greenhouse.io/janest", None, ["JS", "Jane"])], "name string, careers_url string, ats_slug string, aliases array<string>")
    assert df.select(payloads.slug_candidates().alias("x")).first().x == ["janest", "janestreet", "jane-street", "jane"]
    u = spark.createDataFrame([("https://acme.wd5.myworkdayjobs.com/en-US/External",)], "careers_url string")
    assert tuple(u.select(payloads.workday_coordinates().alias("x")).first().x) == ("acme", "wd5", "External")


def test_pack_and_sinks(spark, tmp_path, monkeypatch):
    assert pack.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(pack.PackError):
        pack.load_yaml(tmp_path / "none.yaml")
    df = spark.createDataFrame([(1, "a|b <x>")], "id long, title string")
    sinks.write_markdown(df, tmp_path / "r.md")
    sinks.write_html({"All": df}, tmp_path / "r.html")
    sinks.write_json(df, tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"jobs": [{"id": 1, "title": "a|b <x>"}], "metadata": {}}
    many = spark.range(12_000).withColumn("apply_url", F.lit("https://a.com/?q=1&r=2"))
    sinks.write_json(many, tmp_path / "many.json")
    sinks.write_html({"All": many}, tmp_path / "many.html")
    sinks.write_xlsx({"All": many, "None": many.limit(0)}, tmp_path / "r.xlsx")
    assert len(json.loads((tmp_path / "many.json").read_text())["jobs"]) == (tmp_path / "many.html").read_text().count("<tr><td>") == 12_000
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        assert len(sheet.find("{*}sheetData")) == 12_001 and sheet.find("{*}autoFilter").get("ref") == "A1:B12001"
        assert len(ElementTree.fromstring(z.read("xl/worksheets/sheet2.xml")).find("{*}sheetData")) == 1
    monkeypatch.setattr(sinks, "SHEET_ROWS", 100)
    with pytest.raises(ValueError):
        sinks.write_xlsx({"All": many}, tmp_path / "large.xlsx")
    sinks.write_csv(df.limit(0), str(tmp_path / "csv"))
    assert "a\\|b" in (tmp_path / "r.md").read_text() and "&lt;x&gt;" in (tmp_path / "r.html").read_text()
    assert next((tmp_path / "csv").glob("part-*")).read_text().strip() == "id,title"
