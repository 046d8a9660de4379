"""Slugs, hosts, pages and outcomes of boards; the live data source against a server of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from postforge.sources import board_reader as B

FIRM = "company_id string, name string, aliases array<string>, careers_url string, ats_type string, ats_slug string, ats_tenant string, ats_datacenter string, ats_site string"
ANSWERS = "url string, page int, http_status int, body string"


def firms(spark, *rows):
    full = [({"company_id": f"c{i}", "name": "Acme & Co.", "aliases": None, "careers_url": None, "ats_type": None, "ats_slug": None, "ats_tenant": None, "ats_datacenter": None, "ats_site": None} | r) for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], FIRM)


def answers(spark, *rows):
    return spark.createDataFrame(list(rows) or [("none", 0, 404, None)], ANSWERS)


@pytest.mark.parametrize(
    ("source", "row", "declared", "slugs"),
    [
        ("lever", {}, True, ["acmeco", "acme-co"]),
        ("lever", {"aliases": ["AC", "A-c-m", "acmeco", "One Two"]}, True, ["acmeco", "acme-co", "acm", "onetwo"]),
        ("lever", {"aliases": ["aaa", "bbb", "ccc", "ddd"], "name": "X"}, True, ["x", "aaa", "bbb", "ccc", "ddd"]),
        ("lever", {"ats_slug": " own ", "careers_url": "https://jobs.lever.co/Own/1"}, True, ["own"]),
        ("lever", {"ats_slug": "own", "careers_url": "https://jobs.lever.co/other/1?x"}, True, ["own", "other"]),
        ("lever", {"ats_slug": "own"}, False, ["acmeco", "acme-co"]),
        ("greenhouse", {"careers_url": "https://boards.greenhouse.io/embed/job_board?for=acme2&x=1"}, False, ["acme2"]),
        ("greenhouse", {"careers_url": "https://jobs.lever.co/other"}, True, ["acmeco", "acme-co"]),
        ("ashby", {"name": "..", "aliases": []}, True, []),
    ],
)
def test_slugs(spark, source, row, declared, slugs):
    assert firms(spark, row).select(B.board_slugs(source, declared).alias("x")).first().x == slugs


def outcome(spark, source, *found):
    rows = firms(spark, {"ats_type": source, "ats_slug": "one", "careers_url": f"https://x.{B.CAREER_HOSTS[source]}/two"})
    r = B.settled(B.planned(rows), answers(spark, *[(B.HOSTS[source][h].format(slug=s), 0, code, body) for s, h, code, body in found])).first()
    return r.slug, r.outcome


def test_the_first_answer_that_is_no_404_decides(spark):
    good, jobs = '{"jobs": [{"id": 1}]}', "greenhouse"
    assert outcome(spark, jobs, ("one", 0, 404, None), ("one", 1, 200, good), ("two", 0, 200, good)) == ("one", None)
    assert outcome(spark, jobs, ("one", 0, 404, None), ("one", 1, 404, None), ("two", 0, 429, None), ("two", 1, 200, good)) == ("two", "rate_limit")
    assert outcome(spark, jobs, ("one", 0, 404, None), ("one", 1, 404, None), ("two", 0, 404, None), ("two", 1, 404, None)) == ("two", "config_error")
    assert outcome(spark, jobs, ("one", 0, 403, None), ("two", 0, 200, good)) == ("one", "config_error")
    assert outcome(spark, jobs, ("one", 0, 404, None), ("two", 0, 200, good)) == ("one", "network_error")  # the second host never answered
    for body in ("no json", "[]", '{"jobs": 3}', "{}", None):
        assert outcome(spark, jobs, ("one", 0, 200, body)) == ("one", "parse_error")
    assert outcome(spark, "lever", ("one", 0, 200, "[]")) == ("one", None)
    assert outcome(spark, "lever", ("one", 0, 200, "{}")) == ("one", "parse_error")
    assert outcome(spark, "ashby", ("one", 0, 500, None)) == ("one", "network_error")


def paged(spark, *found):
    row = firms(spark, {"ats_type": "workday", "ats_tenant": "t", "ats_datacenter": "wd1", "ats_site": "S"})
    url = "https://t.wd1.myworkdayjobs.com/wday/cxs/t/S/jobs"
    rows = []
    for p, (code, first, n, total) in enumerate(found):
        body = json.dumps({"jobPostings": [{"title": f"T{i}", "externalPath": f"/job/{i}"} for i in range(first, first + n)], "total": total})
        rows.append((url, p, code, body if code == 200 else None))
    return [(r.page, r.outcome) for r in B.settled_pages(B.planned(row), answers(spark, *rows)).orderBy("page").collect()]


def test_pages_stop_where_the_list_ends(spark):
    full = (200, 0, 20, 0), (200, 20, 20, 0), (200, 40, 20, 0)
    assert paged(spark, *full[:2], (200, 40, 3, 0), (200, 43, 20, 0)) == [(0, None), (1, None), (2, None)]  # a short page
    assert paged(spark, (200, 0, 20, 40), full[1], full[2]) == [(0, None), (1, None)]  # the total of the first page, later ones say 0
    assert paged(spark, *full[:2], full[1], full[2]) == [(0, None), (1, None), (2, None)]  # nothing new
    assert paged(spark, full[0], (200, 0, 0, 0), full[1]) == [(0, None), (1, None)]  # empty
    assert paged(spark, full[0], (500, 0, 0, 0), full[1]) == [(1, "network_error")]  # the board fails as a whole
    assert paged(spark, (200, 0, 20, 20), (500, 0, 0, 0)) == [(0, None)]  # an error behind the end is never met
    assert paged(spark, (429, 0, 0, 0)) == [(0, "rate_limit")]
    assert paged(spark) == [(0, "network_error")]


def test_resolution_probes_sources_in_order(spark):
    rows = firms(spark, {"ats_type": "custom"}, {"ats_type": "Lever", "name": "B"}, {"name": "C", "careers_url": "https://c.wd3.myworkdayjobs.com/en-US/Site"}, {"name": "D"})
    at = lambda source, slug, host=0: B.HOSTS[source][host].format(slug=slug)
    found = answers(
        spark,
        (at("greenhouse", "acmeco"), 0, 500, None), (at("greenhouse", "acmeco", 1), 0, 200, '{"jobs": []}'),  # the second host is not asked
        (at("lever", "acmeco"), 0, 200, "{}"), (at("lever", "acme-co"), 0, 200, "[]"), (at("ashby", "acmeco"), 0, 200, '{"jobs": [{}]}'),
        (at("lever", "b"), 0, 200, "[{}]"), (at("greenhouse", "b"), 0, 404, None), (at("greenhouse", "b", 1), 0, 404, None),
    )
    got = B.resolved(rows, found)
    assert {(r.company_id, r.source_type, r.slug, r.resolved, r.changed, r.note) for r in got.collect()} == {
        ("c0", "lever", "acme-co", True, True, "board is empty"),
        ("c1", "lever", "b", True, False, None),
        ("c2", "workday", "c/Site", True, True, None),
        ("c3", None, None, False, False, None),
    }
    assert B.resolution_report(got).first().asDict() == {"firms": 4, "resolved": 3, "unresolved": 1, "changed": 2}


class _Board(BaseHTTPRequestHandler):
    asked: list = []

    def answer(self, code, body):
        self.asked.append(self.path)
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        code = {"/one": 404, "/down": 503}.get(self.path.split("?")[0], 200)
        self.answer(code, '{"jobs": [{"id": 5}]}' if code == 200 else "")

    def do_POST(self):
        at = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["offset"]
        self.answer(200, json.dumps({"jobPostings": [{"externalPath": f"/{i}"} for i in range(at, min(at + 20, 45))]}))

    def log_message(self, *a):
        pass


def test_live_answers(spark):
    server = HTTPServer(("127.0.0.1", 0), _Board)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = [("a", "greenhouse", "one", 0, f"{base}/one"), ("a", "greenhouse", "two", 1, f"{base}/two"), ("a", "greenhouse", "three", 2, f"{base}/three"), ("b", "lever", "d", 0, f"{base}/down"), ("c", "workday", "w", 0, f"{base}/w"), ("d", "ashby", "x", 0, "http://127.0.0.1:1/x")]
    try:
        requests = spark.createDataFrame(rows, "company_id string, source_type string, slug string, priority int, url string")
        df = B.live_answers(requests, timeout=5)
        assert df.rdd.getNumPartitions() == 4
        got = df.collect()
        assert sorted((r.company_id, r.slug, r.page, r.http_status) for r in got if r.company_id != "d") == [("a", "one", 0, 404), ("a", "two", 0, 200), ("b", "d", 0, 503), ("c", "w", 0, 200), ("c", "w", 1, 200), ("c", "w", 2, 200)]
        assert [(r.http_status, bool(r.error)) for r in got if r.company_id == "d"] == [(None, True)]
        assert any("content=true" in p for p in _Board.asked)
        assert B.live_answers(requests.limit(0)).where(F.lit(True)).count() == 0
    finally:
        server.shutdown()
