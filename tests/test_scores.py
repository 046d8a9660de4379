"""Golden scores and rounding as plain Python rounds."""

import random

from pyspark.sql import functions as F

from postforge.dialect import SPARK
from postforge.functions import rules as R
from postforge.operators import resolve

JOBS = "ingest_seq long, company_id string, title string, apply_url string, source_url string, locations array<string>, season string, year int"


def test_two_places_by_the_binary_value(spark):
    rng = random.Random(4)
    values = [0.0, 1.005, 0.125, 87.755, 90.655, 84.835, 99.995, 100.0, 0.375, 2.675, 62.5, *[rng.random() * 100 for _ in range(3000)], *[rng.randrange(100_000) / 1000 for _ in range(3000)]]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.expr(R.round2(SPARK, "x")).alias("r")).collect()
    assert [(r.x, r.r) for r in rows if r.r != round(r.x, 2)] == []


def score(spark, expression, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} {'double' if isinstance(v, float) else 'string'}" for c, v in cols.items()))
    return df.select(F.expr(expression).alias("x")).first().x


def test_golden_scores(spark):
    fit = R.role_fit(SPARK, "f", "c")
    assert score(spark, fit, f="trading_systems_engineer", c=0.9) == 96.5
    assert [score(spark, fit, f=f, c=1.0) for f in ("quant_research", "other", "unknown", "legal")] == [77.0, 30.0, 40.0, 55.0]
    assert score(spark, R.role_fit(SPARK, "f", "c", excluded=("legal",)), f="legal", c=1.0) == 10.0
    parts = dict(prestige=90.0, role_fit=96.5, technical_depth=68.0, freshness=100.0, eligibility=85.0, visibility=35.0, status_open=100.0)
    gem = score(spark, R.hidden_gem(SPARK, "'open'", "'trading_systems_engineer'"), **parts)
    assert gem == 72.6
    presets = {"cs_algo_engineering": 87.75, "prestige_first": 90.66, "hidden_gems": 84.83, "apply_now": 96.05, "beginner_friendly": 88.94}
    assert {p: score(spark, R.opportunity(SPARK, p), hidden_gem=gem, **parts) for p in presets} == presets


def links(spark, rows, similar=False):
    df = spark.createDataFrame(rows, JOBS)
    found = resolve.exact_links(df)
    if similar:
        found = found.unionByName(resolve.similar_links(df))
    return sorted({(r.a, r.b) for r in found.collect()})


def test_years_veto_equal_titles_unless_a_key_is_shared(spark):
    row = lambda i, year, url, title="Software Engineer Intern": (i, "c", title, f"https://a.com/apply/{url}", f"https://a.com/jobs/{url}", ["London"], "summer", year)
    assert links(spark, [row(1, 2026, "x"), row(2, 2027, "y")], similar=True) == []
    assert links(spark, [row(1, 2027, "x"), row(2, 2027, "y")]) == [(1, 2)]
    assert links(spark, [row(1, None, "x"), row(2, None, "y")]) == [(1, 2)]
    assert links(spark, [row(1, 2026, "x"), row(2, 2027, "x")]) == [(1, 2)]  # the same URL


def test_one_source_url_and_nearly_equal_titles(spark):
    row = lambda i, year, title, source: (i, "c", title, f"https://a.com/apply/{i}", source, [], None, year)
    near = [row(1, 2026, "Software Engineer Intern 2026 London", "https://a.com/jobs"), row(2, 2027, "Software Engineer Intern 2027 London", "https://a.com/jobs"), row(3, 2027, "Chef", "https://a.com/jobs")]
    assert links(spark, near, similar=True) == [(1, 2)]
    near[1] = row(2, 2027, "Software Engineer Intern 2027 London", "https://a.com/other")
    assert links(spark, near, similar=True) == []  # the veto of differing years
