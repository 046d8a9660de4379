"""Evidence: sentences by a scalar version, golden explanations, order and caps."""

import random
import re
from itertools import chain

from pyspark.sql import functions as F

from postforge.dialect import SPARK
from postforge.functions import fixed as K
from postforge.operators import evidence
from postforge.plans import postings

EXTRA = (
    "Master's degree required; PhD required. Graduating in 2027 or 2028.", "Expected graduation between May 2026 and June 2029.", "Graduating between May 2020 and June 2029.", "Class of 2041.", "Students graduating soon; class of '27.",
    "Graduation date 2019. Physics, physics and math.", "GPA 3.1 or higher. Minimum GPA of 3.5.", "We do not sponsor visas. We sponsor visas.", "Visa sponsorship may be available. Sponsorship available.", "ITAR restrictions apply. Security clearance required.",
    "Must be a U.S. citizen.", "bachelor's degree. Bachelor's degree. bachelor's degree.", "Freshmen and sophomores. Rising junior!", "Graduating 2027. Graduating 2027.",
)


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?;])\s+", " ".join(text.split())) if s]


def by_hand(title, body):
    """Each rule as a function from sentences to sentences, in their order."""
    said = sentences(title) + sentences(body)
    hit = lambda s, *patterns: any(re.search(p, s, re.IGNORECASE) for p in patterns)
    those = lambda patterns: [s for s in said if hit(s, *patterns)]

    def dated(s):
        if not hit(s, K.GRADUATION_CUE):
            return False
        span = re.search(K.GRADUATION_RANGE, s, re.IGNORECASE)
        if span and 0 <= int(span[4]) - int(span[2]) <= 4:
            return True
        return hit(s, K.CLASS_OF, K.GRADUATING_IN, K.YEAR_LIST) or any(2020 <= int(y) <= 2035 for y in re.findall(K.YEAR, s))

    deciding = next((found for found in map(those, (K.NO_SPONSORSHIP, K.SPONSORSHIP, K.MAYBE_SPONSORSHIP)) if found), [])
    nation = next((those(p) or [" ".join(said)] for p in K.CITIZENSHIP.values() if those(p) or hit(" ".join(said), *p)), [])
    lists = [*map(those, (K.BACHELOR, K.MASTER, K.PHD, K.REQUIRES_MASTER, K.REQUIRES_PHD)), filter(dated, said), *(those([p]) for p in K.CLASS_YEARS.values()), *(those([p])[:1] for p in K.MAJORS.values()), deciding, nation, those(K.GPA)[:1]]
    return list(dict.fromkeys(chain.from_iterable(lists)))


def test_sentences_equal_the_scalar_version(spark):
    r = random.Random(11)
    parts = [*postings.TEXTS, *EXTRA]
    given = [(i, r.choice(postings.TITLES), " ".join(r.sample(parts, r.randint(0, 6)))) for i in range(400)] + [(400 + i, "", t) for i, t in enumerate(parts)]
    raw = spark.createDataFrame(given, "i long, title string, description string")
    snips = SPARK.concat_lists(f"({SPARK.sentences('title')})", f"({SPARK.sentences('clean')})")
    rows = raw.withColumn("clean", F.expr("trim(regexp_replace(description, '\\\\s+', ' '))")).withColumn("snips", F.expr(snips))
    rows = rows.withColumn("sponsorship", F.expr(postings.R.sponsorship(SPARK, "snips"))).withColumn("citizenship", F.expr(postings.R.citizenship(SPARK, "snips")))
    found = {x.i: x.e for x in rows.select("i", F.expr(SPARK.distinct(evidence.eligibility(SPARK))).alias("e")).collect()}
    assert found == {i: by_hand(t, b) for i, t, b in given}
    assert sum(map(bool, found.values())) > 250 and max(map(len, found.values())) > 6


SCORED = dict(
    title_f="software engineer intern, trading systems", body_f="build low latency market data systems in c++ and python.", role_family="trading_systems_engineer", tier="S", status="open", age_days=0, source_type="greenhouse",
    prestige=90.0, role_fit=96.5, technical_depth=68.0, freshness=100.0, eligibility=85.0, hidden_gem=72.6, status_open=100.0, sponsorship="unknown", citizenship=None,
)


def explained(spark, preset=K.DEFAULT_PRESET, role_evidence=(), snips=(), **changed):
    row = SCORED | changed
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items())
    df = spark.createDataFrame([(*row.values(), list(role_evidence), list(snips))], f"{kinds}, role_evidence array<string>, snips array<string>")
    return evidence.with_evidence(df, preset).first()


def test_golden_explanation(spark):
    assert explained(spark).explanation == [
        "Opportunity score used the cs_algo_engineering preset.",
        "role_fit contributed strongly with score 96.",
        "freshness contributed strongly with score 100.",
        "technical_depth contributed strongly with score 68.",
        "Prestige tier S came from pack defaults.",
        "Role family 'trading_systems_engineer' is in the target set.",
        'description matched strong technical signal "c++"',
        "Job was last verified 0 day(s) ago.",
        evidence.NO_CANDIDATE,
        "Top-tier prestige makes the role somewhat obvious.",
    ]


def test_other_explanations(spark):
    said = explained(spark, "APPLY_NOW", status="closed", tier="Unknown", prestige=50.0, role_family="unknown", title_f="x", body_f="", status_open=0.0).explanation
    assert said[0] == "Opportunity score used the apply_now preset." and not any(x.startswith("freshness") for x in said)
    assert {evidence.NO_TIER, evidence.FAMILY_UNKNOWN, evidence.NOT_TECHNICAL, evidence.CLOSED_NOW, evidence.PRESTIGE_ELSE} <= set(said)
    assert explained(spark, "nonsense").explanation[0].endswith("cs_algo_engineering preset.")
    tied = explained(spark, "beginner_friendly", eligibility=0.0, role_fit=50.0, freshness=50.0, hidden_gem=0.0, prestige=0.0).explanation
    assert [x.split()[0] for x in tied[1:4]] == ["role_fit", "freshness", "prestige"]  # of equal weight the later name first
    assert explained(spark, role_family="legal", body_f="marketing", title_f="x").explanation[5:7] == ["Role family 'legal' is not a primary target but remains somewhat relevant.", 'non-technical signal "marketing" reduced technical depth']


def test_status_evidence(spark):
    said = lambda **c: explained(spark, **c).status_evidence
    feed = "job is listed in the current greenhouse source feed"
    assert said(body_f="apply now") == [feed, 'page matched open signal "apply now"'] and said(status="likely_open") == [feed]
    assert said(status="likely_open", source_type="other", body_f="submit application") == ['page matched open signal "submit application"']
    assert said(status="closed", body_f="404. this job is closed") == ['page matched closed signal "this job is closed"']
    assert said(status="unknown") == [evidence.NO_SIGNAL]


def test_gathered_evidence_is_distinct_and_capped(spark):
    row = explained(spark, role_evidence=["a ", " a", "", "b"], snips=["Bachelor's degree in physics.", "GPA 3.5 minimum."], status="unknown")
    assert row.evidence == ["a", "b", evidence.NO_SIGNAL, "Bachelor's degree in physics.", "GPA 3.5 minimum.", "Opportunity score used the cs_algo_engineering preset."]
    assert row.eligibility_evidence == ["Bachelor's degree in physics.", "GPA 3.5 minimum."]
