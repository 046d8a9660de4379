"""Overrides: priority of keys, first in file order, what is scored again."""

import pytest

from postforge.operators import overrides

ROW = dict(
    job_id="j", company_id="Acme", company_name="Acme Trading", tier="S", role_family="trading_systems_engineer", role_confidence=0.9, status="open", status_confidence=0.9, age_days=0, source_type="greenhouse",
    title_f="software engineer intern, trading systems", body_f="build low latency market data systems in c++ and python.", eligibility=85.0,
    prestige=90.0, role_fit=96.5, technical_depth=68.0, freshness=100.0, visibility=35.0, hidden_gem=72.6, status_open=100.0, opportunity=87.75,
)
KINDS = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in ROW.items())
OWN = "o int, job_id string, tier string, role_family string, status string"


@pytest.fixture(scope="module")
def applied(spark):
    def run(rows=(ROW,), firm=("Acme", "Acme Trading", ["AC"], None), of_firms=(), of_config=(), own=()):
        jobs = spark.createDataFrame([tuple((ROW | r).values()) for r in rows], KINDS)
        firms = spark.createDataFrame([firm], "company_id string, name string, aliases array<string>, default_tier string")
        keyed = spark.createDataFrame(list(of_firms), "o int, key string, tier string, notes string")
        config = spark.createDataFrame(list(of_config), "o int, key string, tier string")
        return {r.job_id: r for r in overrides.apply(jobs, firms, keyed, config, spark.createDataFrame(list(own), OWN)).collect()}

    return run


def scores(row):
    return {k: row[k] for k in overrides.RESCORED}


def test_nothing_set_changes_nothing(applied):
    row = applied()["j"]
    assert scores(row) == {k: ROW[k] for k in overrides.RESCORED} and not row.rescored and row.tier_source == "pack defaults"
    row = applied(own=[(1, "j", "S", None, None), (1, None, "C", None, None), (1, "other", "C", None, None)])["j"]
    assert scores(row) == {k: ROW[k] for k in overrides.RESCORED} and not row.rescored


def test_a_tier_moves_prestige_gem_and_opportunity(applied):
    row = applied(own=[(1, "j", "tier_5", None, None)])["j"]
    assert (row.tier, row.tier_source, row.prestige, row.visibility, row.hidden_gem, row.opportunity) == ("C", "job/company metadata", 60.0, 88.0, 83.15, 85.28)
    assert (row.role_fit, row.technical_depth, row.freshness) == (96.5, 68.0, 100.0) and row.opportunity_before == 87.75


def test_a_family_and_a_status_by_hand_are_sure(applied):
    row = applied(own=[(1, "j", None, "finance_analyst", None)])["j"]
    assert (row.role_confidence, row.role_fit, row.technical_depth, row.hidden_gem, row.tier) == (1.0, 30.0, 58.0, 20.0, "S")
    row = applied(rows=[{"age_days": 90}], own=[(1, "j", None, None, "closed")])["j"]
    assert (row.status_confidence, row.age_days, row.freshness, row.status_open, row.hidden_gem) == (1.0, 0, 15.0, 0.0, 10.0)
    assert applied(rows=[{"age_days": 90}], own=[(1, "j", None, None, "open")])["j"].freshness == 100.0  # verified today


def test_the_order_of_tiers(applied):
    tier = lambda **given: (lambda r: (r.tier, r.tier_source))(applied(**given)["j"])
    firm = [(2, "ac", "B", "late"), (1, "ACME TRADING", None, "first")]
    assert tier(of_firms=firm) == ("S", "pack defaults")  # the first counts whole: it names no tier
    assert applied(of_firms=firm)["j"].firm_notes == "first"
    assert tier(of_firms=[(1, "ac", " B ", None)]) == ("B", "job/company metadata")
    assert tier(firm=("Acme", "Acme Trading", None, "A"), of_firms=[(1, "ac", "B", None)], own=[(1, "j", "C", None, None)]) == ("C", "job/company metadata")
    assert tier(of_config=[(1, "acme", "nonsense"), (2, "acme trading", "TIER_1")], own=[(1, "j", "C", None, None)]) == ("S+", "user override")
    assert tier(of_config=[(1, "acme", "B"), (2, "ACME", "A"), (3, "acme trading", "C")]) == ("A", "user override")
    assert tier(rows=[{"tier": "Unknown"}]) == ("Unknown", "default")
    assert tier(of_config=[(1, "acme", "Unknown")]) == ("Unknown", "user override")


def test_nulls_and_several_overrides_of_a_posting(applied):
    rows = applied(rows=[{}, {"job_id": "n", "company_id": None, "company_name": None}], own=[(1, "j", "A", None, None), (2, "j", "B", "quant_trading", None)])
    assert rows["j"].tier == "B" and rows["j"].role_family == "quant_trading" and not rows["n"].rescored and len(rows) == 2
