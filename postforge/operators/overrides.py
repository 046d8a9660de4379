"""Overrides that rescore: tiers by four candidate keys, roles and states set by hand.

Overrides are tables: of firms (o, key, tier, notes), of the configuration
(o, key, tier) and of postings (key column, tier, role_family, status). Those of firms are
resolved against the firms first, so what is joined with the postings is one
row a firm of the pack, which is counted before it is broadcast. Overrides of
postings grow with their reviewers' work and are joined by whatever join their
size calls for. Scores are worked out again only in rows that an override
touches, in the same projection; other rows keep what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postforge.dialect import SPARK
from postforge.functions import fixed as K
from postforge.functions import rules as R
from postforge.session import cut

#: Firms whose resolved tiers are broadcast; a larger pack is joined by a shuffle.
SMALL_PACK = 100_000

#: Stored columns that change with tier, family, status or age.
RESCORED = ("prestige", "role_fit", "technical_depth", "freshness", "visibility", "hidden_gem", "status_open", "opportunity")


def tier_label(d, x: str) -> str:
    """A tier as configured: its label, an alias in any case, or null."""
    bare = f"trim({x})"
    known = ", ".join(d.lit(t) for t in K.TIER_SCORES)
    aliases = " ".join(f"when {d.lit(a)} then {d.lit(t)}" for a, t in K.TIER_ALIASES.items())
    return f"case when {bare} in ({known}) then {bare} else case lower({bare}) {aliases} end end"


def _keys(firms: DataFrame) -> DataFrame:
    names = F.concat(F.array("company_id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return firms.select("company_id", F.explode(F.transform(names, F.lower)).alias("key")).distinct()


def firm_overrides(firms: DataFrame, overrides: DataFrame) -> DataFrame:
    """JOIN-05: (company_id, tier_set, notes) of the first override in file
    order whose key is a firm's id, name or alias; it counts whole, so fields
    that it leaves out are not taken from later ones."""
    keyed = overrides.select("o", F.lower("key").alias("key"), F.col("tier").alias("t"), F.col("notes").alias("n"))
    first = F.min_by(F.struct("t", "n"), "o")
    return _keys(firms).join(keyed, "key").groupBy("company_id").agg(first.alias("f")).select("company_id", F.col("f.t").alias("tier_set"), F.col("f.n").alias("notes"))


def configured(overrides: DataFrame) -> DataFrame:
    """(key, tier) of the configuration: of keys equal but for case the last stands."""
    label = F.expr(tier_label(SPARK, "t"))
    return overrides.groupBy(F.lower("key").alias("key")).agg(F.max_by("tier", "o").alias("t")).select("key", label.alias("configured")).where("configured is not null")


def tiers(postings: DataFrame, firms: DataFrame, of_firms: DataFrame, of_config: DataFrame) -> DataFrame:
    """JOIN-09, SCO-01 up to the posting: (company_id, company_name, configured,
    firm_tier, firm_notes) of each firm that postings name."""
    config = configured(of_config)
    own = firms.select("company_id", "name", "default_tier").join(firm_overrides(firms, of_firms), "company_id", "left")
    out = postings.select("company_id", "company_name").distinct().join(own, "company_id", "left")
    candidates = ("company_id", "company_name", "company_id", "name")  # the posting's own fields come before its firm's
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.lower(c).alias("key")) for i, c in enumerate(candidates)])
    tried = out.select("company_id", "company_name", F.explode(places).alias("p")).select("company_id", "company_name", "p.place", "p.key")
    best = tried.join(config, "key").groupBy("company_id", "company_name").agg(F.min_by("configured", "place").alias("configured"))
    best = best.select(F.col("company_id").alias("id"), F.col("company_name").alias("named"), "configured")
    firm_tier = F.coalesce("tier_set", "default_tier").alias("firm_tier")
    return out.join(best, F.col("company_id").eqNullSafe(F.col("id")) & F.col("company_name").eqNullSafe(F.col("named")), "left").select("company_id", "company_name", "configured", firm_tier, F.col("notes").alias("firm_notes"))


def apply(postings: DataFrame, firms: DataFrame, of_firms: DataFrame, of_config: DataFrame, of_postings: DataFrame, key: str = "job_id", preset: str = K.DEFAULT_PRESET) -> DataFrame:
    """OVR-01: postings with overrides and the scores that follow from them.

    The tier is the configuration's, else the posting's own override, else its
    firm's (overridden or default), else what is stored; ``tier_source`` says
    which. A family or status set by hand has confidence 1, and a status makes
    the posting verified today. Of several overrides of one posting the last
    in order ``o`` stands. ``rescored`` marks the rows worked out again. Null
    keys override nothing; an unknown tier counts as none.
    """
    by_firm = cut(tiers(postings, firms, of_firms, of_config))  # counted, then joined
    if by_firm.count() <= SMALL_PACK:
        by_firm = F.broadcast(by_firm)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("o")))
    own = of_postings.where(F.col(key).isNotNull()).withColumn("__n", last).where("__n = 1")
    own = own.select(key, F.col("tier").alias("__tier"), F.col("role_family").alias("__family"), F.col("status").alias("__status"))
    firm = by_firm.select(F.col("company_id").alias("__id"), F.col("company_name").alias("__name"), "configured", "firm_tier", "firm_notes")
    rows = postings.join(firm, F.col("company_id").eqNullSafe(F.col("__id")) & F.col("company_name").eqNullSafe(F.col("__name")), "left").join(own, key, "left")
    metadata, stored = tier_label(SPARK, "coalesce(__tier, firm_tier)"), "tier"
    resolved = {
        "__new_tier": f"coalesce(configured, {metadata}, {stored})",
        "tier_source": f"case when configured is not null then 'user override' when ({metadata}) is not null then 'job/company metadata' when {stored} <> 'Unknown' then 'pack defaults' else 'default' end",
        "__new_family": "coalesce(__family, role_family)",
        "__new_status": "coalesce(__status, status)",
    }
    rows = rows.withColumns({n: F.expr(e) for n, e in resolved.items()})
    rescored = "__family is not null or __status is not null or not (__new_tier <=> tier)"
    rows = rows.withColumn("rescored", F.expr(rescored)).withColumn("opportunity_before", F.col("opportunity"))
    changes = {
        "role_confidence": "if(__family is null, role_confidence, 1.0D)",
        "status_confidence": "if(__status is null, status_confidence, 1.0D)",
        "age_days": "if(__status is null, age_days, 0)",
        "tier": "__new_tier",
        "role_family": "__new_family",
        "status": "__new_status",
    }
    rows = rows.withColumns({n: F.expr(e) for n, e in changes.items()})
    for layer in score_layers(SPARK, preset):
        rows = rows.withColumns({n: F.expr(f"case when rescored then {e} else {n} end") for n, e in layer.items()})
    return rows.drop(*[c for c in rows.columns if c.startswith("__")], "configured", "firm_tier")


def score_layers(d, preset: str = K.DEFAULT_PRESET) -> list[dict[str, str]]:
    """The scores that depend on tier, family, status or age, in order of need."""
    first = {
        "prestige": R.tier_score(d, "tier"),
        "role_fit": R.role_fit(d, "role_family", "role_confidence"),
        "technical_depth": R.technical_depth(d, "title_f", "body_f", "role_family"),
        "freshness": R.freshness(d, "age_days", "status"),
        "status_open": R.status_open(d, "status"),
    }
    return [first, {"visibility": R.visibility(d, "prestige", "source_type")}, {"hidden_gem": R.hidden_gem(d, "status", "role_family")}, {"opportunity": R.opportunity(d, preset)}]
