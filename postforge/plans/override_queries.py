"""Overrides that rescore, over the derived postings; reviewers are the suppliers."""

from __future__ import annotations

from postforge.dialect import DUCK
from postforge.operators import overrides
from postforge.plans import catalog, postings, queries
from postforge.session import table

#: Overrides of firms (order, key, tier, notes) and of the configuration (order, key, tier).
FIRMS = ((1, "SUNDIAL", "A", "seen at the fair"), (2, "Northgate", "tier_4", None), (3, "firm-0", "C", "later, so it does not count"), (4, "drw", "S+", None), (5, "firm-7", "great", None))
CONFIG = ((1, "firm-2", "B"), (2, "FIRM-2", " tier_1 "), (3, "Blue Harbor Markets", "C"), (4, "firm-6", "none"), (5, "helix markets", "unknown"))
#: What a reviewer sets, by key modulo 6: (tier, family, status).
SET = (("A", None, None), (None, "fpga_engineer", None), (None, None, "open"), ("odd", None, "closed"), ("tier_2", "quant_trading", "coming_soon"), (None, None, None))

RESULT = ("ingest_seq", "tier", "tier_source", "role_family", "role_confidence", "status", "status_confidence", "firm_notes", *overrides.RESCORED, "opportunity_before", "rescored")


def _set(field: int) -> str:
    return "case s_suppkey % 6 " + " ".join(f"when {i} then {'null' if row[field] is None else repr(row[field])}" for i, row in enumerate(SET)) + " end"


def reviewed(spark, sf_dir):
    """Overrides of postings, one a reviewer: it sets a posting that its key leads to."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as o", "s_suppkey * 13 % 101 as ingest_seq", f"{_set(0)} as tier", f"{_set(1)} as role_family", f"{_set(2)} as status")


def rescored(spark, sf_dir):
    of_firms = spark.createDataFrame(list(FIRMS), "o int, key string, tier string, notes string")
    of_config = spark.createDataFrame(list(CONFIG), "o int, key string, tier string")
    found = overrides.apply(postings.jobs(spark, sf_dir), queries.firms(spark, sf_dir), of_firms, of_config, reviewed(spark, sf_dir), key="ingest_seq")
    return found.select(*RESULT)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


def twin() -> str:
    """The rule by other means: each candidate key is looked up on its own,
    every row is scored again, and scores come from the rows themselves."""
    label = lambda x: "(select label from labels where spelled = " + f"case when trim({x}) in ('S+', 'S', 'A', 'B', 'C', 'Unknown') then trim({x}) else lower(trim({x})) end)"
    ctes = [
        queries._FIRMS_CTE,
        "labels(spelled, label) as (values ('S+', 'S+'), ('S', 'S'), ('A', 'A'), ('B', 'B'), ('C', 'C'), ('Unknown', 'Unknown'), ('unknown', 'Unknown'), ('tier_1', 'S+'), ('tier_2', 'S'), ('tier_3', 'A'), ('tier_4', 'B'), ('tier_5', 'C'))",
        f"fo(o, k, t, n) as (values {_values(FIRMS)})",
        f"co(o, k, t) as (values {_values(CONFIG)})",
        "cfg as (select lower(k) k, arg_max(t, o) t from co group by 1)",
        f"conf as (select k, {label('t')} t from cfg)",
        "firm as (select f.company_id, f.name, f.default_tier, (select min(o) from fo where lower(fo.k) in (lower(f.company_id), lower(f.name)) or lower(fo.k) in (select lower(unnest(f.aliases)))) first_o from firms f)",
        "firm2 as (select firm.*, fo.t set_t, fo.n notes from firm left join fo on fo.o = first_o)",
        f"mine as (select s_suppkey * 13 % 101 q, arg_max(struct_pack(t := {_set(0)}, f := {_set(1)}, s := {_set(2)}), s_suppkey) m from supplier group by 1)",
        "j0 as (select j.*, m.m.t mt, m.m.f mf, m.m.s ms, coalesce(c1.t, c2.t, c3.t, c4.t) ct, coalesce(m.m.t, firm2.set_t, firm2.default_tier) meta, firm2.notes firm_notes from jobs j "
        "left join mine m on m.q = j.ingest_seq left join firm2 on firm2.company_id = j.company_id left join conf c1 on c1.k = lower(j.company_id) left join conf c2 on c2.k = lower(j.company_name) "
        "left join conf c3 on c3.k = lower(firm2.company_id) left join conf c4 on c4.k = lower(firm2.name))",
        f"j1 as (select *, {label('meta')} lt from j0)",
        "j2 as (select * replace (coalesce(ct, lt, tier) as tier, coalesce(mf, role_family) as role_family, case when mf is null then role_confidence else 1.0 end::double as role_confidence, coalesce(ms, status) as status, "
        "case when ms is null then status_confidence else 1.0 end::double as status_confidence, case when ms is null then age_days else 0 end as age_days), "
        "case when ct is not null then 'user override' when lt is not null then 'job/company metadata' when tier <> 'Unknown' then 'pack defaults' else 'default' end tier_source, opportunity opportunity_before, "
        "mf is not null or ms is not null or coalesce(ct, lt, tier) <> tier rescored from j1)",
    ]
    last = "j2"
    for n, layer in enumerate(overrides.score_layers(DUCK)):
        ctes.append(f"s{n} as materialized (select * replace ({', '.join(f'{e} as {c}' for c, e in layer.items())}) from {last})")
        last = f"s{n}"
    return postings.jobs_sql("").rstrip() + ", " + ", ".join(ctes) + f" select {', '.join(RESULT)} from {last}"


catalog.register("q_overrides_rescored", rescored, twin())
