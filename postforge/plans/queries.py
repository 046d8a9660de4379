"""The engine's queries over the derived postings and the driver tables."""

from __future__ import annotations

import uuid
from difflib import SequenceMatcher

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postforge.dialect import DUCK, SPARK
from postforge.functions import fixed as K
from postforge.functions import rules as R
from postforge.operators import discovery, resolve, runs, state
from postforge.plans import catalog, postings, serve
from postforge.session import checkpoint_dir, cut, table

jobs, jobs_sql, normalized_sql = postings.jobs, postings.jobs_sql, postings.normalized_sql


def _both(d, columns: dict) -> list[str]:
    return [f"{e(d) if callable(e) else e} as {n}" for n, e in columns.items()]


def over_jobs(name: str, columns: dict, scored: bool = True) -> None:
    """A projection of the jobs by the same expressions in both dialects."""

    def run(spark, sf_dir):
        base = jobs(spark, sf_dir) if scored else postings.silver(spark, sf_dir)
        return base.selectExpr("ingest_seq", *_both(SPARK, columns))

    sql = (jobs_sql if scored else normalized_sql)(f"select ingest_seq, {', '.join(_both(DUCK, columns))} from jobs")
    catalog.register(name, run, sql)


joined = lambda c: lambda d: d.join(c, "; ")
years = lambda d: d.join(d.transform("graduation_years", "y", "cast(y as string)" if d.name == "spark" else "y::varchar"), ",")

# --- row operators -----------------------------------------------------------------
over_jobs("q_clean_fold_slug", {"title": "title", "folded": lambda d: R.fold(d, "title"), "slug": lambda d: R.slug(d, "title")}, scored=False)
over_jobs("q_url_canonical", {"source_url": "source_url", "apply_url": "apply_url", "same_url": "source_url = apply_url"}, scored=False)
over_jobs("q_url_domain_hash", {"domain": "src_site", "url_hash": lambda d: R.url_hash(d, "source_url")}, scored=False)
over_jobs("q_url_keys", {"ats_key": lambda d: R.ats_key(d, "source_url", "apply_url"), "apply_rank": lambda d: f"cast({R.url_specificity(d, 'apply_url', True)} as bigint)", "source_rank": lambda d: f"cast({R.url_specificity(d, 'source_url', False)} as bigint)", "generic": lambda d: R.generic_url(d, "source_url")}, scored=False)
over_jobs("q_content_hash", {"content_hash": "content_hash"}, scored=False)
over_jobs("q_job_id", {"job_id": "job_id"})
over_jobs("q_season_year", {"season": "season", "year": "year", "confidence": "season_confidence"}, scored=False)
over_jobs("q_locations", {"places": joined("locations"), "remote": "remote_type"}, scored=False)
over_jobs("q_internship", {"program": "coalesce(title_program, description_program)", "is_internship": "is_internship", "confidence": "cast(case when title_program is not null then 0.95 when description_program is not null then 0.6 else 0.0 end as double)"}, scored=False)
over_jobs("q_role_family", {"role_family": "role_family", "role_confidence": "role_confidence", "role_score": "role_score", "role_margin": "role_margin"})
over_jobs("q_degree", {"bachelors": "has_bachelors", "masters": "has_masters", "phd": "has_phd", "needs_masters": "requires_masters", "needs_phd": "requires_phd", "undergrad": "undergrad_friendly"}, scored=False)
over_jobs("q_grad_years", {"years": years}, scored=False)
over_jobs("q_class_years_majors", {"classes": joined("class_years"), "majors": joined("majors"), "early": "early_years"}, scored=False)
over_jobs("q_sponsorship_citizenship_gpa", {"sponsorship": "sponsorship", "citizenship": "citizenship", "gpa": "gpa", "confidence": "eligibility_confidence"}, scored=False)
over_jobs("q_status", {"status": "status", "status_confidence": lambda d: R.status_confidence(d, "body_f", "source_type", "status"), "signal": lambda d: R.first_hit(d, "body_f", (*K.CLOSED_SIGNALS, *K.COMING_SOON_SIGNALS, *K.LOGIN_SIGNALS, *K.OPEN_SIGNALS))}, scored=False)
over_jobs("q_status_unlisted", {"status": lambda d: R.status(d, "body_f", "source_type", listed="saved_raw", age=d.days("posted_at", postings.AS_OF))}, scored=False)
over_jobs("q_scores", {c: c for c in ("prestige", "role_fit", "technical_depth", "freshness", "eligibility", "visibility", "hidden_gem", "status_open")})
over_jobs("q_opportunity_presets", {f"p_{p}": (lambda p: lambda d: R.opportunity(d, p))(p) for p in K.PRESETS} | {"p_custom": lambda d: R.opportunity(d, {"role_fit": 3, "freshness": 1})})
over_jobs("q_needs_review", {"needs_review": serve.needs_review(), "reasons": lambda d: d.join(serve.review_reasons(d), "; ")})
over_jobs("q_low_quality_pages", {"hidden": lambda d: f"source_type = 'custom_page' and status not in ('coming_soon', 'closed', 'stale') and {R.generic_url(d, 'source_url')} and (apply_url = '' or {R.generic_url(d, 'apply_url')})"}, scored=False)


def _candidates(d) -> dict:
    people = (("bachelors", 2027, "computer science", "false", "us"), ("bachelors", 2030, "history", "true", None), ("phd", 2026, "physics", "true", "us"), ("masters", 2027, "electrical engineering", "false", None))
    text = lambda x: "cast(null as string)" if x is None and d.name == "spark" else "null::varchar" if x is None else d.lit(x)
    return {f"match_{i}": R.candidate_match(d, text(p[0]), str(p[1]), text(p[2]), p[3], text(p[4])) for i, p in enumerate(people)}


over_jobs("q_candidate_match", {k: (lambda k: lambda d: _candidates(d)[k])(k) for k in _candidates(SPARK)}, scored=False)

# --- serving -------------------------------------------------------------------------
CORE = "ingest_seq, company_name, title, status, opportunity"
_desc = "opportunity desc, company_name desc, title desc, ingest_seq"


def _register_job_query(name, build, sql, cols=CORE):
    catalog.register(name, lambda spark, sf_dir: build(jobs(spark, sf_dir)), jobs_sql(sql))


def top_open(df):
    return serve.page(serve.filtered(df, is_internship=None).where("status in ('open', 'likely_open')"), limit=20).selectExpr(*CORE.split(", "), "tier", "role_family")


_register_job_query("q_top_open", top_open, f"select {CORE}, tier, role_family from jobs where status in ('open', 'likely_open') order by {_desc} limit 20")
_register_job_query(
    "q_filter_all",
    lambda df: serve.filtered(df, status="Open", location="new york", source_type="greenhouse", min_opportunity=40.0, sponsorship="unknown", search="trading").selectExpr(*CORE.split(", ")),
    f"select {CORE} from jobs where status = 'open' and len(list_filter(locations, lambda x: contains(lower(x), 'new york'))) > 0 and source_type = 'greenhouse' and opportunity >= 40 and sponsorship = 'unknown' and contains(lower(concat_ws(' ', company_name, title, role_family, description, source_type, status)), 'trading')",
)
_register_job_query("q_search", lambda df: serve.filtered(df, search="FPGA").selectExpr(*CORE.split(", ")), f"select {CORE} from jobs where contains(lower(concat_ws(' ', company_name, title, role_family, description, source_type, status)), 'fpga')")
_register_job_query("q_page_2", lambda df: serve.page(df, limit=50, offset=50).selectExpr(*CORE.split(", ")), f"select {CORE} from jobs order by {_desc} limit 50 offset 50")
for _sort, _keys in serve.SORTS.items():
    _o = ", ".join(f"{k} desc" for k in (*_keys, "company_name", "title")) + ", ingest_seq"
    _register_job_query(f"q_sort_{_sort}", (lambda s: lambda df: serve.ranked(df, s, 100).selectExpr("rank", "ingest_seq", "title"))(_sort), f"select row_number() over (order by {_o}) rank, ingest_seq, title from jobs order by {_o} limit 100")
_register_job_query("q_sort_company", lambda df: serve.ranked(df, "company", 100).selectExpr("rank", "ingest_seq", "title"), "select row_number() over (order by company_name, title, ingest_seq) rank, ingest_seq, title from jobs order by company_name, title, ingest_seq limit 100")
_register_job_query("q_best_fits", lambda df: df.orderBy(F.desc(F.col("role_fit") + F.col("technical_depth")), F.desc("opportunity"), "ingest_seq").limit(10).selectExpr(*CORE.split(", ")), f"select {CORE} from jobs order by role_fit + technical_depth desc, opportunity desc, ingest_seq limit 10")
_register_job_query("q_gems", lambda df: df.where("hidden_gem >= 70 and status <> 'closed'").selectExpr(*CORE.split(", "), "hidden_gem"), f"select {CORE}, hidden_gem from jobs where hidden_gem >= 70 and status <> 'closed'")
_register_job_query("q_summary", serve.summary, "select count(*) total, count(*) filter (status = 'open') open, count(*) filter (status = 'likely_open') likely_open, count(*) filter (status = 'coming_soon') coming_soon, count(*) filter (status = 'closed') closed, count(*) filter (status in ('unknown', 'requires_login')) unknown, count(*) filter (hidden_gem >= 70) gems, count(*) filter (" + serve.needs_review() + ") review_needed, count(*) filter (is_internship) internships from jobs")
_facet_sql = " union ".join(f"select '{c}' facet, {c}::varchar as value from jobs where {c} is not null" for c in ("status", "role_family", "company_name", "tier", "season", "year", "source_type", "remote_type", "sponsorship")) + " union select 'location', unnest(locations) from jobs"
_register_job_query("q_facets", serve.facets, _facet_sql)
_register_job_query("q_status_counts", lambda df: df.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status"), "select status, count(*) n from jobs group by 1")
_register_job_query("q_source_counts", lambda df: df.groupBy("source_type").agg(F.count("*").alias("n")), "select source_type, count(*) n from jobs group by 1")


def chart(df, column: str, limit: int = 8):
    """AGG-04: most common values; ties by the best-ranked row of the opportunity order."""
    best = F.max(F.struct("opportunity", "company_name", "title", (-F.col("ingest_seq")).alias("s")))
    return df.groupBy(column).agg(F.count("*").alias("n"), best.alias("best")).orderBy(F.desc("n"), F.desc("best")).limit(limit).select(F.col(column).alias("label"), "n")


for _c in ("role_family", "company_name"):
    _register_job_query(f"q_chart_{_c}", (lambda c: lambda df: chart(df, c))(_c), f"select {_c} as label, count(*) n from (select *, row_number() over (order by {_desc}) r from jobs) group by 1 order by n desc, min(r) limit 8")
_register_job_query("q_review_queue", lambda df: serve.review_queue(df).selectExpr("ingest_seq", "n_reasons", "title", f"{SPARK.join('reasons', '; ')} as reasons"), f"select ingest_seq, len(r) n_reasons, title, array_to_string(r, '; ') reasons from (select *, {serve.review_reasons(DUCK)} r from jobs) where len(r) > 0 order by len(r) desc, hidden_gem desc, opportunity desc, company_name, title, ingest_seq limit 50")
_register_job_query("q_export_view", serve.export_view, f"select {', '.join(f'{e} as {n}' for n, e in serve.export_columns(DUCK).items())} from jobs")


def explanation(d) -> str:
    """SCO-11 for the default preset, without the classifier's wording."""
    weights = K.PRESETS[K.DEFAULT_PRESET]
    num = (lambda k: f"cast(cast(floor({k} + 0.5) as bigint) as string)") if d.name == "spark" else (lambda k: f"floor({k} + 0.5)::bigint::varchar")
    parts = [f"{'named_struct' if d.name == 'spark' else 'struct_pack'}({a}, {b}, {c})" for a, b, c in ((("'w', -(%s * %s)" % (k, w)), f"'k', {d.lit(k)}", f"'s', {num(k)}") if d.name == "spark" else ((f"w := -({k} * {w})"), f"k := {d.lit(k)}", f"s := {num(k)}") for k, w in weights.items())]
    top = d.slice(d.sort(d.array(parts)), 3)
    return d.join(d.transform(top, "x", "concat(x.k, ' ', x.s)" if d.name == "spark" else "concat(struct_extract(x, 'k'), ' ', struct_extract(x, 's'))"), "; ")


over_jobs("q_explanation", {"why": explanation})

# --- joins and overrides -----------------------------------------------------------------


def firms(spark, sf_dir):
    rows = [(f"firm-{i}", n, [n.split()[0]], "S" if i % 5 == 0 else None) for i, n in enumerate(postings.FIRMS)]
    return spark.createDataFrame(rows, "company_id string, name string, aliases array<string>, default_tier string")


_FIRMS_SQL = ", ".join("('firm-%d', '%s', ['%s'], %s)" % (i, n.replace("'", "''"), n.split()[0].replace("'", "''"), "'S'" if i % 5 == 0 else "null") for i, n in enumerate(postings.FIRMS))
_FIRMS_CTE = f"firms(company_id, name, aliases, default_tier) as (values {_FIRMS_SQL})"
#: Overrides of firms (key, tier) in file order, and of postings (seq, family, status).
FIRM_OVERRIDES = ((1, "sundial", "A"), (2, "Northgate", "B"), (3, "firm-0", "C"), (4, "drw", "S+"))
JOB_OVERRIDES = ((5, "quant_trading", None), (12, None, "closed"), (31, "fpga_engineer", "open"))


def firm_join(spark, sf_dir):
    """JOIN-01/08/09, SCO-01: tier by firm default, else tier list; a firm table is bounded by the pack."""
    tiers = spark.createDataFrame([(n.lower(), t, i) for i, (t, names) in enumerate(K.TIERS.items()) for n in names], "token string, tier_listed string, o int")
    f = firms(spark, sf_dir)
    tokens = f.select("company_id", F.explode(F.concat(F.array("name"), "aliases")).alias("token")).select("company_id", F.lower("token").alias("token"))
    listed = tokens.join(tiers, "token").groupBy("company_id").agg(F.min_by("tier_listed", "o").alias("tier_listed"))
    dim = f.join(listed, "company_id", "left").select("company_id", "name", F.coalesce("default_tier", "tier_listed", F.lit("Unknown")).alias("firm_tier"))
    return postings.postings(spark, sf_dir).select("ingest_seq", "company_id").join(F.broadcast(dim), "company_id", "left")


catalog.register(
    "q_firm_join", firm_join,
    "with " + _FIRMS_CTE + ", tiers(token, tier, o) as (values " + ", ".join("('%s', '%s', %d)" % (n.lower(), t, i) for i, (t, ns) in enumerate(K.TIERS.items()) for n in ns) + f"), p as (select {postings.postings_columns(DUCK)['ingest_seq']} ingest_seq, {postings.postings_columns(DUCK)['company_id']} company_id from part), "
    "tok as (select company_id, lower(unnest(list_concat([name], aliases))) token from firms), l as (select company_id, arg_min(tier, o) tier from tok join tiers using (token) group by 1) "
    "select p.ingest_seq, p.company_id, f.name, coalesce(f.default_tier, l.tier, 'Unknown') firm_tier from p left join firms f using (company_id) left join l using (company_id)",
)


def overrides(spark, sf_dir):
    """JOIN-05/06, OVR-01: first key in file order wins; a posting's own override beats its firm's."""
    f = firms(spark, sf_dir)
    tokens = f.select("company_id", F.explode(F.concat(F.array("company_id", "name"), "aliases")).alias("t")).select("company_id", F.lower("t").alias("key"))
    keys = spark.createDataFrame([(o, k.lower(), t) for o, k, t in FIRM_OVERRIDES], "o int, key string, tier_set string")
    firm = tokens.join(F.broadcast(keys), "key").groupBy("company_id").agg(F.min_by("tier_set", "o").alias("tier_set"))
    job = spark.createDataFrame(list(JOB_OVERRIDES), "ingest_seq long, family_set string, status_set string")
    rows = jobs(spark, sf_dir).select("ingest_seq", "company_id", "tier", "role_family", "role_confidence", "status")
    rows = rows.join(F.broadcast(firm), "company_id", "left").join(F.broadcast(job), "ingest_seq", "left")
    return rows.select("ingest_seq", F.coalesce("tier_set", "tier").alias("tier"), F.coalesce("family_set", "role_family").alias("role_family"), F.when(F.col("family_set").isNotNull(), 1.0).otherwise(F.col("role_confidence")).alias("role_confidence"), F.coalesce("status_set", "status").alias("status"))


_q = lambda v: "null" if v is None else f"'{v}'"
catalog.register(
    "q_overrides", overrides,
    jobs_sql("select j.ingest_seq, coalesce(fo.tier_set, tier) tier, coalesce(jo.family_set, role_family) role_family, case when jo.family_set is not null then 1.0 else role_confidence end::double role_confidence, coalesce(jo.status_set, status) status from jobs j left join ("
    f"with {_FIRMS_CTE}, tok as (select company_id, lower(unnest(list_concat([company_id, name], aliases))) k from firms), o(o, k, t) as (values {', '.join(f'({a}, {_q(b.lower())}, {_q(c)})' for a, b, c in FIRM_OVERRIDES)}) select company_id, arg_min(t, o) tier_set from tok join o using (k) group by 1) fo using (company_id) "
    f"left join (values {', '.join(f'({a}, {_q(b)}, {_q(c)})' for a, b, c in JOB_OVERRIDES)}) jo(ingest_seq, family_set, status_set) on jo.ingest_seq = j.ingest_seq"),
)
over_jobs("q_ignored", {"ignored": "lower(company_name) in ('sundial', 'copper lane') or contains(title_f, 'campus') or contains(body_f, 'marketing')"}, scored=False)


def import_comparison(spark, sf_dir):
    """JOIN-10/11, SET-02: customers that never ordered (anti join), by segment."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("unseen"), F.count_distinct(F.lower("c_name")).alias("names"))


catalog.register("q_import_unknown", import_comparison, "select c_mktsegment, count(*) unseen, count(distinct lower(c_name)) as names from customer where c_custkey not in (select o_custkey from orders) group by 1")
catalog.register("q_visibility", lambda s, d: postings.silver(s, d).groupBy(F.lower(F.concat_ws("::", "company_name", "title")).alias("k")).agg(F.count("*").alias("sources")), normalized_sql("select lower(concat_ws('::', company_name, title)) k, count(*) sources from jobs group by 1"))
catalog.register("q_missing_fields", lambda s, d: postings.silver(s, d).agg(*[F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"no_{c}") for c in ("description", "apply_url", "department", "ats_id")]), normalized_sql("select " + ", ".join(f"count(*) filter (coalesce(trim({c}), '') = '') no_{c}" for c in ("description", "apply_url", "department", "ats_id")) + " from jobs"))
catalog.register("q_dup_names", lambda s, d: table(s, d, "part").groupBy(F.lower(F.split("p_name", " ")[0]).alias("k")).agg(F.count("*").alias("n"), F.min_by("p_name", "p_partkey").alias("first_spelling")).where("n > 1"), "select lower(string_split(p_name, ' ')[1]) k, count(*) n, arg_min(p_name, p_partkey) first_spelling from part group by 1 having count(*) > 1")

# --- entity resolution ---------------------------------------------------------------------


def _norm(spark, sf_dir):
    return postings.silver(spark, sf_dir)


_PAIRS_SQL = f"""k as (select company_id, ingest_seq, apply_url a, source_url u, {R.ats_key(DUCK, 'source_url', 'apply_url')} b, lower(title) t, year y, locations from jobs),
g as (select 'same canonical apply URL' reason, company_id, a k, ingest_seq from k where a <> '' union all select 'same ATS job ID', company_id, b, ingest_seq from k where b is not null
  union all select 'same canonical source URL', company_id, u || chr(1) || t, ingest_seq from k where u <> ''
  union all select 'same company, same title, and overlapping location', company_id, t || chr(1) || coalesce(y::varchar, 'none') || chr(1) || lower(l), ingest_seq from (select company_id, t, y, ingest_seq, unnest(locations) l from k)),
f as (select reason, company_id, k, min(ingest_seq) a from g group by all),
links as (select distinct f.a, g.ingest_seq b, reason from g join f using (reason, company_id, k) where g.ingest_seq > f.a)"""
catalog.register("q_pairs_exact", lambda s, d: resolve.exact_links(_norm(s, d)), normalized_sql("select * from links").replace(" select * from links", f", {_PAIRS_SQL} select * from links"))
# the rule text over every pair of a firm's rows: which rules hold, then the veto
_RULES_SQL = f"""k as (select company_id, ingest_seq s, apply_url a, source_url u, {R.ats_key(DUCK, 'source_url', 'apply_url')} b, lower(title) t, year y, list_transform(locations, lambda l: lower(l)) ls from jobs),
p as (select x.s s1, z.s s2, x.a = z.a and x.a <> '' r1, x.u = z.u and x.u <> '' and x.t = z.t r2, coalesce(x.b = z.b, false) r3, x.t = z.t and list_has_any(x.ls, z.ls) r6, x.t = z.t and x.y is distinct from z.y veto
  from k x join k z on x.company_id = z.company_id and x.s < z.s),
l as (select s1 a, s2 b from p where r1 or r2 or r3 or (r6 and not veto))"""
_RECURSIVE = normalized_sql("select 1").replace("with ", "with recursive ", 1).removesuffix(" select 1") + f", {_RULES_SQL}, e as (select a, b from l union select b, a from l), r as (select a n, a c from e union select e.b, r.c from r join e on e.a = r.n where r.c < e.b), comp as (select n ingest_seq, min(c) cluster from r group by 1)"
catalog.register("q_components_exact", lambda s, d: resolve.clusters(resolve.exact_links(_norm(s, d))), f"{_RECURSIVE} select ingest_seq, cluster from comp")


def _similar_values() -> str:
    """(t1, t2, ratio) of the view's titles that are not equal, by the plain matcher over all pairs."""
    titles = sorted({" ".join(t.split()).lower() for t in postings.TITLES})
    rows = [(a, b, SequenceMatcher(None, a, b).ratio() * 100) for a in titles for b in titles if a != b]
    return ", ".join(f"({DUCK.lit(a)}, {DUCK.lit(b)}, {r!r})" for a, b, r in rows if r > K.LIKELY_SIMILARITY)


# every rule over every pair of a firm's rows; the title that a firm had first stands first in the ratio
_ALL_RULES_SQL = f"""sims as (select * from (values {_similar_values()}) v(t1, t2, ratio)),
k as (select company_id, ingest_seq s, apply_url a, source_url u, {R.ats_key(DUCK, 'source_url', 'apply_url')} b, lower(title) t, season n, year y, list_transform(locations, lambda l: lower(l)) ls, min(ingest_seq) over (partition by company_id, lower(title)) t0 from jobs),
p as (select x.s s1, z.s s2, x.a = z.a and x.a <> '' r1, coalesce(x.b = z.b, false) r3, x.t = z.t and list_has_any(x.ls, z.ls) r6, case when x.t = z.t then 100 else coalesce(m.ratio, 0) end sim,
  x.u = z.u and x.u <> '' same_url, x.y is distinct from z.y odd_years, x.y = z.y and x.n is not distinct from z.n same_season
  from k x join k z on x.company_id = z.company_id and x.s < z.s left join sims m on m.t1 = case when x.t0 < z.t0 then x.t else z.t end and m.t2 = case when x.t0 < z.t0 then z.t else x.t end),
q as (select *, same_url and sim > {K.SURE_SIMILARITY} r2, sim > {K.SURE_SIMILARITY} r4, sim > {K.LIKELY_SIMILARITY} and sim <= {K.SURE_SIMILARITY} and coalesce(same_season, false) r5 from p),
l as (select s1 a, s2 b from q where r1 or r2 or r3 or ((r4 or r5 or r6) and not (sim > {K.LIKELY_SIMILARITY} and odd_years)))"""
_ALL_RECURSIVE = _RECURSIVE.replace(_RULES_SQL, _ALL_RULES_SQL)
catalog.register("q_components_similar", lambda s, d: _resolved(s, d), f"{_ALL_RECURSIVE} select ingest_seq, cluster from comp")
catalog.register("q_titles_similar", lambda s, d: resolve.similar_titles(_norm(s, d)), f"{_ALL_RECURSIVE} select distinct x.company_id, sims.t1, sims.t2, ratio::double similarity from k x join k z using (company_id) join sims on sims.t1 = x.t and sims.t2 = z.t where x.t0 < z.t0")


def _resolved(spark, sf_dir):
    return resolve.clusters(resolve.all_links(_norm(spark, sf_dir)))


def survivors(spark, sf_dir):
    found = resolve.survivors(jobs(spark, sf_dir), _resolved(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, "; ") for c in ("locations", "tags")})


def _survivors_sql() -> str:
    top = lambda c, *keys: f"arg_max({c}, {{{', '.join(f'{chr(39)}k{i}{chr(39)}: {k}' for i, k in enumerate((*keys, '-ingest_seq')))}}}) {c}"
    cte = jobs_sql("select 1").replace("with ", "with recursive ", 1).removesuffix(" select 1") + _ALL_RECURSIVE[_ALL_RECURSIVE.index(", sims as (") :]
    ps, pt = resolve.priority(DUCK, "source_type", K.SOURCE_PRIORITY, 2), resolve.priority(DUCK, "status", K.STATUS_PRIORITY, 0)
    primary = ("p_source", "n_text", "status_confidence", "role_confidence")
    return f"""{cte}, m as (select j.*, cluster, {ps} p_source, {pt} p_status, length(description) n_text, {R.url_specificity(DUCK, 'apply_url', True)} u_apply, {R.url_specificity(DUCK, 'source_url', False)} u_source from jobs j join comp using (ingest_seq)),
x as (select cluster, ingest_seq, unnest(locations) v, unnest(range(len(locations))) i from m), y as (select cluster, arg_min(v, {{'a': ingest_seq, 'b': i}}) v, min({{'a': ingest_seq, 'b': i}}) o from x group by cluster, lower(v)),
z as (select cluster, string_agg(v, '; ' order by o) locations from y group by cluster),
w as (select cluster, count(*) members, {top('title', *primary)}, {top('company_name', *primary)}, {top('source_type', *primary)}, {top('description', 'n_text')}, {top('status', 'status_confidence', 'p_status')}, {top('role_family', 'role_confidence')}, {top('sponsorship', 'eligibility_confidence')},
  {top('apply_url', 'u_apply')}, {top('source_url', 'u_source')}, min(posted_at) first_seen, max(last_seen) last_seen, max(last_seen) last_verified, case when bool_or(is_internship) then 'internship' else '' end tags from m group by cluster)
select w.*, coalesce(z.locations, '') locations, {resolve.content_hash(DUCK)} content_hash from w left join z using (cluster)"""


catalog.register("q_survivors", survivors, _survivors_sql())
catalog.register("q_members", lambda s, d: resolve.members(_norm(s, d), _resolved(s, d)), f"{_ALL_RECURSIVE} select cluster, ingest_seq, source_type, source_url, row_number() over (partition by cluster order by ingest_seq) place from comp join jobs using (ingest_seq)")
catalog.register("q_resolved_order", lambda s, d: resolve.resolved_order(_norm(s, d), _resolved(s, d)), f"{_ALL_RECURSIVE} select j.ingest_seq, cluster is null single from jobs j left join comp using (ingest_seq) where cluster is null or cluster = j.ingest_seq")


def cluster_reasons(spark, sf_dir):
    links = cut(resolve.exact_links(_norm(spark, sf_dir)))  # read for the clusters, then for their reasons
    return resolve.reasons(links, resolve.clusters(links)).withColumn("reasons", F.array_join("reasons", "; "))


# a group's links name all its rules, so reasons agree with those of all pairs but for pairs that only the veto spared
catalog.register("q_cluster_reasons", cluster_reasons, f"{_RECURSIVE}, {_PAIRS_SQL[_PAIRS_SQL.index('g as (') :].replace('from k', 'from k2')}, q as (select distinct cluster, reason from links join comp on comp.ingest_seq = links.b) select cluster, string_agg(reason, '; ' order by reason) reasons from q group by 1".replace(", g as (", ", k2 as (select company_id, s ingest_seq, a, u, b, t, y, locations from k join (select ingest_seq s, locations from jobs) using (s)), g as (", 1))

# --- action state, runs ------------------------------------------------------------------------
_LOG = {
    "id": "event_id", "job_id": lambda d: "cast(user_id as string)" if d.name == "spark" else "user_id::varchar", "created_at": "ts", "updated_at": "ts",
    "action_type": "case event_type when 'signup' then 'saved' when 'error' then 'ignored' when 'purchase' then 'application_status' when 'view' then 'reviewed' when 'click' then case when event_id % 3 = 0 then 'notes' else 'applied' end end",
    "action_value": "case when event_type = 'purchase' then case event_id % 6 when 0 then 'saved' when 1 then 'applied' when 2 then 'interviewing' when 3 then 'rejected' when 4 then 'ignored' else null end when event_id % 7 = 0 then 'false' end",
    "notes": lambda d: f"case when event_id % 11 = 0 then concat('note ', {'cast(event_id as string)' if d.name == 'spark' else 'event_id::varchar'}) end",
}


def action_log(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_both(SPARK, _LOG))


_LOG_SQL = f"log as (select {', '.join(_both(DUCK, _LOG))} from events)"
_FOLD_SQL = "select job_id, " + ", ".join(f"arg_max_null({v}, {{'a': created_at, 'b': id}}) filter ({t}) {n}" for n, (t, v) in state.TOUCHES.items()) + ", min(created_at) created_at, arg_max(updated_at, {'a': created_at, 'b': id}) updated_at, count(*) n_actions from log group by 1"
catalog.register("q_action_state", lambda s, d: state.fold_actions(action_log(s, d)), f"with {_LOG_SQL} {_FOLD_SQL}")
catalog.register("q_action_effective", lambda s, d: state.fold_actions(action_log(s, d)).selectExpr("job_id", f"{state.effective_status()} as status"), f"with {_LOG_SQL}, f as ({_FOLD_SQL}) select job_id, {state.effective_status()} status from f")
catalog.register("q_action_first_notes", lambda s, d: action_log(s, d).where("notes is not null").groupBy("job_id").agg(F.min_by("notes", F.struct("created_at", "id")).alias("first_note"), F.max_by("notes", F.struct("created_at", "id")).alias("last_note")), f"with {_LOG_SQL} select job_id, arg_min(notes, {{'a': created_at, 'b': id}}) first_note, arg_max(notes, {{'a': created_at, 'b': id}}) last_note from log where notes is not null group by 1")

RUN_CUT = "TIMESTAMP '2024-01-15 00:00:00'"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as job_id", "event_type as status", "cast(value as string) as content_hash", "event_type as role_family", "ts as first_seen", "event_id as seq")
    halves = [e.where(f"first_seen {op} {RUN_CUT}") for op in ("<", ">=")]
    return [state.last_by_seq(h).drop("seq") for h in halves]


_RUNS_SQL = f"e as (select user_id::varchar job_id, event_type status, value, ts, event_id from events), o as (select job_id, arg_max(status, event_id) status, arg_max(value, event_id) v, arg_max(ts, event_id) first_seen from e where ts < {RUN_CUT} group by 1), i as (select job_id, arg_max(status, event_id) status, arg_max(value, event_id) v, arg_max(ts, event_id) first_seen from e where ts >= {RUN_CUT} group by 1), m as (select coalesce(i.job_id, o.job_id) job_id, case when i.job_id is null then o.status else i.status end status, case when i.job_id is null then o.first_seen else least(i.first_seen, o.first_seen) end first_seen, case when o.job_id is null then 'I' when i.job_id is null then 'K' else 'U' end as merge, coalesce(o.job_id is not null and i.job_id is not null and (o.status <> i.status or o.v <> i.v), false) changed from i full join o on i.job_id = o.job_id)"
catalog.register("q_merge_changes", lambda s, d: state.merge_runs(*_runs(s, d)).select("job_id", "status", "first_seen", "merge", "changed"), f"with {_RUNS_SQL} select * from m")
catalog.register("q_run_metrics", lambda s, d: state.merge_runs(*_runs(s, d)).agg(F.count_if(F.col("merge") == "I").alias("inserted"), F.count_if(F.col("merge") == "U").alias("updated"), F.count_if("changed").alias("changed"), F.count_if(F.col("merge") == "K").alias("kept")), f"with {_RUNS_SQL} select count(*) filter (merge = 'I') inserted, count(*) filter (merge = 'U') updated, count(*) filter (changed) changed, count(*) filter (merge = 'K') kept from m")


def stored_runs(spark, sf_dir):
    """Both halves of the events written as runs of one store, then its postings."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    for run in _runs(spark, sf_dir):
        runs.write_run(run, path, "pack", "test")
    return runs.jobs(spark, path).select("job_id", "status", "first_seen")


catalog.register("q_stored_runs", stored_runs, f"with {_RUNS_SQL} select job_id, status, first_seen from m")
catalog.register("q_first_last_seen", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("sightings")), "select user_id, min(ts) first_seen, max(ts) last_seen, count(*) sightings from events group by 1")
catalog.register("q_latest_run", lambda s, d: table(s, d, "events").orderBy(F.desc("event_id")).limit(1).select("event_id", "event_type"), "select event_id, event_type from events order by event_id desc limit 1")
catalog.register("q_lookup_ids", lambda s, d: table(s, d, "events").where(F.col("event_id").isin(1, 7, 77, 777)).select("event_id", "user_id", "event_type"), "select event_id, user_id, event_type from events where event_id in (1, 7, 77, 777)")


def snapshot_diff(spark, sf_dir):
    """STATE-04: each sighting against the one before (window per key)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("before")).where("before is null or before <> event_type")


catalog.register("q_snapshot_diff", snapshot_diff, "select * from (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events) where before is null or before <> event_type")
catalog.register("q_conv_last_turn", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("r")).select("conv_id", "r.turn", "r.role", F.length("r.text").cast("long").alias("n")), "select conv_id, max(turn) turn, arg_max(role, turn) as role, arg_max(length(text), turn)::bigint n from conversations group by 1")
catalog.register("q_json_payload", lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.from_json("props", T.StructType([T.StructField("k", T.LongType())])).getField("k"), F.lit(-1)).alias("k")), "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) k from events")


def _discovery_sql() -> str:
    """The seven templates written out over value lists."""
    values = lambda name, terms: f"{name} as (select * from (values {', '.join(f'({i}, {DUCK.lit(t)})' for i, t in enumerate(terms))}) v(o, v))"
    cte = ", ".join(values(*x) for x in (("season", K.DISCOVERY_SEASONS[:4]), ("role", K.DISCOVERY_ROLES[:8]), ("gem", K.DISCOVERY_GEMS[:8]), ("site", tuple(K.DISCOVERY_DOMAINS.values())[:5]), ("year", ("2027", "2026"))))
    q = lambda x: f"'\"' || {x}.v || '\"'"
    parts = [
        ("season, role", f"{q('season')} || ' ' || {q('role')}"), ("season", f"{q('season')} || ' \"C++\" \"trading systems\" \"intern\"'"), ("season, role, gem", f"{q('season')} || ' ' || {q('role')} || ' ' || {q('gem')}"), ("season, spot, role", f"{q('season')} || ' ' || {q('spot')} || ' ' || {q('role')}"),
        ("year, role", f"{q('year')} || ' ' || {q('role')}"), ("site, season, role", f"site.v || ' ' || {q('season')} || ' ' || {q('role')}"), ("site, season, role, gem", f"site.v || ' ' || {q('season')} || ' ' || {q('role')} || ' ' || {q('gem')}"),
    ]
    selects = [f"select {i} t, [{', '.join(f'{n}.o' for n in names.split(', '))}] o, {text} q from {names}" for i, (names, text) in enumerate(parts)]
    cte += ", spot as (select n_nationkey o, n_name v from nation where n_nationkey < 5)"
    return f"with {cte}, a as ({' union all '.join(selects)}), n as (select *, row_number() over (order by t, o) r from a), u as (select min(r) r, arg_min(q, r) q from n group by lower(q)) select row_number() over (order by r) as position, q as query from u order by r limit 400"


catalog.register("q_discovery_queries", lambda s, d: discovery.discovery_frame(s, limit=400, places=table(s, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("term"))), _discovery_sql())

# --- extensions: not operators of the reference, free in Spark --------------------------------------
catalog.register("ext_daily_actions", lambda s, d: action_log(s, d).groupBy(F.window("created_at", "1 day").alias("w"), "action_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "action_type", "n"), f"with {_LOG_SQL} select date_trunc('day', created_at)::timestamp as day, action_type, count(*) n from log group by all")
catalog.register("ext_revenue_by_nation", lambda s, d: _revenue(s, d), "select n_name, count(*) n, sum(l_quantity::bigint)::bigint quantity from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1")


def _revenue(s, d):
    joined_ = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined_.groupBy("n_name").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
