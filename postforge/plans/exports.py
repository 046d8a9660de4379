"""Export records and their sections: rows, filters, sheets, reports, summary.

A record is a scored job with its folded workflow state. The twins are written
from the rules, not rendered from the Spark code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.dialect import DUCK, SPARK
from postforge.functions import fixed as K
from postforge.operators import state
from postforge.plans import catalog, serve
from postforge.plans import queries as Q
from postforge.session import cut

ORDER = ("opportunity desc", "lower(company_name) desc", "lower(title) desc", "ingest_seq")
_ORDER_SQL = "opportunity desc, lower(company_name) desc, lower(title) desc, ingest_seq"
FLAGS = ("saved", "applied", "ignored", "reviewed")


def records(spark, sf_dir: str) -> DataFrame:
    """JOIN-02: jobs with folded action state; no action means no flag."""
    states = state.fold_actions(Q.action_log(spark, sf_dir)).select(F.col("job_id").alias("k"), *FLAGS, "notes", "application_status", F.expr(state.effective_status()).alias("shown_status"))
    joined = Q.jobs(spark, sf_dir).drop(*FLAGS).join(states, F.col("ingest_seq").cast("string") == F.col("k"), "left").drop("k")
    flags = {c: F.coalesce(c, F.lit(False)) for c in FLAGS}
    return joined.withColumns(flags | {"shown_status": F.coalesce("shown_status", F.lit("")), "notes": F.coalesce("notes", F.lit(""))})


_RECORDS = f""", {Q._LOG_SQL}, st as ({Q._FOLD_SQL}),
rec as (select j.* exclude (saved_raw), coalesce(st.saved, false) saved, coalesce(st.applied, false) applied, coalesce(st.ignored, false) ignored, coalesce(st.reviewed, false) reviewed, coalesce(st.notes, '') notes,
  case when coalesce(st.application_status, '') <> '' then st.application_status when st.applied then 'applied' when st.saved then 'saved' else '' end shown_status
  from jobs j left join st on st.job_id = j.ingest_seq::varchar) """


def register(name: str, run, sql: str) -> None:
    """``run`` takes records; ``sql`` reads ``rec``."""
    catalog.register(name, lambda spark, sf_dir: run(records(spark, sf_dir)), Q.jobs_sql(_RECORDS + sql))


# --- rows ----------------------------------------------------------------------------


def ordered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows sorted by keys written as SQL."""
    keys = [F.expr(k.removesuffix(" desc")) for k in order]
    return rows.orderBy(*[k.desc() if text.endswith(" desc") else k.asc() for k, text in zip(keys, order, strict=True)])


def numbered(rows: DataFrame, order: tuple[str, ...], name: str = "rank") -> DataFrame:
    """Rows with their place in the order, without gathering them in a task:
    ranges are sorted, each adds the number of rows in the ranges before it."""
    at = cut(ordered(rows, order).select("*", F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % (1 << 33)).alias("__place")))
    before, starts = 0, []
    for r in at.groupBy("__part").count().orderBy("__part").collect():  # one row for each partition
        starts.append((r["__part"], before))
        before += r["count"]
    found = rows.sparkSession.createDataFrame(starts, "__part int, __before long")
    return at.join(F.broadcast(found), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")


def eligibility_text() -> F.Column:
    degrees = F.concat_ws(", ", *[F.when(F.col(f"has_{c}"), F.lit(c)) for c in ("bachelors", "masters", "phd")])
    part = lambda label, text: F.when(text != "", F.concat(F.lit(f"{label}: "), text))
    years = F.array_join(F.transform("graduation_years", lambda y: y.cast("string")), ", ")
    return F.concat_ws(" | ", part("Grad years", years), part("Degrees", degrees), part("Majors", F.array_join(F.slice("majors", 1, 3), ", ")), part("Sponsorship", F.coalesce("sponsorship", F.lit(""))))


def flat_rows(rows: DataFrame) -> DataFrame:
    """PRJ-02: the 27 columns of a flat export row, in order."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return numbered(rows, ORDER).select(
        "rank", F.col("company_name").alias("company"), "title", "role_family", F.lit("").alias("role_subtype"), F.when(F.col("is_internship"), "Yes").otherwise("No").alias("internship"), "status", text("season").alias("season"), text("year").alias("year"),
        F.array_join("locations", ", ").alias("location"), text("remote_type").alias("remote_type"), "apply_url", "source_url", F.col("tier").alias("prestige_tier"), F.col("opportunity").alias("opportunity_score"), F.col("role_fit").alias("role_fit_score"), F.col("technical_depth").alias("technical_depth_score"),
        F.col("eligibility").alias("eligibility_score"), F.col("hidden_gem").alias("hidden_gem_score"), F.col("freshness").alias("freshness_score"), iso("posted_at").alias("first_seen"), iso("last_seen").alias("last_seen"), iso("last_seen").alias("last_verified"), F.col("shown_status").alias("application_status"),
        eligibility_text().alias("eligibility_summary"), F.expr(Q.explanation(SPARK)).alias("why_ranked"), "notes",
    )


register("q_export_rows", flat_rows, f"""
select row_number() over (order by {_ORDER_SQL}) rank, company_name company, title, role_family, '' role_subtype, if(is_internship, 'Yes', 'No') internship, status, coalesce(season, '') season, coalesce(year::varchar, '') as year,
  coalesce(array_to_string(locations, ', '), '') location, coalesce(remote_type, '') remote_type, apply_url, source_url, tier prestige_tier, opportunity opportunity_score, role_fit role_fit_score, technical_depth technical_depth_score,
  eligibility eligibility_score, hidden_gem hidden_gem_score, freshness freshness_score, strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00') first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%S+00:00') last_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%S+00:00') last_verified, shown_status application_status,
  array_to_string(list_filter([case when len(graduation_years) > 0 then 'Grad years: ' || array_to_string(graduation_years, ', ') end,
    case when has_bachelors or has_masters or has_phd then 'Degrees: ' || concat_ws(', ', if(has_bachelors, 'bachelors', null), if(has_masters, 'masters', null), if(has_phd, 'phd', null)) end,
    case when len(majors) > 0 then 'Majors: ' || array_to_string(majors[1:3], ', ') end, 'Sponsorship: ' || nullif(sponsorship, '')], lambda x: x is not null), ' | ') eligibility_summary,
  {Q.explanation(DUCK)} why_ranked, notes
from rec""")  # fmt: skip

PILLS = (("Opportunity", "opportunity"), ("Role Fit", "role_fit"), ("Technical", "technical_depth"), ("Eligibility", "eligibility"), ("Hidden Gem", "hidden_gem"), ("Freshness", "freshness"))


def score_pills(rows: DataFrame) -> DataFrame:
    """PRJ-07: six (label, score) pairs of a record, in order."""
    pills = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), F.col(c).alias("score")) for i, (label, c) in enumerate(PILLS)])
    return rows.select("ingest_seq", F.explode(pills).alias("p")).select("ingest_seq", "p.*")


register("q_score_pills", score_pills, "select ingest_seq, 0 place, 'Opportunity' as label, opportunity score from rec union all select ingest_seq, 1, 'Role Fit', role_fit from rec union all select ingest_seq, 2, 'Technical', technical_depth from rec union all select ingest_seq, 3, 'Eligibility', eligibility from rec union all select ingest_seq, 4, 'Hidden Gem', hidden_gem from rec union all select ingest_seq, 5, 'Freshness', freshness from rec")

SERIAL = "job_id company_id company_name title description apply_url source_url source_type role_family role_confidence season year remote_type status status_confidence sponsorship citizenship gpa eligibility_confidence prestige role_fit technical_depth hidden_gem freshness eligibility opportunity tier is_internship content_hash".split()


def serialised(rows: DataFrame) -> DataFrame:
    """PRJ-01: one record as the API serves it: flat fields, lists as text, flags, review need."""
    return rows.select(*SERIAL, *[F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) for c in ("locations", "majors", "class_years", "graduation_years")], *FLAGS, F.col("shown_status").alias("application_status"), F.expr(serve.needs_review()).alias("needs_review"))


_SERIAL_SQL = f"""select {', '.join(SERIAL)}, {', '.join(f"coalesce(array_to_string({c}, '|'), '') {c}" for c in ('locations', 'majors', 'class_years', 'graduation_years'))}, saved, applied, ignored, reviewed, shown_status application_status,
  (status = 'unknown' or status = 'requires_login' or role_confidence < {K.LOW_ROLE_CONFIDENCE} or eligibility_confidence < {K.LOW_ELIGIBILITY_CONFIDENCE} or description = '' or year is null) needs_review from rec"""
register("q_serialised", serialised, _SERIAL_SQL)


def detail(rows: DataFrame, job_id: str) -> DataFrame:
    """PRJ-05: the record of one job; hidden (FLT-04) and demo (FLT-03) rows read as missing."""
    return serialised(visible(rows).where(F.col("job_id") == job_id))


def demo(payload: str = "raw_payload") -> F.Column:
    """FLT-03: is the captured payload marked as artificial demo data?"""
    return F.coalesce(F.get_json_object(payload, "$.artificial_demo_data"), F.lit("false")) == "true"


def with_payload(rows: DataFrame) -> DataFrame:
    """Records with the payload that they came with (every 23rd posting of the view is a demo)."""
    return rows.withColumn("raw_payload", F.to_json(F.struct((F.col("ingest_seq") % 23 == 0).alias("artificial_demo_data"), "source_url")))


def visible(rows: DataFrame) -> DataFrame:
    return with_payload(rows).where(~demo())


register("q_not_demo", lambda rows: visible(rows).select("ingest_seq", "job_id"), "select ingest_seq, job_id from rec where ingest_seq % 23 <> 0")
register("q_detail", lambda rows: detail(rows, "firm-5-github-list-5"), "select * from (" + _SERIAL_SQL + " where ingest_seq % 23 <> 0) where job_id = 'firm-5-github-list-5'")

# --- filters and sections ----------------------------------------------------------------


def export_filter(rows: DataFrame, status: str | None = None, hidden_gems: bool = False, saved: bool = False, applied: bool = False, include_closed: bool = False) -> DataFrame:
    """FLT-02: closed ones stay out unless they, a status or applied ones are asked for."""
    tests = [F.lit(True)]
    if not include_closed and status is None and not applied:
        tests.append(F.col("status") != "closed")
    if status is not None:
        tests.append(F.lower("status") == status.strip().lower())
    tests += [test for asked, test in ((hidden_gems, F.col("hidden_gem") >= K.GEM_THRESHOLD), (saved, F.col("saved")), (applied, F.col("applied"))) if asked]
    return rows.where(reduce(lambda a, b: a & b, tests))


for _name, _options, _where in (
    ("default", {}, "status <> 'closed'"),
    ("closed", {"include_closed": True}, "true"),
    ("status", {"status": " Coming_Soon "}, "status = 'coming_soon'"),
    ("gems", {"hidden_gems": True}, "status <> 'closed' and hidden_gem >= 70"),
    ("saved", {"saved": True}, "status <> 'closed' and saved"),
    ("applied", {"applied": True}, "applied"),
):
    register(f"q_export_{_name}", (lambda o: lambda rows: export_filter(rows, **o).select("ingest_seq", "status", "hidden_gem", "saved", "applied"))(_options), f"select ingest_seq, status, hidden_gem, saved, applied from rec where {_where}")

#: FLT-11: sheets of the workbook, in order.
SHEETS = {"Open Jobs": "status in ('open', 'likely_open')", "Hidden Gems": f"hidden_gem >= {K.GEM_THRESHOLD}", "Coming Soon": "status = 'coming_soon'", "Saved": "saved", "Applied": "applied", "Closed": "status = 'closed'", "All Jobs": "true"}


def sheets(rows: DataFrame) -> dict[str, DataFrame]:
    return {name: rows.where(test) for name, test in SHEETS.items()}


def sheet_rows(rows: DataFrame) -> DataFrame:
    """(sheet, ingest_seq) in one pass over the records."""
    names = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in SHEETS.items()]))
    return rows.select(F.explode(names).alias("sheet"), "ingest_seq")


register("q_sheets", sheet_rows, "select 'Open Jobs' sheet, ingest_seq from rec where status = 'open' or status = 'likely_open' union all select 'Hidden Gems', ingest_seq from rec where hidden_gem >= 70 union all select 'Coming Soon', ingest_seq from rec where status = 'coming_soon' union all select 'Saved', ingest_seq from rec where saved union all select 'Applied', ingest_seq from rec where applied union all select 'Closed', ingest_seq from rec where status = 'closed' union all select 'All Jobs', ingest_seq from rec")

#: FLT-11: sections of the report: (condition, order, rows). Each is a top-k.
_FITS = ("role_fit + technical_depth desc", *ORDER)
SECTIONS = {
    "Top open": ("status in ('open', 'likely_open')", ORDER, 12),
    "Hidden gems": (f"hidden_gem >= {K.GEM_THRESHOLD}", ORDER, 8),
    "Best fits": ("true", _FITS, 10),
    "Coming soon": ("status = 'coming_soon'", ORDER, 8),
    "Review needed": ("status in ('unknown', 'requires_login') or eligibility_confidence = 0 or year is null", ORDER, 10),
}


def sections(rows: DataFrame) -> dict[str, DataFrame]:
    return {name: ordered(rows.where(test), order).limit(n) for name, (test, order, n) in SECTIONS.items()}


def section_rows(rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("section"), "ingest_seq") for name, df in sections(rows).items()])


_TOP = "(select '{0}' section, ingest_seq from rec where {1} order by {2} limit {3})"
register("q_report_sections", section_rows, " union all ".join((
    _TOP.format("Top open", "status in ('open', 'likely_open')", _ORDER_SQL, 12), _TOP.format("Hidden gems", "hidden_gem >= 70", _ORDER_SQL, 8), _TOP.format("Best fits", "true", "role_fit + technical_depth desc, " + _ORDER_SQL, 10),
    _TOP.format("Coming soon", "status = 'coming_soon'", _ORDER_SQL, 8), _TOP.format("Review needed", "status = 'unknown' or status = 'requires_login' or eligibility_confidence = 0 or year is null", _ORDER_SQL, 10),
)))


def export_metadata(rows: DataFrame) -> DataFrame:
    """AGG-05: the counts that go with an export, in one pass."""
    n = lambda test: F.count_if(F.expr(test))
    return rows.agg(F.count("*").alias("total"), *[n(f"status = '{s}'").alias(s) for s in ("open", "likely_open", "coming_soon", "closed")], n(SHEETS["Hidden Gems"]).alias("hidden_gems"), n("saved").alias("saved"), n("applied").alias("applied"), n("status in ('unknown', 'requires_login') or eligibility_confidence = 0").alias("review_needed"))


register("q_export_metadata", export_metadata, "select count(*) total, sum((status = 'open')::bigint)::bigint open, sum((status = 'likely_open')::bigint)::bigint likely_open, sum((status = 'coming_soon')::bigint)::bigint coming_soon, sum((status = 'closed')::bigint)::bigint closed, sum((hidden_gem >= 70)::bigint)::bigint hidden_gems, sum(saved::bigint)::bigint saved, sum(applied::bigint)::bigint applied, sum((status = 'unknown' or status = 'requires_login' or eligibility_confidence = 0)::bigint)::bigint review_needed from rec")


def workbook_summary(rows: DataFrame) -> DataFrame:
    """AGG-06: (place, label, value) of the summary sheet; the most common
    values as ``name (n)``, of equal ones those that come first in the order."""
    counts = rows.agg(F.count("*").alias("Total jobs"), *[F.count_if(F.expr(t)).alias(label) for label, t in (("Open jobs", "status = 'open'"), ("Likely open jobs", "status = 'likely_open'"), ("Coming soon jobs", "status = 'coming_soon'"), ("Closed jobs", "status = 'closed'"), ("Unknown jobs", "status = 'unknown'"), ("Hidden gems count", SHEETS["Hidden Gems"]), ("Saved count", "saved"), ("Applied count", "applied"))])
    flat = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for i, c in enumerate(counts.columns)])).alias("r")).select("r.*")
    best = F.max(F.struct("opportunity", F.lower("company_name").alias("c"), F.lower("title").alias("t"), (-F.col("ingest_seq")).alias("s")))
    for i, (column, label) in enumerate((("role_family", "Top role families"), ("company_name", "Top companies by count"))):
        top = rows.groupBy(column).agg(F.count("*").alias("n"), best.alias("best")).orderBy(F.desc("n"), F.desc("best")).limit(5)
        text = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n", "best", F.concat(column, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("x"))))), lambda r: r["x"]), ", ")
        flat = flat.unionByName(top.agg(text.alias("value")).select(F.lit(9 + i).alias("place"), F.lit(label).alias("label"), "value"))
    return flat


_TOP5 = f"(select {{1}} place, '{{2}}' as label, string_agg({{0}} || ' (' || n || ')', ', ' order by n desc, r) as value from (select {{0}}, count(*) n, min(r) r from (select *, row_number() over (order by {_ORDER_SQL}) r from rec) group by 1 order by n desc, r limit 5))"
register("q_workbook_summary", workbook_summary, " union all ".join([*(f"select {i}, '{label}', count(*) filter ({test})::varchar from rec" if i else f"select 0 place, '{label}' as label, count(*)::varchar as value from rec" for i, (label, test) in enumerate((("Total jobs", ""), ("Open jobs", "status = 'open'"), ("Likely open jobs", "status = 'likely_open'"), ("Coming soon jobs", "status = 'coming_soon'"), ("Closed jobs", "status = 'closed'"), ("Unknown jobs", "status = 'unknown'"), ("Hidden gems count", "hidden_gem >= 70"), ("Saved count", "saved"), ("Applied count", "applied")))), _TOP5.format("role_family", 9, "Top role families"), _TOP5.format("company_name", 10, "Top companies by count")]))

# --- review ------------------------------------------------------------------------------


def review_filter(rows: DataFrame, status: str | None = None, hidden_gems: bool = False, low_confidence: bool = False, include_all: bool = False) -> DataFrame:
    """FLT-09: unreviewed records by status, high gems, low confidence; those without a reason only if all are asked for."""
    found = rows.where("not reviewed").withColumn("why", F.expr(serve.review_reasons(SPARK)))
    tests = [F.lit(True)]
    if status and status.strip():
        tests.append(F.lower("status") == status.lower())
    if hidden_gems:
        tests.append(F.col("hidden_gem") >= K.QUEUE_GEM)
    if low_confidence:
        tests.append(F.exists("why", lambda r: F.contains(r, F.lit("low-confidence")) | (r == "unknown status")))
    if not include_all:
        tests.append(F.size("why") > 0)
    return found.where(reduce(lambda a, b: a & b, tests))


_DOUBT = f"(status = 'unknown' or status = 'requires_login' or role_confidence < {K.LOW_ROLE_CONFIDENCE} or eligibility_confidence < {K.LOW_ELIGIBILITY_CONFIDENCE})"
_REASON = f"({_DOUBT} or description = '' or season is null or year is null or hidden_gem >= {K.QUEUE_GEM})"
for _name, _options, _where in (("all", {"include_all": True}, "true"), ("reason", {}, _REASON), ("gems", {"hidden_gems": True}, f"hidden_gem >= {K.QUEUE_GEM}"), ("low", {"low_confidence": True}, _DOUBT), ("closed", {"status": "Closed"}, f"status = 'closed' and {_REASON}")):
    register(f"q_review_{_name}", (lambda o: lambda rows: review_filter(rows, **o).select("ingest_seq", "title"))(_options), f"select ingest_seq, title from rec where not reviewed and {_where}")

# --- names as typed to names as stored ----------------------------------------------------


def aliased(column: str, aliases: dict[str, str]) -> F.Column:
    """STR-22/23: trimmed and folded, by the alias table, else as it is."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    folded = F.lower(F.trim(column))
    return F.coalesce(F.element_at(table, folded), folded)


def degree_level(column: str) -> F.Column:
    """STR-24: the degree that a candidate's text names."""
    text = F.lower(F.trim(column))
    has = lambda *terms: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])
    return F.when(text == "", None).when(has("phd", "ph.d", "doctor"), "phd").when(has("master") | text.isin("ms", "m.s."), "masters").when(has("bachelor", "undergrad") | text.isin("bs", "b.s.", "ba", "b.a."), "bachelors").otherwise(text)


_TYPED = ("Save", " mark_applied ", "accept", "Accepted", "mark_reviewed", "ignore", "notes", "TIER_1", "tier_5", "Unknown", "PhD", "Ph.D. student", "Doctorate", "MS", "Master of Science", "B.A.", "undergraduate", "diploma", "", "bs")


def typed_names(spark, sf_dir: str) -> DataFrame:
    events = Q.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, _TYPED)), (F.col("event_id") % len(_TYPED) + 1).cast("int")).alias("typed"))
    return events.select("event_id", aliased("typed", state.ALIASES).alias("action"), aliased("typed", {k: v for k, v in K.TIER_ALIASES.items()}).alias("tier"), degree_level("typed").alias("degree"))


catalog.register("q_typed_names", typed_names, f"""with t as (select event_id, lower(trim(([{', '.join(f"'{x}'" for x in _TYPED)}])[event_id % {len(_TYPED)} + 1])) x from events)
select event_id, case x when 'save' then 'saved' when 'ignore' then 'ignored' when 'mark_applied' then 'applied' when 'accept' then 'reviewed' when 'accepted' then 'reviewed' when 'mark_reviewed' then 'reviewed' else x end "action",
  case x when 'tier_1' then 'S+' when 'tier_2' then 'S' when 'tier_3' then 'A' when 'tier_4' then 'B' when 'tier_5' then 'C' when 'unknown' then 'Unknown' else x end tier,
  case when x = '' then null when x like '%phd%' or x like '%ph.d%' or x like '%doctor%' then 'phd' when x like '%master%' or x in ('ms', 'm.s.') then 'masters' when x like '%bachelor%' or x like '%undergrad%' or x in ('bs', 'b.s.', 'ba', 'b.a.') then 'bachelors' else x end degree from t""")

# --- ignored by override, and what that writes ----------------------------------------------

IGNORE = {"companies": ("sundial", "copper lane"), "title_terms": ("campus",), "text_terms": ("marketing",)}


def ignore_reasons(rows: DataFrame) -> DataFrame:
    """OVR-02: (ingest_seq, status, notes) of the records that overrides ignore; all reasons, joined."""
    company = F.when(F.lower("company_name").isin(*IGNORE["companies"]), F.concat(F.lit("company: "), F.lower("company_name")))
    terms = [F.when(F.contains(F.col(c), F.lit(t)), F.lit(f"{label}: {t}")) for c, label, key in (("title_f", "title", "title_terms"), ("body_f", "text", "text_terms")) for t in IGNORE[key]]
    return rows.select("ingest_seq", F.lit("ignored").alias("status"), F.concat_ws("; ", company, *terms).alias("notes")).where("notes <> ''")


register("q_ignore_reasons", ignore_reasons, "select ingest_seq, 'ignored' status, n notes from (select ingest_seq, concat_ws('; ', case when lower(company_name) in ('sundial', 'copper lane') then 'company: ' || lower(company_name) end, case when title_f like '%campus%' then 'title: campus' end, case when body_f like '%marketing%' then 'text: marketing' end) n from rec) where n <> ''")


def override_actions(rows: DataFrame) -> DataFrame:
    """STATE-05 by STATE-03: the actions that overrides write, but for those that change nothing."""
    asked = ignore_reasons(rows).select(F.col("ingest_seq").cast("string").alias("job_id"), F.lit("application_status").alias("action_type"), F.col("status").alias("action_value"), "notes")
    return state.new_actions(asked, rows.select(F.col("ingest_seq").cast("string").alias("job_id"), F.col("shown_status").alias("application_status"), "applied", "saved"))


register("q_override_actions", override_actions, "select ingest_seq::varchar job_id, 'application_status' action_type, 'ignored' action_value, n notes from (select ingest_seq, shown_status, concat_ws('; ', case when lower(company_name) in ('sundial', 'copper lane') then 'company: ' || lower(company_name) end, case when title_f like '%campus%' then 'title: campus' end, case when body_f like '%marketing%' then 'text: marketing' end) n from rec) where n <> '' and shown_status <> 'ignored'")
register("q_internship_tags", lambda rows: rows.select("ingest_seq", F.array_join(F.array_union(F.split("source_type", "_"), F.when(F.col("is_internship"), F.array(F.lit("internship"))).otherwise(F.array().cast("array<string>"))), ",").alias("tags")), "select ingest_seq, array_to_string(if(is_internship, list_append(string_split(source_type, '_'), 'internship'), string_split(source_type, '_')), ',') tags from rec")
