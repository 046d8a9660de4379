"""Serving queries: filters, sorts, pages, facets, summaries, review, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.dialect import SPARK
from postforge.functions import fixed as K
from postforge.functions import rules as R

#: Sort keys: (columns, descending). Ties end with the job key, so pages are stable.
SORTS = {
    "opportunity_score": ("opportunity",), "hidden_gem_score": ("hidden_gem",), "role_fit_score": ("role_fit",), "freshness_score": ("freshness",), "eligibility_score": ("eligibility",), "prestige_score": ("prestige",), "technical_depth_score": ("technical_depth",), "newest": ("posted_at",), "last_verified": ("last_seen",),
}
ASCENDING = {"company": ("company_name", "title"), "title": ("title", "company_name")}


def filtered(jobs: DataFrame, status=None, role_family=None, company=None, prestige_tier=None, location=None, season=None, year=None, application_status=None, source_type=None, remote_type=None, sponsorship=None, is_internship=None, min_opportunity=None, min_hidden_gem=None, min_role_fit=None, search=None) -> DataFrame:
    """FLT-01: all given predicates hold; the flat ones reach the scan."""
    tests = []
    equal = {"status": status and status.lower(), "role_family": role_family, "tier": prestige_tier, "season": season, "year": year, "application_status": application_status, "source_type": source_type, "remote_type": remote_type, "sponsorship": sponsorship, "is_internship": is_internship}
    tests += [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    tests += [F.col(c) >= v for c, v in (("opportunity", min_opportunity), ("hidden_gem", min_hidden_gem), ("role_fit", min_role_fit)) if v is not None]
    if company:
        tests.append(F.contains(F.lower("company_name"), F.lit(company.lower())))
    if location:
        tests.append(F.exists("locations", lambda x: F.contains(F.lower(x), F.lit(location.lower()))))
    if search:
        haystack = F.lower(F.concat_ws(" ", "company_name", "title", "role_family", "description", "source_type", "status"))
        tests.append(F.contains(haystack, F.lit(search.lower())))
    return jobs.where(reduce(lambda a, b: a & b, tests)) if tests else jobs


def order(sort: str = "opportunity_score", strict: bool = False) -> list:
    """SRT-01/02: descending keys take descending company and title behind them."""
    if sort in ASCENDING:
        return [F.col(c).asc() for c in (*ASCENDING[sort], "ingest_seq")]
    if sort not in SORTS and strict:
        raise ValueError(f"unknown sort {sort}")
    keys = SORTS.get(sort, SORTS["opportunity_score"])
    return [F.col(c).desc() for c in (*keys, "company_name", "title")] + [F.col("ingest_seq").asc()]


def page(jobs: DataFrame, sort: str = "opportunity_score", limit: int = 100, offset: int = 0) -> DataFrame:
    """LIM-01: one page; Spark keeps only offset + limit rows a task."""
    return jobs.orderBy(*order(sort)).offset(max(0, offset)).limit(limit)


def ranked(jobs: DataFrame, sort: str, limit: int) -> DataFrame:
    """WIN-01: the first rows with a rank column; only they are numbered."""
    from pyspark.sql import Window

    return jobs.orderBy(*order(sort, strict=True)).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order(sort))).cast("long"))


def with_actions(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """JOIN-02: jobs with folded action state, defaults where there is none."""
    joined = jobs.join(states, "job_id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("saved", "applied", "ignored", "reviewed")}
    return joined.withColumns(flags).withColumn("application_status", F.coalesce("application_status", F.lit("")))


def needs_review(saved: str = "false") -> str:
    """FLT-10."""
    return f"(status in ('unknown', 'requires_login') or role_confidence < {K.LOW_ROLE_CONFIDENCE} or eligibility_confidence < {K.LOW_ELIGIBILITY_CONFIDENCE} or description = '' or year is null)"


def review_reasons(d) -> str:
    """REV-01: list of reasons in order."""
    low_role, low_elig, doubt = f"role_confidence < {K.LOW_ROLE_CONFIDENCE}", f"eligibility_confidence < {K.LOW_ELIGIBILITY_CONFIDENCE}", "status in ('unknown', 'requires_login')"
    tests = (
        (doubt, "unknown status"), (low_role, "low-confidence role classification"), (low_elig, "low-confidence eligibility"), ("description = ''", "missing description"), ("season is null or year is null", "missing season/year"),
        (f"hidden_gem >= {K.QUEUE_GEM}", "new high hidden-gem signal"), (f"opportunity >= {K.QUEUE_OPPORTUNITY} and ({low_role} or {low_elig} or {doubt})", "high opportunity score but low confidence"),
    )
    return d.compact(d.array(f"case when {c} then {d.lit(t)} end" for c, t in tests))


def review_queue(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """REV-02: rows with a reason, most reasons first."""
    rows = jobs.withColumn("reasons", F.expr(review_reasons(SPARK))).withColumn("n_reasons", F.expr(SPARK.size("reasons"))).where("n_reasons > 0")
    return rows.orderBy(F.desc("n_reasons"), F.desc("hidden_gem"), F.desc("opportunity"), "company_name", "title", "ingest_seq").limit(limit)


def summary(jobs: DataFrame) -> DataFrame:
    """AGG-03: one pass, one row."""
    count = lambda c: F.count_if(F.expr(c))
    return jobs.agg(
        F.count("*").alias("total"), *[count(f"status = '{s}'").alias(s) for s in ("open", "likely_open", "coming_soon", "closed")], count("status in ('unknown', 'requires_login')").alias("unknown"),
        count(f"hidden_gem >= {K.GEM_THRESHOLD}").alias("gems"), count(needs_review()).alias("review_needed"), count("is_internship").alias("internships"),
    )


def facets(jobs: DataFrame) -> DataFrame:
    """AGG-07: (facet, value) of every distinct value, one shuffle."""
    pairs = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("status", "role_family", "company_name", "tier", "season", "year", "source_type", "remote_type", "sponsorship")]
    places = F.transform("locations", lambda x: F.struct(F.lit("location").alias("facet"), x.alias("value")))
    return jobs.select(F.explode(F.concat(F.array(*pairs), places)).alias("p")).select("p.*").where("value is not null").distinct()


def export_view(jobs: DataFrame) -> DataFrame:
    """PRJ-02: the flat export row."""
    d = SPARK
    return jobs.selectExpr(*[f"{e} as {n}" for n, e in export_columns(d).items()])


def eligibility_summary(d) -> str:
    degrees = d.join(d.compact(d.array(f"case when {c} then {d.lit(n)} end" for c, n in (("has_bachelors", "bachelors"), ("has_masters", "masters"), ("has_phd", "phd")))), ", ")
    years = d.join(d.transform("graduation_years", "y", "cast(y as string)" if d.name == "spark" else "y::varchar"), ", ")
    majors = d.join(d.slice("majors", 3), ", ")
    parts = d.compact(d.array([f"nullif({degrees}, '')", f"case when {years} <> '' then concat('Grad ', {years}) end", f"nullif({majors}, '')", "concat('Sponsorship: ', sponsorship)"]))
    return d.join(parts, " | ")


def export_columns(d) -> dict[str, str]:
    text = (lambda x: f"cast({x} as string)") if d.name == "spark" else (lambda x: f"({x})::varchar")
    return {
        "job_id": "job_id", "company": "company_name", "title": "title", "role_family": "role_family", "role_confidence": "role_confidence", "status": "status", "status_confidence": "status_confidence", "season": "coalesce(season, '')", "year": f"coalesce({text('year')}, '')",
        "location": f"case when {d.size('locations')} = 0 then 'Location TBD' else {d.join('locations', ', ')} end", "remote": "coalesce(remote_type, '')", "internship": "case when is_internship then 'Yes' else 'No' end", "tier": "tier", "source": "source_type", "source_url": "source_url", "apply_url": "apply_url",
        "eligibility_summary": eligibility_summary(d), "sponsorship": "sponsorship", "citizenship": "coalesce(citizenship, '')", "opportunity": "opportunity", "hidden_gem": "hidden_gem", "role_fit": "role_fit", "depth": "technical_depth", "freshness": "freshness", "eligibility": "eligibility", "prestige": "prestige", "content_hash": "content_hash",
    }


__all__ = ["R", "export_view", "facets", "filtered", "order", "page", "ranked", "review_queue", "summary", "with_actions"]
