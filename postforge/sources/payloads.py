"""Board payloads (JSON text) to raw postings; markdown lists; fetch outcomes.

Each reader takes a table (company_id, company_name, payload) of captured
responses and gives one row per posting in source order. Live fetching is a
reader of its own (:mod:`postforge.sources.boards`); nothing here needs a network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_COLUMNS = ("company_id", "company_name", "source_type", "title", "url", "apply_url", "location_raw", "description_raw", "department", "posted_at", "ats_id", "ordinal")

GREENHOUSE = "struct<jobs:array<struct<id:string,title:string,absolute_url:string,location:struct<name:string>,departments:array<struct<name:string>>,content:string,updated_at:string>>>"
LEVER = "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,team:string>,descriptionPlain:string,additionalPlain:string,description:string,additional:string,lists:array<struct<text:string,content:string>>,createdAt:string>>"
ASHBY = "struct<jobs:array<struct<id:string,title:string,jobUrl:string,applyUrl:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,team:string,descriptionPlain:string,descriptionHtml:string,publishedAt:string,isListed:boolean>>>"
WORKDAY = "struct<jobPostings:array<struct<title:string,externalPath:string,locationsText:string>>,total:long>"


def _rows(df: DataFrame, schema: str, path: str) -> DataFrame:
    parsed = F.from_json("payload", schema)
    items = parsed.getField(path) if path else parsed
    return df.select("*", F.posexplode(items).alias("ordinal", "j"))


def _blank(c) -> F.Column:
    return F.when(F.trim(c) != "", F.trim(c))


def _out(df: DataFrame, source: str, **cols) -> DataFrame:
    null = F.lit(None).cast("string")
    given = {"apply_url": null, "description_raw": null, "department": null, "posted_at": F.lit(None).cast("timestamp"), "ats_id": null} | cols
    return df.select("company_id", "company_name", F.lit(source).alias("source_type"), *[given[c].alias(c) for c in RAW_COLUMNS[3:-1]], F.col("ordinal").cast("long"))


def greenhouse(df: DataFrame) -> DataFrame:
    """SRC-01/02; ``df`` may bear a ``slug`` column for missing URLs."""
    rows = _rows(df, GREENHOUSE, "jobs")
    slug = F.col("slug") if "slug" in df.columns else F.col("company_id")
    departments = F.array_join(F.filter(F.transform("j.departments", lambda d: _blank(d["name"])), lambda x: x.isNotNull()), ", ")
    url = F.coalesce(_blank(F.col("j.absolute_url")), F.concat(F.lit("https://boards.greenhouse.io/"), slug, F.lit("/jobs/"), F.col("j.id")))
    return _out(rows, "greenhouse", title=F.coalesce(_blank(F.col("j.title")), F.concat(F.lit("Job "), F.col("j.id"))), url=url, apply_url=url, location_raw=F.col("j.location.name"), description_raw=F.col("j.content"), department=_blank(departments), posted_at=F.try_to_timestamp("j.updated_at"), ats_id=F.col("j.id"))


def lever(df: DataFrame) -> DataFrame:
    """SRC-03..05: plain and list sections first, HTML only where there are none."""
    rows = _rows(df, LEVER, "")
    lists = F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws("\n", _blank(x["text"]), _blank(x["content"])))
    plain = F.filter(F.concat(F.array("j.descriptionPlain"), lists, F.array("j.additionalPlain")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    rich = F.filter(F.array("j.description", "j.additional"), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    text = _blank(F.array_join(F.when(F.size(plain) > 0, plain).otherwise(rich), "\n\n"))
    return _out(rows, "lever", title=F.coalesce(_blank(F.col("j.text")), F.concat(F.lit("Job "), F.col("j.id"))), url=F.col("j.hostedUrl"), apply_url=F.col("j.applyUrl"), location_raw=F.col("j.categories.location"), description_raw=text, department=F.col("j.categories.team"), posted_at=F.timestamp_millis(F.expr("try_cast(j.createdAt as bigint)")), ats_id=F.col("j.id"))


def ashby(df: DataFrame) -> DataFrame:
    """SRC-06/07: listed postings; primary and distinct secondary places."""
    rows = _rows(df, ASHBY, "jobs").where(F.coalesce("j.isListed", F.lit(True)))
    places = F.array_join(F.array_distinct(F.filter(F.concat(F.array("j.location"), F.coalesce(F.transform("j.secondaryLocations", lambda x: x["location"]), F.array().cast("array<string>"))), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")), ", ")
    return _out(rows, "ashby", title=F.col("j.title"), url=F.col("j.jobUrl"), apply_url=F.col("j.applyUrl"), location_raw=_blank(places), description_raw=F.coalesce("j.descriptionPlain", "j.descriptionHtml"), department=F.coalesce("j.department", "j.team"), posted_at=F.try_to_timestamp("j.publishedAt"), ats_id=F.col("j.id"))


def workday(df: DataFrame) -> DataFrame:
    """SRC-08/25: pages in order (``page`` column), repeats by path else title dropped."""
    from pyspark.sql import Window

    rows = _rows(df, WORKDAY, "jobPostings").withColumn("k", F.coalesce(_blank(F.col("j.externalPath")), _blank(F.col("j.title"))))
    first = F.row_number().over(Window.partitionBy("company_id", "k").orderBy("page", "ordinal"))
    rows = rows.withColumn("r", first).where("r = 1 and k is not null")
    base = F.col("site_base") if "site_base" in df.columns else F.lit("")
    url = F.concat(base, F.coalesce("j.externalPath", F.lit("")))
    return _out(rows, "workday", title=F.col("j.title"), url=url, apply_url=url, location_raw=F.col("j.locationsText"))


def workday_coordinates(url: str = "careers_url") -> F.Column:
    """SRC-09: struct(tenant, datacenter, site) from a board URL."""
    host = F.regexp_extract(url, r"^https?://([^/]+)", 1)
    parts = F.filter(F.split(F.regexp_extract(url, r"^https?://[^/]+/([^?#]*)", 1), "/"), lambda p: (p != "") & ~p.rlike("^[a-z]{2}-[A-Z]{2}$"))
    return F.struct(_blank(F.regexp_extract(host, r"^([^.]+)\.(wd\d+)\.myworkdayjobs\.com$", 1)).alias("tenant"), _blank(F.regexp_extract(host, r"^([^.]+)\.(wd\d+)\.myworkdayjobs\.com$", 2)).alias("datacenter"), F.get(parts, F.lit(0)).alias("site"))


def outcome(code: str = "http_status", ok: str = "valid") -> F.Column:
    """SRC-24: what a fetch came to; null for a good one."""
    c = F.col(code)
    return F.when(c == 404, "config_error").when(c == 429, "rate_limit").when((c >= 400) & (c < 500), "config_error").when(c >= 500, "network_error").when(~F.coalesce(F.col(ok), F.lit(False)), "parse_error")


def slug_candidates(slug: str = "ats_slug", url: str = "careers_url", name: str = "name", aliases: str = "aliases") -> F.Column:
    """SRC-22: at most five distinct slugs: given, of the URL, made of names."""
    compact, dashed = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "")), F.trim(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "-")), F.lit("-"))
    from_url = F.regexp_extract(url, r"(?:greenhouse\.io|lever\.co|ashbyhq\.com)/(?:embed/job_board\?for=)?([A-Za-z0-9_-]+)", 1)
    more = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(F.regexp_replace(a, "[^A-Za-z0-9]+", ""))), lambda a: F.length(a) >= 3)
    every = F.filter(F.concat(F.array(slug, from_url, compact, dashed), more), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return F.slice(F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1), 1, 5)


def can_collect(source: str, ats: str = "ats_type") -> F.Column:
    """FLT-12: firms a source is tried for; the default takes firms of no board type."""
    return F.col(ats).isNull() | (F.col(ats) == "custom_page") if source == "custom_page" else F.col(ats) == source


def plan_sources(firms: DataFrame, sources=("greenhouse", "lever", "ashby", "workday", "custom_page")) -> DataFrame:
    """JOIN-13: (firm, source, order), the firm's own source first."""
    pairs = [firms.where(can_collect(s)).select("company_id", F.lit(s).alias("source_type"), F.lit(i).alias("o")) for i, s in enumerate(sources)]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def resolve_probes(probes: DataFrame) -> DataFrame:
    """SRC-21/26: first hit by priority per firm; no postings is a hit with a note."""
    hits = probes.where("http_status = 200")
    best = hits.groupBy("company_id").agg(F.min_by(F.struct("source_type", "slug", "n_jobs"), F.struct("priority", "candidate")).alias("b"))
    return probes.select("company_id", "declared").distinct().join(best, "company_id", "left").select("company_id", F.col("b.source_type").alias("source_type"), F.col("b.slug").alias("slug"), F.col("b").isNotNull().alias("resolved"), (F.col("b").isNotNull() & ~F.col("b.source_type").eqNullSafe(F.col("declared"))).alias("changed"), F.when(F.col("b.n_jobs") == 0, "board is empty").alias("note"))


_HEADERS = {"company": "company", "firm": "company", "role": "title", "title": "title", "position": "title", "location": "location_raw", "locations": "location_raw", "application": "url", "link": "url", "apply": "url", "date posted": "posted", "date": "posted", "notes": "notes"}


def markdown_tables(texts: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """MD-01, SRC-11, STR-14: pipe-table rows of whole texts with aliased headers.

    A header is the line before a separator line; short rows are padded. Works
    on one text at a time in expressions, so files are the unit of scale.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("n")
    lines = texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    is_row, is_bar = F.col("line").startswith("|"), F.col("line").rlike(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?$")
    marked = lines.withColumns({"bar": is_bar, "row": is_row}).withColumn("head", F.coalesce(F.lead("bar").over(w), F.lit(False)) & F.col("row"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    named = F.transform(cells, lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _HEADERS.items() for x in kv]), F.lower(c)), F.lower(c)))
    marked = marked.withColumn("cells", cells).withColumn("names", F.last(F.when(F.col("head"), named), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = marked.where("row and not head and not bar and names is not null")
    get = lambda n: F.get("cells", (F.array_position("names", n) - 1).cast("int"))
    link = F.coalesce(_blank(F.regexp_extract(get("url"), r"\((https?://[^)\s]+)\)", 1)), _blank(F.regexp_extract(get("url"), r"(https?://\S+)", 1)))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")
    row = F.row_number().over(w)
    return rows.select(key, F.col("n").cast("long").alias("line_no"), row.cast("long").alias("row_no"), plain(get("company")).alias("company"), plain(get("title")).alias("title"), plain(get("location_raw")).alias("location_raw"), F.coalesce(link, F.concat(F.col(key), F.lit("#row-"), row)).alias("url"))
