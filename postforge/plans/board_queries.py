"""Boards of firms that ``supplier`` gives: their captured answers are written
by the query, read back, and settled by the reader's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.plans import catalog
from postforge.session import stored, table
from postforge.sources import board_reader as B
from postforge.sources import payloads


def supplier_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a firm: its board's source, slugs and coordinates follow its key."""
    key = F.col("s_suppkey")
    k = key.cast("string")
    source = F.element_at(F.array(*map(F.lit, ("greenhouse", "lever", "ashby", "workday"))), (key % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("s"), k).alias("company_id"),
        F.concat(F.lit("Firm "), k, F.lit(" & Co.")).alias("name"),
        F.array(F.lit("Fx"), F.concat(F.lit("F-"), k, F.lit("x"))).alias("aliases"),
        F.when(key % 4 == 0, F.concat(F.lit("https://boards.greenhouse.io/embed?for=gh"), k)).when(key % 8 == 3, F.concat(F.lit("https://t"), k, F.lit(".wd5.myworkdayjobs.com/en-US/ext"))).alias("careers_url"),
        F.when(key % 10 == 9, "custom").otherwise(source).alias("ats_type"),
        F.when((key % 4 == 0) & (key % 3 == 0), F.concat(F.lit("own"), k)).alias("ats_slug"),
        *[F.when(key % 8 == 7, v).otherwise(none).alias(n) for n, v in (("ats_tenant", F.concat(F.lit("t"), k)), ("ats_datacenter", F.lit("wd1")), ("ats_site", F.lit("Jobs")))],
    )


def captured_answers(firms: DataFrame) -> DataFrame:
    """What each firm's requests are answered with. Of firm k, with v = k div 4:
    greenhouse: v mod 5: found, found at the second host, nowhere, too many
    requests, another shape; a declared slug is always unknown. lever: v mod 3:
    by the dashed slug, by the first one, by an alias. ashby: v mod 3: found
    with a hidden entry, server error, no entries. workday: 10 + 15 (v mod 4)
    postings in pages of 20, the total on the first page only (v mod 3 = 1: never);
    one page more than there should be; v mod 7 = 6: the second page fails."""
    key = F.col("s_suppkey")
    k, v = key.cast("string"), F.floor(key / 4).cast("int")
    jobs = lambda entry: F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), entry)
    place = lambda i: F.concat(F.lit("Role "), k, F.lit("-"), i.cast("string"))
    gh = F.to_json(F.struct(jobs(lambda i: F.struct(i.alias("id"), place(i).alias("title"))).alias("jobs")))
    lv = F.to_json(jobs(lambda i: F.struct(i.alias("id"), place(i).alias("text"), F.concat(F.lit("https://jobs.lever.co/"), k, F.lit("/"), i.cast("string")).alias("hostedUrl"))))
    ab = F.to_json(F.struct(F.when(v % 3 == 0, jobs(lambda i: F.struct(place(i).alias("title"), (i != 2).alias("isListed"), F.lit("https://jobs.ashbyhq.com/x").alias("jobUrl")))).otherwise(F.array().cast("array<struct<title:string,isListed:boolean,jobUrl:string>>")).alias("jobs")))
    rows = []

    def add(where, url, status, body, page=F.lit(0)):
        rows.append(firms.where(where).select(url.alias("url"), page.cast("int").alias("page"), status.cast("int").alias("http_status"), F.when(status == 200, body).alias("body")))

    at = lambda source, host, slug: B._filled(B.HOSTS[source][host], slug=slug)
    green, lever, ashby, workday = (key % 4 == i for i in range(4))
    for host in (0, 1):
        add(green & F.col("ats_slug").isNotNull(), at("greenhouse", host, F.col("ats_slug")), F.lit(404), F.lit(""))
        status = F.when(v % 5 == (0 if host == 0 else 1), 200).when((v % 5 == 3) & F.lit(host == 0), 429).when((v % 5 == 4) & F.lit(host == 0), 200).otherwise(404)
        add(green, at("greenhouse", host, F.concat(F.lit("gh"), k)), status, F.when(v % 5 == 4, '{"jobs": 7}').otherwise(gh))
    slugs = (F.concat(F.lit("firm"), k, F.lit("co")), F.concat(F.lit("firm-"), k, F.lit("-co")), F.concat(F.lit("f"), k, F.lit("x")))
    for i, slug in enumerate(slugs):
        add(lever, at("lever", 0, slug), F.when(v % 3 == (1, 0, 2)[i], 200).otherwise(404), lv)
    add(ashby, at("ashby", 0, slugs[0]), F.when(v % 3 == 1, 503).otherwise(200), ab)
    total = 10 + 15 * (v % 4)
    pages = firms.where(workday).withColumn("p", F.explode(F.sequence(F.lit(0), F.ceil(total / B.PAGE_SIZE).cast("int"))))
    here = F.sequence(F.col("p") * B.PAGE_SIZE + 1, F.greatest(F.least(total, (F.col("p") + 1) * B.PAGE_SIZE), F.col("p") * B.PAGE_SIZE + 1))
    entries = F.transform(here, lambda i: F.struct(place(i).alias("title"), F.concat(F.lit("/job/"), F.least(i, total).cast("string")).alias("externalPath"), F.lit("Austin").alias("locationsText")))
    body = F.to_json(F.struct(entries.alias("jobPostings"), F.when((F.col("p") == 0) & (v % 3 != 1), total).otherwise(0).alias("total")))
    url = F.concat(F.lit("https://t"), k, F.when(key % 8 == 7, ".wd1").otherwise(".wd5"), F.lit(".myworkdayjobs.com/wday/cxs/t"), k, F.when(key % 8 == 7, "/Jobs/jobs").otherwise("/ext/jobs"))
    status = F.when((v % 7 == 6) & (F.col("p") == 1), 500).otherwise(200)
    rows.append(pages.select(url.alias("url"), F.col("p").cast("int").alias("page"), status.cast("int").alias("http_status"), F.when(status == 200, body).alias("body")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    firms = supplier_firms(spark, sf_dir)
    return firms.drop("s_suppkey"), stored(spark, f"answers:{sf_dir}", lambda: captured_answers(firms))


def q_board_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = B.collected(*_boards(spark, sf_dir))
    return rows.select("company_id", "source_type", "title", "url", "location_raw")


def q_board_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.collected(*_boards(spark, sf_dir))[1]


def q_board_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resolved(*_boards(spark, sf_dir))


def q_resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resolution_report(B.resolved(*_boards(spark, sf_dir)))


_FIRMS = """f as (select s_suppkey k, 's' || s_suppkey company_id, s_suppkey // 4 v, (s_suppkey % 4)::int kind, s_suppkey % 10 = 9 custom, 10 + 15 * ((s_suppkey // 4) % 4) total from supplier),
o as (select *, case when custom and kind <> 3 then null when kind = 0 then case when v % 5 < 2 then 'found' when v % 5 = 2 then 'config_error' when v % 5 = 3 then 'rate_limit' else 'parse_error' end
  when kind = 1 then 'found' when kind = 2 then case when v % 3 = 1 then 'network_error' else 'found' end
  else case when v % 7 = 6 and total > 20 then 'network_error' else 'found' end end told from f)"""
catalog.register(
    "q_board_postings",
    q_board_postings,
    f"""with {_FIRMS}, j as (select *, unnest(range(1, case when kind = 3 then total when kind = 2 and v % 3 = 2 then 0 else k % 3 + 1 end + 1)) i from o where told = 'found')
select company_id, ['greenhouse', 'lever', 'ashby', 'workday'][kind + 1] source_type, 'Role ' || k || '-' || i title,
  case kind when 0 then 'https://boards.greenhouse.io/gh' || k || '/jobs/' || i when 1 then 'https://jobs.lever.co/' || k || '/' || i when 2 then 'https://jobs.ashbyhq.com/x'
    else 'https://t' || k || case when k % 8 = 7 then '.wd1.myworkdayjobs.com/en-US/Jobs' else '.wd5.myworkdayjobs.com/en-US/ext' end || '/job/' || i end url,
  case when kind = 3 then 'Austin' end location_raw from j where not (kind = 2 and i = 2)""",
)
_SLUG = """case kind when 0 then case when {last} and v % 5 = 2 then 'gh' || k else 'gh' || k end when 1 then case v % 3 when 0 then 'firm-' || k || '-co' when 1 then 'firm' || k || 'co' else 'f' || k || 'x' end
    when 2 then 'firm' || k || 'co' else 't' || k || case when k % 8 = 7 then '/Jobs' else '/ext' end end"""
catalog.register(
    "q_board_outcomes",
    q_board_outcomes,
    f"""with {_FIRMS} select company_id, ['greenhouse', 'lever', 'ashby', 'workday'][kind + 1] source_type, {_SLUG.format(last='true')} slug, nullif(told, 'found') outcome from o where told is not null""",
)
_RESOLVED = f"""{_FIRMS}, r as (select *, case when kind = 0 then v % 5 < 2 when kind = 2 then v % 3 <> 1 else true end hit from o),
s as (select company_id, hit resolved, case when hit then ['greenhouse', 'lever', 'ashby', 'workday'][kind + 1] end source_type, case when hit then {_SLUG.format(last='true')} end slug, hit and custom changed,
  case when hit and kind = 2 and v % 3 = 2 then 'board is empty' end note from r)"""
catalog.register("q_board_resolution", q_board_resolution, f"with {_RESOLVED} select company_id, source_type, slug, resolved, changed, note from s")
catalog.register("q_resolution_report", q_resolution_report, f"with {_RESOLVED} select count(*) firms, count(*) filter (resolved) resolved, count(*) filter (not resolved) unresolved, count(*) filter (changed) changed from s")


# --- single rules over the same firms and answers ------------------------------------------------


def q_request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.planned(supplier_firms(spark, sf_dir)).select("company_id", "source_type", "slug", "priority", "url")


_GREEN = ", ".join(f"('{h}', {i})" for i, h in enumerate(B.HOSTS["greenhouse"]))
catalog.register(
    "q_request_plan",
    q_request_plan,
    f"""with {_FIRMS}, g as (select *, case when k % 3 = 0 then ['own' || k, 'gh' || k] else ['gh' || k] end slugs from o where kind = 0 and not custom),
g2 as (select company_id, slugs, unnest(range(len(slugs))) c from g), h(url, n) as (values {_GREEN}),
l as (select company_id, kind, [('firm' || k || 'co'), ('firm-' || k || '-co'), ('f' || k || 'x')] slugs from o where kind in (1, 2) and not custom), l2 as (select *, unnest(range(len(slugs))) c from l)
select company_id, 'greenhouse' source_type, slugs[c + 1] slug, (c * 2 + n)::int priority, replace(url, '{{slug}}', slugs[c + 1]) url from g2 cross join h
union all select company_id, ['lever', 'ashby'][kind], slugs[c + 1], c::int, replace(['{B.HOSTS["lever"][0]}', '{B.HOSTS["ashby"][0]}'][kind], '{{slug}}', slugs[c + 1]) from l2
union all select company_id, 'workday', 't' || k || case when k % 8 = 7 then '/Jobs' else '/ext' end, 0, 'https://t' || k || case when k % 8 = 7 then '.wd1' else '.wd5' end || '.myworkdayjobs.com/wday/cxs/t' || k || case when k % 8 = 7 then '/Jobs/jobs' else '/ext/jobs' end from o where kind = 3""",
)
# every captured answer by itself
catalog.register(
    "q_fetch_outcome",
    lambda s, d: _boards(s, d)[1].withColumn("valid", F.try_parse_json("body").isNotNull()).groupBy("http_status", payloads.outcome().alias("outcome")).agg(F.count("*").alias("n")),
    f"""with {_FIRMS}, a as (
  select 404 s, count(*) * 2 n from o where kind = 0 and k % 3 = 0 union all
  select unnest(case v % 5 when 0 then [200, 404] when 1 then [404, 200] when 2 then [404, 404] when 3 then [429, 404] else [200, 404] end), 1 from o where kind = 0 union all
  select unnest([200, 404, 404]), 1 from o where kind = 1 union all select case when v % 3 = 1 then 503 else 200 end, 1 from o where kind = 2 union all
  select case when v % 7 = 6 and p = 1 then 500 else 200 end, 1 from (select *, unnest(range(ceil(total / 20)::bigint + 1)) p from o where kind = 3))
select s::int http_status, case when s = 404 then 'config_error' when s = 429 then 'rate_limit' when s >= 500 then 'network_error' end outcome, sum(n)::bigint n from a group by 1, 2 having sum(n) > 0""",
)
