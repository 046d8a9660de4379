"""Crawls over pages that the driver's tables give: links by arithmetic on
``pages``, and whole career sites of derived firms, one posting for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.operators import crawl
from postforge.plans import catalog
from postforge.session import table

#: Links of a page, firms that crawl, pages read for a firm and rounds of the link query.
FANOUT, CRAWLERS, PAGES_READ, ROUNDS = 6, 20, 12, 4


def _address(c) -> F.Column:
    return F.concat(F.lit("p"), F.col(c).cast("string"))


def q_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page i links to (31 i + 17 k + 7) mod (pages + 3), of which three are
    dead; every eleventh address leads on to the page before it, every
    thirteenth page is gone."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("i"))
    n = pages.count() + 3
    captured = pages.select(_address("i").alias("url"), F.when(F.col("i") % 11 == 5, F.concat(F.lit("p"), (F.col("i") - 1).cast("string"))).alias("final_url"), F.when(F.col("i") % 13 == 4, 404).otherwise(200).alias("http_status"))
    targets = pages.select(_address("i").alias("url"), F.col("i"), F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1))).alias("position"))
    links = targets.select("url", "position", F.concat(F.lit("p"), ((F.col("i") * 31 + F.col("position") * 17 + 7) % n).cast("string")).alias("href"))
    roots = pages.where(F.col("i") < CRAWLERS).select(F.col("i").alias("firm"), _address("i").alias("url"), F.lit(0).alias("position"))
    return crawl.crawl(roots, captured, crawl.by_table(links), PAGES_READ, ROUNDS).select("firm", "n", "depth", "final_url", "http_status")


_CRAWL_SQL = f"""
with recursive z as (select count(*) + 3 n from pages),
r as (
  select page_id firm, 0 depth, [case when page_id % 11 = 5 then page_id - 1 else page_id end] read, [0] depths,
    [case when page_id % 11 = 5 then page_id - 1 else page_id end] front, case when page_id % 13 = 4 then [] else [case when page_id % 11 = 5 then page_id - 1 else page_id end] end live
  from pages where page_id < {CRAWLERS}
  union all
  select firm, depth + 1, read || fresh, depths || list_transform(fresh, lambda x: depth + 1), fresh, list_filter(asked, lambda x: list_contains(fresh, x[1]) and x[2] % 13 <> 4).list_transform(lambda x: x[1])
  from (select *, list_transform(asked, lambda x: x[1])[1:{PAGES_READ} - len(read)] fresh from (
    select firm, depth, read, depths, list_filter(t, lambda x, i: not list_contains(read, x[1]) and list_position(list_transform(t, lambda y: y[1]), x[1]) = i) asked from (
      select r.*, list_transform(list_filter(flatten(list_transform(live, lambda p: list_transform(range(0, {FANOUT}), lambda k: (p * 31 + k * 17 + 7) % z.n))), lambda x: x < z.n - 3),
        lambda x: [case when x % 11 = 5 then x - 1 else x end, x]) t from r, z where len(read) < {PAGES_READ} and depth < {ROUNDS} and len(live) > 0)))
  where len(fresh) > 0),
l as (select distinct on (firm) firm, read, depths, depth from r order by firm, depth desc),
u as (select firm, unnest(range(1, len(read) + 1)) n, read, depths from l)
select firm, n, depths[n]::int depth, 'p' || read[n] final_url from u"""


# Career sites: of each posting's ten kinds the detail page says something else.
_TERMS = "Build market data systems in London with a small team of people who care, Summer 2027."
_DETAIL = "Work on exchange connectivity and order books together with researchers."


def _site(parts: DataFrame, firms: int) -> DataFrame:
    """(firm, k, kind, title, link, ...) of every part's posting."""
    firm = F.concat(F.lit("f"), (F.col("p_partkey") % firms).cast("string"))
    k, base = F.col("p_partkey").cast("string"), F.concat(F.lit("https://"), firm, F.lit(".example.com"))
    kind = (F.floor(F.col("p_partkey") / firms) % 10).cast("int")
    path = F.when(kind == 7, "/read/").otherwise("/jobs/")
    title = F.concat(F.lit("Software Engineer Intern k"), k)
    return parts.select(firm.alias("firm"), base.alias("base"), F.col("p_partkey").alias("k"), kind.alias("kind"), title.alias("title"), F.concat(base, path, k).alias("link"))


def career_site(parts: DataFrame, firms: int) -> tuple[DataFrame, DataFrame]:
    """(firms, captured pages) of the derived sites."""
    jobs = _site(parts, firms)
    said = F.when(F.col("kind") == 3, F.lit("Applications are closed for this role.")).otherwise(F.lit(_TERMS))
    card = F.concat(F.lit("<div><h3>"), "title", F.lit("</h3><p>"), said, F.lit("</p><a href='"), "link", F.lit("'>"), "title", F.lit("</a></div>"))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", card.alias("card")))), lambda x: x["card"]), "")
    roots = jobs.groupBy("firm", "base").agg(F.concat(F.lit("<title>Careers</title>"), cards).alias("html"))
    listing = roots.select(F.concat("base", F.lit("/careers")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("http_status"), "html")
    k = F.col("k").cast("string")
    h1 = lambda t: F.concat(F.lit("<h1>"), t, F.lit("</h1><p>"), F.lit(_DETAIL), F.lit("</p>"))
    posting = lambda t: F.concat(F.lit('{"@type": "JobPosting", "title": "'), t, F.lit('", "description": "<p>' + _DETAIL + '</p>", "jobLocation": {"address": {"addressLocality": "Chicago"}}}'))
    structured = F.concat(F.lit('<script type="application/ld+json">['), posting(F.concat(F.lit("Software Engineer Intern x"), k)), F.lit(", "), posting(F.concat(F.lit("Intern Software Engineer k"), k)), F.lit("]</script>"), h1(F.col("title")))
    html = (
        F.when(F.col("kind") == 1, h1(F.lit("Hardware Analyst")))
        .when(F.col("kind") == 4, F.lit("<h1>Later</h1><p>Nothing now, please check back soon.</p>"))
        .when(F.col("kind") == 6, structured)
        .when(F.col("kind") == 7, F.lit("<p>Who we are, and life at the firm.</p>"))
        .when(F.col("kind") == 8, F.concat(h1(F.col("title")), F.lit("<a href='https://boards.example.org/acme/jobs/"), k, F.lit("/apply'>Apply now</a>")))
        .otherwise(h1(F.col("title")))
    )
    final = F.when(F.col("kind") == 4, F.concat("base", F.lit("/future-opportunities/"), k)).when(F.col("kind") == 9, F.concat("base", F.lit("/positions/"), k))
    details = jobs.where("kind <> 5").select(F.col("link").alias("url"), final.alias("final_url"), F.when(F.col("kind").isin(2, 3), 404).otherwise(200).alias("http_status"), html.alias("html"))
    return roots.select("firm", F.concat("base", F.lit("/careers")).alias("careers_url"), F.concat("base", F.lit("/")).alias("website")), listing.unionByName(details)


#: Postings of a firm about, and pages read for it.
SITE_POSTINGS, SITE_BUDGET = 24, 18


def q_career_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    firms, captured = career_site(parts, max(1, parts.count() // SITE_POSTINGS))
    found = crawl.career_postings(firms, captured, SITE_BUDGET)
    return found.select("firm", "title", "link", "apply_url", "hint", "confidence", "location", "season", "check")


#: What must come out, posting by posting, from what the pages were made of.
_CAREER_SQL = f"""
with z as (select greatest(1, count(*) // {SITE_POSTINGS}) n from part),
j as (select 'f' || (p_partkey % n) firm, p_partkey k, ((p_partkey // n) % 10)::int kind, 'https://f' || (p_partkey % n) || '.example.com' base from part, z),
p as (select *, sum((kind <> 5)::int) over (partition by firm order by k) + 1 as page_no, count(*) over (partition by firm) cards from j),
s as (select *, kind <> 5 and page_no <= {SITE_BUDGET} as was_read from p where cards >= 2)
select firm, case when was_read and kind = 6 then 'Intern Software Engineer k' else 'Software Engineer Intern k' end || k title,
  case when kind in (3, 4) and was_read then base || '/careers' when kind = 9 and was_read then base || '/positions/' || k when kind = 6 and was_read then base || '/jobs/' || k
    when kind = 7 then base || '/read/' || k else base || '/jobs/' || k end link,
  case when kind = 8 and was_read then 'https://boards.example.org/acme/jobs/' || k || '/apply' end apply_url,
  case when kind = 3 then 'closed' when kind = 4 and was_read then 'coming_soon' end hint,
  case when was_read and kind = 6 then 0.97 when was_read and kind in (0, 8, 9) then 0.9 else 0.8 end::double confidence,
  case when was_read and kind = 6 then 'Chicago' when kind <> 3 then 'London' end as location, case when kind <> 3 then 'Summer 2027' end season,
  case when kind = 5 then 'unfetched' when not was_read then 'unread' when kind = 3 then 'gone' when kind = 4 then 'future' else 'verified' end as "check"
from s where not was_read or kind in (0, 3, 4, 6, 8, 9)"""

catalog.register("q_crawl", lambda s, d: q_crawl(s, d).select("firm", "n", "depth", "final_url"), _CRAWL_SQL)
catalog.register("q_career_postings", q_career_postings, _CAREER_SQL)
