"""Boards of firms: requests planned from firm rows, answers settled by rule.

``planned`` lists what may be asked for each firm and source, in order. Answers
come from a captured table, or live from the ``postforge_boards`` data source,
one partition a (firm, source). Either way the same joins settle which answer
counts, how far a paged board is read and what went wrong; what went wrong is a
row, never a raised task.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postforge.sources import payloads

# Where boards answer, by source, host after host.
HOSTS = {
    "greenhouse": ("https://boards-api.greenhouse.io/v1/boards/{slug}/jobs", "https://boards-api.eu.greenhouse.io/v1/boards/{slug}/jobs"),
    "lever": ("https://api.lever.co/v0/postings/{slug}",),
    "ashby": ("https://api.ashbyhq.com/posting-api/job-board/{slug}",),
    "workday": ("https://{tenant}.{datacenter}.myworkdayjobs.com/wday/cxs/{tenant}/{site}/jobs",),
}
QUERIES = {"greenhouse": "content=true", "lever": "mode=json", "ashby": "includeCompensation=true", "workday": ""}
CAREER_HOSTS = {"greenhouse": "greenhouse.io", "lever": "lever.co", "ashby": "ashbyhq.com"}
SLUGGED = ("greenhouse", "lever", "ashby")
PAGE_SIZE, MOST_PAGES, MOST_INFERRED = 20, 200, 5

ANSWER = "company_id string, source_type string, slug string, url string, page int, http_status int, body string, error string"


# --- plan -------------------------------------------------------------------------------


def _folded(values: Column) -> Column:
    """Trimmed values that are not blank, of equal folded ones the first."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.get(F.transform(F.array(kept), lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, F.lower), F.lower(x)) == i + 1)), 0)


def board_slugs(source: str, declared: bool = True) -> Column:
    """SRC-22, SRC-26: slugs to try, in order: the declared one and that of the
    careers URL; only without either, at most five made of name and aliases.
    A probe passes over what the firm declares."""
    host = F.lower(F.regexp_extract("careers_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    asked = F.regexp_extract("careers_url", r"[?&]for=([^&#]+)", 1) if source == "greenhouse" else F.lit("")
    first = F.regexp_extract("careers_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    linked = F.when(F.contains(host, F.lit(CAREER_HOSTS[source])), F.coalesce(F.nullif(asked, F.lit("")), first))
    given = _folded(F.array(F.col("ats_slug") if declared else F.lit(None).cast("string"), linked))
    dashed = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    compact = lambda c: F.replace(dashed(c), F.lit("-"))
    short = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), compact), lambda x: F.length(x) >= 3)
    named = F.array(compact(F.col("name")), F.when(F.contains(dashed(F.col("name")), F.lit("-")), dashed(F.col("name"))))
    made = _folded(F.slice(F.filter(F.concat(named, short), lambda x: F.coalesce(x, F.lit("")) != ""), 1, MOST_INFERRED))
    return F.when(F.size(given) > 0, given).otherwise(made)


def coordinates() -> Column:
    """SRC-09: struct(tenant, datacenter, site), declared whole or from the careers URL; null without."""
    given = F.when(F.col("ats_tenant").isNotNull() & F.col("ats_datacenter").isNotNull() & F.col("ats_site").isNotNull(), F.struct(F.col("ats_tenant").alias("tenant"), F.col("ats_datacenter").alias("datacenter"), F.col("ats_site").alias("site")))
    linked = payloads.workday_coordinates("careers_url")
    return F.coalesce(given, F.when(linked["tenant"].isNotNull() & linked["site"].isNotNull(), linked))


def _filled(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def planned(firms: DataFrame, declared: bool = True) -> DataFrame:
    """(company_id, source_type, slug, candidate, host, priority, url) of every
    request that may be made, priority rising within (firm, source).

    ``firms``: company_id, name, aliases, careers_url, ats_type, ats_slug,
    ats_tenant, ats_datacenter, ats_site. ``declared``: for the source that a firm
    names (what it collects); else for every source (what a resolver probes)."""
    out = []
    for source in SLUGGED:
        own = firms.where(F.lower("ats_type") == source) if declared else firms
        slugs = own.select("company_id", F.posexplode(board_slugs(source, declared)).alias("candidate", "slug"))
        for host, template in enumerate(HOSTS[source]):
            out.append(slugs.select("company_id", F.lit(source).alias("source_type"), "slug", "candidate", F.lit(host).alias("host"), (F.col("candidate") * len(HOSTS[source]) + host).alias("priority"), _filled(template, slug=F.col("slug")).alias("url")))
    own = firms.withColumn("at", coordinates()).where(F.col("at").isNotNull())
    own = own.where((F.lower("ats_type") == "workday") | (F.lower(F.coalesce("ats_type", F.lit(""))).isin("", "custom", "unknown"))) if declared else own
    at = {n: F.col(f"at.{n}") for n in ("tenant", "datacenter", "site")}
    out.append(own.select("company_id", F.lit("workday").alias("source_type"), F.concat_ws("/", at["tenant"], at["site"]).alias("slug"), F.lit(0).alias("candidate"), F.lit(0).alias("host"), F.lit(0).alias("priority"), _filled(HOSTS["workday"][0], **at).alias("url")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


# --- answers ------------------------------------------------------------------------------


def entries() -> Column:
    """How many entries a body lists, by the shape of its source; null for another shape."""
    shown = F.from_json(F.get_json_object("body", "$.jobs"), "array<string>")
    listed = F.filter(F.from_json(F.get_json_object("body", "$.jobs"), "array<struct<isListed:boolean>>"), lambda j: F.coalesce(j["isListed"], F.lit(True)))
    whole = F.when(F.substring(F.ltrim("body"), 1, 1) == "[", F.from_json("body", "array<string>"))
    valid = F.try_parse_json("body").isNotNull()
    found = F.when(F.col("source_type") == "greenhouse", F.size(shown)).when(F.col("source_type") == "ashby", F.size(listed)).when(F.col("source_type") == "lever", F.size(whole))
    return F.when(valid & (found >= 0), found)


def _outcome() -> Column:
    """SRC-24, with answers that never came."""
    return F.when(F.col("http_status").isNull(), "network_error").otherwise(payloads.outcome("http_status", "valid"))


def settled(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """SRC-01, SRC-03, SRC-06: one row per firm and slugged source: the first
    request that was not answered with 404 decides: (company_id, source_type,
    slug, url, body, outcome). Only its body counts; ``outcome`` is null for a
    good one, ``config_error`` where every request was a 404. Requests without
    an answer count as network errors. ``answers``: one row a url (page 0)."""
    single = requests.where(F.col("source_type") != "workday").join(answers.where("coalesce(page, 0) = 0").select("url", "http_status", "body"), "url", "left")
    marked = single.withColumn("valid", F.coalesce(F.col("http_status") == 200, F.lit(False)) & entries().isNotNull())
    answer = F.struct("slug", "url", "http_status", "valid", F.when(F.col("valid"), F.col("body")).alias("body"))
    told = ~F.col("http_status").eqNullSafe(404)
    best = marked.groupBy("company_id", "source_type").agg(F.min_by(F.when(told, answer), F.when(told, F.col("priority"))).alias("a"), F.max_by("slug", "priority").alias("last"))
    rows = best.select("company_id", "source_type", F.coalesce("a.slug", "last").alias("slug"), "a.url", "a.http_status", "a.valid", "a.body", F.col("a").isNull().alias("missing"))
    return rows.select("company_id", "source_type", "slug", "url", "body", F.when(F.col("missing"), "config_error").otherwise(_outcome()).alias("outcome"))


def settled_pages(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """SRC-08: the pages of paged boards that are read: (company_id, source_type,
    slug, url, page, body, outcome).

    Pages are taken in order up to the first that is empty, shorter than a full
    page, reaches the total (the first positive one that a page names) or holds
    nothing new. A bad page before that makes the whole board its one error row.
    Every step is a window over the at most MOST_PAGES pages of one board."""
    asked = requests.where("source_type = 'workday'").join(answers.where(F.col("page") < MOST_PAGES).select("url", "page", "http_status", "body"), "url", "left")
    postings = F.from_json(F.get_json_object("body", "$.jobPostings"), "array<struct<title:string,externalPath:string>>")
    pages = asked.withColumns({"page": F.coalesce("page", F.lit(0)), "postings": postings, "total": F.try_to_number(F.get_json_object("body", "$.total"), F.lit("999999999")).cast("long")})
    pages = pages.withColumn("valid", F.coalesce(F.col("http_status") == 200, F.lit(False)) & F.col("postings").isNotNull())
    pages = pages.withColumn("outcome", _outcome())
    board = ["company_id", "url"]
    key = lambda p: F.coalesce(F.nullif(F.trim(p["externalPath"]), F.lit("")), F.nullif(F.trim(p["title"]), F.lit("")), F.lit(""))
    keys = pages.select(*board, "page", F.explode(F.transform("postings", key)).alias("key")).groupBy(*board, "key").agg(F.min("page").alias("page"))
    new = keys.groupBy(*board, "page").agg(F.count("*").alias("new"))
    order = Window.partitionBy(*board).orderBy("page")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = pages.join(new, [*board, "page"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    counted = counted.withColumns({"held": F.sum("new").over(so_far), "goal": F.first(F.when(F.col("total") > 0, F.col("total")), ignorenulls=True).over(so_far), "gap": F.col("page") - F.row_number().over(order) + 1})
    ends = F.coalesce(F.col("outcome").isNotNull() | (F.size("postings") < PAGE_SIZE) | (F.col("held") >= F.col("goal")) | (F.col("new") == 0), F.lit(False))
    counted = counted.withColumn("ended", F.coalesce(F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    read = counted.where(~F.col("ended") & (F.col("gap") == 0))
    broken = F.max("outcome").over(Window.partitionBy(*board))
    read = read.withColumn("broken", broken).where(F.col("broken").isNull() | F.col("outcome").isNotNull())
    return read.select("company_id", "source_type", "slug", "url", "page", F.when(F.col("broken").isNull(), F.col("body")).alias("body"), "outcome")


def collected(firms: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw postings of all boards, outcomes (company_id, source_type, slug, outcome))."""
    requests = planned(firms)
    boards, pages = settled(requests, answers), settled_pages(requests, answers)
    names = firms.select("company_id", F.col("name").alias("company_name"))
    good = boards.where("outcome is null").join(names, "company_id").withColumn("payload", F.col("body"))
    base = _filled("https://{t}.myworkdayjobs.com/en-US/{s}", t=F.regexp_extract("url", r"^https://([^.]+\.wd\d+)\.", 1), s=F.element_at(F.split("slug", "/"), -1))
    paged = pages.where("outcome is null").join(names, "company_id").withColumns({"payload": F.col("body"), "site_base": base})
    out = payloads.workday(paged)
    for source in SLUGGED:
        out = out.unionByName(getattr(payloads, source)(good.where(F.col("source_type") == source)))
    told = boards.select("company_id", "source_type", "slug", "outcome").unionByName(pages.groupBy("company_id", "source_type", "slug").agg(F.max("outcome").alias("outcome")))
    return out, told


def resolved(firms: DataFrame, answers: DataFrame) -> DataFrame:
    """SRC-21, SRC-26: per firm the board that answers, in the order of sources,
    slugs and hosts: (company_id, source_type, slug, resolved, changed, note).
    Coordinates of a paged board resolve without a request. A second host is
    asked only where the first knows no such slug."""
    requests = planned(firms, declared=False)
    tried = requests.join(answers.where("coalesce(page, 0) = 0").select("url", "http_status", "body"), "url", "left").withColumn("jobs", entries())
    first = F.max(F.when(F.col("host") == 0, F.col("http_status"))).over(Window.partitionBy("company_id", "source_type", "slug"))
    tried = tried.withColumn("asked", (F.col("host") == 0) | (first == 404)).where("asked")
    paged = F.col("source_type") == "workday"
    place = F.when(paged, 0).when(F.col("source_type") == "greenhouse", 1).when(F.col("source_type") == "lever", 2).otherwise(3)
    hit = paged | (F.coalesce(F.col("http_status") == 200, F.lit(False)) & F.col("jobs").isNotNull())
    declared = firms.select("company_id", F.lower(F.coalesce("ats_type", F.lit(""))).alias("declared"))
    probes = declared.join(tried, "company_id", "left").select("company_id", "declared", F.when(F.coalesce(hit, F.lit(False)), 200).alias("http_status"), "source_type", "slug", F.when(paged, None).otherwise(F.col("jobs")).alias("n_jobs"), place.alias("priority"), F.col("priority").alias("candidate"))
    return payloads.resolve_probes(probes)


def resolution_report(resolutions: DataFrame) -> DataFrame:
    """AGG-15: one row: firms, resolved, unresolved, changed."""
    return resolutions.agg(F.count("*").alias("firms"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if("changed").alias("changed"))


# --- live -----------------------------------------------------------------------------------


class _Board(InputPartition):
    def __init__(self, requests: list[dict]):
        super().__init__(0)
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.requests = json.loads(options.get("requests", "[]"))
        self.timeout, self.wait = float(options.get("timeout", "20")), float(options.get("wait", "0"))
        self.agent = options.get("agent", "postforge")

    def partitions(self) -> list[InputPartition]:
        boards: dict[tuple, list[dict]] = {}
        for r in sorted(self.requests, key=lambda r: r["priority"]):
            boards.setdefault((r["company_id"], r["source_type"]), []).append(r)
        return [_Board(r) for r in boards.values()] or [_Board([])]

    def _ask(self, url: str, body: dict | None) -> tuple[int | None, str | None, str | None]:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(url, data, {"User-Agent": self.agent, "Accept": "application/json", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return r.status, r.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            return e.code, None, None
        except (OSError, ValueError) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def read(self, partition: _Board) -> Iterator[tuple]:
        """Requests in order up to the first that is not a 404; of paged boards
        pages up to one that cannot be the middle of a list."""
        for i, r in enumerate(partition.requests):
            if i:
                time.sleep(self.wait)
            paged, query = r["source_type"] == "workday", QUERIES.get(r["source_type"], "")
            seen: set[str] = set()
            for page in range(MOST_PAGES if paged else 1):
                if page:
                    time.sleep(self.wait)
                body = {"appliedFacets": {}, "limit": PAGE_SIZE, "offset": page * PAGE_SIZE, "searchText": ""} if paged else None
                status, text, error = self._ask(f"{r['url']}?{query}" if query else r["url"], body)
                yield r["company_id"], r["source_type"], r["slug"], r["url"], page, status, text, error
                if not paged or not self._goes_on(text, seen):
                    break
            if status != 404:
                return

    @staticmethod
    def _goes_on(text: str | None, seen: set[str]) -> bool:
        """A full page with something new; the total is left to the reader's rules."""
        try:
            postings = json.loads(text or "")["jobPostings"]
            keys = {str(p.get("externalPath") or p.get("title") or "") for p in postings} - seen
        except (ValueError, TypeError, KeyError, AttributeError):
            return False
        seen |= keys
        return len(postings) >= PAGE_SIZE and bool(keys)


class LiveBoards(DataSource):
    """``postforge_boards``: answers of live boards. Option ``requests``: JSON
    rows of :func:`planned` (a pack's firms, so bounded); ``timeout``, ``wait``
    seconds between requests to a board, ``agent``."""

    @classmethod
    def name(cls) -> str:
        return "postforge_boards"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def live_answers(requests: DataFrame, **options) -> DataFrame:
    """The data source over planned requests of a pack."""
    spark = requests.sparkSession
    spark.dataSource.register(LiveBoards)
    rows = [r.asDict() for r in requests.select("company_id", "source_type", "slug", "priority", "url").collect()]  # a pack's firms
    read = spark.read.format("postforge_boards").option("requests", json.dumps(rows))
    return read.options(**{k: str(v) for k, v in options.items()}).load()
