"""Crawl over captured pages with a budget per firm, and the postings it yields.

The frontier is iterated semi-naively: only links of the pages read last are
followed, joined with the captured pages, freed of what the firm has read, and
ranked within the firm by where they were found. A round reads what the firm's
budget still allows; the crawl ends when no firm has both links and budget.
Each round is one plan and a table of its own in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.functions import html as H
from postforge.session import cut

#: Pages read for a firm, and links followed from its first pages, unless asked otherwise.
BUDGET, DEPTH = 20, 1
GONE = (404, 410)
WAITING = ("closed", "coming_soon")

PLACE = "struct<n:long,position:long>"


def crawl(roots: DataFrame, captured: DataFrame, links: Callable[[DataFrame], DataFrame], budget: int = BUDGET, depth: int | None = DEPTH) -> DataFrame:
    """SRC-10: (firm, n, depth, url, final_url, http_status): the pages read for
    each firm, numbered in the order of reading.

    ``roots`` (firm, url, position) are read first. ``captured`` has one row a
    requested url, with final_url (null: the same) and http_status. ``links``
    gives the (firm, n, position, href) of pages read, in order of position.
    A page is read once a firm, whatever address led to it; links that were not
    captured cost nothing; a budget under 1 is an error. ``depth`` None follows
    links until nothing is left.
    """
    if budget < 1:
        raise ValueError("a crawl needs a budget of at least one page")
    known = captured.select("url", F.coalesce("final_url", "url").alias("final_url"), F.coalesce("http_status", F.lit(200)).alias("http_status"))
    front = roots.select("firm", F.col("url").alias("href"), F.struct(F.lit(0).cast("long").alias("n"), F.col("position").cast("long").alias("position")).alias("at"))
    read: list[DataFrame] = []
    while True:
        asked = front.groupBy("firm", "href").agg(F.min("at").alias("at"))
        found = asked.join(known, asked["href"] == known["url"]).groupBy("firm", "final_url").agg(F.min_by(F.struct("url", "http_status"), "at").alias("page"), F.min("at").alias("at"))
        spent = None
        if read:
            before = reduce(DataFrame.unionByName, read)
            found = found.join(before.select("firm", "final_url"), ["firm", "final_url"], "left_anti")
            spent = before.groupBy("firm").agg(F.count("*").alias("spent"))
        # the rank is limited before the shuffle too, so that a firm with very many links is no large task
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("firm").orderBy("at"))).where(F.col("rank") <= budget)
        ranked = ranked.join(spent, "firm", "left") if read else ranked.withColumn("spent", F.lit(0).cast("long"))
        number = F.col("spent") + F.col("rank")
        new = cut(ranked.where(number <= budget).select("firm", number.alias("n"), F.lit(len(read)).alias("depth"), "page.url", "final_url", "page.http_status"))
        if new.isEmpty():
            break
        read.append(new)
        if depth is not None and len(read) > depth:
            break
        able = reduce(DataFrame.unionByName, read).groupBy("firm").agg(F.count("*").alias("all")).where(F.col("all") < budget).select("firm")
        last = new.where(F.col("http_status") == 200).join(able, "firm", "left_semi")
        front = links(last).select("firm", "href", F.struct(F.col("n").cast("long").alias("n"), F.col("position").cast("long").alias("position")).alias("at"))
    return reduce(DataFrame.unionByName, read) if read else new


def by_table(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Links of a table (url, position, href), as :func:`crawl` asks for them."""
    return lambda pages: pages.join(table, pages["final_url"] == table["url"]).select("firm", "n", "position", "href")


# --- postings of a crawl --------------------------------------------------------------


def _listed(c: Column) -> Column:
    return F.coalesce(c.isin(*WAITING), F.lit(False))


def _usable(link: Column) -> Column:
    """A link for applications, unless it leads to a whole site."""
    return F.when(~H.is_generic_url(link), link)


def best_matches(listed: DataFrame, detailed: DataFrame) -> DataFrame:
    """HTML-17: ``listed`` (key, final_url, title) with the candidate of the page
    ``final_url`` whose title agrees and shares most words, the first of equals:
    (key, best)."""
    pairs = listed.join(detailed, "final_url").where(H.token_overlap(F.col("title"), F.col("d.title")) >= 0.45)
    shared = F.size(F.array_intersect(H.title_words("title"), H.title_words("d.title")))
    return pairs.groupBy("key").agg(F.max_by("d", F.struct(shared.alias("shared"), (-F.col("d.pos")).alias("place"))).alias("best"))


def verified(listed: DataFrame, captured: DataFrame, read: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    """HTML-12, JOIN-17: listed candidates against the pages their links lead to.

    ``listed``: candidates of listing pages, with firm, key (unique) and page
    (their listing). ``captured``: where addresses lead. ``read``: pages of the
    crawl, ``facts`` and ``found`` their facts and candidates by page. Adds ``check`` and drops what the detail page
    refutes: a page that is gone, of another kind or title leaves only what the
    listing says is closed or coming soon, and that points at the listing.
    """
    kinds = facts.select(F.col("page").alias("final_url"), H.page_kind().alias("d_kind"), H.status_hint("text").alias("d_hint"))
    leads = captured.select(F.col("url").alias("link"), F.coalesce("final_url", "url").alias("final_url"), "http_status")
    seen_by = read.select("firm", "final_url", F.lit(True).alias("was_read"))
    joined = cut(listed.join(leads, "link", "left").join(seen_by, ["firm", "final_url"], "left").join(kinds, "final_url", "left"))
    fields = ("title", "apply_url", "body", "hint", "confidence", "location", "season", "kind", "pos")
    best = best_matches(joined.select("key", "final_url", "title"), found.select(F.col("page").alias("final_url"), F.struct(*fields).alias("d")))
    rows = joined.join(best, "key", "left")
    check = (
        F.when(F.col("link") == F.col("page"), "listing")
        .when(F.col("final_url").isNull(), "unfetched")
        .when(F.col("was_read").isNull(), "unread")
        .when(F.col("http_status").isin(*GONE), "gone")
        .when(F.col("d_kind") == "future", "future")
        .when(F.col("d_kind").isin("editorial", "generic"), "editorial")
        .when(F.col("best").isNull(), "no_match")
        .otherwise("verified")
    )
    rows = rows.withColumn("check", check)
    rows = rows.where(F.col("check").isin("listing", "unfetched", "unread", "verified", "future") | _listed(F.col("hint")))
    same, seen = F.col("check").isin("listing", "unfetched", "unread"), F.col("check") == "verified"
    hint = F.when(F.col("check") == "future", F.coalesce("d_hint", "hint", F.lit("closed"))).when(seen, F.coalesce("best.hint", H.status_hint(F.col("best.body")), "hint")).otherwise(F.col("hint"))
    chosen = lambda name: F.when(seen, F.coalesce(f"best.{name}", name)).otherwise(F.col(name)).alias(name)
    body = F.when(seen, F.coalesce(F.nullif("best.body", F.lit("")), "body")).otherwise(F.col("body"))
    link = F.when(same, F.col("link")).when(seen, F.col("final_url")).otherwise(F.col("page"))
    apply_url = F.when(same, F.col("apply_url")).when(seen, _usable(F.coalesce("best.apply_url", "apply_url"))).when(F.col("check") == "no_match", F.col("apply_url"))
    confidence = F.when(seen, F.greatest("confidence", "best.confidence")).otherwise(F.col("confidence"))
    return rows.select("firm", "n", "pos", "page", chosen("title"), link.alias("link"), apply_url.alias("apply_url"), body.alias("body"), hint.alias("hint"), F.when(seen, F.col("best.kind")).otherwise(F.col("kind")).alias("kind"), confidence.alias("confidence"), chosen("location"), chosen("season"), "check")


def speaks_for_itself() -> Column:
    """A candidate that says enough to go without its detail page."""
    words = F.size(F.filter(F.split(F.coalesce("body", F.lit("")), r"\s+"), lambda w: w != ""))
    return F.col("location").isNotNull() | F.col("season").isNotNull() | F.col("hint").isNotNull() | _usable(F.col("apply_url")).isNotNull() | (words >= 10)


def accepted() -> Column:
    """What may be emitted: a role's title, from a page and with links of its own."""
    known = F.col("hint").isNotNull()
    title = H.is_role_title("title") & ~H.is_marketing("title")
    return title & (known | ~F.col("kind").isin("editorial", "generic")) & (known | ~H.is_generic_url(F.col("link"))) & (F.col("apply_url").isNull() | ~H.is_generic_url(F.col("apply_url")))


def career_postings(firms: DataFrame, captured: DataFrame, budget: int = BUDGET) -> DataFrame:
    """SRC-10, HTML-12, HTML-17, URL-10: postings of firms' career pages: (firm,
    n, pos, title, link, apply_url, body, hint, kind, confidence, location,
    season, check), one per firm, folded title and link, in order of (n, pos).

    ``firms`` (firm, careers_url, website); ``captured`` (url, final_url,
    http_status, html), one row a requested url. Root pages give candidates,
    their links are read within the budget and verify them. A link that the
    budget leaves unread is emitted only if its candidate speaks for itself.
    Every emitted link passes the guard against links to whole sites. A page is
    parsed once, by the address it came from in the end.
    """
    parsed: list[tuple[DataFrame, DataFrame]] = []
    texts = captured.groupBy(F.coalesce("final_url", "url").alias("page")).agg(F.min("html").alias("html"))

    def parse(pages: DataFrame) -> DataFrame:
        """Facts and candidates of pages read, each once."""
        wanted = pages.where(~F.col("http_status").isin(*GONE)).select(F.col("final_url").alias("page")).distinct()
        facts = cut(H.page_facts(texts.join(wanted, "page", "left_semi").select("page", F.col("page").alias("url"), "html"), key="page"))
        found = cut(H.candidates(facts, key="page"))
        parsed.append((facts, found))
        return found

    def links(pages: DataFrame) -> DataFrame:
        found = parse(pages).where(F.col("link") != F.col("page"))
        return pages.join(found, pages["final_url"] == found["page"]).select("firm", "n", F.col("pos").alias("position"), F.col("link").alias("href"))

    roots = firms.select("firm", F.col("careers_url").alias("url"), F.lit(0).alias("position")).where("url is not null")
    read = cut(crawl(roots, captured, links, budget))
    if not parsed:
        parse(read.limit(0))
    found = parsed[0][1]
    parse(read.where("depth > 0"))
    facts = parsed[-1][0].unionByName(parsed[0][0]).dropDuplicates(["page"])
    details = parsed[-1][1].join(parsed[0][1].select("page").distinct(), "page", "left_anti").unionByName(found)
    first = read.where("depth = 0").select("firm", "n", F.col("final_url").alias("page"))
    listed = first.join(found, "page").withColumn("key", F.sha1(F.concat_ws("\0", "firm", "page", F.col("pos").cast("string"), "title", "link")))
    out = verified(listed, captured, read, facts, details)
    out = out.where((F.col("check") != "unread") | speaks_for_itself()).where(accepted())
    guarded = out.join(firms.select("firm", "careers_url", "website"), "firm").where(H.role_specific(F.col("link"), F.col("hint"), F.col("careers_url"), F.col("website")))
    fields = ("n", "pos", "title", "apply_url", "body", "hint", "kind", "confidence", "location", "season", "check")
    kept = guarded.groupBy("firm", F.lower("title").alias("k"), "link").agg(F.min_by(F.struct(*fields), F.struct("n", "pos")).alias("c"))
    return kept.select("firm", "link", *[f"c.{f}" for f in fields])
