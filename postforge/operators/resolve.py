"""Duplicate postings: pair rules within a firm, components, survivorship.

Exact rules (same canonical URL, same board key, same title and place) are
equal-key groups: they become links to the group's first row by one
aggregation each, never a pair join. Similar titles are found by an index of
character pairs, and compared once per distinct pair of a firm's titles that
share one which the ratio demands, so neither many postings under few titles
nor many titles cost comparisons of all with all.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from postforge.dialect import SPARK
from postforge.functions import fixed as K
from postforge.functions import rules as R
from postforge.operators.graph import connected_components
from postforge.session import cut


@F.pandas_udf(DoubleType())
def title_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """STR-07: 100 times the matching-block ratio of two folded titles, lower
    row first (the ratio depends on the order)."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() * 100 for a, b in zip(left, right, strict=True)])


def keyed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("ats_key", F.expr(R.ats_key(SPARK, "source_url", "apply_url")))


def exact_links(jobs: DataFrame) -> DataFrame:
    """(a, b, reason): links to the first row of each group of DED-01 R1, R3 and
    R6, and of R2 where titles are equal.

    Title and place meet per place, so rows that share any place are linked;
    equal titles of different years are vetoed unless another rule holds, so
    the year is part of that key.
    """
    rows = keyed(jobs)
    base = rows.select("company_id", "ingest_seq", "apply_url", "source_url", "ats_key", F.lower("title").alias("t"), "locations", F.coalesce(F.col("year").cast("string"), F.lit("")).alias("y"))
    place = F.explode(F.transform("locations", lambda x: F.concat_ws("\x01", "t", "y", F.lower(x))))
    by = [
        (base.where("apply_url <> ''"), F.col("apply_url"), "same canonical apply URL"),
        (base.where("source_url <> ''"), F.concat_ws("\x01", "source_url", "t"), "same canonical source URL"),
        (base.where("ats_key is not null"), F.col("ats_key"), "same ATS job ID"),
        (base, place, "same company, same title, and overlapping location"),
    ]
    found = [df.select("company_id", key.alias("k"), "ingest_seq", F.lit(reason).alias("reason")) for df, key, reason in by]
    all_rows = reduce(DataFrame.unionByName, found)
    # a table of its own is joined, so that a key that many rows share can be split
    first = cut(all_rows.groupBy("reason", "company_id", "k").agg(F.min("ingest_seq").alias("a"), F.count("*").alias("n")).where("n > 1").select("reason", "company_id", "k", "a"))
    return all_rows.join(first, ["reason", "company_id", "k"]).where("ingest_seq > a").select("a", F.col("ingest_seq").alias("b"), "reason").distinct()


def title_grams(titles: DataFrame) -> DataFrame:
    """(company_id, t, seq, n, gram): the pairs of adjacent characters that a
    similar title must share one of.

    A ratio over r of titles of n and m characters leaves M > r (n + m) / 2
    characters matched, so one is made of the other by n - M deletions, which
    spoil two pairs each, and m - M insertions, which spoil one: of the first
    title at most 2 n + m - 3 M pairs are lost, and as m >= n r / (2 - r), at
    most LOST n. Two titles that share all but so many of their pairs share one
    among the LOST n + 1 that come first in any common order; the rarest come
    first. Repeats of a pair are told apart by number. Titles under three
    characters have no similar ones but equal titles.
    """
    each = titles.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("i", "pair")).where(F.length("t") > 2)
    numbered = each.groupBy("company_id", "t", "seq", "pair").agg(F.count("*").alias("times")).select("company_id", "t", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: F.concat("pair", i.cast("string")))).alias("gram"))
    numbered = cut(numbered)
    common = numbered.groupBy("gram").agg(F.count("*").alias("held"))
    ordered = numbered.join(common, "gram").groupBy("company_id", "t", "seq").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("g"))  # a title's own
    first = F.slice("g", 1, (F.floor(F.length("t") * LOST) + 1).cast("int"))
    return ordered.select("company_id", "t", "seq", F.length("t").alias("n"), F.explode(F.transform(first, lambda x: x["gram"])).alias("gram"))


_R = K.LIKELY_SIMILARITY / 100
#: 2 n + m - 3 r (n + m) / 2 at the least m, for each character of n.
LOST = 2 - 1.5 * _R + (1 - 1.5 * _R) * _R / (2 - _R) + 1e-9


def similar_titles(jobs: DataFrame) -> DataFrame:
    """(company_id, t1, t2, similarity): distinct folded titles of a firm with a
    ratio over 85, the title of the earlier row first. Pairs come from an index
    of rare character pairs, never from a join of all titles of a firm."""
    titles = jobs.groupBy("company_id", F.lower("title").alias("t")).agg(F.min("ingest_seq").alias("seq"))
    grams = cut(title_grams(titles))
    a, b = grams.select("company_id", "gram", F.col("t").alias("t1"), F.col("seq").alias("s1"), F.col("n").alias("n1")), grams.select("company_id", "gram", F.col("t").alias("t2"), F.col("seq").alias("s2"), F.col("n").alias("n2"))
    bound = 200 * F.least("n1", "n2") / (F.col("n1") + F.col("n2"))  # no ratio exceeds it
    met = a.join(b, ["company_id", "gram"]).where((F.col("s1") < F.col("s2")) & (bound > K.LIKELY_SIMILARITY)).select("company_id", "t1", "t2").distinct()
    return met.withColumn("similarity", title_ratio("t1", "t2")).where(F.col("similarity") > K.LIKELY_SIMILARITY)


def similar_links(jobs: DataFrame) -> DataFrame:
    """(a, b, reason) of R2 for unequal titles, and of R4 and R5 under the veto
    of differing years: similar rows are linked per source URL (R2), per year
    (R4) or per season and year (R5)."""
    rows = jobs.select("company_id", F.lower("title").alias("t"), "ingest_seq", "season", "year")
    groups = rows.groupBy("company_id", "t", "season", "year").agg(F.min("ingest_seq").alias("first"))
    same = rows.join(groups.groupBy("company_id", "t", "year").agg(F.min("first").alias("a")), (rows["company_id"] == groups["company_id"]) & (rows["t"] == groups["t"]) & rows["year"].eqNullSafe(groups["year"]))
    own = same.where(rows["ingest_seq"] > F.col("a")).select("a", rows["ingest_seq"].alias("b"))
    sim = similar_titles(jobs)
    left = groups.select("company_id", F.col("t").alias("t1"), F.col("season").alias("n1"), F.col("year").alias("y1"), F.col("first").alias("a"))
    right = groups.select("company_id", F.col("t").alias("t2"), F.col("season").alias("n2"), F.col("year").alias("y2"), F.col("first").alias("b"))
    met = sim.join(left, ["company_id", "t1"]).join(right, ["company_id", "t2"])
    r4 = F.col("y1").eqNullSafe(F.col("y2")) & (F.col("similarity") > K.SURE_SIMILARITY)
    r5 = (F.col("y1") == F.col("y2")) & F.col("n1").eqNullSafe(F.col("n2"))
    near = met.where(r4 | r5).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    at = jobs.where("source_url <> ''").groupBy("company_id", F.lower("title").alias("t"), "source_url").agg(F.min("ingest_seq").alias("first"))
    ends = [at.select("company_id", "source_url", F.col("t").alias(f"t{i}"), F.col("first").alias(c)) for i, c in ((1, "a"), (2, "b"))]
    sure = sim.where(F.col("similarity") > K.SURE_SIMILARITY).join(ends[0], ["company_id", "t1"]).join(ends[1], ["company_id", "source_url", "t2"])
    near = near.unionByName(sure.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return own.unionByName(near).select("a", "b", F.lit("same company with highly similar title").alias("reason")).distinct()


def all_links(jobs: DataFrame) -> DataFrame:
    """DED-01: links of every rule."""
    return exact_links(jobs).unionByName(similar_links(jobs))


def clusters(links: DataFrame) -> DataFrame:
    """DED-02: (ingest_seq, cluster) of rows that have a duplicate."""
    return connected_components(links.select("a", "b")).select(F.col("node").alias("ingest_seq"), F.col("component").alias("cluster"))


def reasons(links: DataFrame, found: DataFrame) -> DataFrame:
    """DED-05: every reason of a cluster, sorted."""
    return links.join(found, links["b"] == found["ingest_seq"]).groupBy("cluster").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def priority(d, column: str, table: dict, default: int) -> str:
    return f"case {column} " + " ".join(f"when {d.lit(k)} then {v}" for k, v in table.items()) + f" else {default} end"


def first_spellings(members: DataFrame, column: str) -> DataFrame:
    """(cluster, column): the distinct case-folded values of an array column,
    in the order of members, each as first spelled. Repeats meet in a partial
    aggregate, so a large cluster sends one row for each value."""
    each = members.select("cluster", "ingest_seq", F.posexplode(column).alias("i", "v"))
    one = each.groupBy("cluster", F.lower("v").alias("f")).agg(F.min(F.struct("ingest_seq", "i", "v")).alias("m"))
    return one.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["v"]).alias(column))


def survivors(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """DED-03: one row per cluster; ties go to the earliest row. Title and
    company are the primary row's, other fields those of their best row; places
    and tags are united; the content hash is that of the merged record."""
    d = SPARK
    rows = jobs.join(found, "ingest_seq").withColumns({
        "p_source": F.expr(priority(d, "source_type", K.SOURCE_PRIORITY, 2)), "p_status": F.expr(priority(d, "status", K.STATUS_PRIORITY, 0)), "n_text": F.length("description"),
        "u_apply": F.expr(R.url_specificity(d, "apply_url", True)), "u_source": F.expr(R.url_specificity(d, "source_url", False)), "seq": -F.col("ingest_seq"),
    })
    top = lambda c, *keys: F.max_by(c, F.struct(*keys, "seq")).alias(c)
    primary = ("p_source", "n_text", "status_confidence", "role_confidence")
    merged = rows.groupBy("cluster").agg(
        F.count("*").alias("members"), top("title", *primary), top("company_name", *primary), top("source_type", *primary), top("description", "n_text"), top("status", "status_confidence", "p_status"), top("role_family", "role_confidence"),
        top("sponsorship", "eligibility_confidence"), top("apply_url", "u_apply"), top("source_url", "u_source"), F.min("posted_at").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("last_seen").alias("last_verified"),
        F.when(F.bool_or("is_internship"), F.array(F.lit("internship"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    places = first_spellings(rows.select("cluster", "ingest_seq", "locations"), "locations")
    merged = merged.join(places, "cluster", "left").withColumn("locations", F.coalesce("locations", F.array().cast("array<string>")))
    return merged.withColumn("content_hash", F.expr(content_hash(d)))


def content_hash(d) -> str:
    return f"substr({d.sha1('concat(lower(title), chr(10), lower(description), chr(10), source_url)')}, 1, 16)"


def members(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """JOIN-15: (cluster, ingest_seq, source_type, source_url, place) of every
    member, numbered within its cluster."""
    rows = jobs.join(found, "ingest_seq").select("cluster", "ingest_seq", "source_type", "source_url")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy("ingest_seq")).cast("long"))


def resolved_order(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """DED-04: (ingest_seq, single): one row per cluster (its first) and every
    other row; merged ones come first, each part in order."""
    rows = jobs.select("ingest_seq").join(found, "ingest_seq", "left").where("cluster is null or cluster = ingest_seq")
    return rows.select("ingest_seq", F.col("cluster").isNull().alias("single")).orderBy("single", "ingest_seq")
