"""DSC-01: search queries as cross joins of term tables, template by template.

Terms are rows (kind, place, term). A template is a cross join of the tables
it names; every query carries its template's number and its terms' places, the
first of equal folded texts stays, and a limit on that order ends the list.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postforge.functions import fixed as K

#: kind: (terms in order, names they may be asked by, how many are used unless all are)
KINDS = {
    "role": (K.DISCOVERY_ROLES, K.DISCOVERY_ROLES, 8),
    "season": (K.DISCOVERY_SEASONS, K.DISCOVERY_SEASONS, 4),
    "domain_term": (tuple(K.DISCOVERY_DOMAINS.values()), tuple(K.DISCOVERY_DOMAINS), 5),
    "hidden_gem_term": (K.DISCOVERY_GEMS, K.DISCOVERY_GEMS, 8),
    "location_term": (K.DISCOVERY_PLACES, K.DISCOVERY_PLACES, 5),
}


def term_table(spark: SparkSession, places: DataFrame | None = None) -> DataFrame:
    """(kind, place, term, name, usual) of every known term; ``places`` (place
    int, term), a pack's own, stand for the built-in ones."""
    rows = [(kind, i, term, name, i < usual) for kind, (terms, names, usual) in KINDS.items() for i, (term, name) in enumerate(zip(terms, names, strict=True))]
    known = spark.createDataFrame(rows, "kind string, place int, term string, name string, usual boolean")
    if places is None:
        return known
    usual = F.col("place") < KINDS["location_term"][2]
    own = places.select(F.lit("location_term").alias("kind"), F.col("place").cast("int").alias("place"), "term", F.col("term").alias("name"), usual.alias("usual"))
    return known.where("kind <> 'location_term'").unionByName(own)


def used_terms(known: DataFrame, asked: dict[str, str], exhaustive: bool) -> DataFrame:
    """(kind, place, term): of a kind that is asked for, the terms of that text
    or name, else the first domain whose name begins so, else the text itself
    (a domain must be known); of other kinds the usual ones or all. Years are
    those of the seasons used, in their order."""
    spark = known.sparkSession
    words = spark.createDataFrame([(k, v.strip().lower(), v.strip()) for k, v in asked.items()], "kind string, low string, text string")
    met = known.join(F.broadcast(words), "kind").withColumn("rank", F.when((F.lower("term") == F.col("low")) | (F.lower("name") == F.col("low")), 0).when((F.col("kind") == "domain_term") & F.lower("name").startswith(F.col("low")), 1)).where("rank is not null")
    best = met.groupBy("kind").agg(F.min(F.struct("rank", "place", "term")).alias("b")).select("kind", "b.place", "b.term")
    own = words.join(best, "kind", "left_anti").select("kind", F.lit(0).alias("place"), F.col("text").alias("term"))
    if "domain_term" in asked and not own.where("kind = 'domain_term'").isEmpty():
        raise ValueError(f"unknown domain {asked['domain_term']}; known: {', '.join(sorted(K.DISCOVERY_DOMAINS))}")
    rest = known.join(words, "kind", "left_anti").where(F.lit(exhaustive) | F.col("usual")).select("kind", "place", "term")
    used = best.unionByName(own).unionByName(rest)
    years = used.where("kind = 'season'").select("place", F.explode(F.regexp_extract_all("term", F.lit(r"\b(20\d{2})\b"))).alias("term"))
    return used.unionByName(years.groupBy("term").agg(F.min("place").alias("place")).select(F.lit("year").alias("kind"), "place", "term"))


def filled(terms: DataFrame, number: int, template: str) -> DataFrame:
    """(at, query) of one template: at orders queries by template and places."""
    pieces = re.split(r"\{(\w+)\}", template)
    names = pieces[1::2]
    tables = [terms.where(F.col("kind") == n).select(F.col("place").alias(f"p{i}"), F.col("term").alias(f"t{i}")) for i, n in enumerate(names)]
    joined = reduce(DataFrame.crossJoin, tables)
    text = F.concat(*[F.lit(x) if i % 2 == 0 else F.col(f"t{i // 2}") for i, x in enumerate(pieces)])
    return joined.select(F.array(F.lit(number), *[F.col(f"p{i}") for i in range(len(names))]).alias("at"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("query"))


def discovery_frame(spark: SparkSession, season: str | None = None, role: str | None = None, domain: str | None = None, limit: int | None = None, exhaustive: bool = False, places: DataFrame | None = None) -> DataFrame:
    """(position, query): at most ``limit`` distinct queries (60, or 250 if exhaustive)."""
    asked = {k: v for k, v in (("season", season), ("role", role), ("domain_term", domain)) if v and v.strip()}
    terms = used_terms(term_table(spark, places), asked, exhaustive).cache()
    templates = (*K.DISCOVERY_TEMPLATES, *(K.DISCOVERY_EXHAUSTIVE if exhaustive else ()))
    every = reduce(DataFrame.unionByName, [filled(terms, i, t) for i, t in enumerate(templates)])
    first = every.groupBy(F.lower("query").alias("folded")).agg(F.min(F.struct("at", "query")).alias("q")).select("q.*")
    kept = first.orderBy("at").limit(limit if limit is not None else (250 if exhaustive else 60))
    return kept.select(F.row_number().over(Window.orderBy("at")).cast("long").alias("position"), "query")


def write_queries(queries: DataFrame, path: str, kind: str | None = None) -> None:
    """SNK-11: text, JSON lines or CSV by ``kind``, else by the path's suffix."""
    suffix = {"txt": "text", "json": "json", "csv": "csv"}.get(path.rsplit(".", 1)[-1].lower())
    kind = (kind or suffix or "text").lower()
    ordered = queries.orderBy("position")
    if kind == "text":
        ordered.select("query").write.mode("overwrite").text(path)
    elif kind in ("json", "csv"):
        getattr(ordered.write.mode("overwrite").option("header", True), kind)(path)
    else:
        raise ValueError(f"unknown format {kind}; known: text, json, csv")
