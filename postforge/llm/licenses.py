"""Licence scan by ordered signature rules, in DataFrame expressions only.

A set test on the words lets through documents that hold any word a rule or
base phrase needs; only those are normalised. Rules whose keyword occurs
are tried, each match is an interval of the normalised text. Intervals are
swept in order of start: one that lies within an interval of the same or a
higher priority, met before, is suppressed, so a named version beats the bare
name inside it. Documents that pass the test are swept in one pass, with no
comparison of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.llm.decontam import folded_words
from postforge.llm.license_rules import RULES

#: Phrase and label of the base signatures (fixed values of the contract).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Confidence of a kept detection by priority.
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.95}
#: Every match of a rule and every base phrase holds one of these as a whole word (a test walks all rules).
GATE = (
    "license", "licence", "licensed", "licenced", "licenses", "licences", "unlicense", "unlicence", "copyright", "gpl", "gplv2", "gplv3", "lgpl", "lgplv3", "lgplv2", "agpl", "agplv3", "gfdl", "sspl", "mpl", "mplv2", "epl", "eplv2",
    "spdx", "0bsd", "cc0", "cc", "wtfpl", "unencumbered", "eupl", "cddl", "cecill", "lppl", "ofl", "eula", "etalab", "datenlizenz", "creativecommons", "commons", "domain", "reserved", "rechte", "droits", "derechos", "evil", "psl",
    "hereby", "redistribution", "contributors", "advertising", "consortium", "warranty", "merchantability", "reproduced", "permission", "unauthorized", "confidential", "perl", "agreement", "exception", "apache", "bsd", "openrail", "rail",
    "gplv1", "lgplv", "agplv", "gpl2", "gpl3", "lgpl2", "lgpl3", "agpl3", "mpl2", "mpl1", "epl2", "mplv1", "gplv", "mplv", "eplv",
)


def _literal(rules) -> F.Column:
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(kw).alias("kw"), F.lit(rf"(?<![^ ])(?:{rx})(?![^ ])").alias("rx")) for label, p, kw, rx in rules])


#: Matches of rule r in norm as (start, -end, -priority, label): pieces between matches give the places.
_MATCHES = """transform(
  aggregate(
    zip_with(split(norm, r.rx, -1), regexp_extract_all(norm, r.rx, 0), (gap, hit) -> struct(length(gap) as gap, length(hit) as hit)),
    named_struct('at', 0, 'found', cast(array() as array<struct<start:int,end:int>>)),
    (a, x) -> case when x.hit is null then a else named_struct('at', a.at + x.gap + x.hit,
      'found', array_append(a.found, named_struct('start', a.at + x.gap, 'end', a.at + x.gap + x.hit))) end).found,
  m -> struct(m.start as start, -m.end as back, -r.priority as low, r.label as label))"""

#: ends[p]: the furthest end of a kept detection of priority p or more.
_SWEEP = """aggregate(array_sort(array_distinct(dets)),
  named_struct('e1', -1, 'e2', -1, 'e3', -1, 'labels', cast(array() as array<string>), 'top', 0, 'kept', cast(array() as array<struct<start:int,end:int,label:string>>)),
  (a, d) -> case when -d.back <= (case d.low when -1 then a.e1 when -2 then a.e2 else a.e3 end) then a else named_struct(
    'e1', greatest(a.e1, -d.back), 'e2', case when d.low <= -2 then greatest(a.e2, -d.back) else a.e2 end, 'e3', case when d.low <= -3 then greatest(a.e3, -d.back) else a.e3 end,
    'labels', array_union(a.labels, array(d.label)), 'top', greatest(a.top, -d.low),
    'kept', array_append(a.kept, named_struct('start', d.start, 'end', -d.back, 'label', d.label))) end)"""


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, base=BASE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, detections), one row per row of ``docs``.

    detections: kept intervals (characters of the normalised text) and their
    labels. Null and empty texts have no words; labels are then empty and the
    score 0. Words are those of the fully lower-cased text, which have the
    same places and, in every signature, the same letters as under A-Z alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", folded_words(F.col("text")).alias("w"))
    may = F.arrays_overlap("w", F.array(*[F.lit(x) for x in GATE]))
    rows = rows.select("id", F.size("w").cast("long").alias("n_words"), F.when(may, F.col("w")).alias("w"))  # null: nothing to find
    passed = rows.select("id", "n_words", F.array_join("w", " ").alias("norm"), F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")).alias("wide"))
    # base phrases: every word has spaces of its own, so phrases never share one
    n_base, firsts, lasts, labels = F.lit(0), [], [], []
    spaces = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")
    for phrase, label in base:
        p, n = " " + phrase.replace(" ", "  ") + " ", len(phrase.split())
        found = F.contains(F.col("wide"), F.lit(p))
        n_base = n_base + ((F.length("wide") - F.length(F.replace(F.col("wide"), F.lit(p), F.lit("")))) / len(p)).cast("long")
        firsts.append(F.when(found, spaces(F.substring_index("wide", p, 1))))
        lasts.append(F.when(found, F.col("n_words") - spaces(F.substring_index("wide", p, -1)) - n))
        labels.append(F.when(found, F.lit(label)))
    scanned = passed.select(
        "id", "n_words", "norm", F.coalesce(n_base, F.lit(0)).cast("long").alias("n_base"), F.array_min(F.array(*firsts)).alias("first_word"), F.array_max(F.array(*lasts)).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"), F.when(F.col("norm").isNotNull(), F.filter(_literal(rules), lambda r: F.contains(F.col("norm"), r["kw"]))).alias("active"),
    )
    scanned = scanned.withColumn("dets", F.expr(f"flatten(transform(active, r -> {_MATCHES}))")).withColumn("s", F.expr(_SWEEP))
    score = F.when(F.size("base") > 0, 1.0)
    for priority, confidence in sorted(CONFIDENCE.items(), reverse=True):
        score = score.when(F.col("s.top") == priority, confidence)
    kept = F.coalesce("s.labels", F.array().cast("array<string>"))
    return scanned.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", kept)), ",").alias("labels"), score.otherwise(0.0).alias("score"), F.col("s.kept").alias("detections"),
    )
