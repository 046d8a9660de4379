"""Pack, configuration and override files: YAML on the driver, small frames out."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRM_SCHEMA = "id string, name string, aliases array<string>, website string, careers_url string, ats_type string, ats_slug string, categories array<string>, default_prestige_tier string, notes string, seq long"


class PackError(ValueError):
    """A missing, malformed or wrongly shaped file."""


def load_yaml(path: str | Path, kind: type = dict) -> Any:
    """SRC-12: the document, or PackError."""
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise PackError(f"{path}: {e}") from e
    except yaml.YAMLError as e:
        raise PackError(f"{path}: not YAML") from e
    if not isinstance(data, kind):
        raise PackError(f"{path}: a {kind.__name__} is needed")
    return data


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """MAP-01: maps merge, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load_layers(*paths: str | Path) -> dict:
    """SRC-13/14: later files win; absent ones are skipped."""
    out: dict = {}
    for p in paths:
        if Path(p).exists():
            out = deep_merge(out, load_yaml(p))
    return out


def firms_frame(spark: SparkSession, firms: list[Mapping]) -> tuple[DataFrame, list[str]]:
    """(valid firms, errors): a bad record is an error, the others survive."""
    rows, errors = [], []
    for i, f in enumerate(firms):
        if not isinstance(f, Mapping) or not isinstance(f.get("id"), str) or not isinstance(f.get("name"), str):
            errors.append(f"record {i}: id and name are needed")
            continue
        rows.append((f["id"], f["name"], list(f.get("aliases") or []), f.get("website"), f.get("careers_url"), f.get("ats_type"), f.get("ats_slug"), list(f.get("categories") or []), f.get("default_prestige_tier"), f.get("notes"), i))
    return spark.createDataFrame(rows, FIRM_SCHEMA), errors


def validate_firms(firms: DataFrame) -> DataFrame:
    """DQ-01: one row: repeated ids and names (folded), missing fields, verdict."""
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    repeats = lambda c: firms.groupBy(F.lower(c).alias("k")).agg(F.count("*").alias("n"), F.min_by(c, "seq").alias("v"), F.min("seq").alias("s")).where("n > 1").agg(F.array_sort(F.collect_list(F.struct("s", "v"))).alias("r")).select(F.transform("r", lambda x: x["v"]).alias(f"repeated_{c}"))
    out = firms.agg(F.count("*").alias("firms"), blank("website").alias("no_website"), blank("careers_url").alias("no_careers_url"), blank("ats_type").alias("no_ats_type"))
    out = out.join(repeats("id")).join(repeats("name"))  # one row each
    return out.withColumn("valid", (F.size("repeated_id") == 0) & (F.size("repeated_name") == 0) & (F.col("firms") > 0))


def search_firms(firms: DataFrame, query: str) -> DataFrame:
    """FLT-06: id, name, alias or category holds the query; blank finds none."""
    q = F.lit(query.strip().lower())
    parts = F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("categories", F.array().cast("array<string>")))
    return firms.where(F.lit(bool(query.strip())) & F.exists(parts, lambda x: F.contains(F.lower(x), q)))


def select_firms(firms: DataFrame, query: str | None = None, most: int | None = None) -> DataFrame:
    """FLT-05: firms by part of id, name or alias, in file order."""
    if query:
        q = F.lit(query.strip().lower())
        firms = firms.where(F.exists(F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.contains(F.lower(x), q)))
    firms = firms.orderBy("seq")
    return firms.limit(most) if most is not None else firms
