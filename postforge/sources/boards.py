"""Captured board responses as a table, with fault isolation (SRC-23).

Spark reads the files itself, so any file system it knows will do; a file that
cannot be parsed becomes an error row and the others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def captured_boards(spark: SparkSession, path: str) -> DataFrame:
    """(file, company_id, company_name, payload, error) of every file below
    ``path``: documents {"company_id", "company_name"?, "payload"}. The payload
    stays JSON text for the board readers; an error names what is missing."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    held = texts.select("file", F.try_parse_json("value").isNull().alias("broken"), *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("company_id", "company_name", "payload")])
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("company_id", "payload")])
    error = F.when(F.col("broken"), "not JSON").when(missing != "", F.concat(F.lit("missing: "), missing))
    good = error.isNull()
    return held.select("file", *[F.when(good, F.col(c)).alias(c) for c in ("company_id",)], F.when(good, F.coalesce("company_name", "company_id")).alias("company_name"), F.when(good, F.col("payload")).alias("payload"), error.alias("error"))
