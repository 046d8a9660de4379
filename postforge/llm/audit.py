"""Filter interaction audit: what each filter removes in every order of the filters.

1. Texts are fingerprinted (XXH64) and dealt by range of (fingerprint, id, salt),
   so that no group of copies, however large, has to fit a task. Each task sorts
   by fingerprint, full text and id and compares every row with the row before
   it: equal texts form a run whose first id is its smallest. The same pass
   takes the figures of the text that the other filters judge.
2. A fingerprint that ends one task's rows and begins another's is a boundary.
   There is at most one a task, so the runs at boundaries, told by SHA-256, are
   a small table: the smallest id of each is merged and handed back.
3. Failed filters become a bit mask. Rows are added up by (part, mask), at most
   2 ** filters counters a part, whatever the input; kept, removed, redundant and
   Shapley figures of all orders follow from these counters alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.session import cut, shuffle_partitions, small_batches

#: Failure conditions over the columns of :func:`text_figures`.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_points",
    "D": "n_symbols > 0",
    "E": "repeated",
}
#: All orders of the filters are listed: 720 of six.
MOST_FILTERS = 6

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point
_FIGURES = ("n_words", "n_distinct", "n_upper", "n_points", "n_symbols")
_SCHEMA = "fp long, id long, part string, " + ", ".join(f"{c} long" for c in _FIGURES) + ", digest binary, first long"


def figures(text: bytes) -> tuple[int, ...]:
    """Words, distinct words, capital letters A-Z, code points and symbols of a UTF-8 text."""
    words = text.split()
    n = len(text)
    return len(words), len(set(words)), n - len(text.translate(None, _UPPER)), len(text.translate(None, _CONTINUED)), n - len(text.translate(None, _SYMBOLS))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, id, part, text) in order of fingerprint, text and id to
    figures, the text's digest and the smallest id of its run in this task."""
    fp_before, text_before, first, found, digest = None, None, None, None, None
    for batch in batches:
        rows, digests, firsts = [], [], []
        for fp, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            text = text.as_py()
            if fp != fp_before or text != text_before:
                fp_before, text_before, first = fp, text, own
                found, digest = figures(text), hashlib.sha256(text).digest()
            rows.append(found)
            digests.append(digest)
            firsts.append(first)
        counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(_FIGURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts, pa.array(digests, pa.binary()), pa.array(firsts, pa.int64())], names=["fp", "id", "part", *_FIGURES, "digest", "first"])


def text_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, n_words, n_distinct, n_upper, n_points, n_symbols, repeated)
    of every row; ``repeated``: a smaller id holds the identical text.

    Null texts are empty ones, null parts the empty string. Ids are integers;
    rows that repeat an id do not repeat each other, and a null id is neither
    smaller nor larger than any. Columns of other names are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fp"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.cast("binary").alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "fp", "id", F.rand(11)).sortWithinPartitions("fp", "text", F.asc_nulls_last("id"))
    compared = cut(dealt.mapInArrow(_compared, _SCHEMA).withColumn("task", F.spark_partition_id()))
    # boundaries: fingerprints at the edge of more than one task, so fewer than there are tasks
    edges = compared.groupBy("task").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).select("task", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("fp"))
    shared = edges.groupBy("fp").count().where("count > 1").select("fp")
    runs = compared.join(F.broadcast(shared), "fp").groupBy("fp", "digest").agg(F.min("first").alias("overall"))
    merged = compared.join(F.broadcast(runs), ["fp", "digest"], "left")
    smallest = F.coalesce("overall", "first")
    return merged.select(F.col("id").alias(id_col), "part", *_FIGURES, F.coalesce(F.col("id") > smallest, F.lit(False)).alias("repeated"))


def failure_mask(filters: Mapping[str, str] = FILTERS) -> Column:
    """The failed filters as a number, the first one its lowest bit."""
    return sum((F.when(F.expr(f), 1 << i).otherwise(0) for i, f in enumerate(filters.values())), F.lit(0)).cast("int")


def _marked(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (id, part, mask) with ``good`` and ``toxic``: some label row of the id says so."""
    said = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic"))
    said = cut(said.where("id is not null and (good or toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    known = rows.where("id is not null").join(said, "id", "left")
    return known.unionByName(rows.where("id is null"), allowMissingColumns=True)


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: (part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``filters``: one-letter names and their failure conditions over the columns
    of :func:`text_figures`, at most six. A condition that is null counts as
    passed. ``shapley`` is the removed rows of the step's filter, summed over all
    orders. An id with several label rows is good (toxic) if one says so; rows
    that repeat an id are counted each. No rows, no parts.
    """
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters of one letter each")
    rows = text_figures(docs, id_col, text_col, part_col).select(F.col(id_col).alias("id"), "part", failure_mask(filters).alias("mask"))
    counted = _marked(rows, labels, id_col).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    return orders(counted, names)


def orders(counted: DataFrame, names: list[str]) -> DataFrame:
    """Counters (part, mask, n, good, toxic) to the rows of :func:`audit`."""
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))  # 2 ** filters at most
    steps = [(order, step, names.index(f), sum(1 << names.index(g) for g in order[:step])) for order in map("".join, permutations(names)) for step, f in enumerate(order)]
    listed = ", ".join(f"struct('{order}' as filter_order, {step + 1} as step, {1 << bit} as own, {earlier} as earlier)" for order, step, bit, earlier in steps)
    rows = held.select("part", "held", F.explode(F.expr(f"array({listed})")).alias("s")).select("part", "held", "s.*")

    def added(what: str, where: str) -> Column:
        return F.expr(f"aggregate(filter(held, x -> {where}), 0L, (a, x) -> a + {what})")

    fails, before = "(x.mask & own) <> 0", "(x.mask & earlier) <> 0"
    removed = f"{fails} and not {before}"
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        added("x.n", "(x.mask & (own | earlier)) = 0").alias("kept"),
        added("x.n", removed).alias("removed"),
        added("x.n", f"{fails} and {before}").alias("redundant"),
        added("x.n", "x.mask = own").alias("unique_fails"),
        added("x.good", removed).alias("good_lost"),
        added("x.toxic", removed).alias("toxic_lost"),
        # of the filters that a row fails, each comes first in an equal share of all orders
        added(f"x.n * ({factorial(len(names))} div bit_count(x.mask))", fails).alias("shapley"),
    )
