"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A text's k-gram hashes are thinned to the minimum of every run of
WINDOW - k + 1, so any WINDOW shared words leave a common fingerprint in both
texts. Fingerprints of the documents meet those of the items; matching k-grams
are extended to the windows that hold them, and windows are compared as words.
Items shorter than a window have no guaranteed fingerprint: their whole length
is hashed instead, one pass for each such length (at most WINDOW - 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.session import cut

WINDOW = 10
K = 5
#: Fingerprints of the items that a broadcast may hold; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, GAP), "")


def exact_words(text: F.Column) -> F.Column:
    """Words after lower-casing A-Z only."""
    return _split(F.translate(text, UPPER, LOWER))


def folded_words(text: F.Column) -> F.Column:
    """Words after full lower-casing: cheaper, with the same places. Texts that
    share exact words share these; matches are compared exactly later."""
    return _split(F.lower(text))


def _hashes(words: str) -> F.Column:
    return F.expr(f"transform({words}, w -> xxhash64(w))")


def _grams(hashes: str, n: int) -> F.Column:
    """Hash of every n consecutive word hashes; empty for shorter texts."""
    parts = ", ".join(f"get({hashes}, i + {j})" for j in range(n))
    return F.expr(f"case when size({hashes}) >= {n} then transform(sequence(0, size({hashes}) - {n}), i -> xxhash64({parts})) else array() end")


def _winnowed(grams: str, run: int) -> F.Column:
    parts = ", ".join(f"get({grams}, i + {j})" for j in range(run))
    return F.expr(f"case when size({grams}) >= {run} then array_distinct(transform(sequence(0, size({grams}) - {run}), i -> least({parts}))) else array() end")


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(item, size, words): the distinct windows of every item as joined words."""
    base = items.select(F.col(id_col).alias("item"), exact_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    base = base.withColumn("size", size)
    return base.select("item", "size", F.explode(F.expr("array_distinct(transform(sequence(0, size(w) - size), i -> array_join(slice(w, i + 1, size), ' ')))")).alias("words"))


def window_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, item, start, size): occurrences of item windows in documents."""
    run = window - k + 1
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    windows = cut(item_windows(items, item_col, item_text, window))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `window` values
    texts = items.select(folded_words(F.col(item_text)).alias("w")).withColumn("h", _hashes("w"))
    hashed = source.select("id", folded_words(F.col("text")).alias("w")).select("id", _hashes("w").alias("h"))
    found = []
    if window in sizes:
        marks = cut(texts.withColumn("g", _grams("h", k)).select(F.explode(_winnowed("g", run)).alias("fp")).distinct())
        held = _maybe_broadcast(marks, marks.count())
        fps = hashed.select("id", _grams("h", k).alias("g")).select("id", F.explode(_winnowed("g", run)).alias("fp")).join(held, "fp", "left_semi")
        found.append(fps.groupBy("id").agg(F.collect_set("fp").alias("fps"), F.lit(None).cast("array<struct<start:int,size:int>>").alias("short")))
    for n in (s for s in sizes if s < window):
        marks = cut(texts.where(F.size("h") == n).select(F.get(_grams("h", n), F.lit(0)).alias("fp")).distinct())
        held = _maybe_broadcast(marks, marks.count())
        places = hashed.select("id", F.posexplode(_grams("h", n)).alias("start", "fp")).join(held, "fp", "left_semi")
        found.append(places.groupBy("id").agg(F.lit(None).cast("array<bigint>").alias("fps"), F.collect_list(F.struct("start", F.lit(n).alias("size"))).alias("short")))
    if not found:
        return windows.limit(0).select(F.lit(None).cast(dict(source.dtypes)["id"]).alias("id"), "item", F.lit(0).alias("start"), "size")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    if len(found) > 1:
        hits = hits.groupBy("id").agg(F.first("fps", ignorenulls=True).alias("fps"), F.flatten(F.collect_list("short")).alias("short"))
    near = source.join(cut(hits), "id")
    near = near.select("id", "fps", "short", exact_words(F.col("text")).alias("w"), _split(F.lower("text")).alias("f")).withColumn("h", _hashes("f")).withColumn("g", _grams("h", k))
    starts = f"""concat(coalesce(short, array()), case when fps is null or size(w) < {window} then array() else
      transform(array_distinct(flatten(transform(filter(sequence(0, size(g) - 1), i -> array_contains(fps, get(g, i))),
        p -> sequence(greatest(0, p - {window - k}), least(p, size(w) - {window}))))), s -> named_struct('start', s, 'size', {window})) end)"""
    spans = near.withColumn("starts", F.expr(starts)).select("id", F.explode(F.expr("transform(starts, s -> named_struct('start', s.start, 'size', s.size, 'words', array_join(slice(w, s.start + 1, s.size), ' ')))")).alias("s"))
    spans = spans.select("id", "s.start", "s.size", "s.words")
    held = _maybe_broadcast(windows, windows.count())
    return spans.join(held, ["words", "size"]).select("id", "item", "start", "size")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, n_words, n_hit, n_items, items array<string>, spans array of hit
    word ranges, contaminated), one row per row of ``docs``.

    Null text has no words; null or wordless items have no window; rows
    without an id are never hit; rows that repeat an id share their hits.
    """
    hits = window_hits(docs, items, id_col, text_col, item_col, item_text, window, k)
    spans = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("s"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    step = """aggregate(s, named_struct('n', 0L, 'last', 0), (a, x) -> named_struct(
      'n', a.n + greatest(0, x.end - greatest(x.start, a.last)), 'last', greatest(a.last, x.end))).n"""
    spans = spans.select("id", F.expr(step).alias("n_hit"), "items", F.col("s").alias("spans"))
    counted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    out = counted.join(spans, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", (n_hit > 0).alias("contaminated"))
