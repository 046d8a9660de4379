"""One query per corpus operator, over its whole table, and the DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.llm import audit, decontam, language, licenses, lines, lm, packing, quality, ranked, simhash, substrings, urls, vectors
from postforge.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_passages(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit_language(docs))
    return found.select("doc_id", language.is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontamination": op6_decontamination,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality": op13_quality,
}

_GAP = decontam.GAP
_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    # lines: split, key, owner, keep
    "op2_line_dedup": rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
e as (select doc_id, unnest(l) line, unnest(range(len(l))) i from d),
k as (select *, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), '{urls.UPPER}', '{urls.LOWER}') as key from e),
o as (select key, min(doc_id) own, count(distinct doc_id) n from k where length(key) >= 10 group by key),
m as (select k.*, coalesce(o.n >= 2 and o.own <> k.doc_id, false) gone from k left join o on o.key = k.key)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
from m group by doc_id""",
    "op4_url_filter": urls.oracle_sql(),
    # all windows of all items against all places of all documents
    "op6_decontamination": rf"""
with f as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_GAP}'), lambda w: w <> '') w from documents),
i as (select item_id, list_filter(regexp_split_to_array(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{_GAP}'), lambda w: w <> '') w from benchmark),
v as (select item_id, w, least(len(w), 10)::bigint z from i where len(w) > 0),
x as (select distinct item_id, z, array_to_string(w[s:s + z - 1], ' ') t from (select *, unnest(range(1, (len(w) - z + 2)::bigint)) s from v)),
z as (select distinct z from x),
p as (select doc_id, z, unnest(range(1, (len(w) - z + 2)::bigint)) s, w from f cross join z where len(w) >= z),
h as (select p.doc_id, p.s, p.z, x.item_id from (select doc_id, s, z, array_to_string(w[s:s + z - 1], ' ') t from p) p join x on p.t = x.t and p.z = x.z),
n as (select doc_id, count(distinct u) n_hit from (select doc_id, unnest(range(s, s + z)) u from h) group by doc_id),
m as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) t from h group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(t, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from f left join n using (doc_id) left join m using (doc_id)""",
    # equal cosine in double precision, components by recursion over links
    "op7_embedding_dedup": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
good as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) n from v
  where e is not null and len(e) > 0 and not list_contains(list_transform(e, lambda x: x is null or not isfinite(x)), true)),
u as (select vec_id, list_transform(e, lambda x: x / n) e from good where n > 0),
p as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) >= 0.95),
r as (select vec_id a, vec_id b from v union select r.a, p.b from r join p on p.a = r.b),
c as (select a vec_id, min(b) component_id from r group by a),
n as (select a vec_id, count(*) n from p group by a)
select v.vec_id, coalesce(n.n, 0)::bigint n_links, c.component_id, v.vec_id = c.component_id kept
from v join c using (vec_id) left join n using (vec_id)""",
    # passages: the word lists of all windows and their smallest document
    "op9_substring_dedup": rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '') w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 48)) i from d),
h as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from s),
o as (select h, min(doc_id) own from h group by h having min(doc_id) < max(doc_id)),
g as (select distinct doc_id, unnest(range(i, i + 50)) i from h join o using (h) where own < doc_id),
x as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from d),
k as (select x.doc_id, count(*) n, count(g.i) r, string_agg(word, ' ' order by x.i) filter (g.i is null) t
  from x left join g on g.doc_id = x.doc_id and g.i = x.i group by x.doc_id)
select doc_id, coalesce(n, 0)::bigint n_words, coalesce(r, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join k using (doc_id)""",
    # masks, all orders of five letters by recursion, and a plain sum over orders for the Shapley figure
    "op11_filter_audit": rf"""
with recursive d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '') w from documents),
f as (select doc_id, part, (len(w) < 100)::int a, (100 * len(list_distinct(w)) < 80 * len(w))::int b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int c, regexp_matches(t, '[#$%&*|]')::int d,
    coalesce(doc_id > min(doc_id) over (partition by t), false)::int e from d),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
m as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e mask, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic
  from f left join l using (doc_id) group by 1, 2),
o as (select '' s union all select s || x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) x) where not contains(s, x)),
p as (select s, unnest(range(1, 6)) step from o where length(s) = 5),
q as (select s, step, (1 << (ascii(s[step]) - 65)) own,
    list_sum([0] || list_transform(string_split(s[1:step - 1], ''), lambda x: case when x = '' then 0 else 1 << (ascii(x) - 65) end))::int earlier from p),
r as (select part, s filter_order, step::int step, own,
    sum(n) filter (mask & (own | earlier) = 0) kept, sum(n) filter (mask & own <> 0 and mask & earlier = 0) removed,
    sum(n) filter (mask & own <> 0 and mask & earlier <> 0) redundant, sum(n) filter (mask = own) unique_fails,
    sum(good) filter (mask & own <> 0 and mask & earlier = 0) good_lost, sum(toxic) filter (mask & own <> 0 and mask & earlier = 0) toxic_lost
  from m cross join q group by part, s, step, own)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant,
  coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost,
  coalesce(sum(removed) over (partition by part, own), 0)::bigint shapley from r""",
    # every posting of every item's terms, summed and ranked
    "op12_ranked_search": rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{ranked.GAP}'), lambda w: w <> '') w from documents),
s as (select count(*) filter (len(w) > 0)::bigint total, sum(len(w))::bigint words from d),
i as (select item_id, term, count(*) k from (select item_id, unnest(list_filter(regexp_split_to_array(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{ranked.GAP}'), lambda w: w <> '')) term from benchmark) group by all),
t as (select doc_id, len(w)::bigint n, term, count(*)::bigint tf from (select doc_id, w, unnest(w) term from d) where term in (select term from i) group by all),
f as (select term, floor(1000 * ln((2 * total + 2)::double / (2 * count(*) + 1)))::bigint w from t, s group by term, total),
x as (select item_id, doc_id, sum(k * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // words))))::bigint score
  from i join t using (term) join f using (term), s group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20""",
}
