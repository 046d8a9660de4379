"""Evidence of every posting, and the review queue with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from postforge.dialect import DUCK, SPARK
from postforge.functions import fixed as K
from postforge.operators import classify, evidence
from postforge.plans import catalog, postings, serve
from postforge.session import cut

LISTS = ("role_evidence", "status_evidence", "eligibility_evidence", "explanation", "evidence")


def _shown(d) -> str:
    return ", ".join(f"{d.join(c, ' | ')} as {c}" for c in LISTS)


def all_evidence(spark, sf_dir):
    return evidence.with_evidence(postings.jobs(spark, sf_dir), every=True).selectExpr("ingest_seq", *[f"{SPARK.join(c, ' | ')} as {c}" for c in LISTS])


def review_items(spark, sf_dir):
    """REV-02: the queue with its evidence, which only the rows of the queue need."""
    queue = serve.review_queue(postings.jobs(spark, sf_dir)).select("ingest_seq", "reasons", *evidence.READS)
    queue = cut(queue)  # else Spark moves evidence under the limit, and sorts all rows for it
    return evidence.with_evidence(queue).selectExpr("ingest_seq", f"{SPARK.join('reasons', ' | ')} as reasons", *[f"{SPARK.join(c, ' | ')} as {c}" for c in LISTS])


def apply_now(spark, sf_dir):
    found = evidence.with_explanation(postings.jobs(spark, sf_dir), "apply_now")
    return found.select("ingest_seq", F.expr(SPARK.join("explanation", " | ")).alias("why"))


def _twin(final: str, preset: str = K.DEFAULT_PRESET) -> str:
    said = classify.oracle_evidence(DUCK, "title_f", "body_f", "department_f", "categories_f")
    ctes = [f"e as materialized (select *, {said} ev_ from jobs)", f"e0 as materialized (select *, case when weak_ then {DUCK.slice('ev_', 2)} else {DUCK.slice('ev_', 8)} end role_evidence from e)"]
    for n, layer in enumerate(evidence.layers(DUCK, preset)):
        ctes.append(f"e{n + 1} as materialized (select *, {', '.join(f'{e} as {c}' for c, e in layer.items())} from e{n})")
    return postings.jobs_sql("").rstrip() + ", " + ", ".join(ctes) + f" {final}"


catalog.register("q_evidence", all_evidence, _twin(f"select ingest_seq, {_shown(DUCK)} from e4"))
catalog.register(
    "q_review_items", review_items,
    _twin(f"select ingest_seq, {DUCK.join('r', ' | ')} as reasons, {_shown(DUCK)} from (select *, {serve.review_reasons(DUCK)} r from e4) where len(r) > 0 order by len(r) desc, hidden_gem desc, opportunity desc, company_name, title, ingest_seq limit 50"),
)
catalog.register("q_explanation_apply_now", apply_now, _twin(f"select ingest_seq, {DUCK.join('explanation', ' | ')} as why from e4", "apply_now"))
