"""Row work of a small table goes to many tasks, and that of a text is done once."""

from pyspark.sql import functions as F

from postforge.functions import fixed as K
from postforge.operators import evidence, resolve
from postforge.plans import evidence_queries, postings, queries
from postforge.session import once, tasks

SF = "/root/testdata/sf0.001"


def test_keys_are_dealt_to_tasks(spark):
    rows = postings.postings(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 4


def test_derived_once_for_each_value(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, ("a", "b", None)[i % 3], (None, "", "x")[i % 2]) for i in range(600)], "i long, p string, q string").repartition(7)
    for most in (100, 0):  # broadcast, then joined by a shuffle
        seen.value = 0
        found = once(df, ["p", "q"], lambda rows: rows.mapInArrow(run, "p string, q string").withColumn("both", F.concat_ws("-", "p", "q")), most)
        assert sorted((r.i, r.both) for r in found.collect()) == [(i, "-".join(v for v in (("a", "b", None)[i % 3], (None, "", "x")[i % 2]) if v is not None)) for i in range(600)]
        assert seen.value == 6 and found.columns == ["i", "p", "q", "both"]


def test_layers_are_all_there(spark):
    silver = postings.normalized(postings.postings(spark, SF))
    named = {n for layer in postings.layers(postings.SPARK) for n in layer}
    assert named <= set(silver.columns) and set(postings.TEXT_COLUMNS) <= named
    assert silver.count() == spark.read.parquet(f"{SF}/part.parquet").count()
    assert tasks(spark) >= 4 * spark.sparkContext.defaultParallelism


def test_sentences_are_looked_up_once_for_each_text(spark):
    jobs = postings.jobs(spark, SF)
    plan = evidence_queries.all_evidence(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "eligibility_evidence" in plan and not any(p in plan for p in K.MAJORS.values())
    one, all_ = (evidence.with_evidence(jobs, every=every).select("ingest_seq", *evidence_queries.LISTS) for every in (False, True))
    assert one.count() == all_.count() == jobs.count() and one.exceptAll(all_).isEmpty()


def test_links_of_cluster_reasons_are_made_once(spark, monkeypatch):
    seen = []
    clusters = resolve.clusters
    monkeypatch.setattr(resolve, "clusters", lambda links: seen.append(links) or clusters(links))
    queries.cluster_reasons(spark, SF)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_queue_with_evidence_sorts_no_table(spark):
    plan = evidence_queries.review_items(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "parquet" not in plan


def test_explanations_look_depth_up_once_for_each_text(spark):
    jobs, shown = postings.jobs(spark, SF), ("ingest_seq", "explanation")
    found = evidence.with_explanation(jobs, "apply_now").select(*shown)
    assert evidence.NOT_TECHNICAL not in evidence_queries.apply_now(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == jobs.count() and found.exceptAll(evidence.with_evidence(jobs, "apply_now").select(*shown)).isEmpty()


def test_places_and_role_scores_once_for_each_value(spark):
    silver = postings.normalized(postings.postings(spark, SF))
    gold = postings.scored(postings.silver(spark, SF))
    for df, column, own, rule in ((silver, "locations", "remote_type", postings.R.locations(postings.SPARK, "location", "remote_type")), (gold, "technical_depth", "role_family", postings.R.technical_depth(postings.SPARK, "title_f", "body_f", "role_family"))):
        plan = df.select(column)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan.split("Join")[0] and not any(f", {k})" in plan for k in K.STRONG_KEYWORDS)
        assert df.select(column, own, F.expr(rule).alias("again")).where("not (again <=> " + column + ")").isEmpty()


def test_first_spellings_fold_each_value_once(spark):
    rule = postings.SPARK.fold_distinct("v")
    assert rule.count("lower(") == 1
    rows = [(["B", "b", "A", "a", "B"],), ([],), (None,), ([None, "x", "X"],)]
    assert [r.f for r in spark.createDataFrame(rows, "v array<string>").select(F.expr(rule).alias("f")).collect()] == [["B", "A"], [], None, ["x"]]


def test_picks_are_one_lookup(spark):
    rule = postings.pick(postings.SPARK, "k", ("a", "b'", "c"))
    assert "case" not in rule
    assert [r.p for r in spark.createDataFrame([(0,), (4,), (5,), (-1,), (None,)], "k long").select(F.expr(rule).alias("p")).collect()] == ["a", "b'", "c", None, None]
