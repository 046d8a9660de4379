"""Empty tables, lone rows and repeated rows."""

from postforge.llm import decontam, language, licenses, lines, lm, packing, simhash, substrings, urls, vectors

DOCS = "doc_id long, text string, lang string"


def test_empty_tables_give_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert lm.score_documents(docs).count() == 0
    assert decontam.contamination(docs, bench).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert language.identify(docs, language.fit_language(docs)).count() == 0
    assert simhash.near_copies(docs).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a text without an id", None), (1, "same text " * 60, "en"), (1, "same text " * 60, "en"), (2, "same text " * 60, None)], DOCS)
    bench = spark.createDataFrame([(None, None), (1, "same text same text same text same text same text")], "item_id long, text string")
    assert [r.n_removed for r in substrings.drop_repeated_passages(docs).orderBy("doc_id").collect()] == [0, 0, 0, 120]
    assert [r.n_dropped for r in lines.drop_repeated_lines(docs).orderBy("doc_id").collect()] == [0, 0, 0, 1]
    assert [r.component_id for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 1]
    assert [r.contaminated for r in decontam.contamination(docs, bench).orderBy("doc_id").collect()] == [False, True, True, True]
    assert licenses.scan_licenses(docs).count() == 4 and packing.pack(docs).select("doc_id").distinct().count() == 3
