"""What op10_language rejects: unlearned languages and junk, not clean texts."""

import random

import pytest
from pyspark.sql import functions as F

from postforge.llm import language

DOCS = "/root/testdata/sf0.1/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).where("text rlike '[a-z]' and lang is not null").select("doc_id", "text", "lang").limit(4000).cache()


def rejected(model, texts):
    return sum(model.predict(texts)[2]) / len(texts)


def test_clean_texts_pass_also_as_short_ones(docs):
    model = language.fit_language(docs)
    held = [r.text for r in docs.where(language.is_held_out("doc_id")).collect()]
    rates = {n: rejected(model, [t[:n] for t in held]) for n in (40, 200, 1000, 10**6)}
    print("held-out clean rejected, by characters:", rates)
    assert all(r <= 0.02 for r in rates.values())


def test_an_unlearned_language_and_junk_are_rejected(docs):
    rng = random.Random(1)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789 ") for _ in range(600)) for _ in range(100)]
    for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        model = language.fit_language(docs.where(F.col("lang") != lang))
        other = [r.text for r in docs.where(F.col("lang") == lang).limit(300).collect()]
        rates = rejected(model, other), rejected(model, junk)
        print("rejected without", lang, rates)
        assert min(rates) >= 0.95
