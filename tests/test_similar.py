"""Similar titles: the index of character pairs against comparing all with all."""

import random
from difflib import SequenceMatcher

from postforge.functions import fixed as K
from postforge.operators import resolve


def test_index_finds_every_similar_pair(spark):
    rng = random.Random(8)
    words = ["intern", "engineer", "quant", "trader", "data", "c++", "é", "ab", "aa", "2027", "x"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)]
    for t in list(titles):  # near ones: letters dropped, added, moved
        for _ in range(4):
            u = list(t)
            for _ in range(rng.randint(1, 1 + len(u) // 6)):
                at = rng.randrange(len(u) + 1)
                u[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a", u[0] if u else "q"])
            titles.append("".join(u))
    titles += ["", "a", "b", "ab", "abc", "abcd", "abce", "aaaaaaa", "aaaaaaaa", "Intern", "INTERN"]
    rows = [(f"f{rng.randrange(3)}", i, t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "company_id string, ingest_seq long, title string")
    first = {}
    for firm, i, t in rows:
        first.setdefault((firm, t.lower()), i)
    want = set()
    for (f, t), i in first.items():
        for (g, u), j in first.items():
            if f == g and i < j and (r := SequenceMatcher(None, t, u).ratio() * 100) > K.LIKELY_SIMILARITY:
                want.add((f, t, u, round(r, 9)))
    got = {(r.company_id, r.t1, r.t2, round(r.similarity, 9)) for r in resolve.similar_titles(df).collect()}
    assert got == want and len(want) > 100


def test_candidates_are_few_where_titles_differ(spark):
    """A firm of many unlike titles is not joined with itself."""
    rng = random.Random(2)
    rows = [("f", i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30))) for i in range(1500)]
    df = spark.createDataFrame(rows, "company_id string, ingest_seq long, title string")
    grams = resolve.title_grams(df.selectExpr("company_id", "title as t", "ingest_seq as seq"))
    assert grams.groupBy("t").count().agg({"count": "max"}).first()[0] <= int(30 * resolve.LOST) + 1
    assert resolve.similar_titles(df).count() == 0


def test_long_and_single_titles(spark):
    df = spark.createDataFrame([("f", 1, "word " * 400), ("f", 2, "word " * 399 + "work "), ("g", 3, "word " * 400)], "company_id string, ingest_seq long, title string")
    assert [(r.company_id, r.similarity > 99) for r in resolve.similar_titles(df).collect()] == [("f", True)]
    assert resolve.similar_titles(df.limit(0)).count() == 0
