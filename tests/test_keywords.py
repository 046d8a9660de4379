"""Keyword configuration: fields over the built-in ones, families by a scalar version, large packs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from postforge.functions import fixed as K
from postforge.operators import keywords
from postforge.operators.keywords import Family, Keywords

TEXTS = "title_f string, body_f string, department_f string, categories_f array<string>"


def test_a_pack_counts_field_by_field():
    base = keywords.built_in()
    found = keywords.resolve({"role_keywords": {"role_families": {"fpga_engineer": {"strong": [" FPGA ", 3, ""], "role_subtype": "  "}, "zeta": ["b"], "alpha": {"medium": "no list"}, "odd": 7}}})
    assert found.families["fpga_engineer"] == Family(("fpga",), base.families["fpga_engineer"].medium, (), base.families["fpga_engineer"].categories)
    assert found.families["zeta"] == Family(medium=("b",)) and found.families["alpha"] == Family() and "odd" not in found.families
    assert found.preferences == (*K.ROLE_PREFERENCES, "alpha", "zeta")
    assert found.negatives == base.negatives and keywords.resolve({"negative_keywords": ["Chef"]}).negatives == ("chef",)
    flat = keywords.resolve({"zeta": ["B", None], "role_preferences": ["zeta"], "note": "x"})
    assert flat.families["zeta"].medium == ("b",) and flat.preferences[0] == "zeta" and "note" not in flat.families
    for odd in (None, [], "x", {"role_keywords": 3}, {"role_families": []}):
        assert keywords.resolve(odd).families == base.families


def by_hand(config, title, body, department, categories):
    """(family, score, evidence) of the best family, by walking every keyword of every family."""
    title, body, department, categories = title or "", body or "", department or "", categories or []
    best = []
    for name, family in config.families.items():
        if name in keywords.RESIDUAL:
            continue
        score, strong_title, any_title, seen = 0, False, False, {"title": [], "description": []}
        said = []
        for word, strong in family.ordered():
            for where, text, points in (("title", title, (5, 3)), ("description", body, (2, 1))):
                if word in text and not any(word in other for other in seen[where]):
                    seen[where].append(word)
                    score += points[0] if strong else points[1]
                    said.append(f'{where} matched {"strong" if strong else "medium"} keyword "{word}"')
                    any_title |= where == "title"
                    if where == "title" and strong:
                        strong_title = True
                        if title == word:
                            score += 2
                            said.append(f'title exactly matched role keyword "{word}"')
                    break
        deps = [w for w in family.departments if w in department]
        cats = [w for w in family.categories if any(w in c for c in categories)]
        negs = [] if name in K.NEGATIVE_EXEMPT else [w for w in (*config.negatives, *family.negatives) if w in title or w in body or w in department]
        hits = len(seen["title"]) + len(seen["description"]) + len(deps) + len(cats)
        said += [f'department matched keyword "{w}"' for w in deps] + [f'company category matched keyword "{w}"' for w in cats] + [f'negative keyword "{w}" lowered score for {name}' for w in negs]
        best.append((score + 2 * len(deps) + len(cats) - 3 * len(negs), strong_title, any_title, config.preferences.index(name), name, hits, said))
    if not best:
        return "unknown", 0, 0, []
    best.sort(key=lambda b: b[:4], reverse=True)
    score, _, _, _, name, hits, said = best[0]
    low = best[1][0] if len(best) > 1 else 0
    if score < 3 or not hits:
        return ("other" if said else "unknown"), score, score - low, said[:2]
    return name, score, score - low, said[:8]


@pytest.mark.parametrize("seed", range(4))
def test_random_packs_equal_the_scalar_version(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randint(1, 5))).strip() or "a"
    some = lambda n: tuple(dict.fromkeys(word() for _ in range(r.randint(0, n))))
    names = [*(f"f{i}" for i in range(6)), *r.sample(K.NEGATIVE_EXEMPT, 3)]
    families = {n: Family(some(4), some(4), some(2), some(2), some(2), r.choice([None, n.upper()])) for n in names}
    config = Keywords(families, some(2), tuple(r.sample(names, len(names))))
    text = lambda: r.choice([None, "", " ".join(word() for _ in range(r.randint(0, 6))), word()])
    given = [(text(), text(), text(), r.choice([None, [], [word()], [word(), word()]])) for _ in range(150)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], f"i long, {TEXTS}")
    found = keywords.classify_by(df.withColumn("categories_f", F.coalesce("categories_f", F.array().cast("array<string>"))), config, categories="categories_f").orderBy("i").collect()
    assert [(x.role_family, x.role_score, x.role_margin, x.role_evidence) for x in found] == [by_hand(config, *g) for g in given]
    assert all(x.role_subtype == (families[x.role_family].subtype if x.role_family in families and x.role_score >= 3 else None) for x in found)
    assert len({x.role_family for x in found}) > 3


def test_a_pack_of_many_keywords(spark):
    families = {f"f{i:03}": Family(tuple(f"skill {i}-{k}" for k in range(20)), tuple(f"tool {i}-{k}" for k in range(20))) for i in range(500)}
    config = Keywords(families, (), tuple(families))
    df = spark.range(3000).selectExpr("id", "concat('skill ', id % 500, '-7 engineer') title_f", "concat('uses tool ', id % 500, '-3 and more ', repeat('words ', 50)) body_f", "'' department_f")
    began = time.time()
    found = keywords.classify_by(df, config).groupBy("role_family", "role_score").count().collect()
    assert {(x.role_family, x.role_score): x["count"] for x in found} == {(f"f{i:03}", 6): 6 for i in range(500)}
    assert time.time() - began < 60
    plan = keywords.classify_by(df, config)._jdf.queryExecution().toString()
    assert "skill 499-7" not in plan and "Exchange" not in plan  # the pack is no part of the plan, and nothing is shuffled


def test_odd_packs(spark, monkeypatch):
    df = spark.createDataFrame([("a", None, None, [])], TEXTS)
    row = keywords.classify_by(df, Keywords(), categories="categories_f").first()
    assert (row.role_family, row.role_confidence, row.role_subtype, row.role_evidence) == ("unknown", 0.0, None, [])
    monkeypatch.setattr(keywords, "MOST_CHARACTERS", 10)
    with pytest.raises(ValueError, match="a pack may hold 10"):
        keywords.classify_by(df, keywords.built_in())
