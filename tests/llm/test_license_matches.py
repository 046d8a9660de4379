"""Every match of a rule is found by the scan's own wrapped pattern and keyword."""

import random
import re
from re import _parser

from postforge.llm import licenses
from postforge.llm.license_rules import RULES
from test_license_rules import sample


def test_every_match_holds_its_keyword_and_can_be_whole_words():
    rng = random.Random(3)
    for label, _, keyword, pattern in RULES:
        tree = _parser.parse(pattern)
        for text in {sample(tree, rng) for _ in range(200)}:
            assert keyword in text and text == " ".join(text.split()), (label, pattern, text)
            found = re.search(rf"(?<![^ ])(?:{pattern})(?![^ ])", f"before {text} behind")
            assert found and found.start() == 7, (label, pattern, text)
            assert set(licenses.GATE) & set(text.split()), (label, pattern, text)


def test_alternatives_without_the_old_keywords_are_labelled(spark):
    texts = ["No part of this book may be reproduced.", "The PSF License.", "the unlicence", "Licensed under the following: x", "licensed under the terms of something", "licensed under a", "without prior written permission"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["proprietary", "python-2", "unlicense", "unknown-reference", "unknown-reference", "", "proprietary"]


def test_every_rule_is_found_by_the_scan(spark):
    rng = random.Random(4)
    texts = [(i, sample(_parser.parse(rule[3]), rng)) for i, rule in enumerate(RULES) for _ in range(3)]
    rows = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), base=()).select("doc_id", "detections").collect()
    assert len(rows) == len(texts) and all(r.detections for r in rows)
