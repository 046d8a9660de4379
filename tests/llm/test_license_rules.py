"""Every text that a rule can match must pass the gate."""

import random
import re
from re import _parser

from postforge.llm.license_rules import RULES
from postforge.llm.licenses import BASE, GATE


def sample(tree, rng):
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            kind, value = arg[rng.randrange(len(arg))]
            out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.choice([low, min(high, low + 1)])))
        else:
            raise AssertionError(name)
    return out


def test_every_match_holds_its_keyword_or_is_never_tried_and_passes_the_gate():
    rng = random.Random(1)
    for _, _, keyword, pattern in RULES:
        tree = _parser.parse(pattern)
        for text in {sample(tree, rng) for _ in range(60)}:
            assert re.fullmatch(pattern, text), (pattern, text)
            if keyword in text:
                assert set(GATE) & set(text.split()), (pattern, text)


def test_every_rule_has_matches_with_its_keyword():
    rng = random.Random(2)
    for _, _, keyword, pattern in RULES:
        tree = _parser.parse(pattern)
        assert any(keyword in sample(tree, rng) for _ in range(200)), (keyword, pattern)


def test_base_phrases_pass_the_gate():
    assert all(set(GATE) & set(p.split()) for p, _ in BASE)
    assert len(RULES) > 200
