"""Keywords of role families as data: a pack over the built-in ones, of any size.

An inlined pack makes a plan as long as the pack. Here an automaton over all
keywords, built once a task, reads each posting once and names the families
and keywords that may count; the exact rule (longest first, a keyword inside
one counted before is skipped, negatives, context) then runs over those few in
``classify.classify``. No shuffle; the pack travels with the task and its size
is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.functions import fixed as K
from postforge.operators import classify

#: Characters of keywords that may travel with a task.
MOST_CHARACTERS = 16_000_000
#: Families that no keyword leads to.
RESIDUAL = ("other", "unknown")
FIELDS = {"strong": "strong", "medium": "medium", "departments": "departments", "categories": "categories", "negative_keywords": "negatives"}


@dataclass(frozen=True)
class Family:
    strong: tuple[str, ...] = ()
    medium: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    subtype: str | None = None

    def over(self, base: Family) -> Family:
        """This family's fields, those left empty from ``base``."""
        return Family(**{name: getattr(self, name) or getattr(base, name) for name in self.__dataclass_fields__})

    def ordered(self) -> list[tuple[str, bool]]:
        """Keywords in order of trial, with their strength."""
        return [(k, True) for k in classify.ordered(self.strong)] + [(k, False) for k in classify.ordered(self.medium)]


@dataclass(frozen=True)
class Keywords:
    families: dict[str, Family] = field(default_factory=dict)
    negatives: tuple[str, ...] = ()
    preferences: tuple[str, ...] = ()


def built_in() -> Keywords:
    families = {name: Family(strong, medium, (), categories) for name, (strong, medium, categories) in K.ROLE_FAMILIES.items()}
    return Keywords(families, tuple(K.ROLE_NEGATIVES), tuple(K.ROLE_PREFERENCES))


def _words(value) -> tuple[str, ...]:
    """Trimmed and folded strings of a list; anything else holds none."""
    return tuple(v.strip().casefold() for v in value if isinstance(v, str) and v.strip()) if isinstance(value, list) else ()


def parse(payload) -> Keywords:
    """CLS-05: a pack's payload, bare or under ``role_keywords``; families as
    settings or, in the flat form, as lists of medium keywords."""
    given = payload.get("role_keywords", payload) if isinstance(payload, Mapping) else {}
    given = given if isinstance(given, Mapping) else {}
    families = given.get("role_families")
    if not isinstance(families, Mapping):
        families = {n: v for n, v in given.items() if n not in ("role_families", "negative_keywords", "role_preferences") and isinstance(v, list)}
    found = {}
    for name, settings in families.items():
        if isinstance(settings, list):
            found[name] = Family(medium=_words(settings))
        elif isinstance(settings, Mapping):
            subtype = settings.get("role_subtype")
            subtype = (subtype.strip() or None) if isinstance(subtype, str) else None
            found[name] = Family(subtype=subtype, **{to: _words(settings.get(key)) for key, to in FIELDS.items()})
    return Keywords(found, _words(given.get("negative_keywords")), _words(given.get("role_preferences")))


def resolve(payload=None, base: Keywords | None = None) -> Keywords:
    """A pack over the built-in keywords, field by field. Families that no list
    of preferences names follow in order of their names."""
    base, pack = base or built_in(), parse(payload or {})
    names = [*base.families, *(n for n in pack.families if n not in base.families)]
    families = {n: pack.families.get(n, Family()).over(base.families.get(n, Family())) for n in names}
    preferences = list(dict.fromkeys([*(pack.preferences or base.preferences), *K.ROLE_PREFERENCES]))
    preferences += sorted(set(families) - set(preferences))
    return Keywords(families, pack.negatives or base.negatives, tuple(preferences))


_TEXTS = pa.list_(pa.string())
_FAMILY = pa.struct([("family", pa.string()), ("kws", pa.list_(pa.struct([("kw", pa.string()), ("strong", pa.bool_())]))), ("cats", _TEXTS), ("deps", _TEXTS), ("negs", _TEXTS), ("exempt", pa.bool_()), ("pref", pa.int32()), ("subtype", pa.string())])
_FOUND = pa.struct([("families", pa.list_(_FAMILY)), ("negatives", _TEXTS)])
_FOUND_SQL = "struct<families:array<struct<family:string,kws:array<struct<kw:string,strong:boolean>>,cats:array<string>,deps:array<string>,negs:array<string>,exempt:boolean,pref:int,subtype:string>>,negatives:array<string>>"


class _Index:
    """Which families a posting's keywords lead to."""

    def __init__(self, config: Keywords):
        import ahocorasick

        self.config, self.uses, words = config, {}, set(config.negatives)
        self.families = [n for n in config.preferences if n in config.families and n not in RESIDUAL]
        place = {n: i for i, n in enumerate(config.preferences)}
        self.pref = [place[n] for n in self.families]
        self.best = sorted(range(len(self.families)), key=lambda f: -self.pref[f])
        for f, name in enumerate(self.families):
            family = config.families[name]
            for kind, values in (("kws", family.ordered()), ("deps", family.departments), ("cats", family.categories), ("negs", family.negatives)):
                for order, value in enumerate(values):
                    word = value[0] if kind == "kws" else value
                    self.uses.setdefault(word, []).append((f, kind, order, value))
        words |= set(self.uses)
        self.automaton = ahocorasick.Automaton()
        for word in words:
            self.automaton.add_word(word, word)
        if words:
            self.automaton.make_automaton()
        self.empty = not words

    def inside(self, text: str | None) -> set[str]:
        return set() if self.empty or not text else {word for _, word in self.automaton.iter(text)}

    def row(self, title, body, department, categories) -> dict:
        texts, dep, cat = self.inside(title) | self.inside(body), self.inside(department), self.inside(categories)
        where = {"kws": texts, "deps": dep, "cats": cat, "negs": texts | dep}
        found: dict[int, dict[str, list]] = {}
        for word in texts | dep | cat:
            for f, kind, order, value in self.uses.get(word, ()):
                if word in where[kind]:
                    found.setdefault(f, {}).setdefault(kind, []).append((order, value))
        # families that nothing leads to tie with each other: only the two first of either sort can be first or second
        left = {True: 2, False: 2}
        for f in self.best:
            exempt = self.families[f] in K.NEGATIVE_EXEMPT
            if f not in found and left[exempt]:
                left[exempt] -= 1
                found[f] = {}
            if not any(left.values()):
                break
        out = []
        for f, kinds in found.items():
            name = self.families[f]
            values = {kind: [v for _, v in sorted(kinds.get(kind, ()))] for kind in where}
            values["kws"] = [{"kw": k, "strong": s} for k, s in (v for _, v in sorted(kinds.get("kws", ()), key=lambda x: x[0]))]
            out.append({"family": name, **values, "exempt": name in K.NEGATIVE_EXEMPT, "pref": self.pref[f], "subtype": self.config.families[name].subtype})
        return {"families": out, "negatives": [n for n in self.config.negatives if n in where["negs"]]}


def matcher(config: Keywords):
    """A function of (title, body, department, joined categories) to the families that may count."""
    size = sum(len(k) for f in config.families.values() for k in (*f.strong, *f.medium, *f.departments, *f.categories, *f.negatives))
    if size > MOST_CHARACTERS:
        raise ValueError(f"keywords of {size} characters; a pack may hold {MOST_CHARACTERS}")

    @F.arrow_udf(_FOUND_SQL)
    def match(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = _Index(config)
        for batch in batches:
            yield pa.array([index.row(*row) for row in zip(*(column.to_pylist() for column in batch), strict=True)], _FOUND)

    return match


def classify_by(df: DataFrame, config: Keywords, title: str = "title_f", body: str = "body_f", department: str = "department_f", categories: str | None = None) -> DataFrame:
    """CLS-05, JOIN-16: ``classify.classify`` under a configuration. Null texts
    hold no keyword; without any family all rows are unknown."""
    joined = F.array_join(categories, "\n") if categories else F.lit("")
    texts = [F.coalesce(F.col(c), F.lit("")) for c in (title, body, department)]
    found = df.withColumns(dict(zip(("__t", "__b", "__d"), texts, strict=True))).withColumn("__found", matcher(config)("__t", "__b", "__d", joined))
    return classify.classify(found, "__t", "__b", "__d", categories, matched="__found").drop("__found", "__t", "__b", "__d")
