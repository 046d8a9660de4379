"""Evidence: which sentences, signals and scores a posting's labels rest on.

The rules of ``functions.rules`` say that a sentence matched; these say which.
All are column expressions in either dialect, added layer by layer to scored
postings, so they are worked out only for the rows that are asked for (after the
limit of a queue, say); for all postings, sentences once for each distinct text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.dialect import SPARK
from postforge.functions import fixed as K
from postforge.functions import rules as R
from postforge.session import once

#: Most entries of a score's explanation and of the evidence shown with a review item.
EXPLAINED, SHOWN = 10, 6

#: What the sentences behind eligibility follow from.
ELIGIBILITY_KEYS = ("snips", "sponsorship", "citizenship")
#: What the reason of the technical depth follows from.
DEPTH_KEYS = ("title_f", "body_f", "role_family")
#: Columns of scored postings that evidence is made of.
READS = ("title_f", "body_f", "snips", "source_type", "status", "sponsorship", "citizenship", "role_family", "role_evidence", "tier", "age_days", "prestige", *(c for c in K.PRESETS[K.DEFAULT_PRESET] if c != "prestige"))

# The wording of explanations.
NO_TIER = "No prestige tier was configured, so a neutral prestige score was used."
FAMILY_SAYS = (
    (K.TARGET_ROLES, "is in the target set."),
    (K.ADJACENT_ROLES, "is adjacent to the target set."),
    (K.DEPRIORITIZED_ROLES, "is deprioritized for this ranking profile."),
)
FAMILY_UNKNOWN = "Role family is unknown, so role fit stays neutral-low."
FAMILY_ELSE = "is not a primary target but remains somewhat relevant."
NOT_TECHNICAL = "No strong technical signals were found, so technical depth remained conservative."
CLOSED_NOW = "Job is marked closed, so freshness is zero in apply-now mode."
NO_CANDIDATE = "No candidate profile was configured, so eligibility started from a neutral score."
PRESTIGE_SAYS = (
    (95, "S+ prestige makes the role highly visible rather than hidden."),
    (90, "Top-tier prestige makes the role somewhat obvious."),
    (80, "A-tier prestige keeps the firm credible while still less saturated than S+ names."),
    (70, "B-tier prestige suggests a credible but less obvious firm."),
    (60, "C-tier prestige increases hidden-gem visibility potential."),
)
PRESTIGE_ELSE = "Unknown prestige keeps visibility moderate until more evidence is available."
NO_SIGNAL = "no explicit open, closed, login, or coming-soon signals were found"


def eligibility(d, s: str = "snips") -> str:
    """ELG-10: sentences in the order of the rules that they satisfy, repeats
    included. Degrees, graduation and class years give every sentence, a major
    and the grade the first; of sponsorship and citizenship only what decided."""
    every = lambda patterns: d.filter(s, "s", R.any_match(d, "s", patterns))
    first = lambda patterns: d.slice(every(patterns), 1)
    whole = d.array([d.join(s, " ")])
    deciding = "case sponsorship " + " ".join(f"when {d.lit(k)} then {every(p)}" for k, p in (("not_available", K.NO_SPONSORSHIP), ("available", K.SPONSORSHIP), ("maybe", K.MAYBE_SPONSORSHIP))) + f" else {d.array([])} end"
    nation = "case citizenship " + " ".join(f"when {d.lit(k)} then case when {d.size(every(p))} > 0 then {every(p)} else {whole} end" for k, p in K.CITIZENSHIP.items()) + f" else {d.array([])} end"
    lists = [every(p) for p in (K.BACHELOR, K.MASTER, K.PHD, K.REQUIRES_MASTER, K.REQUIRES_PHD)]
    lists.append(d.filter(s, "s", f"{d.size(R.years_of_sentence(d))} > 0"))
    lists += [every([p]) for p in K.CLASS_YEARS.values()]
    lists += [first([p]) for p in K.MAJORS.values()]
    return d.concat_lists(*(f"({x})" for x in (*lists, deciding, nation, first(K.GPA))))


def status(d, text: str = "body_f", source: str = "source_type") -> str:
    """The signals that decided the status of a listed posting."""

    def signal(kind: str, terms) -> str:
        hit = R.first_hit(d, text, terms)
        return f"case when ({hit}) is not null then concat({d.lit(f'page matched {kind} signal {chr(34)}')}, {hit}, {d.lit(chr(34))}) end"

    listed = f"case when lower({source}) in ({', '.join(map(d.lit, K.ACTIVE_SOURCES))}) then concat('job is listed in the current ', lower({source}), ' source feed') end"
    found = {
        "closed": [signal("closed", K.CLOSED_SIGNALS)],
        "coming_soon": [signal("coming-soon", K.COMING_SOON_SIGNALS)],
        "requires_login": [signal("login-required", K.LOGIN_SIGNALS)],
        "open": [listed, signal("open", K.OPEN_SIGNALS)],
        "likely_open": [listed, signal("open", K.OPEN_SIGNALS)],
    }
    return "case status " + " ".join(f"when {d.lit(k)} then {d.compact(d.array(v))}" for k, v in found.items()) + f" else {d.array([d.lit(NO_SIGNAL)])} end"


def _depth(d, title: str = "title_f", body: str = "body_f") -> str:
    """What the technical depth rests on first."""
    quoted = lambda start, k, end="": d.lit(f'{start} "{k}"{end}')
    whens = []
    for kind, terms in (("strong", K.STRONG_KEYWORDS), ("medium", K.MEDIUM_KEYWORDS)):
        for k in terms:
            whens += [f"when contains({where}, {d.lit(k)}) then {quoted(f'{name} matched {kind} technical signal', k)}" for name, where in (("title", title), ("description", body))]
    whens += [f"when contains({title}, {d.lit(k)}) or contains({body}, {d.lit(k)}) then {quoted('non-technical signal', k, ' reduced technical depth')}" for k in K.NEGATIVE_KEYWORDS]
    families = ", ".join(map(d.lit, K.TECHNICAL_FAMILIES))
    return f"case {' '.join(whens)} when role_family in ({families}) then concat({d.lit("role family '")}, role_family, {d.lit("' is strongly technical")}) else {d.lit(NOT_TECHNICAL)} end"


def explanation(d, preset: str = K.DEFAULT_PRESET, tier_source: str = "case when tier = 'Unknown' then 'default' else 'pack defaults' end", depth: str | None = None) -> str:
    """SCO-11: the preset, its three weightiest components (of equal weight the
    later name first), then what each score rests on first. ``depth`` names a
    column that holds the reason of the technical depth already."""
    preset = preset.lower() if preset.lower() in K.PRESETS else K.DEFAULT_PRESET
    now = preset == "apply_now"
    score = lambda k: "case when status = 'closed' then cast(0 as double) else freshness end" if now and k == "freshness" else k
    parts = [d.struct(w=f"({score(k)}) * {w}", k=d.lit(k), s=f"({score(k)})") for k, w in K.PRESETS[preset].items()]
    top = d.slice(d.sort_down(d.array(parts)), 3)
    strongly = d.transform(top, "x", f"concat(x.k, ' contributed strongly with score ', {d.whole('x.s')}, '.')")
    mark = d.lit("'")
    family = " ".join(f"when role_family in ({', '.join(map(d.lit, names))}) then concat({d.lit('Role family ' + chr(39))}, role_family, {mark}, {d.lit(' ' + text)})" for names, text in FAMILY_SAYS)
    family += f" when role_family = 'unknown' then {d.lit(FAMILY_UNKNOWN)} else concat({d.lit('Role family ' + chr(39))}, role_family, {mark}, {d.lit(' ' + FAMILY_ELSE)}) end"
    verified = f"concat('Job was last verified ', {'cast(age_days as string)' if d.name == 'spark' else 'age_days::varchar'}, ' day(s) ago.')"
    firsts = [
        f"case when ({tier_source}) = 'default' then {d.lit(NO_TIER)} else concat('Prestige tier ', tier, ' came from ', {tier_source}, '.') end",
        f"case {family}",
        depth or _depth(d),
        f"case when status = 'closed' then {d.lit(CLOSED_NOW)} else {verified} end" if now else verified,
        d.lit(NO_CANDIDATE),
        "case " + " ".join(f"when prestige >= {least} then {d.lit(text)}" for least, text in PRESTIGE_SAYS) + f" else {d.lit(PRESTIGE_ELSE)} end",
    ]
    return d.concat_lists(f"({d.array([d.lit(f'Opportunity score used the {preset} preset.')])})", f"({strongly})", f"({d.array(firsts)})")


def layers(d, preset: str = K.DEFAULT_PRESET, depth: str | None = None) -> list[dict[str, str]]:
    """Columns status_evidence, eligibility_evidence, explanation and evidence
    over scored postings that hold role_evidence."""
    said = d.transform(d.concat_lists("role_evidence", "status_evidence", "eligibility_evidence", "explanation"), "x", "trim(x)")
    return [
        {"status_evidence": status(d), "eligibility_all": eligibility(d), "explanation_all": explanation(d, preset, depth=depth)},
        {"eligibility_evidence": d.distinct("eligibility_all"), "explanation": d.slice(d.fold_distinct("explanation_all"), EXPLAINED)},
        {"evidence_all": d.filter(said, "x", "x <> ''")},
        {"evidence": d.slice(d.distinct("evidence_all"), SHOWN)},
    ]


def with_evidence(jobs: DataFrame, preset: str = K.DEFAULT_PRESET, every: bool = False) -> DataFrame:
    """ELG-10, SCO-11, ARR-06 for scored postings. Where ``every`` posting is
    asked for, not a page, sentences are looked up once for each distinct text."""
    parts, own = layers(SPARK, preset, "depth_said" if every else None), ("eligibility_all", "eligibility_evidence")
    if every:
        of_text = [{n: e for n, e in layer.items() if n in own} for layer in parts]
        parts = [{n: e for n, e in layer.items() if n not in own} for layer in parts]
        jobs = once(jobs, list(ELIGIBILITY_KEYS), lambda texts: _layered(texts, of_text).drop("eligibility_all"))
        jobs = _depth_said(jobs)
    return _layered(jobs, parts).drop("eligibility_all", "explanation_all", "evidence_all", "depth_said")


def with_explanation(jobs: DataFrame, preset: str = K.DEFAULT_PRESET) -> DataFrame:
    """SCO-11 alone, for every posting: the reason of the technical depth is
    looked up once for each distinct text."""
    own = [{n: e for n, e in layer.items() if n in ("explanation_all", "explanation")} for layer in layers(SPARK, preset, "depth_said")]
    return _layered(_depth_said(jobs), own).drop("explanation_all", "depth_said")


def _depth_said(jobs: DataFrame) -> DataFrame:
    return once(jobs, list(DEPTH_KEYS), lambda texts: texts.withColumn("depth_said", F.expr(_depth(SPARK))))


def _layered(df: DataFrame, parts: list[dict[str, str]]) -> DataFrame:
    for layer in filter(None, parts):
        df = df.withColumns({n: F.expr(e) for n, e in layer.items()})
    return df
