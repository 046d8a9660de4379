"""Role classification: keyword scores by family, best family, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from postforge.dialect import SPARK
from postforge.functions import fixed as K


def ordered(words) -> list[str]:
    return sorted(words, key=len, reverse=True)


def family_table(families=None) -> list[tuple[str, list[tuple[str, bool]], tuple, bool, int]]:
    """(family, keywords in order of trial with strength, categories, exempt, preference)."""
    families = families or K.ROLE_FAMILIES
    prefs = list(K.ROLE_PREFERENCES) + sorted(set(families) - set(K.ROLE_PREFERENCES))
    return [(f, [(k, True) for k in ordered(s)] + [(k, False) for k in ordered(m)], c, f in K.NEGATIVE_EXEMPT, prefs.index(f)) for f, (s, m, c) in families.items()]


def _literal(families) -> F.Column:
    rows, none = [], F.array().cast("array<string>")
    for name, words, cats, exempt, pref in family_table(families):
        kws = F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(s).alias("strong")) for k, s in words])
        rows.append(F.struct(F.lit(name).alias("family"), kws.alias("kws"), (F.array(*[F.lit(c) for c in cats]) if cats else F.array().cast("array<string>")).alias("cats"),
                             none.alias("deps"), none.alias("negs"), F.lit(exempt).alias("exempt"), F.lit(pref).alias("pref"), F.lit(None).cast("string").alias("subtype")))
    return F.array(*rows)


#: One pass over a family's keywords; a keyword inside one matched before in the same field is skipped.
_FAMILY = """aggregate(f.kws,
  named_struct('score', 0, 'hits', 0, 'strong', false, 'titled', false, 't', cast(array() as array<string>), 'b', cast(array() as array<string>), 'ev', cast(array() as array<string>)),
  (a, k) -> case
    when contains({title}, k.kw) and not exists(a.t, m -> contains(m, k.kw)) then named_struct(
      'score', a.score + if(k.strong, 5, 3) + if(k.strong and {title} = k.kw, 2, 0), 'hits', a.hits + 1, 'strong', a.strong or k.strong, 'titled', true,
      't', array_append(a.t, k.kw), 'b', a.b, 'ev', array_compact(concat(a.ev, array(concat('title matched ', if(k.strong, 'strong', 'medium'), ' keyword "', k.kw, '"'),
        if(k.strong and {title} = k.kw, concat('title exactly matched role keyword "', k.kw, '"'), null)))))
    when contains({body}, k.kw) and not exists(a.b, m -> contains(m, k.kw)) then named_struct(
      'score', a.score + if(k.strong, 2, 1), 'hits', a.hits + 1, 'strong', a.strong, 'titled', a.titled,
      't', a.t, 'b', array_append(a.b, k.kw), 'ev', array_append(a.ev, concat('description matched ', if(k.strong, 'strong', 'medium'), ' keyword "', k.kw, '"')))
    else a end)"""


def classify(df, title: str = "title_f", body: str = "body_f", department: str = "department_f", categories: str | None = None, families=None, matched: str | None = None):
    """CLS-01..04: adds role_family, role_confidence, role_score, role_margin, role_evidence, role_subtype.

    ``title``, ``body`` and ``department`` are folded columns, ``categories``
    an array of folded strings or None. Runs as one projection, no shuffle.
    Families are literals of the plan, or ``matched`` names a column of those
    that may count for the row (see ``operators.keywords``).
    """
    d = SPARK
    negatives = d.compact(d.array(f"if(contains({title}, {d.lit(k)}) or contains({body}, {d.lit(k)}) or contains({department}, {d.lit(k)}), {d.lit(k)}, null)" for k in K.ROLE_NEGATIVES))
    none, anywhere = "cast(array() as array<string>)", f"c -> contains({title}, c) or contains({body}, c) or contains({department}, c)"
    cats = f"filter(f.cats, c -> exists({categories}, x -> contains(x, c)))" if categories else none
    scored = f"""transform(__families, f -> named_struct('m', {_FAMILY.format(title=title, body=body)}, 'cats', {cats}, 'deps', filter(f.deps, c -> contains({department}, c)), 'negs', if(f.exempt, {none}, concat(__negatives, filter(f.negs, {anywhere}))), 'family', f.family, 'pref', f.pref, 'subtype', f.subtype))"""
    context = """concat(transform(s.deps, c -> concat('department matched keyword "', c, '"')), transform(s.cats, c -> concat('company category matched keyword "', c, '"')), transform(s.negs, n -> concat('negative keyword "', n, '" lowered score for ', s.family)))"""
    ranked = f"""array_sort(transform(__scored, s -> named_struct('score', -(s.m.score + 2 * size(s.deps) + size(s.cats) - 3 * size(s.negs)), 'strong', if(s.m.strong, 0, 1), 'titled', if(s.m.titled, 0, 1), 'pref', -s.pref,
      'family', s.family, 'hits', s.m.hits + size(s.deps) + size(s.cats), 'seen', s.m.hits + size(s.deps) + size(s.cats) + size(s.negs) > 0, 'context', size(s.deps) + size(s.cats) > 0, 'ev', concat(s.m.ev, {context}), 'subtype', s.subtype)))"""
    known, negatives = (F.col(f"{matched}.families"), f"{matched}.negatives") if matched else (_literal(families), negatives)
    out = df.withColumn("__families", known).withColumn("__negatives", F.expr(negatives)).withColumn("__scored", F.expr(scored)).withColumn("__ranked", F.expr(ranked))
    top, low = "get(__ranked, 0)", "coalesce(-get(__ranked, 1).score, 0)"
    score = f"coalesce(-{top}.score, 0)"
    weak = f"coalesce({score} < 3 or {top}.hits = 0, true)"  # without any family nothing is known
    conf = f"least(0.98D, least(0.55D, {score} / 20.0D) + least(0.2D, greatest({score} - {low}, 0) / 10.0D) + case when {top}.strong = 0 then 0.15D when {top}.titled = 0 then 0.08D else 0.0D end + if({top}.context, 0.05D, 0.0D))"
    capped = f"case when {score} < 5 then least({conf}, 0.45D) when {score} < 8 then least({conf}, 0.65D) else {conf} end"
    cols = {
        "role_family": f"case when {weak} then if({top}.seen, 'other', 'unknown') else {top}.family end",
        "role_confidence": f"cast(case when {weak} then if({top}.seen, 0.15D, 0.0D) else floor(({capped}) * 1000 + 0.5) / 1000 end as double)",
        "role_score": f"cast({score} as bigint)",
        "role_margin": f"cast({score} - {low} as bigint)",
        "role_evidence": f"case when not {weak} then slice({top}.ev, 1, 8) when {top}.seen then slice({top}.ev, 1, 2) else cast(array() as array<string>) end",
        "role_subtype": f"case when not {weak} then {top}.subtype end",
    }
    return out.withColumns({k: F.expr(v) for k, v in cols.items()}).drop("__families", "__negatives", "__scored", "__ranked")


def oracle_layers(d, title: str, body: str, department: str, categories: str | None = None, families=None) -> list[dict[str, str]]:
    """The same columns for DuckDB as layers, a column for each keyword and field.

    In a title a keyword counts unless a longer one around it is there too; in
    a body only keywords that counted there block those inside them.
    """
    table = family_table(families)
    titles: dict[str, str] = {"neg_": " + ".join(f"(contains({title}, {d.lit(k)}) or contains({body}, {d.lit(k)}) or contains({department}, {d.lit(k)}))::int" for k in K.ROLE_NEGATIVES)}
    bodies: list[dict[str, str]] = [{}, {}, {}, {}]
    scores: dict[str, str] = {}
    ranked = []
    for n, (family, words, cats, exempt, pref) in enumerate(table):
        depth: list[int] = []
        for i, (kw, _) in enumerate(words):
            above = [j for j in range(i) if kw in words[j][0]]
            titles[f"t{n}_{i}"] = f"contains({title}, {d.lit(kw)})" + "".join(f" and not contains({title}, {d.lit(words[j][0])})" for j in above)
            depth.append(1 + max((depth[j] for j in above), default=-1))
            bodies[depth[i]][f"b{n}_{i}"] = f"not t{n}_{i} and contains({body}, {d.lit(kw)})" + "".join(f" and not b{n}_{j}" for j in above)
        exact = lambda kw, s: f" + ({title} = {d.lit(kw)})::int * 2" if s else ""
        parts = [f"case when t{n}_{i} then {5 if s else 3}{exact(kw, s)} when b{n}_{i} then {2 if s else 1} else 0 end" for i, (kw, s) in enumerate(words)]
        cat = " + ".join(f"(len(list_filter({categories}, lambda x: contains(x, {d.lit(c)}))) > 0)::int" for c in cats) if categories and cats else "0"
        scores[f"c{n}"] = cat
        scores[f"s{n}"] = " + ".join(parts) + ("" if exempt else " - 3 * neg_")
        scores[f"h{n}"] = " + ".join(f"(t{n}_{i} or b{n}_{i})::int" for i in range(len(words)))
        scores[f"x{n}"] = " or ".join(f"t{n}_{i}" for i, (_, s) in enumerate(words) if s)
        scores[f"y{n}"] = " or ".join(f"t{n}_{i}" for i in range(len(words)))
        ranked.append(f"{{'score': -(s{n} + c{n}), 'strong': (not x{n})::int, 'titled': (not y{n})::int, 'pref': -{pref}, 'family': {d.lit(family)}, 'hits': h{n} + c{n}, 'seen': h{n} + c{n}{'' if exempt else ' + neg_'} > 0, 'context': c{n} > 0}}")
    last = [{"ranked_": f"list_sort([{', '.join(ranked)}])"}, {"top_": "ranked_[1]", "lo_": "-struct_extract(ranked_[2], 'score')"}]
    top = lambda c: f"struct_extract(top_, '{c}')"
    last.append({"sc_": f"-{top('score')}"})
    last.append({"weak_": f"sc_ < 3 or {top('hits')} = 0", "conf_": f"least(0.98::double, least(0.55::double, sc_ / 20.0::double) + least(0.2::double, greatest(sc_ - lo_, 0) / 10.0::double) + case when {top('strong')} = 0 then 0.15::double when {top('titled')} = 0 then 0.08::double else 0.0::double end + case when {top('context')} then 0.05::double else 0.0::double end)"})
    last.append({"capped_": "case when sc_ < 5 then least(conf_, 0.45::double) when sc_ < 8 then least(conf_, 0.65::double) else conf_ end"})
    last.append({"role_family": f"case when weak_ then case when {top('seen')} then 'other' else 'unknown' end else {top('family')} end", "role_confidence": f"(case when weak_ then case when {top('seen')} then 0.15 else 0.0 end else floor(capped_ * 1000 + 0.5) / 1000 end)::double", "role_score": "sc_::bigint", "role_margin": "(sc_ - lo_)::bigint"})
    return [titles, *[b for b in bodies if b], scores, *last]


def oracle_evidence(d, title: str, body: str, department: str, categories: str) -> str:
    """The evidence of the top family for DuckDB, over the columns of :func:`oracle_layers`."""
    negatives = [f"case when contains({title}, {d.lit(k)}) or contains({body}, {d.lit(k)}) or contains({department}, {d.lit(k)}) then {d.lit(k)} end" for k in K.ROLE_NEGATIVES]
    whens = []
    for n, (family, words, cats, exempt, _) in enumerate(family_table()):
        said = []
        for i, (kw, strong) in enumerate(words):
            kind = "strong" if strong else "medium"
            said.append(f"case when t{n}_{i} then {d.lit(f'title matched {kind} keyword {chr(34)}{kw}{chr(34)}')} when b{n}_{i} then {d.lit(f'description matched {kind} keyword {chr(34)}{kw}{chr(34)}')} end")
            if strong:
                said.append(f"case when t{n}_{i} and {title} = {d.lit(kw)} then {d.lit(f'title exactly matched role keyword {chr(34)}{kw}{chr(34)}')} end")
        said += [f"case when len(list_filter({categories}, lambda x: contains(x, {d.lit(c)}))) > 0 then {d.lit(f'company category matched keyword {chr(34)}{c}{chr(34)}')} end" for c in cats]
        said += [] if exempt else [f"'negative keyword \"' || ({x}) || {d.lit(f'{chr(34)} lowered score for {family}')}" for x in negatives]
        whens.append(f"when {d.lit(family)} then {d.compact(d.array(said))}")
    return f"case struct_extract(top_, 'family') {' '.join(whens)} end"
