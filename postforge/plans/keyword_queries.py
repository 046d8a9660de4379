"""Role families under a pack of keywords, over the derived postings."""

from __future__ import annotations

from postforge.functions import fixed as K
from postforge.operators import keywords
from postforge.plans import catalog, postings

#: A pack: fields over the built-in ones, families of its own, a flat list, values to be passed over.
PACK = {
    "role_keywords": {
        "negative_keywords": ["Marketing", "campus ambassador", 7, " "],
        "role_preferences": ["fpga_engineer", "site_engineer"],
        "role_families": {
            "fpga_engineer": {"strong": ["FPGA", "fpga engineer", "Verilog"], "departments": ["technology"]},
            "software_engineer_trading": {"medium": ["python", "c++", "distributed systems", "systems"], "negative_keywords": ["compliance", "operations"]},
            "site_engineer": {"strong": ["kubernetes", "cloud"], "medium": ["linux", "remote role"], "role_subtype": " sre "},
            "student": ["intern", "internship", "internship program", "working student"],
            "broken": 3,
        },
    }
}
COLUMNS = ("ingest_seq", "role_family", "role_confidence", "role_score", "role_margin", "role_subtype", "role_evidence")


def by_pack(spark, sf_dir):
    found = keywords.classify_by(postings.silver(spark, sf_dir), keywords.resolve(PACK), categories="categories_f")
    return found.selectExpr(*COLUMNS[:-1], "array_join(role_evidence, ' | ') as role_evidence")


def built_in(spark, sf_dir):
    """The same answers as the inlined keywords give."""
    return keywords.classify_by(postings.silver(spark, sf_dir), keywords.resolve(), categories="categories_f").select(*COLUMNS[:5])


def _rows(values) -> str:
    one = lambda v: "null::varchar" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in values)


def twin(config: keywords.Keywords, shown: str) -> str:
    """The rule over all pairs of a posting and a keyword. A keyword counts in
    the title unless one tried before it holds it and stands there too; else in
    the body unless one tried before it holds it, stands there and does not count in the title."""
    names = [n for n in config.preferences if n in config.families]
    fam = [(n, config.preferences.index(n), n in K.NEGATIVE_EXEMPT, config.families[n].subtype) for n in names]
    kws = [(n, k, s, i) for n in names for i, (k, s) in enumerate(config.families[n].ordered())]
    more = [(n, kind, k, i) for n in names for kind, values in (("dep", config.families[n].departments), ("cat", config.families[n].categories), ("neg", config.families[n].negatives)) for i, k in enumerate(values)]
    more += [(n, "all", k, i) for n in names for i, k in enumerate(config.negatives)]
    said = "case when titled then 'title' else 'description' end || ' matched ' || case when strong then 'strong' else 'medium' end || ' keyword \"' || kw || '\"'"
    ctes = [
        f"fam(family, pref, exempt, subtype) as (values {_rows(fam)})",
        f"kws(family, kw, strong, o) as (values {_rows(kws)})",
        f"more(family, kind, kw, o) as (values {_rows(more or [('', '', '', 0)])})",
        "hit as materialized (select ingest_seq, family, kw, strong, o, contains(title_f, kw) in_t, contains(body_f, kw) in_b, title_f = kw whole from jobs join kws on contains(title_f, kw) or contains(body_f, kw))",
        "ht as materialized (select h.*, in_t and not exists (select 1 from hit l where l.ingest_seq = h.ingest_seq and l.family = h.family and l.o < h.o and l.in_t and contains(l.kw, h.kw)) titled from hit h)",
        "hb as materialized (select h.*, not titled and in_b and not exists (select 1 from ht l where l.ingest_seq = h.ingest_seq and l.family = h.family and l.o < h.o and l.in_b and not l.titled and contains(l.kw, h.kw)) bodied from ht h)",
        "ks as (select ingest_seq, family, sum(case when titled then case when strong then 5 else 3 end + case when strong and whole then 2 else 0 end when strong then 2 else 1 end) s, count(*) n, bool_or(titled and strong) st, bool_or(titled) tt, "
        f"flatten(list(case when titled and strong and whole then [{said}, 'title exactly matched role keyword \"' || kw || '\"'] else [{said}] end order by o)) ev from hb where titled or bodied group by all)",
        "ms as (select ingest_seq, family, sum(case kind when 'dep' then 2 when 'cat' then 1 else -3 end) s, count(*) filter (kind in ('dep', 'cat')) n, "
        "list(case kind when 'dep' then 'department matched keyword \"' || kw || '\"' when 'cat' then 'company category matched keyword \"' || kw || '\"' else 'negative keyword \"' || kw || '\" lowered score for ' || family end order by case kind when 'dep' then 0 when 'cat' then 1 when 'all' then 2 else 3 end, o) ev "
        "from jobs join more on case kind when 'dep' then contains(department_f, kw) when 'cat' then len(list_filter(categories_f, lambda c: contains(c, kw))) > 0 else contains(title_f, kw) or contains(body_f, kw) or contains(department_f, kw) end "
        f"where not (kind in ('all', 'neg') and family in ({', '.join(repr(n) for n in K.NEGATIVE_EXEMPT)})) group by all)",
        "fs as (select j.ingest_seq, f.family, f.pref, f.subtype, coalesce(ks.s, 0) + coalesce(ms.s, 0) s, coalesce(ks.n, 0) + coalesce(ms.n, 0) n, coalesce(ms.n, 0) > 0 ctx, coalesce(st, false) st, coalesce(tt, false) tt, coalesce(ks.ev, []::varchar[]) || coalesce(ms.ev, []::varchar[]) ev "
        "from jobs j cross join fam f left join ks on ks.ingest_seq = j.ingest_seq and ks.family = f.family left join ms on ms.ingest_seq = j.ingest_seq and ms.family = f.family)",
        "top as (select *, row_number() over w r, lead(s) over w low from fs window w as (partition by ingest_seq order by s desc, st desc, tt desc, pref desc))",
        "c as (select *, s < 3 or n = 0 weak, least(0.98::double, least(0.55::double, s / 20.0::double) + least(0.2::double, greatest(s - low, 0) / 10.0::double) + case when st then 0.15::double when tt then 0.08::double else 0.0::double end + case when ctx then 0.05::double else 0.0::double end) f from top where r = 1)",
    ]
    columns = {
        "ingest_seq": "ingest_seq",
        "role_family": "case when not weak then family when len(ev) > 0 then 'other' else 'unknown' end",
        "role_confidence": "(case when weak then case when len(ev) > 0 then 0.15 else 0.0 end else floor(case when s < 5 then least(f, 0.45::double) when s < 8 then least(f, 0.65::double) else f end * 1000 + 0.5) / 1000 end)::double",
        "role_score": "s::bigint",
        "role_margin": "(s - coalesce(low, 0))::bigint",
        "role_subtype": "case when not weak then subtype end",
        "role_evidence": "array_to_string(ev[1:case when weak then 2 else 8 end], ' | ')",
    }
    return postings.normalized_sql("").rstrip() + ", " + ", ".join(ctes) + f" select {', '.join(f'{columns[n]} as {n}' for n in shown)} from c"


catalog.register("q_role_family_pack", by_pack, twin(keywords.resolve(PACK), COLUMNS))
catalog.register("q_role_family_data", built_in, twin(keywords.resolve(), COLUMNS[:5]))
