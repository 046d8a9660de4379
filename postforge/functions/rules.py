"""Row rules as SQL text in a dialect: cleaning, identity, parsing, scoring.

Every function takes a dialect ``d`` and SQL operands and gives one SQL
expression without subqueries, so Spark keeps it in the scan's projection.
"""

from __future__ import annotations

from postforge.functions import fixed as K


def clean(d, x: str) -> str:
    """STR-01 for text without markup: common entities, no-break spaces, runs of white space."""
    out = f"coalesce({x}, '')"
    for entity, char in (("&nbsp;", " "), (" ", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {d.lit(entity)}, {d.lit(char)})"
    return f"trim({d.replace(out, chr(92) + 's+', ' ')})"


def fold(d, x: str) -> str:
    """STR-02: case folding (``ß`` becomes ``ss``)."""
    return f"lower(replace({x}, 'ß', 'ss'))"


def slug(d, x: str) -> str:
    """STR-04."""
    s = d.replace(d.replace(fold(d, x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return f"case when {x} is null or {s} = '' then 'unknown' else {s} end"


def first_hit(d, x: str, terms) -> str:
    """STR-06: the first term, in list order, that the text holds."""
    return "case " + " ".join(f"when contains({x}, {d.lit(t)}) then {d.lit(t)}" for t in terms) + " end"


def any_hit(d, x: str, terms) -> str:
    return "(" + " or ".join(f"contains({x}, {d.lit(t)})" for t in terms) + ")"


def any_match(d, x: str, patterns) -> str:
    return "(" + " or ".join(d.match(x, p) for p in patterns) + ")"


# --- URLs ----------------------------------------------------------------------


def url_part(d, x: str, what: str) -> str:
    group = {"scheme": 1, "host": 2, "path": 3, "query": 4}[what]
    return d.extract(f"trim(coalesce({x}, ''))", r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", group)


def url_parts(d, x: str, to: str) -> dict[str, str]:
    """The raw parts of a URL as columns ``to``_scheme, _host, _path, _query."""
    return {f"{to}_{p}": url_part(d, x, p) for p in ("scheme", "host", "path", "query")}


def url_forms(d, to: str) -> dict[str, str]:
    """Normalised host, path and query from the columns of :func:`url_parts`."""
    scheme, host = f"coalesce(nullif(lower({to}_scheme), ''), 'https')", f"lower({to}_host)"
    bare = f"case when {scheme} = 'http' then {d.replace(host, ':80$', '')} when {scheme} = 'https' then {d.replace(host, ':443$', '')} else {host} end"
    dropped = ", ".join(d.lit(k) for k in K.TRACKING_KEYS)
    pairs = d.filter(d.split(f"{to}_query", "&"), "p", f"p <> '' and lower({d.replace('p', '=.*$', '')}) not in ({dropped})")
    plain = d.transform(pairs, "p", "replace(case when contains(p, '=') then p else concat(p, '=') end, '%20', '+')")
    args = d.join(d.sort(plain), "&")
    if d.name == "spark":  # most URLs have no query
        args = f"case when {to}_query = '' then '' else {args} end"
    return {f"{to}_proto": scheme, f"{to}_site": d.replace(f"({bare})", r"^www\.", ""), f"{to}_route": d.replace(d.replace(f"coalesce(nullif({to}_path, ''), '/')", "/{2,}", "/"), "(.)/$", "$1" if d.name == "spark" else "\\1"), f"{to}_args": args}


def url_whole(d, x: str, to: str) -> str:
    """URL-01 from :func:`url_forms`: relative URLs as given; tracking keys and fragment dropped, pairs sorted."""
    raw = f"trim(coalesce({x}, ''))"
    relative = f"not ({d.match(raw, '^(?:[a-z][a-z0-9+.' + chr(92) + '-]*:)?//')})"
    return f"case when {raw} = '' then '' when {relative} then {raw} else concat({to}_proto, '://', {to}_site, {to}_route, case when {to}_args = '' then '' else concat('?', {to}_args) end) end"


def url_hash(d, canonical: str) -> str:
    return f"case when {canonical} = '' then '' else substr({d.sha1(canonical)}, 1, 16) end"


def ats_key(d, *urls: str) -> str:
    """URL-05 over canonical URLs in order."""
    out = []
    for u in urls:
        g, lv = d.extract(u, r"/jobs/(\d+)"), d.extract(u, r"/([^/?#]+)/?$")
        out.append(f"case when contains({u}, 'greenhouse') and {g} <> '' then concat('greenhouse:', {g}) when contains({u}, 'lever.co') and {lv} <> '' then concat('lever:', {lv}) end")
    return f"coalesce({', '.join(out)})"


def url_specificity(d, canonical: str, prefer_apply: bool) -> str:
    """URL-06 as one number: hint, not generic, segments."""
    path = f"lower({url_part(d, canonical, 'path')})"
    hint = f"(({path} like '%/apply') or contains({path}, '/apply/') or contains({path}, '/application'))" if prefer_apply else any_hit(d, path, K.DETAIL_PATHS)
    generic = f"({path} in ({', '.join(d.lit(p) for p in K.LISTING_PATHS)}) or " + " or ".join(f"{path} like {d.lit('%' + e)}" for e in K.LISTING_ENDINGS) + ")"
    segments = d.size(d.filter(d.split(path, "/"), "p", "p <> ''"))
    return f"case when {canonical} = '' then 0 else (case when {hint} then 100000 else 0 end) + (case when {generic} then 0 else 10000 end) + {segments} end"


def generic_url(d, x: str) -> str:
    """URL-07, serving variant: no path or a listing-like last part."""
    path = d.replace(f"lower({url_part(d, x, 'path')})", "^/+|/+$", "")
    ends = " or ".join(f"{path} = {d.lit(e)} or {path} like {d.lit('%/' + e)}" for e in K.GENERIC_ENDINGS)
    return f"({path} = '' or {ends})"


# --- parsing ---------------------------------------------------------------------


def season_parts(d, title: str, description: str) -> dict[str, str]:
    """STR-17: season, year and confidence; the title wins if it has a year."""
    season = r"\b(" + "|".join(K.SEASONS) + r")\b"
    month = r"\b(" + "|".join(K.MONTH_SEASONS) + r")\b"

    def one(x: str, k: int) -> tuple[str, str, str]:
        y, s, m = d.extract(x, K.YEAR), f"lower({d.extract(x, season)})", f"lower({d.extract(x, month)})"
        of_month = "case " + " ".join(f"when {m} = {d.lit(a)} then {d.lit(b)}" for a, b in K.MONTH_SEASONS.items()) + " end"
        conf = (("0.95", "0.8", "0.55"), ("0.85", "0.7", "0.45"))[k]
        return f"case when {y} = '' then null when {s} <> '' then {s} else {of_month} end", f"try_cast(nullif({y}, '') as int)", f"cast(case when {y} = '' then 0.0 when {s} <> '' then {conf[0]} when {m} <> '' then {conf[1]} else {conf[2]} end as double)"

    t, b = one(title, 0), one(description, 1)
    return {n: f"case when {t[1]} is not null then {t[i]} else {b[i]} end" for i, n in enumerate(("season", "year", "season_confidence"))}


def remote_type(d, location: str, description: str) -> str:
    """STR-19."""
    both = f"lower(concat({location}, ' ', {description}))"
    return "case " + " ".join(f"when contains({both}, {d.lit(a)}) then {d.lit(b)}" for a, b in K.REMOTE_TERMS.items()) + " end"


def places(d, location: str) -> str:
    """STR-18: list of places that the text names."""
    bare = d.replace(location, r"(?i)^\s*(remote|hybrid|onsite|on-site|on site)\s*[-:]\s*", "")
    base = f"case when trim({bare}) = '' then trim({location}) else trim({bare}) end"
    parts = d.filter(d.transform(d.split(f"({base})", r"\s*(?:/|;|\|)\s*"), "p", d.replace("p", r"^[ ,]+|[ ,]+$", "")), "p", "p <> ''")
    title = "case lower(p) " + " ".join(f"when {d.lit(t)} then {d.lit('Remote' if m == 'remote' else t.title())}" for t, m in K.REMOTE_TERMS.items()) + " else p end"
    return d.fold_distinct(d.transform(parts, "p", title))


def with_remote(d, found: str, remote: str) -> str:
    return f"case when {remote} = 'remote' and {d.size(found)} = 0 then {d.array(['' + d.lit('Remote')])} else {found} end"


def locations(d, location: str, remote: str) -> str:
    """STR-18: list of places; of a remote posting that names none, Remote."""
    return with_remote(d, places(d, location), remote)


def program_type(d, title: str, description: str) -> dict[str, str]:
    """STR-20: program type and confidence."""
    t = "case " + " ".join(f"when {d.match(title, p)} then {d.lit(k)}" for k, p in K.TITLE_INTERNSHIP) + " end"
    b = "case " + " ".join(f"when {d.match(description, p)} then {d.lit(k)}" for k, p in K.DESCRIPTION_INTERNSHIP) + " end"
    return {"title_program": t, "description_program": b}


# --- status ------------------------------------------------------------------------


def status(d, text: str, source: str, listed: str = "true", http: str = "cast(null as int)", age: str = "cast(null as bigint)") -> str:
    """STA-01: the decision list; ``text`` is folded."""
    hit = {n: any_hit(d, text, terms) for n, terms in (("open", K.OPEN_SIGNALS), ("closed", K.CLOSED_SIGNALS), ("soon", K.COMING_SOON_SIGNALS), ("login", K.LOGIN_SIGNALS))}
    active = f"({listed} and lower({source}) in ({', '.join(d.lit(s) for s in K.ACTIVE_SOURCES)}))"
    return (
        f"case when {http} = 404 or {hit['closed']} then 'closed' when {hit['soon']} then 'coming_soon' when {hit['login']} then 'requires_login' "
        f"when {active} and {hit['open']} then 'open' when {active} or {hit['open']} then 'likely_open' when not {listed} and {age} >= {K.STALE_DAYS} then 'stale' else 'unknown' end"
    )


def status_confidence(d, text: str, source: str, st: str, http: str = "cast(null as int)") -> str:
    active = f"lower({source}) in ({', '.join(d.lit(s) for s in K.ACTIVE_SOURCES)})"
    return f"cast(case {st} when 'closed' then case when {http} = 404 then 0.98 else 0.95 end when 'coming_soon' then 0.82 when 'requires_login' then 0.9 when 'open' then 0.9 when 'likely_open' then case when {active} then 0.7 else 0.68 end when 'stale' then 0.65 else 0.2 end as double)"


# --- eligibility -------------------------------------------------------------------


def _any(d, s: str, patterns) -> str:
    return "(" + d.any(s, "s", any_match(d, "s", patterns)) + ")"


def degree_flags(d, s: str) -> dict[str, str]:
    return {"has_bachelors": _any(d, s, K.BACHELOR), "has_masters": _any(d, s, K.MASTER), "has_phd": _any(d, s, K.PHD), "requires_masters": _any(d, s, K.REQUIRES_MASTER), "requires_phd": _any(d, s, K.REQUIRES_PHD)}


def undergrad_friendly(d) -> str:
    return "case when has_bachelors and not requires_phd then true when requires_phd or (requires_masters and not has_bachelors) then false end"


def years_of_sentence(d) -> str:
    """Years of graduation that one sentence ``s`` names, if it has a graduation cue."""
    num = lambda x: f"try_cast({x} as int)"
    a, b = num(d.extract("s", K.GRADUATION_RANGE, 2)), num(d.extract("s", K.GRADUATION_RANGE, 4))
    one, first, second = d.extract("s", K.CLASS_OF), d.extract("s", K.YEAR_LIST, 1), d.extract("s", K.YEAR_LIST, 2)
    near = d.extract("s", K.GRADUATING_IN)
    listed = f"case when {first} <> '' then {d.array([num(first), num(second)])} else {d.filter(d.transform(d.extract_all('s', K.YEAR), 'y', 'try_cast(y as int)'), 'y', 'y between 2020 and 2035')} end"
    own = f"case when {near} <> '' then {d.array([num(near)])} else {d.ints()} end"
    return (
        f"case when not ({d.match('s', K.GRADUATION_CUE)}) then {d.ints()} when {b} - {a} between 0 and 4 then {d.range(a, b)} "
        f"when {one} <> '' then {d.array([num(one)])} else {d.concat_lists(f'({own})', f'({listed})')} end"
    )


def graduation_years(d, s: str) -> str:
    """ELG-02: sorted distinct years of sentences with a graduation cue."""
    return d.distinct_sorted(d.flatten(d.transform(s, "s", years_of_sentence(d))))


def labels(d, s: str, table: dict) -> str:
    return d.compact(d.array(f"case when {_any(d, s, [p])} then {d.lit(k)} end" for k, p in table.items()))


def early_years_friendly(d, s: str) -> str:
    early = f"({_any(d, s, K.EARLY_YEARS_WELCOME)} or {_any(d, s, [K.CLASS_YEARS['freshman'], K.CLASS_YEARS['sophomore']])})"
    upper = f"({_any(d, s, K.UPPER_YEARS_ONLY)} or {_any(d, s, [K.CLASS_YEARS[k] for k in ('junior', 'senior', 'penultimate year', 'final year', 'rising junior', 'rising senior')])})"
    return f"case when {early} then true when {upper} then false end"


def sponsorship(d, s: str) -> str:
    return f"case when {_any(d, s, K.NO_SPONSORSHIP)} then 'not_available' when {_any(d, s, K.SPONSORSHIP)} then 'available' when {_any(d, s, K.MAYBE_SPONSORSHIP)} then 'maybe' else 'unknown' end"


def citizenship(d, s: str) -> str:
    whole = d.join(s, " ")
    return "case " + " ".join(f"when {_any(d, s, p)} or {any_match(d, whole, p)} then {d.lit(k)}" for k, p in K.CITIZENSHIP.items()) + " end"


def gpa(d, s: str) -> str:
    each = "coalesce(" + ", ".join(f"nullif({d.extract('s', p)}, '')" for p in K.GPA) + ")"
    return f"try_cast({d.first(d.compact(d.transform(s, 's', each)))} as double)"


def eligibility_confidence(d) -> str:
    w = K.ELIGIBILITY_WEIGHTS
    parts = {"degree": "has_bachelors or has_masters or has_phd", "graduation": f"{d.size('graduation_years')} > 0", "sponsorship": "sponsorship <> 'unknown'", "citizenship": "citizenship is not null", "major": f"{d.size('majors')} > 0", "class_year": f"{d.size('class_years')} > 0", "gpa": "gpa is not null"}
    return "cast(" + " + ".join(f"case when {c} then {w[k]} else 0 end" for k, c in parts.items()) + " as double) / 100"


def candidate_match(d, degree: str, year: str, major: str, needs: str, nation: str) -> str:
    """ELG-09: 0 to 1 for one candidate; caps apply in rule order, the last one set counts."""
    accepted = (
        f"({degree} is not null and (not (has_bachelors or has_masters or has_phd) or ({degree} = 'bachelors' and (has_bachelors or coalesce(undergrad_friendly, false))) or ({degree} = 'masters' and has_masters)"
        f" or ({degree} = 'phd' and (has_phd or has_masters or has_bachelors))))"
    )
    technical = f"{major} in ({', '.join(d.lit(m) for m in K.TECHNICAL_MAJORS)})"
    fits = f"({d.contains_list('majors', major)} or (({d.contains_list('majors', d.lit('stem'))} or {d.contains_list('majors', d.lit('quantitative field'))}) and {technical}) or ({d.contains_list('majors', d.lit('engineering'))} and contains({major}, 'engineering')))"
    phd = f"(requires_phd and coalesce({degree}, '') <> 'phd')"
    masters = f"(not {phd} and requires_masters and coalesce({degree}, '') not in ('masters', 'phd'))"
    foreign = f"coalesce({nation}, '') not in ('us', 'us_citizen', 'u.s. citizen')"
    blocked = f"(sponsorship = 'not_available' and {needs})"
    s1 = f"case when {phd} then 5 when {masters} then 10 when {accepted} then 65 else 50 end"
    s2 = f"({s1}) + case when {d.size('graduation_years')} = 0 then 0 when coalesce({d.contains_list('graduation_years', year)}, false) then 15 else -20 end"
    s3 = f"({s2}) + case when {d.size('majors')} = 0 or {major} is null then 0 when {fits} then 10 else -10 end"
    s4 = f"case when {blocked} then least({s3}, 2) when sponsorship in ('available', 'maybe') and {needs} then ({s3}) + 5 else {s3} end"
    cap = f"case when {foreign} and citizenship = 'us_citizen_required' then 2 when {foreign} and citizenship in ('security_clearance_required', 'itar_restricted') then 10 when {blocked} then 2 when {phd} then 5 when {masters} then 10 else 1000 end"
    return f"cast(greatest(0, least(100, {s4}, {cap})) as double) / 100"


# --- scores --------------------------------------------------------------------------


def round2(d, x: str) -> str:
    """MTH-01: two places, by the exact binary value, ties to even.

    ``v`` splits into a part of 24 bits and a rest; both times 100 are exact,
    so what is left beside the nearest whole number is exact as well.
    """
    near = "floor(v * 100 + 0.5)"
    high = "cast(cast(v as float) as double)"
    rest = f"(({high} * 100 - {near}) + (v - {high}) * 100)"
    even = f"2 * floor(({near} + {rest} + 0.5) / 2)"
    whole = f"case when {rest} > 0.5 then {near} + 1 when {rest} < -0.5 then {near} - 1 when abs({rest}) = 0.5 then {even} else {near} end"
    return d.first(d.transform(d.array([f"cast({x} as double)"]), "v", f"cast({whole} as double) / 100"))


def technical_depth(d, title: str, description: str, family: str) -> str:
    """SCO-03 over folded text."""
    parts = [f"case when contains({title}, {d.lit(k)}) then {a} when contains({description}, {d.lit(k)}) then {b} else 0 end" for terms, a, b in ((K.STRONG_KEYWORDS, 12, 10), (K.MEDIUM_KEYWORDS, 6, 3)) for k in terms]
    parts += [f"case when contains({title}, {d.lit(k)}) or contains({description}, {d.lit(k)}) then -18 else 0 end" for k in K.NEGATIVE_KEYWORDS]
    families = ", ".join(d.lit(f) for f in K.TECHNICAL_FAMILIES)
    return f"cast(greatest(0, least(100, 25 + {' + '.join(parts)} + case when {family} in ({families}) then 10 else 0 end)) as double)"


def role_fit(d, family: str, confidence: str, excluded: tuple[str, ...] = ()) -> str:
    """SCO-02; no family is excluded unless the configuration says so."""
    boost = f"least(5.0, {confidence} * 5.0)"
    cases = [(K.TARGET_ROLES, f"least(100.0, 92.0 + {boost})"), (K.ADJACENT_ROLES, f"72.0 + {boost}"), (K.DEPRIORITIZED_ROLES, f"greatest(20.0, 35.0 - {boost})"), (excluded, "10.0"), (("unknown",), "40.0")]
    whens = " ".join(f"when {family} in ({', '.join(map(d.lit, names))}) then cast({value} as double)" for names, value in cases if names)
    return round2(d, f"case {whens} else 55.0 end")


def freshness(d, age: str, st: str) -> str:
    base = f"case when {age} = 0 then 100 when {age} <= 3 then 90 when {age} <= 7 then 75 when {age} <= 30 then 55 else 35 end"
    return f"cast(case {st} when 'closed' then least({base}, 15) when 'stale' then least({base}, 25) when 'coming_soon' then least(85, {base} + 5) else {base} end as double)"


def eligibility_score(d) -> str:
    raw = (
        "60 + case when undergrad_friendly then 15 when undergrad_friendly = false then -20 else 0 end + case when early_years then 8 else 0 end"
        " + case when sponsorship = 'not_available' then -10 when sponsorship in ('available', 'maybe') then 5 else 0 end + case when requires_phd then -25 when requires_masters then -15 else 0 end"
        f" + case when {d.size('graduation_years')} > 0 then 5 else 0 end + case when {d.size('majors')} > 0 then 5 else 0 end"
    )
    return f"cast(greatest(0, least(100, case when eligibility_confidence = 0 then least({raw}, 60) else {raw} end)) as double)"


def tier_score(d, tier: str) -> str:
    return f"cast(case {tier} " + " ".join(f"when {d.lit(k)} then {v}" for k, v in K.TIER_SCORES.items()) + " else 50.0 end as double)"


def visibility(d, prestige: str, source: str, count: str = "1") -> str:
    base = f"case when {prestige} >= 95 then 20 when {prestige} >= 90 then 35 when {prestige} >= 80 then 70 when {prestige} >= 70 then 82 when {prestige} >= 60 then 88 else 75 end"
    shift = f"case {source} when 'custom_page' then 10 when 'github_list' then -12 when 'greenhouse' then 0 when 'lever' then 0 else 5 end"
    return f"cast(greatest(0, least(100, {base} + {shift} - least(15, greatest(0, 4 * ({count} - 1))))) as double)"


def hidden_gem(d, st: str, family: str) -> str:
    """SCO-06 over the columns of the other scores."""
    quality = "case when prestige >= 95 then 85 when prestige >= 90 then 80 when prestige >= 80 then 75 when prestige >= 70 then 70 when prestige >= 60 then 62 else 55 end"
    raw = f"0.25 * visibility + 0.25 * {round2(d, 'technical_depth * 0.6 + role_fit * 0.4')} + 0.20 * eligibility + 0.15 * freshness + 0.15 * ({quality})"
    weak = ", ".join(d.lit(f) for f in K.GEM_DEPRIORITIZED)
    cap1 = f"case when {family} in ({weak}) or technical_depth < 40 then 20.0 when role_fit < 50 or technical_depth < 50 then 35.0 else 100.0 end"
    cap2 = f"case when {st} = 'closed' then 10.0 when {st} in ('requires_login', 'unknown') then 30.0 else 100.0 end"
    return round2(d, f"greatest(0.0, least({raw}, {cap1}, {cap2}))")


def status_open(d, st: str) -> str:
    return f"cast(case {st} " + " ".join(f"when {d.lit(k)} then {v}" for k, v in K.STATUS_OPEN_SCORES.items()) + " else 40.0 end as double)"


def opportunity(d, preset: str | dict) -> str:
    """SCO-10: weighted sum in the preset's order, within 0 and 100, two places."""
    weights = K.PRESETS.get(preset.lower(), K.PRESETS[K.DEFAULT_PRESET]) if isinstance(preset, str) else custom_weights(preset)
    return round2(d, "greatest(0.0, least(100.0, " + " + ".join(f"{k} * {w}" for k, w in weights.items()) + "))")


def custom_weights(weights: dict[str, float]) -> dict[str, float]:
    """MTH-03: positive weights to a sum of one, four places."""
    kept = {k: float(v) for k, v in weights.items() if float(v) > 0}
    if not kept:
        raise ValueError("custom weights need a positive value")
    total = sum(kept.values())
    return {k: round(v / total, 4) for k, v in kept.items()}
