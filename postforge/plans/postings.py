"""The derived postings view and the scored jobs over it, in two dialects.

``part`` carries the view: each row becomes a posting whose title, text,
place, firm, source and times follow its key by coprime moduli. The table of keys
is small beside the work on them, so keys are dealt to all cores first. Rules of
texts, and the role, are worked out once for each distinct text, all others row
by row in narrow projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.dialect import DUCK, SPARK
from postforge.functions import fixed as K
from postforge.functions import rules as R
from postforge.operators import classify
from postforge.session import once, stored, table, tasks

AS_OF = "TIMESTAMP '2026-09-01 00:00:00'"

TITLES = (
    "Software Engineer Intern, Trading Systems", "FPGA Engineer Intern", "Quant Developer Intern - Summer 2027", "Quantitative Research Intern", "Trading Operations Analyst", "Low Latency C++ Engineer", "Market Data Engineer Intern (Fall 2026)",
    "Machine Learning Engineer, Signals", "Platform Engineer, Kubernetes", "Summer Analyst, Sales and Trading", "Software Engineering Intern 2027", "software engineer intern", "Infrastructure Engineer Co-op", "Werkstudent Data Engineering", "Trader Intern, Options Trading",
    "Research Engineer Intern, Backtesting", "Hardware Engineer Intern", "Campus Ambassador", "Compliance Officer", "Data Engineer, Streaming Data", "Algorithmic Trading Developer", "Head of Marketing", "International Staging Lead", "Execution Systems Engineer, June 2027", "Algo Trading Intern Winter 2027", "Network Card Firmware Engineer", "Middle Office Associate", "Simulation Engineer Placement Year", "Software Engineer",
)
TEXTS = (
    "Build low latency market data systems in C++ and Python. Apply now.", "Currently pursuing a Bachelor's degree in Computer Science or related Engineering field. Expected graduation date between December 2026 and June 2028. Apply for this job.",
    "PhD required in statistics or mathematics. We sponsor visas.", "This job is closed.", "Applications for Summer 2026 are closed. Check back next year.", "Please sign in to continue.", "Class of 2027 students graduating with a minimum GPA of 3.5; US citizen required.",
    "Open to sophomores and first-year students. Sponsorship available. Submit application.", "Final year students only. We do not sponsor visas.", "Distributed systems, Linux and performance optimization. Security clearance required.",
    "", "Work on the order book, matching engine and exchange connectivity. Hybrid role.", "Our internship starts May 2027. Undergraduate students graduating in 2027 or 2028 are welcome.", "FPGA and Verilog design, kernel bypass, network programming.",
    "Python models, deep learning and feature engineering for trading.", "Position has been filled.", "Portfolio reconciliation and client onboarding for operations.", "Remote role with Kubernetes, cloud and databases. Apply now!", "Master's degree required. Visa sponsorship may be available.",
    "Backtesting   of trading models &amp; simulation.", "A 12-week internship program. Export control restrictions apply.", "Rising junior or rising senior in a quantitative field; GPA 3.2 or higher.", "STEM majors graduating December 2027.", "Market microstructure, signal generation and optimization in Java.",
    "Tick data pipelines, ETL and warehouse work. Application form below.", "On-site in our office. Investment and capital markets analyst.", "Join our talent community.", "Alpha research with probability and data science.", "Profiling, multithreading and concurrency on real-time systems.", "Marketing and business development for client services.", "Graduate student in physics or applied math; will not sponsor.",
)
PLACES = ("New York, NY", "Remote - New York / Chicago; Boston", "London", "Chicago, IL | Austin", "Remote", "Hybrid: Amsterdam", "Singapore; singapore", "", "On-site - Boston", "Zurich / Remote", "Hong Kong")
SOURCES = ("greenhouse", "lever", "ashby", "workday", "custom_page", "github_list", "other")
DEPARTMENTS = ("Technology", "Trading", "Operations", "", "Research")
#: Firms: the fixed tier names at even places, names of our own between.
OWN_FIRMS = ("Northgate Trading", "Ashfall Capital", "Blue Harbor Markets", "Copper Lane", "Deltaview", "Eastbridge Quant", "Fennel Street", "Granite Peak Trading", "Helix Markets", "Ironwood Systems", "Juniper Flow", "Kestrel Prop", "Lantern Trading", "Meridian Nine", "Oakline", "Pinewave", "Quarry Capital", "Redwood Execution")
FIRMS = tuple(n for pair in zip(OWN_FIRMS, [x for t in K.TIERS.values() for x in t][::3] + ["Sundial", "Tidewater"], strict=False) for n in pair) + ("Unlisted Partners",)
CATEGORIES = ("trading_systems", "quant_developer", "market_data", "fpga", "proprietary_trading")


def pick(d, key: str, values) -> str:
    n = len(values)
    if d.name == "spark":  # one lookup; a chain of conditions makes methods too long for Java to compile
        return f"get({d.array(d.lit(v) for v in values)}, cast({key} % {n} as int))"
    return f"case {key} % {n} " + " ".join(f"when {i} then {d.lit(v)}" for i, v in enumerate(values)) + " end"


def postings_columns(d) -> dict[str, str]:
    k = "p_partkey"
    host = f"case {k} % 7 when 0 then 'https://boards.greenhouse.io' when 1 then 'https://jobs.lever.co' when 2 then 'https://jobs.ashbyhq.com' when 4 then 'HTTPS://www.Example.com:443' else 'http://careers.example.org:80' end"
    firm = f"cast({k} % {len(FIRMS)} as string)" if d.name == "spark" else f"({k} % {len(FIRMS)})::varchar"
    num = f"cast({k} % 1009 as string)" if d.name == "spark" else f"({k} % 1009)::varchar"
    tail = f"case {k} % 13 when 0 then '/' when 1 then '?utm_source=feed&b=2&a=1' when 2 then '?gclid=9#apply' when 3 then '//details' when 4 then '?q=c%20plus' else '' end"
    return {
        "ingest_seq": k,
        "source_type": pick(d, k, SOURCES),
        "company_id": f"concat('firm-', {firm})",
        "company_name": pick(d, k, FIRMS),
        "title_raw": pick(d, k, TITLES),
        "description_raw": pick(d, k, TEXTS),
        "location_raw": pick(d, k, PLACES),
        "department": pick(d, k, DEPARTMENTS),
        "source_url_raw": f"case when {k} % 17 = 0 then concat({host}, '/careers') else concat({host}, '/acme//jobs/', {num}, {tail}) end",
        "apply_url_raw": f"case when {k} % 3 = 0 then null else concat({host}, '/acme/jobs/', {num}, '/apply') end",
        "ats_id": f"case when {k} % 5 = 0 then {num} end",
        "posted_at": d.add_hours("TIMESTAMP '2026-03-01 06:00:00'", f"({k} % 97) * 24 + {k} % 23"),
        "last_seen": d.add_hours("TIMESTAMP '2026-07-20 03:00:00'", f"({k} % 43) * 24 + {k} % 19"),
        "saved_raw": f"{k} % 11 = 0",
    }


def layers(d) -> list[dict[str, str]]:
    """Columns up to the role, layer by layer."""
    e = {"company_category": pick(d, "ingest_seq", CATEGORIES), "title": f"case when {R.clean(d, 'title_raw')} = '' then 'Untitled Job' else {R.clean(d, 'title_raw')} end", "description": R.clean(d, "description_raw"), "location": R.clean(d, "location_raw"), **R.url_parts(d, "source_url_raw", "src"), **R.url_parts(d, "apply_url_raw", "app")}
    forms = {**R.url_forms(d, "src"), **R.url_forms(d, "app")}
    folded = {"source_url": R.url_whole(d, "source_url_raw", "src"), "apply_url": R.url_whole(d, "apply_url_raw", "app"), "title_f": R.fold(d, "title"), "body_f": R.fold(d, "description"), "department_f": R.fold(d, "department"), "categories_f": d.array(["company_category"]), "snips": d.concat_lists(f"({d.sentences('title')})", f"({d.sentences('description')})"), "remote_type": R.remote_type(d, "location", "description"), **R.season_parts(d, "title", "description"), **R.program_type(d, "title", "description")}
    degree = {**R.degree_flags(d, "snips"), "graduation_years": R.graduation_years(d, "snips"), "class_years": R.labels(d, "snips", K.CLASS_YEARS), "majors": R.labels(d, "snips", K.MAJORS), "early_years": R.early_years_friendly(d, "snips"), "sponsorship": R.sponsorship(d, "snips"), "citizenship": R.citizenship(d, "snips"), "gpa": R.gpa(d, "snips")}
    more = {"undergrad_friendly": R.undergrad_friendly(d), "eligibility_confidence": R.eligibility_confidence(d), "locations": R.locations(d, "location", "remote_type"), "status": R.status(d, "body_f", "source_type"), "is_internship": "title_program is not null or description_program is not null", "age_days": f"greatest(0, {d.days('greatest(posted_at, last_seen)', AS_OF)})", "content_hash": f"substr({d.sha1(f'concat(lower(title), chr(10), lower(description), chr(10), source_url)')}, 1, 16)"}
    return [e, forms, folded, degree, more]


def tier_case(d) -> str:
    return "case " + " ".join(f"when company_name in ({', '.join(d.lit(n) for n in names)}) then {d.lit(t)}" for t, names in K.TIERS.items()) + " else 'Unknown' end"


def score_layers(d) -> list[dict[str, str]]:
    """Columns after the role."""
    job_id = (
        f"concat({R.slug(d, 'company_id')}, '-', {R.slug(d, 'source_type')}, '-', case when ats_id is not null then {R.slug(d, 'ats_id')} when source_url <> '' then substr({d.sha1('source_url')}, 1, 12) "
        f"else concat(substr({R.slug(d, 'title')}, 1, 60), '-', substr({d.sha1('title')}, 1, 12)) end)"
    )
    one = {"job_id": job_id, "tier": tier_case(d), "status_confidence": R.status_confidence(d, "body_f", "source_type", "status"), "technical_depth": R.technical_depth(d, "title_f", "body_f", "role_family"), "role_fit": R.role_fit(d, "role_family", "role_confidence"), "freshness": R.freshness(d, "age_days", "status"), "eligibility": R.eligibility_score(d), "status_open": R.status_open(d, "status")}
    two = {"prestige": R.tier_score(d, "tier")}
    three = {"visibility": R.visibility(d, "prestige", "source_type")}
    four = {"hidden_gem": R.hidden_gem(d, "status", "role_family")}
    return [one, two, three, four, {"opportunity": R.opportunity(d, K.DEFAULT_PRESET)}]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select("p_partkey").repartition(tasks(spark), "p_partkey")
    return keys.selectExpr(*[f"{e} as {n}" for n, e in postings_columns(SPARK).items()])


#: What the rules of texts read, the columns they give, and those that the role rests on.
TEXT_KEYS = ("title_raw", "description_raw")
TEXT_COLUMNS = (
    "title", "description", "title_f", "body_f", "snips", "season", "year", "season_confidence", "title_program", "description_program", "is_internship",
    "has_bachelors", "has_masters", "has_phd", "requires_masters", "requires_phd", "graduation_years", "class_years", "majors", "early_years", "sponsorship", "citizenship", "gpa", "undergrad_friendly", "eligibility_confidence",
)
ROLE_KEYS = ("title_f", "body_f", "department_f", "categories_f")


def layered(df: DataFrame, parts: list[dict[str, str]]) -> DataFrame:
    for layer in parts:
        df = df.withColumns({n: F.expr(e) for n, e in layer.items()})
    return df


def normalized(raw: DataFrame) -> DataFrame:
    of_text = [{n: e for n, e in layer.items() if n in TEXT_COLUMNS} for layer in layers(SPARK)]
    of_row = [{n: e for n, e in layer.items() if n not in TEXT_COLUMNS} for layer in layers(SPARK)]
    raw = once(raw, list(TEXT_KEYS), lambda texts: layered(texts, [x for x in of_text if x]))
    raw = once(raw, ["location_raw"], lambda rows: layered(rows, [{"location": of_row[0].pop("location")}, {"places": R.places(SPARK, "location")}]))
    of_row[-1]["locations"] = R.with_remote(SPARK, "places", "remote_type")
    return layered(raw, [x for x in of_row if x]).drop("places")


#: Scores that follow from the texts and the role alone.
ROLE_SCORES = ("technical_depth", "role_fit")


def scored(df: DataFrame) -> DataFrame:
    of_role = [{n: e for n, e in layer.items() if n in ROLE_SCORES} for layer in score_layers(SPARK)]
    of_row = [{n: e for n, e in layer.items() if n not in ROLE_SCORES} for layer in score_layers(SPARK)]
    df = once(df, list(ROLE_KEYS), lambda rows: layered(classify.classify(rows, categories="categories_f"), [x for x in of_role if x]))
    return layered(df, of_row)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised postings, stored once per session."""
    return stored(spark, f"silver {sf_dir}", lambda: normalized(postings(spark, sf_dir)))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored jobs, stored once per session."""
    return stored(spark, f"gold {sf_dir}", lambda: scored(silver(spark, sf_dir)))


def _chain(layers_: list[dict[str, str]], final: str) -> str:
    """Layers as materialised tables, the last one named ``jobs``; ``final`` reads it."""
    names = [f"l{i}" for i in range(len(layers_))] + ["jobs"]
    ctes = [f"l0 as materialized (select {', '.join(f'{e} as {n}' for n, e in postings_columns(DUCK).items())} from part)"]
    ctes += [f"{name} as materialized (select *, {', '.join(f'{e} as {n}' for n, e in layer.items())} from {before})" for name, before, layer in zip(names[1:], names, layers_, strict=False)]
    return f"with {', '.join(ctes)} {final}"


def normalized_sql(final: str = "select * from jobs") -> str:
    return _chain(layers(DUCK), final)


def jobs_sql(final: str = "select * from jobs") -> str:
    return _chain([*layers(DUCK), *classify.oracle_layers(DUCK, "title_f", "body_f", "department_f", "categories_f"), *score_layers(DUCK)], final)
