"""Words, thresholds and tables that results depend on."""

# Status signals, in order of precedence within a list.
OPEN_SIGNALS = ("apply now", "apply for this job", "submit application", "application form", "application")
CLOSED_SIGNALS = ("no longer accepting applications", "this job is closed", "position has been filled", "applications are closed", "job not found", "404", "no longer available", "this posting has expired")
COMING_SOON_SIGNALS = ("check back next year", "check back soon", "applications will open", "join our talent community", "summer 2027 applications", "applications for summer 2026 are closed", "not currently accepting applications")
LOGIN_SIGNALS = ("login to apply", "sign in to continue", "create an account to view", "log in to view", "authentication required")
ACTIVE_SOURCES = ("greenhouse", "lever")
STALE_DAYS = 180

# Technical-depth keywords.
STRONG_KEYWORDS = ("c++", "low latency", "distributed systems", "network programming", "multithreading", "concurrency", "performance optimization", "market data", "exchange connectivity", "trading infrastructure", "backtesting", "simulation", "real-time systems", "fpga", "verilog", "hardware acceleration", "kernel bypass", "order book", "matching engine")
MEDIUM_KEYWORDS = ("python", "linux", "performance", "optimization", "real-time", "latency-sensitive", "profiling", "data feeds", "signal generation", "market microstructure")
NEGATIVE_KEYWORDS = ("sales", "operations", "client services", "marketing", "administrative", "accounting", "business development", "compliance")

# Role families, their sets and keywords.
TECHNICAL_FAMILIES = ("quant_developer", "trading_systems_engineer", "algorithmic_trading_engineer", "software_engineer_trading", "low_latency_engineer", "market_data_engineer", "infrastructure_engineer", "fpga_engineer", "hardware_trading_engineer", "ml_engineer_quant", "data_engineer_quant", "research_engineer_quant")
TARGET_ROLES = TECHNICAL_FAMILIES
ADJACENT_ROLES = ("quant_research", "quant_trading")
DEPRIORITIZED_ROLES = ("finance_analyst", "trading_operations", "other")
GEM_DEPRIORITIZED = ("finance_analyst", "trading_operations", "other", "unknown")
NEGATIVE_EXEMPT = ("finance_analyst", "trading_operations", "other", "unknown")
ROLE_NEGATIVES = ("sales", "operations", "compliance", "accounting", "marketing", "business development", "investment banking", "wealth management", "client services", "campus ambassador")
ROLE_PREFERENCES = ("trading_systems_engineer", "software_engineer_trading", "low_latency_engineer", "algorithmic_trading_engineer", "market_data_engineer", "infrastructure_engineer", "fpga_engineer", "hardware_trading_engineer", "quant_developer", "ml_engineer_quant", "data_engineer_quant", "research_engineer_quant", "quant_trading", "quant_research", "trading_operations", "finance_analyst", "other", "unknown")
#: family: (strong keywords, medium keywords, category keywords)
ROLE_FAMILIES = {
    "quant_developer": (("quant developer", "quantitative developer", "quantitative software developer", "quant dev", "research engineer", "trading developer"), ("backtesting", "trading models", "research platform", "python", "c++", "quantitative systems"), ("quant_developer",)),
    "trading_systems_engineer": (("trading systems", "trading platform", "trade execution", "execution systems", "order management", "market connectivity"), ("exchange connectivity", "order book", "matching engine", "market data", "real-time systems"), ("trading_systems_engineer",)),
    "algorithmic_trading_engineer": (("algorithmic trading", "algo trading", "trading algorithms", "execution algorithms"), ("signal generation", "backtesting", "simulation", "market microstructure", "strategy development"), ("algorithmic_trading_engineer",)),
    "software_engineer_trading": (("software engineer intern", "software engineering intern", "trading software", "engineering intern trading", "software engineer"), ("python", "java", "c++", "distributed systems", "backend", "infrastructure", "trading"), ("software_engineer_trading",)),
    "low_latency_engineer": (("low latency", "ultra-low latency", "latency-sensitive", "high performance c++", "performance critical", "kernel bypass"), ("network programming", "linux systems", "profiling", "optimization", "real-time systems", "multithreading", "concurrency"), ("low_latency_engineer",)),
    "market_data_engineer": (("market data", "market data engineer", "data feeds", "exchange data"), ("streaming data", "tick data", "order book", "real-time data"), ("market_data_engineer",)),
    "infrastructure_engineer": (("infrastructure engineer", "platform engineer", "systems engineer", "distributed systems"), ("kubernetes", "linux", "backend", "databases", "cloud", "observability"), ("infrastructure_engineer",)),
    "fpga_engineer": (("fpga", "verilog", "vhdl", "hardware acceleration", "hardware engineer intern"), ("digital logic", "computer architecture", "low latency hardware", "rtl"), ("fpga_engineer", "hardware_trading_engineer")),
    "hardware_trading_engineer": (("hardware trading", "trading hardware", "smartnic", "network card"), ("fpga", "digital logic", "latency hardware"), ("hardware_trading_engineer",)),
    "ml_engineer_quant": (("machine learning engineer", "ml engineer", "ai engineer"), ("models", "prediction", "deep learning", "pytorch", "tensorflow", "feature engineering", "trading"), ("ml_engineer_quant",)),
    "data_engineer_quant": (("data engineer", "data engineering", "data platform", "data infrastructure"), ("streaming data", "pipelines", "etl", "warehouse", "trading data"), ("data_engineer_quant",)),
    "research_engineer_quant": (("research engineer", "research platform engineer", "simulation engineer"), ("backtesting", "research platform", "models", "python"), ("research_engineer_quant",)),
    "quant_trading": (("quantitative trading intern", "quant trader", "trading intern", "trader intern"), ("market making", "options trading", "risk taking", "decision making"), ("quant_trading",)),
    "quant_research": (("quantitative research intern", "quant researcher", "research scientist", "alpha research"), ("statistics", "probability", "mathematics", "optimization", "signals"), ("quant_research",)),
    "finance_analyst": (("sales and trading", "summer analyst", "finance analyst", "trading analyst"), ("analyst", "capital markets", "portfolio", "investment"), ()),
    "trading_operations": (("trading operations", "trade support", "middle office", "operations analyst"), ("post-trade", "reconciliation", "settlement", "client onboarding"), ()),
}

# Prestige tiers, their scores and label aliases.
TIERS = {
    "S+": ("Jane Street", "Citadel", "Citadel Securities", "Hudson River Trading", "Jump Trading", "Two Sigma", "D. E. Shaw", "IMC Trading", "Optiver", "Susquehanna International Group"),
    "S": ("DRW", "Tower Research Capital", "Akuna Capital", "Flow Traders", "Five Rings", "Headlands Technologies", "PDT Partners", "Cubist Systematic Strategies", "G-Research", "XTX Markets"),
    "A": ("Maven Securities", "Old Mission", "XR Trading", "Valkyrie Trading", "Geneva Trading", "Belvedere Trading", "CTC", "Wolverine Trading", "PEAK6", "Virtu Financial"),
    "B": ("TransMarket Group", "Teza Technologies", "Millennium", "Qube Research & Technologies", "Man Group", "Winton", "Squarepoint Capital", "Schonfeld", "Balyasny Asset Management", "ExodusPoint"),
    "C": ("Marshall Wace", "AQR Capital Management", "WorldQuant", "TGS Management", "Arrowstreet Capital", "Radix Trading", "DV Trading", "RGM Advisors", "Quantlab", "Aquatic Capital Management"),
}
TIER_SCORES = {"S+": 100.0, "S": 90.0, "A": 80.0, "B": 70.0, "C": 60.0, "Unknown": 50.0}
TIER_ALIASES = {"tier_1": "S+", "tier_2": "S", "tier_3": "A", "tier_4": "B", "tier_5": "C", "unknown": "Unknown"}

# Ranking presets.
PRESETS = {
    "cs_algo_engineering": {"role_fit": 0.35, "technical_depth": 0.20, "freshness": 0.15, "eligibility": 0.15, "prestige": 0.10, "hidden_gem": 0.05},
    "prestige_first": {"prestige": 0.40, "role_fit": 0.25, "freshness": 0.15, "eligibility": 0.10, "technical_depth": 0.05, "hidden_gem": 0.05},
    "hidden_gems": {"hidden_gem": 0.35, "role_fit": 0.25, "freshness": 0.20, "technical_depth": 0.10, "eligibility": 0.10},
    "apply_now": {"freshness": 0.30, "status_open": 0.25, "role_fit": 0.20, "eligibility": 0.15, "prestige": 0.10},
    "beginner_friendly": {"eligibility": 0.35, "role_fit": 0.20, "freshness": 0.20, "hidden_gem": 0.15, "prestige": 0.10},
}
DEFAULT_PRESET = "cs_algo_engineering"
STATUS_OPEN_SCORES = {"open": 100.0, "likely_open": 80.0, "coming_soon": 55.0, "requires_login": 35.0, "unknown": 40.0, "stale": 20.0, "closed": 0.0}

# Seasons, months, remote terms, location tokens.
SEASONS = ("summer", "winter", "fall", "spring")
MONTH_SEASONS = {"january": "winter", "february": "winter", "march": "spring", "april": "spring", "may": "summer", "june": "summer", "july": "summer", "august": "summer", "september": "fall", "october": "fall", "november": "fall", "december": "winter"}
REMOTE_TERMS = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite", "on site": "onsite"}
LOCATION_TOKENS = ("new york, ny", "new york city", "new york", "nyc", "london", "singapore", "chicago, il", "chicago", "remote", "austin", "boston", "amsterdam")
STOPWORDS = ("a", "an", "and", "at", "for", "in", "of", "on", "our", "the", "to", "with", "your")

# Internship patterns (program type, pattern).
MULTILINGUAL_INTERNSHIP = (
    ("internship", r"\b(?:praktikum|praktikant(?:in|en)?)\b"), ("internship", r"\bwerkstudent(?:in)?\b"), ("internship", r"\bstagiaire\b"), ("internship", r"\b(?:becari[oa]|pr[áa]cticas)\b"),
    ("internship", r"\btirocinio\b"), ("internship", r"\best[áa]gi(?:o|ári[oa])\b"), ("internship", r"实习生?|インターン(?:シップ)?|인턴(?:십)?"),
)
PLACEMENT = r"\b(?:industrial placement|placement (?:year|student|programme|program)|vacation (?:scheme|programme|program)|spring (?:week|insight)|insight (?:programme|program|week))\b"
TITLE_INTERNSHIP = (("internship", r"\bintern(?:ship|ships|s)?\b"), ("co_op", r"\bco[\s\-]?op(?:s)?\b"), ("summer_analyst", r"\bsummer analyst\b"), ("placement", PLACEMENT), *MULTILINGUAL_INTERNSHIP)
DESCRIPTION_INTERNSHIP = (
    ("internship", r"\b(?:summer|winter|spring|fall|autumn|graduate)?\s*intern(?:ship)?\s+(?:program|programme|position|role|opportunit(?:y|ies)|opening|cohort)\b"), ("internship", r"\b(?:this|our)\s+internship\b"), ("internship", r"\b\d+[\s\-]?(?:week|month)s?\s+intern(?:ship)?\b"),
    ("co_op", r"\bco[\s\-]?op\s+(?:program|programme|position|role|term)\b"), ("summer_analyst", r"\bsummer analyst\b"), ("placement", PLACEMENT), *MULTILINGUAL_INTERNSHIP,
)

# Eligibility patterns.
GRADUATION_CUE = r"\b(graduat(?:e|ing|ion)|class of|expected graduation|students graduating|degree date)\b"
YEAR = r"\b(20\d{2})\b"
YEAR_LIST = r"\b(20\d{2})\s*(?:or|and|/)\s*(20\d{2})\b"
CLASS_OF = r"\bclass of\s+(20\d{2})\b"
GRADUATING_IN = r"\b(?:graduating|graduate|expected graduation(?: date)?(?: of)?)\b[^.]{0,80}?\b(20\d{2})\b"
GRADUATION_RANGE = r"\b(?:graduating|graduate|expected graduation(?: date)?(?: of)?)\b[^.]{0,80}?between\s+([A-Za-z]+)\s+(20\d{2})\s+and\s+([A-Za-z]+)\s+(20\d{2})\b"
GPA = (r"\bminimum(?: cumulative)? gpa(?: of)?\s*([0-4]\.\d{1,2})\b", r"\bgpa\s*([0-4]\.\d{1,2})\s*(?:or higher|minimum|required)?\b", r"\b([0-4]\.\d{1,2})\s*minimum gpa\b")
BACHELOR = (r"\bbachelor'?s degree\b", r"\bbachelors degree\b", r"\bundergraduate\b", r"\bcurrently pursuing a b\.?s\.?\b", r"\bcurrently pursuing a b\.?a\.?\b", r"\bpursuing a bachelor'?s\b", r"\bpursuing a bachelors\b", r"\b(?:bs|b\.s\.|ba|b\.a\.)\b[^.]{0,20}\bdegree\b")
MASTER = (r"\bmaster'?s degree\b", r"\bmasters degree\b", r"\bgraduate degree\b", r"\bm\.?s\.?\b")
PHD = (r"\bph\.?d\.?\b", r"\bdoctorate\b", r"\bdoctoral\b")
REQUIRES_MASTER = (r"\bmaster'?s degree required\b", r"\bmust be pursuing a master'?s\b", r"\bgraduate student\b", r"\bgraduate degree required\b")
REQUIRES_PHD = (r"\bph\.?d\.? required\b", r"\bdoctor(?:al|ate) required\b", r"\bmust be pursuing a ph\.?d\.?\b", r"\bph\.?d\.? candidates only\b")
CLASS_YEARS = {"freshman": r"\bfreshm(?:a|e)n\b|\bfirst[- ]years?\b", "sophomore": r"\bsophomores?\b|\bsecond[- ]years?\b", "junior": r"\bjunior\b", "senior": r"\bsenior\b", "rising junior": r"\brising junior\b", "rising senior": r"\brising senior\b", "penultimate year": r"\bpenultimate year\b", "final year": r"\bfinal year\b", "undergraduate": r"\bundergraduate student\b|\bundergraduate\b"}
EARLY_YEARS_WELCOME = (r"\b(open to|eligible|welcome|accept(?:ed)?|considered?)\b[^.]{0,40}?\b(first[- ]years?|freshm(?:a|e)n|sophomores?)\b", r"\b(first[- ]years?|freshm(?:a|e)n|sophomores?)\b[^.]{0,40}?\b(open to|eligible|welcome|accept(?:ed)?|considered?)\b")
UPPER_YEARS_ONLY = (r"\b(?:junior|senior|penultimate year|final year)\b[^.]{0,30}\bonly\b", r"\bonly\b[^.]{0,30}\b(?:junior|senior|penultimate year|final year)\b")
MAJORS = {"computer science": r"\bcomputer science\b", "computer engineering": r"\bcomputer engineering\b", "electrical engineering": r"\belectrical engineering\b", "mathematics": r"\bmathematics\b|\bmath\b", "statistics": r"\bstatistics\b|\bstatistical\b", "physics": r"\bphysics\b", "engineering": r"\bengineering\b", "operations research": r"\boperations research\b", "data science": r"\bdata science\b", "machine learning": r"\bmachine learning\b", "applied math": r"\bapplied math(?:ematics)?\b", "quantitative field": r"\bquantitative field\b", "stem": r"\bstem\b"}
TECHNICAL_MAJORS = ("computer science", "computer engineering", "electrical engineering", "mathematics", "statistics", "physics", "engineering", "operations research", "data science", "machine learning", "applied math")
NO_SPONSORSHIP = (r"\bdo not sponsor visas\b", r"\bsponsorship is not available\b", r"\bmust be authorized to work without sponsorship\b", r"\bwill not sponsor\b", r"\bwithout the need for sponsorship\b", r"\bwithout sponsorship now or in the future\b", r"\blegally authorized to work without sponsorship\b")
MAYBE_SPONSORSHIP = (r"\bvisa sponsorship may be available\b", r"\bsponsorship may be considered\b")
SPONSORSHIP = (r"\bwe sponsor visas\b", r"\bsponsorship available\b")
CITIZENSHIP = {"security_clearance_required": (r"\bsecurity clearance required\b",), "itar_restricted": (r"\bitar restrictions?\b", r"\bexport control restrictions?\b"), "us_citizen_required": (r"\bu\.?\s*s\.?\s+citizenship required\b", r"\bmust be a u\.?\s*s\.?\s+citizen\b", r"\bus citizen required\b")}
#: Hundredths of confidence by signal.
ELIGIBILITY_WEIGHTS = {"degree": 20, "graduation": 20, "sponsorship": 15, "citizenship": 15, "major": 15, "class_year": 10, "gpa": 5}

# URLs.
TRACKING_KEYS = ("fbclid", "gclid", "gh_src", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
GENERIC_ENDINGS = ("careers", "search-careers", "students-graduates", "students-graduates/internships", "student-opportunities", "future-opportunities", "recruitment-process", "teams/engineering", "engineering", "team", "teams")
DETAIL_PATHS = ("/jobs/", "/job/", "/positions/", "/vacancies/", "/hrt-job/")
LISTING_PATHS = ("", "/", "/careers", "/search-careers", "/us", "/ap", "/eu")
LISTING_ENDINGS = ("/search-careers", "/careers", "/students-graduates/internships", "/recruitment-process")

# Pages.
ROLE_TERMS = ("intern", "internship", "engineer", "engineering", "developer", "analyst", "researcher", "research", "scientist", "trader", "trading", "quant", "quantitative", "software", "market data", "infrastructure", "systems", "backend", "hardware", "fpga", "machine learning", "data analyst", "data engineer")
GENERIC_PAGE_TERMS = ("how we hire", "recruitment process", "talent community", "join our team", "life at", "work at", "who we are", "about hrt", "join a community guided by", "find your role", "grow with us", "opportunities for early talent", "full-time & internship opportunities", "built by coders", "a place where kindness and excellence converge", "team", "engineering team", "tech blog", "future opportunities")
EXACT_GENERIC_TITLES = ("internship", "internships", "careers", "career opportunities", "student opportunities", "students and graduates", "students & graduates", "our opportunities")
MARKETING_PREFIXES = ("join ", "discover ", "explore ", "learn ", "welcome ", "work where")
APPLY_TERMS = ("apply", "apply now", "submit application", "apply here", "express interest")
NEGATIVE_LINK_TERMS = ("privacy", "terms", "cookies", "blog", "news", "press", "contact", "linkedin", "facebook", "twitter", "instagram", "login", "sign in", "sign-in", "account")
PAGE_CLOSED_TERMS = ("applications are closed", "position has been filled", "vacancy has been filled", "no longer available", "no longer accepting applications", "job not found", "posting has expired", "this job is closed", "this vacancy has been filled")
PAGE_SOON_TERMS = ("check back next year", "check back soon", "applications will open", "join our talent community", "join here", "not currently accepting applications")
# Links of pages, and sites by host (host, path of a listing, path of a posting).
SECTION_SEGMENTS = ("careers", "search-careers", "career", "jobs", "job", "students-graduates", "students-and-graduates", "student-opportunities", "internships", "programs", "teams", "team", "engineering", "future-opportunities", "talent-community", "recruitment-process", "about")
DETAIL_WORDS = ("intern", "engineer", "developer", "analyst", "research", "trader")
APPLY_PATHS = ("/apply", "/application", "/jobs/", "/vacancies/", "/hrt-job/")
SITES = (("hudsonrivertrading.com", "student-opportunities", "/hrt-job/"), ("gresearch.com", "/teams/engineering", "/vacancies/"), ("imc.com", "/search-careers", "/careers/jobs/"), ("imc.com", "/careers/students-graduates/internships/", "/careers/jobs/"))

# Entity resolution, review, actions.
SOURCE_PRIORITY = {"greenhouse": 4, "lever": 4, "custom_page": 3, "ats": 3, "other": 2, "github": 1, "list": 1, "search": 1}
STATUS_PRIORITY = {"closed": 7, "requires_login": 6, "coming_soon": 5, "open": 4, "likely_open": 3, "stale": 2, "unknown": 1}
SURE_SIMILARITY, LIKELY_SIMILARITY = 92, 85
GEM_THRESHOLD, QUEUE_GEM, QUEUE_OPPORTUNITY = 70.0, 80.0, 85.0
LOW_ROLE_CONFIDENCE, LOW_ELIGIBILITY_CONFIDENCE = 0.55, 0.35
SAVED_STATES = ("saved", "applied", "oa_received", "interviewing", "offer", "rejected")
APPLIED_STATES = ("applied", "oa_received", "interviewing", "offer", "rejected")

# Discovery terms and templates.
DISCOVERY_ROLES = ("Software Engineer Intern", "Software Engineering Intern", "Trading Systems Intern", "Quant Developer Intern", "Quantitative Developer Intern", "Algorithm Developer Intern", "Low Latency Software Engineer Intern", "Market Data Engineer Intern", "Infrastructure Engineer Intern", "FPGA Engineer Intern", "Research Engineer Intern", "Machine Learning Engineer Intern Trading", "C++ Trading Intern", "Trading Infrastructure Intern", "Backend Engineer Intern Trading", "Systems Engineer Intern Trading")
DISCOVERY_SEASONS = ("Summer 2027", "Summer 2026", "Winter 2027", "Fall 2026", "Spring 2027", "May 2027", "June 2027", "2027 Internship")
DISCOVERY_DOMAINS = {"greenhouse": "site:greenhouse.io", "lever": "site:lever.co", "ashby": "site:ashbyhq.com", "icims": "site:icims.com", "workday": "site:workdayjobs.com", "smartrecruiters": "site:smartrecruiters.com", "jobvite": "site:jobvite.com"}
DISCOVERY_GEMS = ("proprietary trading", "market maker", "systematic trading", "quantitative trading", "low latency", "market data", "trading infrastructure", "exchange connectivity", "options trading", "algorithmic trading", "trading systems", "trading", "C++")
DISCOVERY_PLACES = ("New York", "New York, NY", "Chicago", "Chicago, IL", "London", "Austin", "Boston", "Amsterdam", "Singapore", "Remote")
DISCOVERY_TEMPLATES = ('"{season}" "{role}"', '"{season}" "C++" "trading systems" "intern"', '"{season}" "{role}" "{hidden_gem_term}"', '"{season}" "{location_term}" "{role}"', '"{year}" "{role}"', '{domain_term} "{season}" "{role}"', '{domain_term} "{season}" "{role}" "{hidden_gem_term}"')
DISCOVERY_EXHAUSTIVE = ('"{season}" "{role}" "{location_term}" "{hidden_gem_term}"', '"{year}" "{hidden_gem_term}" "{role}"')
