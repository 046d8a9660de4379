"""URL filter: host and path rules, else a weighted vocabulary.

An Aho-Corasick automaton finds every vocabulary term of a URL in one scan;
a hit counts if no letter (of any script) or digit adjoins it. One strict term, or SOFT_LIMIT
distinct soft terms, block the URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One of these blocks a URL: adult, piracy, fraud and gambling words that hardly stand for anything else,
#: English first, then German, French, Spanish, Italian, Portuguese, Dutch, Polish and Russian in Latin letters.
STRICT = (
    "porn", "porno", "pornos", "pornstar", "pornstars", "xxx", "hentai", "nsfw", "milf", "milfs", "camgirl", "camgirls", "camsex", "sexcam", "sexcams", "sexchat", "sextube", "sexvideo", "sexvideos", "sexshop", "blowjob", "handjob", "gangbang", "creampie", "bukkake", "bdsm", "femdom", "upskirt", "voyeur", "jailbait",
    "redtube", "xvideos", "xhamster", "escorts", "escortservice", "callgirl", "callgirls", "deepfakes", "gore", "beastiality", "warez", "keygen", "keygens", "crackz", "serialz", "nulled", "carding", "cardingforum", "darkmarket", "phishing", "malware", "spyware", "ransomware", "botnet", "viagra", "cialis", "levitra", "casinobonus", "casino-bonus", "sportsbook",
    "sexkontakte", "sexbilder", "pornofilme", "hurenforum", "nutten", "spielothek", "sexe", "plan-cul", "plancul", "femmes-nues", "putas", "culonas", "pornogratis", "porno-gratis", "sexogratis", "casinoenlinea", "incontri-hard", "pompini", "putaria", "sexoamador", "sexfilm", "seksfilm", "gratisporno", "darmowe-porno", "sekskamerki", "poker-onlain", "prostitutki", "porevo",
)
#: SOFT_LIMIT distinct ones of these block a URL: each has an innocent use.
SOFT = (
    "adult", "adults", "sex", "sexy", "nude", "nudes", "naked", "erotic", "erotica", "fetish", "lingerie", "webcam", "webcams", "hookup", "hookups", "swinger", "swingers", "escort", "stripper", "strippers", "dating", "singles", "amateur", "mature", "busty", "casino", "casinos", "poker", "roulette", "blackjack", "betting", "bookmaker", "slots", "jackpot", "gamble", "gambling", "lottery", "wager",
    "torrent", "torrents", "crack", "cracked", "serials", "pirate", "unblocked", "pills", "pharmacy", "tramadol", "steroids", "loan", "loans", "payday", "forex", "replica", "replicas", "knockoff", "clickbait", "vape", "cannabis", "kush",
    "nackt", "erotik", "partnersuche", "wetten", "spielautomaten", "gluecksspiel", "kredit", "nue", "nues", "erotique", "rencontres", "paris-sportifs", "machines-a-sous", "desnudas", "eroticas", "contactos", "apuestas", "tragamonedas", "nude-donne", "erotico", "scommesse", "incontri", "nuas", "apostas", "naakt", "erotiek", "gokken", "gokkasten", "randki", "erotyka", "zaklady", "kasyno", "znakomstva", "stavki", "kazino", "erotika",
)
SOFT_LIMIT = 2
#: (host, path, verdict): the longest one that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

HOST = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    c = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(c, HOST, 1), UPPER, LOWER), F.regexp_extract(c, PATH, 1)


def rule_for(rules=RULES, host: str = "host", path: str = "path") -> F.Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def vocabulary_hits(urls: DataFrame, url_col: str, strict=STRICT, soft=SOFT) -> DataFrame:
    """``urls`` with n_strict and n_soft, the distinct terms found (A-Z folded)."""
    kinds = {t: 0 for t in soft} | {t: 1 for t in strict}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in kinds:
            automaton.add_word(term, term)
        automaton.make_automaton()
        adjoins = lambda c: bool(c) and (c in LOWER or c in "0123456789" or c > "\x7f")
        fold = str.maketrans(UPPER, LOWER)
        for batch in batches:
            found = []
            for url in batch.column(batch.schema.get_field_index(url_col)).to_pylist():
                url = (url or "").translate(fold)
                terms = {t for end, t in automaton.iter(url) if not adjoins(url[end + 1 : end + 2]) and not adjoins(url[end - len(t) : end - len(t) + 1] if end >= len(t) else "")}
                found.append((sum(kinds[t] for t in terms), sum(not kinds[t] for t in terms)))
            s, w = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.int64()), pa.array(w, pa.int64())], names=[*batch.schema.names, "n_strict", "n_soft"])

    fields = ", ".join(f"`{c}` {t}" for c, t in urls.dtypes)
    return urls.mapInArrow(run, f"{fields}, n_strict long, n_soft long")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(id, host, path, rule, n_strict, n_soft, verdict), a row per input row.

    Null and malformed URLs have empty host and path, fit no rule and hold no
    term of their own: they are allowed unless their text holds terms.
    """
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).cast("string").alias("url_text"))
    host, path = host_path("url_text")
    scored = vocabulary_hits(rows, "url_text", strict, soft).withColumn("host", host).withColumn("path", path).withColumn("fit", rule_for(rules))
    bad = (F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit)
    return scored.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), "n_strict", "n_soft", F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"))


def oracle_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """The same verdicts in DuckDB, a regular expression for each term."""
    lists = {k: "[" + ", ".join(f"'{t}'" for t in v) + "]" for k, v in (("strict", strict), ("soft", soft))}
    count = lambda k: f"len(list_filter({lists[k]}, lambda t: regexp_matches(low, '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])' || t || '($|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])')))"
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule = "case " + " ".join(f"when {c} then '{n}'" for c, n, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in fits) + f" when n_strict >= 1 or n_soft >= {soft_limit} then 'block' else 'allow' end"
    up, low = UPPER, LOWER
    return f"""
with p as (select page_id, coalesce(url, '') u, translate(coalesce(url, ''), '{up}', '{low}') low from pages),
q as (select page_id, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), '{up}', '{low}') host,
  regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) path, {count("strict")} n_strict, {count("soft")} n_soft from p)
select page_id, host, path, {rule} rule, n_strict, n_soft, {verdict} verdict from q"""
