"""Page operators: one pass of an HTML parser per page, structs out.

``page_facts`` runs in Arrow batches; everything after it (page class, title
choice, status hint, candidates) is column expressions over its output.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postforge.functions import fixed as K

SKIPPED = {"script", "style", "noscript"}
BLOCKS = {"article", "div", "li", "section", "tr", "td"}
FACTS = "title string, text string, json_ld array<string>, headings array<string>, anchors array<struct<text:string,href:string>>, items array<string>, postings array<struct<title:string,body:string,place:string,link:string>>, blocks array<struct<title:string,href:string,text:string,links:array<struct<text:string,href:string>>>>"


LISTS = {"ul", "ol"}
HEADINGS = {"h1", "h2", "h3", "h4"}
MARKED = HEADINGS | {"a", "p", "li"}
#: Starts and ends before which an open paragraph ends by itself.
ENDS_P = BLOCKS | LISTS | {"p", "h1", "h2", "h3", "h4", "table", "main", "header", "footer", "form", "body"}
#: Lengths of a block's text that may be a posting.
SHORTEST, LONGEST = 40, 2400


class _Open:
    """Open elements in order; the last one of a tag is found, and taken out from wherever it stands, in constant time."""

    def __init__(self):
        self.top: dict | None = None
        self.by_tag: dict[str, list[dict]] = {}

    def push(self, tag: str, **values):
        node = {"tag": tag, "below": self.top, "above": None, **values}
        if self.top is not None:
            self.top["above"] = node
        self.top = node
        self.by_tag.setdefault(tag, []).append(node)

    def last(self, tag: str) -> dict | None:
        found = self.by_tag.get(tag)
        return found[-1] if found else None

    def remove(self, node: dict):
        """Take out the last element of its tag."""
        self.by_tag[node["tag"]].pop()
        below, above = node["below"], node["above"]
        if below is not None:
            below["above"] = above
        if above is not None:
            above["below"] = below
        else:
            self.top = below


def _squash(parts) -> str:
    return " ".join(" ".join(parts).split())


class _Page(HTMLParser):
    """Marks and blocks hold where their text begins in the page's words, so
    what stays open costs nothing; left-out end tags of p and li are implied.

    A block knows the length of its text from a running sum and its first seed
    that names a role, so what encloses it is tried in constant time; the seeds
    of two blocks are joined by moving the fewer."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.words, self.ld, self.headings, self.anchors, self.items = url, [], [], [], [], [], []
        self.blocks: list[dict] = []
        self.open, self.marks = _Open(), _Open()  # marks: kind, where its text begins, link; lists are kept as bounds
        self.skip, self.in_title, self.in_ld = 0, False, False
        self.lists, self.solid = 0, 0  # open lists, characters of all words so far

    def _end_mark(self, mark: dict):
        self.marks.remove(mark)
        kind = mark["tag"]
        if kind in LISTS:
            return
        joined = " ".join(self.words[mark["begin"] :])
        if kind == "a":
            self.anchors.append({"text": joined, "href": mark["href"]})
        elif kind in ("p", "li"):
            self.items.append(joined)
        else:
            self.headings.append(joined)
        block = self.open.top
        if kind not in ("p", "li") and block is not None and joined:
            block["seeds"].append((joined, mark["href"]))
            block["href"] = block["href"] or mark["href"]
            if block["role"] is None and any(t in joined.lower() for t in K.ROLE_TERMS):
                block["role"] = joined

    def _imply(self, *kinds: str):
        """End the open marks of these kinds in the list at hand, with what stands in them."""
        mark, low = self.marks.top, None
        while mark is not None and (mark["tag"] in kinds or mark["tag"] not in LISTS):
            low = mark if mark["tag"] in kinds else low
            mark = mark["below"]
        while low is not None:
            mark = self.marks.top
            self._end_mark(mark)
            if mark is low:
                break

    def _end_block(self, block: dict):
        self.open.remove(block)
        outer = block["below"]
        done = self._close(block)
        if outer is None:
            return
        outer["holds"] |= block["holds"] or done
        if not done:
            mine, theirs = block["seeds"], outer["seeds"]
            if len(mine) <= len(theirs):
                theirs.extend(mine)
            else:
                mine.extendleft(reversed(theirs))
                outer["seeds"] = mine
            outer["href"] = outer["href"] or block["href"]
            outer["role"] = block["role"] if outer["role"] is None else outer["role"]

    def _end_list_items(self):
        while self.open.top is not None and self.open.top["tag"] == "li" and self.open.top["lists"] == self.lists:
            self._end_block(self.open.top)

    def close(self):
        super().close()
        self._imply("p", "li", *LISTS)  # the end of the page ends them

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ENDS_P:
            self._imply("p")
        if tag == "li":
            self._imply("p", "li")
            self._end_list_items()
        elif tag in HEADINGS or tag == "a":  # neither stands in its own kind, so few marks are open at a time
            self._imply(*(HEADINGS if tag in HEADINGS else ("a",)))
        if tag in SKIPPED:
            self.skip += 1
            self.in_ld = tag == "script" and (a.get("type") or "").lower() == "application/ld+json"
            if self.in_ld:
                self.ld.append("")
        elif tag == "title":
            self.in_title = True
        elif tag in MARKED:
            self.marks.push(tag, begin=len(self.words), href=urldefrag(urljoin(self.url, a.get("href") or ""))[0] if tag == "a" and a.get("href") else "")
        elif tag in LISTS:
            self.marks.push(tag)
            self.lists += 1
        if tag in BLOCKS:
            self.open.push(tag, begin=len(self.words), solid=self.solid, lists=self.lists, seeds=deque(), role=None, href="", holds=False)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip, self.in_ld = max(0, self.skip - 1), False
        elif tag == "title":
            self.in_title = False
        if tag in ENDS_P and tag != "p":
            self._imply("p")
        if tag in LISTS:
            self._imply("p", "li")
            self._end_list_items()
            self.lists = max(0, self.lists - 1)
        if tag in MARKED or tag in LISTS:
            mark = self.marks.last(tag)
            if mark is not None:
                self._end_mark(mark)
        if tag in BLOCKS:
            block = self.open.last(tag)
            if block is not None:
                self._end_block(block)

    def _close(self, block: dict) -> bool:
        """Whether the block is the nearest container of its seeds. One around a
        block found before is no block of its own: the smaller one stays."""
        words = len(self.words) - block["begin"]
        if block["role"] is None or not SHORTEST <= self.solid - block["solid"] + words - 1 <= LONGEST:
            return False
        text = " ".join(self.words[block["begin"] :])
        low = text.lower()
        if not any(t in low for t in K.ROLE_TERMS):
            return False
        if not block["holds"]:
            self.blocks.append({"title": block["role"], "href": block["href"], "text": text, "links": [{"text": t, "href": h} for t, h in block["seeds"] if h]})
        return True

    def handle_data(self, data):
        if self.in_ld:
            self.ld[-1] += data
        if self.skip:
            return
        if self.in_title:
            self.title.append(data)
            return
        words = data.split()
        self.words += words
        self.solid += sum(map(len, words))


def parse_page(html: str | None, url: str | None = None) -> dict:
    """HTML-01/03 for one page; broken markup gives what could be read."""
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    return {"title": _squash(page.title), "text": " ".join(page.words), "json_ld": page.ld, "headings": page.headings, "anchors": page.anchors, "items": page.items, "postings": ld_postings(page.ld, url or ""), "blocks": page.blocks}


def page_facts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, title, text, json_ld, headings, anchors, items, postings, blocks) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_page(h, u) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kinds = {"title": pa.string(), "text": pa.string(), "json_ld": pa.list_(pa.string()), "headings": pa.list_(pa.string()), "anchors": pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())])), "items": pa.list_(pa.string())}
            kinds["postings"] = pa.list_(pa.struct([(n, pa.string()) for n in ("title", "body", "place", "link")]))
            kinds["blocks"] = pa.list_(pa.struct([("title", pa.string()), ("href", pa.string()), ("text", pa.string()), ("links", kinds["anchors"])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([f[k] for f in found], t) for k, t in kinds.items()]], names=[key, url, *kinds])

    return pages.select(key, url, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, {url} string, {FACTS}")


def clean_html(texts: DataFrame, column: str, to: str) -> DataFrame:
    """STR-01 with markup: visible text by the parser, white space collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parse_page(v)["text"] for v in values], pa.string())], names=[*batch.schema.names, to])

    return texts.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + f", `{to}` string")


def _ld_objects(ld: list[str]) -> Iterator[dict]:
    """JSN-02: JobPosting objects of JSON-LD texts, in lists and graphs at any depth."""

    def walk(x):
        if isinstance(x, list):
            for y in x:
                yield from walk(y)
        elif isinstance(x, dict):
            kinds = x.get("@type")
            if "jobposting" in {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])}:
                yield x
            yield from walk(x.get("@graph"))

    for text in ld:
        try:
            yield from list(walk(json.loads(text)))
        except (ValueError, RecursionError):
            continue


def _address(posting: dict) -> dict:
    place = posting.get("jobLocation")
    place = place[0] if isinstance(place, list) and place else place
    address = place.get("address") if isinstance(place, dict) else None
    return address if isinstance(address, dict) else {}


def job_postings(ld: list[str]) -> list[dict]:
    """JSN-02/03: JobPosting objects of JSON-LD texts, at any depth."""
    out = []
    for x in _ld_objects(ld):
        address = _address(x)
        parts = [address.get("addressLocality") or address.get("addressRegion"), address.get("addressCountry")]
        out.append({"title": x.get("title"), "description": x.get("description"), "location": ", ".join(p for p in parts if isinstance(p, str) and p), "url": x.get("url")})
    return out


def ld_postings(ld: list[str], page_url: str) -> list[dict]:
    """HTML-08: (title, body, place, link) of structured postings. The place is
    the locality, else region and country; bodies are freed of markup; links
    are made absolute, without one the page's own stands."""
    squash = lambda v: " ".join(str("" if v is None else v).split())
    out = []
    for x in _ld_objects(ld):
        address = _address(x)
        place = squash(address.get("addressLocality")) or ", ".join(v for v in (squash(address.get(k)) for k in ("addressRegion", "addressCountry")) if v)
        body = parse_page(x["description"])["text"] if isinstance(x.get("description"), str) else ""
        try:
            link = urldefrag(urljoin(page_url, squash(x.get("url")) or page_url))[0]
        except ValueError:
            link = page_url
        out.append({"title": squash(x.get("title")), "body": body, "place": place or None, "link": link})
    return out


# --- expressions over the facts ---------------------------------------------------------


def _has(c, terms) -> F.Column:
    """Any of the terms, as one pattern: plans stay small, however many terms there are."""
    return F.rlike(c, F.lit("|".join(re.escape(t) for t in terms)))


def _texts(values) -> F.Column:
    """An array of fixed texts, as one expression."""
    return F.expr("array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")")


def _begins(c, prefixes) -> F.Column:
    return F.rlike(c, F.lit("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"))


def _count(c, terms) -> F.Column:
    """How many of the terms stand in the text, which is worked out once."""
    held = _texts(terms)
    return F.get(F.transform(F.array(c), lambda x: F.size(F.filter(held, lambda t: F.contains(x, t)))), 0)


def is_role_title(c) -> F.Column:
    """STR-10."""
    low = F.lower(F.trim(c))
    starts = _begins(low, K.MARKETING_PREFIXES)
    return (low != "") & ~low.isin(*K.EXACT_GENERIC_TITLES) & ~starts & ~_has(low, K.GENERIC_PAGE_TERMS) & (F.size(F.split(low, r"\s+")) <= 12) & _has(low, K.ROLE_TERMS)


def specificity(c) -> F.Column:
    """STR-09: more role words, fewer generic ones, shorter."""
    low = F.lower(c)
    return F.struct(_count(low, K.ROLE_TERMS).alias("r"), (-_count(low, K.GENERIC_PAGE_TERMS)).alias("g"), (-F.length(c)).alias("n"))


def status_hint(c) -> F.Column:
    """HTML-13: coming-soon terms beat closed ones."""
    low = F.lower(c)
    return F.when(_has(low, K.PAGE_SOON_TERMS), "coming_soon").when(_has(low, K.PAGE_CLOSED_TERMS), "closed")


def page_title() -> F.Column:
    """HTML-06: the most specific heading, else the page title before a pipe."""
    best = F.array_max(F.transform(F.filter("headings", lambda h: h != ""), lambda h: F.struct(specificity(h).alias("s"), h.alias("h"))))
    return F.coalesce(best["h"], F.trim(F.regexp_extract("title", r"^([^|]*)", 1)))


def page_class() -> F.Column:
    """HTML-02."""
    low, path = F.lower("text"), F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*([^?#]*)", 1))
    titled = F.get(F.transform(F.array(page_title()), is_role_title), 0)  # bound once: the test names it again and again
    detail = _has(path, K.DETAIL_PATHS)
    return F.when(_has(path, ("/future-opportunities", "/talent-community", "/talentcommunity")), "future").when(detail & titled, "detail").when(F.size("blocks") >= 2, "listing").when(_count(low, K.GENERIC_PAGE_TERMS) >= 2, "editorial").otherwise("generic")


def description_text(n: int = 6) -> F.Column:
    """HTML-07."""
    return F.array_join(F.slice(F.filter("items", lambda x: (F.length(x) >= 20) & ~_has(F.lower(x), K.NEGATIVE_LINK_TERMS)), 1, n), " ")


def title_words(c) -> F.Column:
    """STR-08: the distinct words of a title, stop words and years aside."""
    return F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda w: (w != "") & ~w.isin(*K.STOPWORDS) & ~w.rlike("^20[0-9]{2}$"))


def token_overlap(a, b) -> F.Column:
    """STR-08: common words over the larger set."""
    x, y = title_words(a), title_words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def location_text(c) -> F.Column:
    """STR-12: the first known place named in the text."""
    label = lambda t: "New York, NY" if t in ("new york, ny", "nyc", "new york city", "new york") else "Chicago, IL" if t.startswith("chicago") else t.title()
    known = F.arrays_zip(_texts(K.LOCATION_TOKENS).alias("t"), _texts([label(t) for t in K.LOCATION_TOKENS]).alias("label"))
    return F.get(F.transform(F.array(F.lower(c)), lambda low: F.get(F.filter(known, lambda k: F.contains(low, k["t"])), 0)["label"]), 0)


def url_path(c) -> F.Column:
    """Lower-cased path of an absolute URL, else empty."""
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def url_host(c) -> F.Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _last_segment(c) -> F.Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(url_path(c), "/"), lambda x: x != ""), F.lit(-1)), F.lit(""))


def is_generic_url(c) -> F.Column:
    """A bare domain, or a path that ends in a section of a site."""
    last = _last_segment(c)
    return (last == "") | last.isin(*K.SECTION_SEGMENTS)


def is_detail_url(c) -> F.Column:
    """A path of postings, or a last segment with a word of a role that is no section."""
    last = _last_segment(c)
    return _has(F.lower(c), K.DETAIL_PATHS) | (~last.isin(*K.SECTION_SEGMENTS) & _has(last, K.DETAIL_WORDS))


def role_specific(c, hint, careers_url, website) -> F.Column:
    """URL-10: a link that may stand for one role: not generic, nor the firm's
    careers page (unless that looks like a posting) or home page. What is
    coming soon or closed may point anywhere; an empty link never passes."""
    bare = lambda u: F.lower(F.regexp_replace(F.coalesce(u, F.lit("")), "/+$", ""))
    careers = (bare(careers_url) != "") & (bare(c) == bare(careers_url)) & ~is_detail_url(c)
    home = (bare(website) != "") & (bare(c) == bare(website))
    waiting = F.coalesce(hint.isin("coming_soon", "closed"), F.lit(False))
    return (F.trim(F.coalesce(c, F.lit(""))) != "") & (waiting | (~is_generic_url(c) & ~careers & ~home))


def season_hint(c) -> F.Column:
    """STR-13: season and year; else the first year, if the text speaks of interns."""
    season = F.regexp_extract(c, r"(?i)(?:^|[^\w])((?:summer|winter|fall|spring)[ \t\r\n]+20[0-9]{2})(?:$|[^\w])", 1)
    year = F.regexp_extract(c, r"(?:^|[^\w])(20[0-9]{2})(?:$|[^\w])", 1)
    return F.when(season != "", F.regexp_replace(season, r"[ \t\r\n]+", " ")).when((year != "") & F.contains(F.lower(c), F.lit("intern")), year)


def is_marketing(c) -> F.Column:
    """STR-11, of titles."""
    low = F.lower(F.trim(c))
    starts = _begins(low, K.MARKETING_PREFIXES)
    return low.isin(*K.EXACT_GENERIC_TITLES) | starts | _has(low, K.GENERIC_PAGE_TERMS) | ((F.size(F.split(low, r"\s+")) >= 11) & ~_has(low, K.ROLE_TERMS))


def is_editorial(c) -> F.Column:
    """STR-11, of blocks."""
    low = F.lower(c)
    return ((_count(low, K.GENERIC_PAGE_TERMS) >= 2) & (_count(low, K.ROLE_TERMS) <= 1)) | _has(low, ("tech blog", "follow us"))


def site_segment(c) -> F.Column:
    """HTML-11: the path of postings on a known site; null on others."""
    out = F.lit(None).cast("string")
    for host, _, segment in reversed(K.SITES):
        out = F.when(F.contains(url_host(c), F.lit(host)), segment).otherwise(out)
    return out


def page_kind() -> F.Column:
    """HTML-15: on known sites the path says what a page is, elsewhere its class."""
    out = page_class()
    for host in sorted({s[0] for s in K.SITES}):
        out = F.when(F.contains(url_host("url"), F.lit(host)), "generic").otherwise(out)
    for host, listing, segment in reversed(K.SITES):
        here = F.contains(url_host("url"), F.lit(host))
        out = F.when(here & F.contains(url_path("url"), F.lit(listing)), "listing").when(here & F.contains(url_path("url"), F.lit(segment)), "detail").otherwise(out)
    return out


def role_link(links, preferred) -> F.Column:
    """HTML-04: the link with the best score, the first of equals; null if none will do."""

    def score(a):
        at_site = F.coalesce(F.contains(url_path(a["href"]), preferred), F.lit(False))
        marks = ((at_site, 5), (is_detail_url(a["href"]), 4), (is_role_title(a["text"]), 3), (_has(F.lower(a["text"]), K.APPLY_TERMS), -1))
        return sum((F.when(test, n).otherwise(0) for test, n in marks), F.lit(0))

    usable = F.filter(links, lambda a: (a["href"] != "") & ~_has(F.lower(a["href"]), K.NEGATIVE_LINK_TERMS))
    scored = F.transform(usable, lambda a, i: F.struct(score(a).alias("s"), (-i).alias("i"), a["href"].alias("href")))
    return F.array_max(F.filter(scored, lambda x: x["s"] >= 0))["href"]


def apply_link(links, page_url) -> F.Column:
    """HTML-05: the first link that speaks of applying and leads to one place
    for it: on another host, or under a path of applications."""

    def explicit(href):
        elsewhere = url_host(href) != url_host(page_url)
        return href.rlike("(?i)^https?://") & ~is_generic_url(href) & (elsewhere | _has(url_path(href), K.APPLY_PATHS))

    named = lambda a: _has(F.lower(F.concat_ws(" ", a["text"], a["href"])), K.APPLY_TERMS)
    return F.get(F.filter(links, lambda a: (a["href"] != "") & named(a) & explicit(a["href"])), 0)["href"]


def _words(text: str) -> set[str]:
    return {w for w in re.split("[^a-z0-9]+", text.lower()) if w and w not in K.STOPWORDS and not re.fullmatch("20[0-9]{2}", w)}


def match_cards(titles: list[str], links: list[str | None], anchors: list[dict]) -> list[str | None]:
    """HTML-10: cards without a link of their own take, in order, the first free
    anchor whose text holds the title, else the one that shares most of its
    words (0.45 of the larger set at least); an anchor serves once."""
    free = list({a["href"]: a["text"] for a in reversed(anchors)}.items())[::-1]  # of one link the first text
    out = []
    for title, link in zip(titles, links, strict=True):
        if link is None and title.strip():
            low, words = title.lower().strip(), _words(title)
            at = next((i for i, (_, text) in enumerate(free) if low in text.lower()), None)
            if at is None and words:
                shared = [len(words & other) if other and len(words & other) >= 0.45 * max(len(words), len(other)) else 0 for other in (_words(text) for _, text in free)]
                at = shared.index(max(shared)) if any(shared) else None
            link = None if at is None else free.pop(at)[0]
        out.append(link)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def paired(titles: pd.Series, links: pd.Series, anchors: pd.Series) -> pd.Series:
    """``match_cards`` of each page."""
    return pd.Series([match_cards(list(t), list(k), list(a)) for t, k, a in zip(titles, links, anchors, strict=True)], dtype=object)


def _listed(pages: DataFrame, key: str) -> DataFrame:
    """HTML-09/10: cards of listing pages, each with the link that is its own."""
    segment = site_segment("url")
    valid = lambda b: is_role_title(b["title"]) & ~is_marketing(b["title"]) & ~is_editorial(b["text"])
    card = lambda b: F.struct(b["title"].alias("title"), b["text"].alias("body"), role_link(b["links"], segment).alias("link"), apply_link(b["links"], F.col("url")).alias("apply_url"))
    cards = pages.where("kind = 'listing'").select(key, "url", "hint", "kind", "anchors", F.transform(F.filter("blocks", valid), card).alias("cards")).where("size(cards) > 0")
    path = lambda a: url_path(a["href"])
    detail = lambda a: F.coalesce(F.contains(path(a), segment), F.lit(False)) | is_detail_url(a["href"])
    own = F.filter("anchors", lambda a: detail(a) & (path(a) != "") & (path(a) != url_path("url")) & ~path(a).rlike("/apply/?$") & ~_has(path(a), K.NEGATIVE_LINK_TERMS))
    linked = cards.withColumn("links", paired("cards.title", "cards.link", own))
    rows = linked.select(key, "url", "hint", "kind", F.posexplode(F.arrays_zip("cards", "links")).alias("pos", "x"))
    found, card = F.col("x.links"), F.col("x.cards")
    return rows.select(key, card["title"].alias("title"), F.coalesce(found, "url").alias("link"), card["apply_url"].alias("apply_url"), card["body"].alias("body"), status_hint(card["body"]).alias("hint"), "kind", F.when(found.isNotNull(), 0.8).otherwise(0.72).alias("confidence"), F.lit(None).cast("string").alias("place"), F.lit("card").alias("origin"), "pos")


def candidates(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """HTML-08/09/14/15/16/18: role candidates of each page, one per folded title
    and link, in the order ``pos`` of the page, with a provenance payload. Listing pages give a candidate a card;
    detail pages their structured postings, or without any the page itself
    (known sites always the page); other pages none."""
    pages = facts.withColumns({"kind": page_kind(), "best": page_title(), "hint": status_hint("text"), "page_apply": apply_link(F.col("anchors"), F.col("url"))})
    pages = pages.withColumn("found", F.when(site_segment("url").isNull(), F.filter("postings", lambda p: is_role_title(p["title"]))).otherwise(F.filter("postings", lambda p: F.lit(False))))
    details = pages.where("kind = 'detail'")
    whole = details.where("size(found) = 0").select(key, F.col("best").alias("title"), F.col("url").alias("link"), F.col("page_apply").alias("apply_url"), description_text().alias("body"), "hint", "kind", F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("place"), F.lit("page").alias("origin"), F.lit(0).alias("pos"))
    structured = details.select(key, "text", "kind", "page_apply", F.posexplode("found").alias("pos", "p"))
    text = F.coalesce(F.nullif("p.body", F.lit("")), "text")
    structured = structured.select(key, "p.title", "p.link", F.col("page_apply").alias("apply_url"), text.alias("body"), status_hint(text).alias("hint"), "kind", F.lit(0.97).alias("confidence"), "p.place", F.lit("structured_data").alias("origin"), "pos")
    both = whole.unionByName(structured).unionByName(_listed(pages, key))
    kept = ("title", "apply_url", "body", "hint", "kind", "confidence", "place", "origin", "pos")
    first = both.groupBy(key, F.lower("title").alias("k"), "link").agg(F.min_by(F.struct(*kept), "pos").alias("c"))
    payload = F.to_json(F.struct(F.col("c.kind").alias("page_class"), F.col("c.confidence").alias("confidence"), F.col("link"), F.col("c.origin").alias("extracted_from"), F.coalesce("c.hint", F.lit("unknown")).alias("status_hint"), season_hint(F.col("c.body")).alias("season_hint")))
    return first.select(key, "c.title", "link", "c.apply_url", "c.body", "c.hint", "c.kind", "c.confidence", F.coalesce("c.place", location_text("c.body")).alias("location"), season_hint(F.col("c.body")).alias("season"), payload.alias("payload"), F.col("c.pos").cast("int").alias("pos"))


def verified(found: DataFrame, facts: DataFrame) -> DataFrame:
    """HTML-12, JOIN-17: candidates against the page their link leads to."""
    detail = facts.select(F.col("url").alias("d_url"), page_class().alias("d_kind"), page_title().alias("d_title"), description_text().alias("d_body"), status_hint("text").alias("d_hint"))
    out = found.join(detail, found["link"] == detail["d_url"], "left")
    agrees = token_overlap(F.col("title"), F.col("d_title")) >= 0.45
    return out.withColumn("check", F.when(F.col("d_url").isNull(), "unfetched").when(F.col("d_kind").isin("future", "editorial"), F.col("d_kind")).when(~agrees, "title_mismatch").otherwise("verified")).withColumn("body", F.when(F.col("check") == "verified", F.coalesce(F.nullif("d_body", F.lit("")), "body")).otherwise(F.col("body"))).withColumn("hint", F.coalesce("d_hint", "hint"))
