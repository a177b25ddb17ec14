"""Main text of web pages by template deduction over the pages of a host (after Arasu and Garcia-Molina, 2003).

Tags (with their class, id and role, a closing tag with those of its element) and text segments are tokens. Tokens of a host that
occur equally often on every page share an occurrence vector; such an equivalence class, found on most pages, is part of the
template. Four passes over the pages: occurrence vectors; the root class, tokens that occur once on every page, less those out of order
on some page; slots, the gaps between root tokens, with the other classes, kept when their tokens come in one order and all their instances
nest in one gap of the same class; the text. A host's slots are chosen by their text: articles and main elements, text outside links,
headings and the elements that the template shows around the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import stored
from gridtally.llm.urlfilter import host_and_path
from gridtally.session import ship_package

#: Share of a host's pages, and pages at least, on which a class must occur to be part of the template.
SHARE, PAGES = 0.5, 3
#: A slot with this share of the text of the host's largest slot holds main text; elements of a smaller share are not the article.
SLOT_SHARE, ELEMENT_SHARE = 0.1, 0.25

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|select)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html head body div section nav header footer aside form article main menu dialog ul ol dl table fieldset blockquote center".split())
DROPPED = frozenset("head nav header footer aside form menu dialog button".split())
#: Dropped outside of an article only.
EMBEDDED = frozenset("svg object".split())
#: Never dropped inside an article for their class, id or role.
KEPT = frozenset("h1 h2 h3 h4 h5 h6 hgroup math".split())
#: Words in a class, id or role that mark what is not part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar sidenav complementary contentinfo header masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter "
    "subscribe subscription signup login search toolbar pagination pager skip widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Tags that a worker remembers, and characters of a tag's attributes up to which it does.
KNOWN_TAGS, KNOWN_CHARS = 1 << 14, 300
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NONE: frozenset = frozenset()


def marks_of(attrs: str) -> frozenset:
    """The words of the class, id and role in an opening tag's attributes, and their whole values after a dot."""
    values = [a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)]
    return frozenset([w.lower() for v in values for w in _NAME.findall(v)] + ["." + w.lower() for v in values for w in v.split()]) if values else _NONE


_known_marks = lru_cache(KNOWN_TAGS)(marks_of)


def tokens(page: str | None) -> Iterator[tuple[str, str, frozenset]]:
    """('text', content, -), ('open' or 'close', tag name, words of its class, id and role, and their whole values after a dot) in page order."""
    page = page or ""
    at = 0
    for m in _TOKEN.finditer(page):
        start, end = m.span()
        if start > at:
            yield "text", page[at:start], _NONE
        at = end
        _, close, name, attrs, close2, name2, attrs2 = m.groups()
        if not name:
            close, name, attrs = close2, name2, attrs2
        if name:
            if close:
                yield "close", name.lower(), _NONE
            else:
                yield "open", name.lower(), (_known_marks if len(attrs) <= KNOWN_CHARS else marks_of)(attrs) if attrs else _NONE
    if at < len(page):
        yield "text", page[at:], _NONE


def paired(page: str | None) -> Iterator[tuple[str, str, frozenset]]:
    """``tokens``, where the closing tag of a container has the words of the element that it closes."""
    stack: list[tuple[str, frozenset]] = []
    for kind, value, marks in tokens(page):
        if kind == "open" and value in CONTAINERS:
            stack.append((value, marks))
        elif kind == "close" and value in CONTAINERS:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == value), None)
            if at is not None:
                marks = stack[at][1]
                del stack[at:]
        yield kind, value, marks


def flat(text: str) -> str:
    """A text segment with its references decoded and white space as one space."""
    return " ".join(html.unescape(text).split())


def hashed(kind: str, value: str, marks: frozenset) -> int:
    words = " ".join(sorted(m for m in marks if m[0] != ".")) if marks else ""
    return xxhash.xxh64_intdigest(f"{kind} {value} {words}".encode("utf-8", "surrogatepass")) >> 1


_known_hash = lru_cache(KNOWN_TAGS)(hashed)


def signature(kind: str, value: str, marks: frozenset) -> int | None:
    """Hash of a token for occurrence counts; None for blank text."""
    if kind == "text":
        value = flat(value)
        return hashed(kind, value, marks) if value else None
    chars = len(value) + sum(map(len, marks)) if marks else len(value)
    return (_known_hash if chars <= KNOWN_CHARS else hashed)(kind, value, marks)


def occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token: pages with it, occurrences, two sums that fingerprint its occurrence vector, and its place on the first page by uid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), 1000):
                some = pdf.iloc[start : start + 1000]
                found: dict[tuple[str, int], list[int]] = {}
                for host, uid, page in zip(some["host"], some["uid"], some["html"]):
                    mixes: dict[int, int] = {}
                    for at, (sig, n) in enumerate(Counter(s for t in paired(page) if (s := signature(*t)) is not None).items()):
                        mixed = mixes.get(n)
                        if mixed is None:
                            mixed = mixes[n] = xxhash.xxh64_intdigest(f"{uid} {n}")
                        row = found.setdefault((host, sig), [0, 0, 0, 0, uid, at])
                        row[0] += 1
                        row[1] += n
                        row[2] += mixed >> 34
                        row[3] += mixed & 0x3FFFFFFF
                        if uid < row[4]:
                            row[4:] = uid, at
                yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["host", "token", "pages", "n", "f1", "f2", "uid", "at"])

    return pages.mapInPandas(run, "host string, token long, pages long, n long, f1 long, f2 long, uid long, at long")


class Template:
    """The template of one host: slot n lies after the n-th root token, slot 0 before the first."""

    def __init__(self, root=None, nested=None, slots=None, trusted=True):
        self.root = {t: n + 1 for n, t in enumerate(root if root is not None else ())}
        parts = [list(c) for c in nested] if nested is not None else []
        self.part = {t: (c, n) for c, tokens_ in enumerate(parts) for n, t in enumerate(tokens_)}
        self.size = [len(c) for c in parts]
        self.fixed = frozenset([*self.root, *self.part])
        self.slots = frozenset(int(n) for n in slots) if slots is not None else None
        self.trusted = trusted is not False and trusted is not None


def per_page(pages: DataFrame, made: DataFrame, columns: list[str], step, schema: str) -> DataFrame:
    """``step(rows)`` over chunks of (Template, page row), the template kept while the pages of a host follow each other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, Template] = {}

        def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
            for row in pdf.itertuples(index=False):
                if row.host not in known:
                    if len(known) >= 500:
                        known.clear()
                    known[row.host] = Template(*(getattr(row, c) for c in columns))
                yield known[row.host], row

        for pdf in frames:
            for start in range(0, len(pdf), 1000):
                yield step(rows(pdf.iloc[start : start + 1000]))

    return pages.join(made.select("host", *columns), "host", "left").select(*pages.columns, *columns).mapInPandas(run, schema)


def misplaced(page: str | None, root: dict[int, int]) -> list[int]:
    """The root tokens to leave out for the others to stand in the template's order on a page."""
    found = [s for t in paired(page) if (s := signature(*t)) in root]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, s in enumerate(found):
        at = bisect_left(tails, root[s])
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [root[s]], [n]
    keep, n = set(), ends[-1] if ends else -1
    while n >= 0:
        keep.add(n)
        n = before[n]
    return [s for n, s in enumerate(found) if n not in keep]


def survey(page: str | None, made: Template) -> Iterator[tuple[str, int, int, tuple]]:
    """What a page says of its host's slots and classes.

    ('slot', n, 0, (characters, of these in links, articles, main elements, headings)), ('pair', a, b, -) for an element that opens with
    slot a and closes with slot b, ('bad', class, 0, -) for a class out of order or not nested, ('place', class, place, -) for where it nests.
    """
    slot, link, head = 0, 0, 0
    opened: list[tuple[str, int]] = []
    inside: list[list[int]] = []  # classes with an unfinished instance: [class, next token]
    for kind, value, marks, place in walk(page):
        if kind == "text":
            value = flat(value)
            sig = hashed(kind, value, marks) if value else None
        else:
            sig = signature(kind, value, marks)
        if sig in made.root:
            slot = made.root[sig]
            for c, _ in inside:
                yield "bad", c, 0, ()
            inside.clear()
        elif sig in made.part:
            c, n = made.part[sig]
            at = next((i for i in range(len(inside) - 1, -1, -1) if inside[i][0] == c), None)
            if at is None:
                top = inside[-1] if inside else (-1, 0)
                yield "place", c, (slot << 32) + ((top[0] + 1) << 12) + top[1], ()
                inside.append([c, 0])
                at = len(inside) - 1
            for other, _ in inside[at + 1 :]:
                yield "bad", other, 0, ()
            del inside[at + 1 :]
            if inside[at][1] != n:
                yield "bad", c, 0, ()
            inside[at][1] = n + 1
            if n + 1 >= made.size[c]:
                del inside[at]
        if kind == "text":
            if place != "drop" and (n := len(value)):
                yield "slot", slot, 0, (n, n * (link > 0), n * (place == "article"), n * (place == "main"), n * (head > 0 and sig not in made.fixed))
        elif value == "a":
            link = 1 if kind == "open" else 0
        elif value in _HEADINGS:
            head = 1 if kind == "open" else 0
        elif value in CONTAINERS and value not in ("html", "body", "head"):
            if kind == "open":
                opened.append((value, made.root.get(sig, 0)))
            else:
                at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == value), None)
                if at is not None:
                    if opened[at][1] and sig in made.root:
                        yield "pair", opened[at][1], slot, ()
                    del opened[at:]
    for c, _ in inside:
        yield "bad", c, 0, ()


def surveyed(rows: Iterator[tuple]) -> pd.DataFrame:
    found: dict[tuple, list[int]] = {}
    for made, row in rows:
        if made.root or made.part:
            for kind, a, b, sums in survey(row.html, made):
                own = found.setdefault((row.host, kind, a, b), [0] * 6)
                own[0] += 1
                for n, v in enumerate(sums, 1):
                    own[n] += v
    return pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["host", "kind", "a", "b", "n", "chars", "links", "article", "main", "head"])


def choose(facts: list, pages: int) -> tuple[list[int], bool]:
    """The slots to extract, and whether articles and main elements hold the text of the host."""
    slots = {f["a"]: f for f in facts if f["kind"] == "slot"}
    pairs = sorted(((f["a"], f["b"]) for f in facts if f["kind"] == "pair" and f["n"] == pages), key=lambda p: p[1] - p[0])
    words = {n: f["chars"] - f["links"] for n, f in slots.items()}
    element = "article" if any(f["article"] for f in slots.values()) else "main"
    held = sum(f[element] for f in slots.values())
    if held and held >= ELEMENT_SHARE * max(words[n] - f["article"] - f["main"] for n, f in slots.items()):
        return [n for n, f in slots.items() if 2 * f[element] > f["chars"]], True
    chosen = {n for n, f in slots.items() if f["head"] and 2 * f["links"] <= f["chars"]}
    for n, f in slots.items():
        if words[n] and words[n] >= SLOT_SHARE * max(words.values()) and 2 * f["links"] <= f["chars"]:
            around = next((p for p in pairs if p[0] <= n < p[1]), None)
            if around:
                chosen.update(range(*around))
            else:
                chosen.update(m for m, g in slots.items() if 2 * g["links"] <= g["chars"] and not any(p[0] <= m < p[1] for p in pairs))
    return sorted(chosen), not held


def templates(pages: DataFrame) -> DataFrame:
    """Per host: the ordered root class, the ordered classes nested in it, the slots to extract, and whether elements hold the text.

    A class is valid when it has at least two tokens, or occurs once on every page, lies on enough of the host's pages, and its
    tokens stand in one order on all of them. A root token out of order leaves the root class; another class is valid or not as a whole.
    """
    seen = stored(occurrences(pages).groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "f1", "f2")], F.min(F.struct("uid", "at")).alias("first")).where(F.col("pages") >= PAGES), "occurrences")
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= PAGES)
    often = seen.join(hosts, "host").where(F.col("pages") >= SHARE * F.col("all"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("first.at").alias("at"), "token")))
    classes = often.groupBy("host", "f1", "f2", "pages", "n", "all").agg(F.transform(ordered, lambda t: t["token"]).alias("tokens"))
    root = (F.col("pages") == F.col("all")) & (F.col("n") == F.col("all"))
    made = classes.where(root | (F.size("tokens") > 1)).groupBy("host").agg(
        F.first("all").alias("all"), F.flatten(F.collect_list(F.when(root, F.col("tokens")))).alias("root"), F.collect_list(F.when(~root, F.col("tokens"))).alias("nested")
    )
    made = stored(made, "classes")

    def out_of_order(rows: Iterator[tuple]) -> pd.DataFrame:
        return pd.DataFrame(list({(row.host, t) for t_, row in rows for t in misplaced(row.html, t_.root)}), columns=["host", "token"])

    lost = per_page(pages, made, ["root"], out_of_order, "host string, token long").groupBy("host").agg(F.collect_set("token").alias("lost"))
    made = stored(made.join(lost, "host", "left").withColumn("root", F.array_except("root", F.coalesce("lost", F.array().cast("array<bigint>")))).drop("lost"), "roots")
    sums = ("n", "chars", "links", "article", "main", "head")
    facts = per_page(pages, made, ["root", "nested"], surveyed, "host string, kind string, a long, b long, " + ", ".join(f"{c} long" for c in sums))
    facts = facts.groupBy("host", "kind", "a", "b").agg(*[F.sum(c).alias(c) for c in sums]).groupBy("host").agg(F.collect_list(F.struct("kind", "a", "b", *sums)).alias("facts"))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for host, pages_, own, nested, found in zip(pdf["host"], pdf["all"], pdf["root"], pdf["nested"], pdf["facts"]):
                places = Counter(f["a"] for f in found if f["kind"] == "place")
                bad = {f["a"] for f in found if f["kind"] == "bad"} | {c for c, n in places.items() if n > 1}
                slots, trusted = choose(found, pages_) if any(f["kind"] == "slot" for f in found) else ([], True)
                out.append((host, list(own), [list(c) for n, c in enumerate(nested) if n not in bad], slots, trusted))
            yield pd.DataFrame(out, columns=["host", "root", "nested", "slots", "trusted"])

    return made.join(facts, "host").mapInPandas(decide, "host string, root array<bigint>, nested array<array<bigint>>, slots array<bigint>, trusted boolean")


def unwanted(name: str, marks: frozenset, in_article: bool) -> bool:
    """Whether an element holds something else than the article's text."""
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return bool(marks & COMMENTS)
    if in_article:
        whole = frozenset(m[1:] for m in marks if m[0] == ".")
        if name == "header":
            return bool(whole & (MARKS - {"header"}))
        return name not in KEPT and (name in DROPPED or bool(whole & MARKS))
    return name in DROPPED or name in EMBEDDED or bool(marks & MARKS)


def walk(page: str | None) -> Iterator[tuple[str, str, frozenset, str]]:
    """``paired`` tokens with the place of a text: 'article', 'main', 'drop' in an unwanted element, or ''."""
    stack: list[tuple[str, str]] = []  # container name; '', 'main', 'article', 'drop' or 'comments'
    roles: set[str] = set()
    inside = ""
    for kind, value, marks in paired(page):
        if kind == "text":
            yield kind, value, marks, inside
            continue
        yield kind, value, marks, ""
        if kind == "close":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == value), None)
            if at is None:
                continue
            del stack[at:]
        else:
            held = len(stack)
            if value == "body":
                stack = [s for s in stack if s[0] == "html"]
            if value in ("article", "main") and "comments" not in roles:
                # an element that was left open before the article ends where the article begins
                first = next((i for i, s in enumerate(stack) if s[1] == "drop"), len(stack))
                del stack[first:]
            if unwanted(value, marks, "article" in roles) and (value in CONTAINERS or value == "button" or value in EMBEDDED or marks):
                role = "comments" if marks & COMMENTS else "drop"
            else:
                role = "article" if value == "article" else "main" if value == "main" or "main" in marks and value in CONTAINERS else ""
            if value in CONTAINERS or (role in ("drop", "comments") and value not in _VOID):
                stack.append((value, role))
            elif len(stack) == held:
                continue
        roles = {r for _, r in stack}
        inside = "drop" if "drop" in roles or "comments" in roles else "article" if "article" in roles else "main" if "main" in roles else ""


def main_text(page: str | None, fixed: frozenset, made: Template | None = None) -> str:
    """The text of the article; ``fixed`` are the signatures of the host's template, ``made`` its slots.

    Where elements hold the host's text, a page's article or main element bounds it, and the chosen slots serve the pages that have
    none; else the chosen slots alone. A page with no text there gives what lies outside of unwanted elements.
    """
    made = made or Template()
    out: dict[str, list[str]] = {"article": [], "main": [], "slots": [], "": []}
    ends = dict.fromkeys(out, 0)
    slot = block = 0

    def put(where: str, text: str) -> None:
        if ends[where] != block:
            ends[where] = block
            out[where].append(" ")
        out[where].append(text)

    for kind, value, marks, place in walk(page):
        sig = signature(kind, value, marks) if made.root or kind == "text" and place == "" else None
        slot = made.root.get(sig, slot)
        if kind != "text":
            if value not in INLINE:
                block += 1
            continue
        if place == "drop":
            continue
        text = html.unescape(value)
        if place:
            put("main", text)
        if place == "article":
            put("article", text)
        if sig not in fixed:
            if made.slots is not None and slot in made.slots:
                put("slots", text)
            if not place:
                put("", text)
    order = ("article", "main", "slots", "") if made.trusted else ("slots", "article", "main", "")
    return next((found for k in order if (found := " ".join("".join(out[k]).split()))), "")


_VOID = frozenset("area base br col embed hr img input link meta source track wbr p li dt dd tr td th option".split())


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html is an empty page; a page without text gives an empty string. Null URLs form one host. Hosts of few pages have no
    template and are extracted by their elements alone. Repeated rows and null ids stay as they are.
    """
    ship_package(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    src = src.withColumn("uid", F.xxhash64("page_id", "url"))
    made = stored(templates(src), "templates")

    def texts(rows: Iterator[tuple]) -> pd.DataFrame:
        got = [(row.page_id, row.url, main_text(row.html, made_.fixed, made_)) for made_, row in rows]
        out = pd.DataFrame([(i, u, t, len(t)) for i, u, t in got], columns=["page_id", "url", "text", "n_chars"])
        return out.astype({"page_id": "Int64"})

    return per_page(src, made, ["root", "nested", "slots", "trusted"], texts, "page_id long, url string, text string, n_chars long")
