"""HTML extraction by wrappers inferred from the pages of one host (union-free regular expressions).

A page is a stream of tokens: tags (with class, id and role) and texts.  A wrapper is a sequence of tags that every
page of the host has exactly once and in one order, with a slot between each two.  Pages are aligned one after the
other: tags that both sides share stay, and a mismatch is resolved inside the slot it falls into, which becomes
  * a text slot, if only texts differ (a text that never differs is kept as a constant),
  * a repeated group (u)+, if every page holds a whole number of copies of one unit u there,
  * an optional group, if some page has nothing there,
  * and otherwise a repeated group of optional tokens (a? b? ...)+, which is the loosest union-free expression.
Aligning two wrappers is the same operation as aligning a wrapper and a page and does not depend on order, so each
task folds the pages it reads into one wrapper a host, and one small merge per host follows; every page takes part,
and a host with a third of all pages is nowhere collected.

Extraction matches a page against its host's wrapper: the tags of the wrapper's main element (article, main and the
like, whatever their ids) frame the slots that hold content, starting no later than the page's own first main element, and groups of boilerplate in them (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles) are skipped.  Where a host has no single main element, all of its main
elements count, or, without any, all of the body, less boilerplate.

A slot's first and last tokens that are the same on all pages, tags and texts, are the host's own once MIN_PAGES different
pages agree (copies of a page have one vote together): blocks of such texts alone are dropped, in main elements as
elsewhere.  Element names break ties: titles (h1) stay, and in main elements labels (LABELS) do.  A page of which less than
a quarter would stay is taken for a near copy of the others and keeps its constants; so do pages without a host, which
share no site.  Constants between varying parts of one slot, or on some pages only, are not told from content.

Blocks end at block-level tags and at <br>; character references are decoded once; white space in a block becomes one
space; empty blocks are dropped; blocks are joined by one line feed.  Edge cases: null html is an empty page with an
empty text; a page cut off in the middle counts as far as it goes; a page without tags is one block; a null or odd url
has the empty host; repeated pages are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrowio import slices, tidy
from .shared import stored

MARK_WORDS = 3  # of one class or id that may mark boilerplate, such as cookie-consent-banner
MERGED = 64  # partial wrappers of one host that a task merges
MIN_PAGES = 3  # different pages that must agree before a text is taken for the host's own
# Element names by their role, and the words that mark boilerplate or content in class, id and role.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER = set("nav header footer aside form menu button dialog head".split())
MAIN = set("article main".split())
LABELS = set("h1 h2 h3 h4 h5 h6 th dt caption figcaption legend summary".split())
BOILER_WORDS = set("nav navbar navigation menu header footer sidebar aside ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal newsletter subscribe signup comment comments reply replies disqus share sharing social related breadcrumb breadcrumbs pagination pager login search toolbar widget copyright".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN_WORDS = set("article content main post entry story".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b(?P<attrs>[^>]*)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)|<[/!?a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?a-zA-Z][^<>]*(?:>|\Z|(?=<))|[^<]+|<", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def role(key: str) -> str:
    """"boiler", "main" or "" for an opening tag's key.  A class or id of more than MARK_WORDS words is a title, say, and
    marks no boilerplate."""
    name, *marks = key.split(" ")
    if name in BOILER:
        return "boiler"
    words: set[str] = set()
    boiler = False
    for mark in re.split(r" (?=class=|id=|role=)", key)[1:]:
        kind, _, value = mark.partition("=")
        if kind == "role" and value in BOILER_ROLES:
            return "boiler"
        for one in value.split():
            parts = [x for x in re.split(r"[^a-z0-9]+", one) if x]
            words.update(parts)
            boiler = boiler or len(parts) <= MARK_WORDS and not BOILER_WORDS.isdisjoint(parts)
    if boiler and name not in ("body", "html", "article", "main"):
        return "boiler"
    return "main" if name in MAIN or name in ("div", "section", "td") and words & MAIN_WORDS else ""


@lru_cache(1 << 16)
def named(key: str) -> str:
    """A main element goes by its name and the words that mark it: its id and other classes may differ on every page."""
    if " " not in key or role(key) != "main":
        return key
    name, _, marks = key.partition(" ")
    words = sorted(MAIN_WORDS & set(re.split(r"[^a-z0-9]+", marks)))
    return name if name in MAIN else f"{name} class={' '.join(words)}"


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text): key is "" for a text, "name attributes" for an opening and "/name" for a closing tag."""
    out: list[tuple[str, str]] = []
    for m in TOKEN.finditer(page):
        x = m[0]
        if m["raw"] or x.startswith(("<!", "<?")):
            continue
        name = NAME.match(x) if x[0] == "<" and len(x) > 1 else None
        if name is None:
            if out and out[-1][0] == "":
                out[-1] = ("", out[-1][1] + x)
            else:
                out.append(("", x))
        elif x[1] == "/":
            out.append(("/" + name[1].lower(), ""))
        else:
            marks = "".join(f" {a.lower()}={(b or c or d).strip().lower()}" for a, b, c, d in ATTRIBUTE.findall(x)) if "=" in x else ""
            out.append((named(name[1].lower() + marks), ""))
    return [t for t in out if t[0] or t[1].strip()]


# -- inference.  A wrapper: {"pages": n, "votes": [digest], "tags": [key], "slots": [slot]}, one slot more than tags; votes are
# the MIN_PAGES smallest digests of different pages, so that copies count once in whatever tasks they are read.
# A slot: {"keys": sorted token keys in it, "unit": the repeated unit or None, "gone": empty in some page, "text": a constant text or
# None, "exact": the keys in order if all pages have the same, "head", "tail": at most EDGE first and last tokens that all pages
# share, texts by digest, "whole": head is all of the slot on every page (and tail is not kept)}
EDGE = 64


def unit_of(keys: list[str]) -> list[str] | None:
    """The shortest unit that `keys` is whole copies of; one longer than EDGE is not kept (only expression() shows it)."""
    return next((keys[:n] for n in range(1, min(EDGE, len(keys)) + 1) if len(keys) % n == 0 and keys[n:] == keys[: len(keys) - n]), None)


def marks(part: list[tuple[str, str]]) -> list[str]:
    return [k or "=" + hashlib.blake2b(" ".join(t.split()).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for k, t in part]


def edges(parts: list[dict]) -> dict:
    """What slots in a row have at their ends."""
    whole = all(p["whole"] for p in parts) and sum(len(p["head"]) for p in parts) <= EDGE
    head, tail = [], []
    for p in parts:
        head += p["head"]
        if not p["whole"]:
            break
    for p in () if whole else reversed(parts):
        tail = (p["head"] if p["whole"] else p["tail"]) + tail
        if not p["whole"]:
            break
    return {"head": head[:EDGE], "tail": tail[-EDGE:], "whole": whole}


def shared_edges(a: dict, b: dict) -> dict:
    same = lambda x, y: next((n for n, (v, w) in enumerate(zip(x, y, strict=False)) if v != w), min(len(x), len(y)))
    if a["whole"] and b["whole"] and a["head"] == b["head"]:
        return {"head": a["head"], "tail": [], "whole": True}
    tails = [x["head"] if x["whole"] else x["tail"] for x in (a, b)]
    n = same(tails[0][::-1], tails[1][::-1])
    return {"head": a["head"][: same(a["head"], b["head"])], "tail": tails[0][len(tails[0]) - n :], "whole": False}


def slot(part: list[tuple[str, str]]) -> dict:
    keys = [k for k, _ in part]
    ends = marks(part) if len(part) <= EDGE else None
    ends = {"head": ends, "tail": [], "whole": True} if ends is not None else {"head": marks(part[:EDGE]), "tail": marks(part[-EDGE:]), "whole": False}
    texts = [t for k, t in part if not k]
    return {"keys": sorted(set(keys)), "unit": unit_of(keys), "gone": not part, "text": " ".join(texts[0].split()) if len(texts) == 1 else None, "exact": keys if len(keys) <= EDGE else None} | ends


def joined(parts: list[dict]) -> dict:
    """One slot for several slots and tags in a row."""
    full = [p for p in parts if p["keys"]]
    if len(full) == 1:
        return full[0] | {"gone": all(p["gone"] for p in parts)}
    exact = None if any(p["exact"] is None for p in parts) else [k for p in parts for k in p["exact"]][: EDGE + 1]
    exact = exact if exact is not None and len(exact) <= EDGE else None
    return {"keys": sorted({k for p in full for k in p["keys"]}), "unit": unit_of(exact) if exact else None, "gone": all(p["gone"] for p in parts), "text": None, "exact": exact} | edges(parts)


def either(a: dict, b: dict) -> dict:
    """The slot that holds what a holds and what b holds."""
    unit = a["unit"] if a["unit"] == b["unit"] else a["unit"] if not b["keys"] else b["unit"] if not a["keys"] else None
    return {"keys": sorted({*a["keys"], *b["keys"]}), "unit": unit, "gone": a["gone"] or b["gone"], "text": a["text"] if a["text"] == b["text"] else None, "exact": a["exact"] if a["exact"] == b["exact"] else None} | shared_edges(a, b)


def from_page(stream: list[tuple[str, str]]) -> dict:
    counts = Counter(k for k, _ in stream)
    at = [i for i, (k, _) in enumerate(stream) if k and counts[k] == 1]
    bounds = [-1, *at, len(stream)]
    vote = hashlib.blake2b("\0".join(f"{k}\1{' '.join(t.split())}" for k, t in stream).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return {"pages": 1, "votes": [vote], "tags": [stream[i][0] for i in at], "slots": [slot(stream[a + 1 : b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}


def ascending(order: list[int]) -> list[int]:
    """Positions of a longest ascending subsequence."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(order)
    for i, x in enumerate(order):
        n = bisect_left(tops, x)
        tops[n:n + 1] = [x]
        last[n:n + 1] = [i]
        before[i] = last[n - 1] if n else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def reduced(w: dict, keep: set[str]) -> dict:
    """The same wrapper with fewer tags: the others move into the slots."""
    tags, slots, run = [], [], [w["slots"][0]]
    for tag, after in zip(w["tags"], w["slots"][1:], strict=True):
        if tag in keep:
            tags.append(tag)
            slots.append(joined(run))
            run = [after]
        else:
            run += [{"keys": [tag], "unit": [tag], "gone": False, "text": None, "exact": [tag], "head": [tag], "tail": [], "whole": True}, after]
    return {"pages": w["pages"], "votes": w["votes"], "tags": tags, "slots": [*slots, joined(run)]}


def align(a: dict, b: dict) -> dict:
    """The wrapper of all pages behind a and b."""
    place = {k: i for i, k in enumerate(b["tags"])}
    loose = {k for w in (a, b) for s in w["slots"] for k in s["keys"]}
    shared = [k for k in a["tags"] if k in place and k not in loose]
    keep = {shared[i] for i in ascending([place[k] for k in shared])}
    # a tag that is dropped turns up in a slot, so it can be no tag of the result; kept ones are unaffected
    a, b = reduced(a, keep), reduced(b, keep)
    return {"pages": a["pages"] + b["pages"], "votes": sorted({*a["votes"], *b["votes"]})[:MIN_PAGES], "tags": a["tags"], "slots": [either(x, y) for x, y in zip(a["slots"], b["slots"], strict=True)]}


def expression(w: dict) -> str:
    """The wrapper as text, for people."""
    out = []
    for i, s in enumerate(w["slots"]):
        show = lambda keys: " ".join(f"<{k}>" if k else "#TEXT" for k in keys)
        if s["keys"]:
            body = repr(s["text"]) if s["keys"] == [""] and s["text"] is not None else show([""]) if s["keys"] == [""] else f"({show(s['unit'])})+" if s["unit"] else "(" + " ".join(f"{show([k])}?" for k in s["keys"]) + ")+"
            out.append(f"({body})?" if s["gone"] else body)
        if i < len(w["tags"]):
            out.append(f"<{w['tags'][i]}>")
    return " ".join(out)


# -- extraction
class Reader:
    """Extracts pages of one host."""

    def __init__(self, wrapper: dict):
        self.wrapper = wrapper
        self.roles: dict[str, str] = {}
        keys = {*wrapper["tags"], *(k for s in wrapper["slots"] for k in s["keys"])}
        self.bounded = any(k and k[0] != "/" and self.role(k) == "main" for k in keys)
        # The wrapper's main element, if each page has one: its tags frame the slots that are read.
        tags = wrapper["tags"]
        self.first = next((k for k in tags if k[0] != "/" and self.role(k) == "main"), None)
        end = "/" + self.first.partition(" ")[0] if self.first else None
        self.last = end if self.first and end in tags[tags.index(self.first) :] else None
        # Slots with texts of the host's own: (slot, tokens at its start, tokens at its end).
        texts = lambda x: any(k[0] == "=" for k in x)
        ends = [(i, s["head"], s["tail"]) for i, s in enumerate(wrapper["slots"])] if len(wrapper["votes"]) >= MIN_PAGES else []
        self.fixed = [(i, len(head) if texts(head) else 0, len(tail) if texts(tail) else 0) for i, head, tail in ends if texts(head) or texts(tail)]

    def role(self, key: str) -> str:
        if key not in self.roles:
            self.roles[key] = role(key)
        return self.roles[key]

    def constant(self, stream: list[tuple[str, str]]) -> set[int]:
        """Where a page has the host's own texts: the page is matched against the wrapper, tag by tag."""
        if not self.fixed:
            return set()
        place = {k: i for i, (k, _) in enumerate(stream)}
        bounds = [-1, *(place[k] for k in self.wrapper["tags"]), len(stream)]
        out: set[int] = set()
        for i, head, tail in self.fixed:
            out.update(range(bounds[i] + 1, bounds[i] + 1 + head))
            out.update(range(bounds[i + 1] - tail, bounds[i + 1]))
        return out

    def framed(self, stream: list[tuple[str, str]]) -> tuple[int, int]:
        """The slots of the wrapper's main element, with its tags; the whole stream where the wrapper has none.  A main
        element of the page that opens earlier (an article around it, say) takes its place, or one outside of boilerplate."""
        keys = [k for k, _ in stream]
        if self.first not in keys:
            return 0, len(stream)
        start, last = keys.index(self.first), self.last
        own = next(self.mains(keys), start)
        if own < start or self.first.partition(" ")[0] not in MAIN:  # article and main count even in boilerplate, such as a form
            start = own
        if keys[start] != self.first:
            last = "/" + keys[start].partition(" ")[0]
            last = last if keys.count(last) == 1 else None
        return start, keys.index(last, start) + 1 if last and last in keys[start:] else len(stream)

    def mains(self, keys: list[str]) -> Iterator[int]:
        """Where main elements open outside of boilerplate."""
        around: list[tuple[str, bool]] = []  # open boilerplate elements, and elements of the same name inside one
        for i, key in enumerate(keys):
            name = key[1:] if key[:1] == "/" else key.partition(" ")[0]
            if key[:1] == "/":
                at = next((n for n in range(len(around) - 1, -1, -1) if around[n][0] == name), None)
                if at is not None:
                    del around[at:]
            elif key and name not in VOID:
                what = self.role(key)
                if what == "main" and not any(boiler for _, boiler in around):
                    yield i
                if what == "boiler" or any(n == name for n, _ in around):
                    around.append((name, what == "boiler"))

    def text(self, page: str) -> str:
        stream = tokens(page)
        low, high = self.framed(stream)
        fixed = {i - low for i in self.constant(stream) if low <= i < high}
        stream = stream[low:high]
        whole = self.read(stream, set())
        less = self.read(stream, fixed) if fixed else whole
        return less if 4 * len(less) >= len(whole) else whole

    def read(self, stream: list[tuple[str, str]], fixed: set[int]) -> str:
        blocks, run = [], []
        element = ""  # the block-level element that was opened last
        opened: list[tuple[str, str]] = []  # elements with a role, or of the same name inside one: (name, role)
        own = False  # a text of the run is the page's own
        bounded = self.bounded and any(k and k[0] != "/" and self.role(k) == "main" for k, _ in stream)

        def close() -> None:
            nonlocal own
            block = " ".join(entities.unescape("".join(run)).split())
            if block and (own or element == "h1" or bounded and element in LABELS):
                blocks.append(block)
            run.clear()
            own = False

        inside, outside = 0, 0  # open main elements, open boilerplate elements
        for i, (key, text) in enumerate(stream):
            if not key:
                if not outside and (inside or not bounded):
                    run.append(text)
                    own = own or i not in fixed
                continue
            closing = key[0] == "/"
            name = key[1:] if closing else key.partition(" ")[0]
            if name in BLOCKS:
                close()
                element = "" if closing else name
            if closing:
                at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == name), None)
                # an unclosed boilerplate element ends with the element around it
                if at is not None:
                    del opened[at:]
                    inside = sum(r == "main" for _, r in opened)
                    outside = sum(r == "boiler" for _, r in opened)
            elif name not in VOID:
                what = self.role(key)
                if what == "boiler" or what == "main" and not outside:
                    opened.append((name, what))
                    inside, outside = inside + (what == "main"), outside + (what == "boiler")
                elif any(n == name for n, _ in opened):
                    opened.append((name, ""))
        close()
        return "\n".join(blocks)


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from (host, html)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    new = from_page(tokens(page))
                    known[host] = align(known[host], new) if host in known else new
            if len(known) > 50_000:
                yield batch_of(known)
                known = {}
        if known:
            yield batch_of(known)

    def batch_of(known: dict[str, dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(known, pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], ["host", "wrapper"])

    def merge(table: pa.Table) -> pa.Table:
        out = None
        for x in sorted(table.column("wrapper").to_pylist()):
            out = align(out, json.loads(x)) if out else json.loads(x)
        if not table.column("host")[0].as_py():
            out["votes"] = []  # no site: nothing is its own text
        return pa.table({"host": table.column("host")[:1], "wrapper": pa.array([json.dumps(out)])})

    parts = stored(pages.select("host", "html").mapInArrow(tidy(fold), "host string, wrapper string"), "wrapper-parts")
    # a tree of merges: no task takes more than MERGED wrappers or so of one host, which may be on as many as there are tasks
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > MERGED:
        groups = -(-most // MERGED)
        parts = stored(parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(groups)).alias("part")).applyInArrow(merge, "host string, wrapper string"), "wrapper-parts")
        most = groups
    return parts.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text."""
    rows = hosted(pages, id_col, url_col, html_col)
    wrappers = stored(infer(rows), "wrappers")  # one row a host; the join broadcasts it only while it is small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for page, wrapper in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                    if wrapper not in readers:
                        if len(readers) > 1000:
                            readers.clear()
                        readers[wrapper] = Reader(json.loads(wrapper))
                    out.append(readers[wrapper].text(page))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.join(wrappers, "host").select("page_id", "url", "html", "wrapper").mapInArrow(tidy(run), f"page_id {kind}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
