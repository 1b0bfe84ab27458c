"""Main text of web pages by equivalence-class template deduction.

Every page becomes a sequence of marks: element openings, closings and text blocks, each
named by its path of elements with class and id; containers of one path beside each other
differ in role by their place (``#2``, ``#3`` ...).  Over all pages of a host a mark's
occurrence vector (its count on each page) is summed into a 64-bit fingerprint, which any
number of partial sums add up to; marks of one host with equal fingerprints and the same
number of pages form an equivalence class.  The class of the marks found once on every page
is the template's trunk; of its elements those count that have both their ends in it.  A text
belongs to the template if it is once on each of its pages and both ends of its element are
in its own class, the trunk or any other (so notices shown on some pages count too).
The trunk must be ordered: each page keeps the sequence of the elements it has once, and
marks that stand in another order on any page of the host leave the class.
A block is page furniture when an element around it says so (navigation, footers, asides,
forms, adverts, notices, comments ...).  The main slot is the deepest container of the trunk
that holds three fifths of the free text of all pages of the host, template texts not counted.
A page's text is that of its main slot without template texts; where a page has an article
or main element, an exact check follows: that element is the main text, whole.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import prepare, written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACES = re.compile(r"\s+")
#: Element kinds of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE_TAGS = frozenset("nav header footer aside form script style noscript template iframe object svg canvas select button textarea head title menu dialog math audio video input".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies respond share sharing social related recommended recommendations pagination pager toolbar tags copyright legal disclaimer skip".split())
CONTAINERS = frozenset("html body div section center table tbody tr td fieldset dl ul ol".split())
MAIN_TAGS = frozenset(("article", "main"))
_SUFFIX = re.compile(r"\[(?:class|id|role)=[^\]]*\]")
_WORDS = re.compile(r"[a-z0-9]+")
_CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}


def _names(attributes: str) -> tuple[str, frozenset, bool]:
    """(path suffix, words of class, id and role, hidden) of an element's attributes."""
    if not attributes:
        return "", frozenset(), False
    found, hidden = {}, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
        hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true"
        found.setdefault(key, value.lower())
    suffix = "".join(f"[{k}={found[k]}]" for k in ("class", "id", "role") if k in found)
    return suffix, frozenset(_WORDS.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")))), hidden


#: bytes of a path beyond which its front is replaced by a hash
LONG_PATH = 600


class Page:
    """Blocks of a page: (text, path, is furniture, explicit main element or 0, elements around it)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool, int, tuple]] = []
        self.marks: list[str] = []
        #: open elements: tag, path, furniture, main number, own number
        stack: list[tuple[str, str, bool, int, int]] = []
        self.mains = 0
        count = 0
        #: containers so far by number of the element around and path
        beside: dict[tuple[int, str], int] = {}
        run: list[str] = []

        def close_block():
            if run:
                text = _SPACES.sub(" ", html.unescape("".join(run))).strip()
                run.clear()
                if text:
                    top = block_parent()
                    self.blocks.append((text, top[1], any(s[2] for s in stack[-1:]), stack[-1][3] if stack else 0, tuple((s[4], s[1]) for s in stack if s[0] not in INLINE)))
                    self.marks.append(_text_mark(top[1], text))

        def block_parent():
            for s in reversed(stack):
                if s[0] not in INLINE:
                    return s
            return ("", "", False, 0, 0)

        def pop_to(depth: int):
            while len(stack) > depth:
                gone = stack[-1]
                if gone[0] not in INLINE:
                    close_block()
                    self.marks.append("/" + gone[1])
                stack.pop()

        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                run.append(source[at:])
                break
            if m.start() > at:
                run.append(source[at : m.start()])
            at = m.end() if m.end() > m.start() else m.start() + 1
            if m[1]:
                tag = m[1].lower()
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if depth >= 0:
                    # an inline end does not close blocks around it
                    if tag not in INLINE or all(s[0] in INLINE for s in stack[depth:]):
                        pop_to(depth)
                elif tag in ("p", "br"):
                    close_block()
                continue
            # an element whose quotes don't pair ends at the next >
            name, attributes = (m[2], m[3]) if m[2] else (m[4], m[5])
            if not name:
                continue
            tag = name.lower()
            if tag in ("br", "hr"):
                close_block()
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                if tag not in ("noscript", "template"):
                    at = end.end() if end else n
                    continue
            suffix, words, hidden = _names(attributes)
            if tag not in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in INLINE:
                        continue
                    if tag in _CLOSES.get(stack[i][0], ()):
                        pop_to(i)
                    break
                close_block()
            if tag in VOID or attributes.endswith("/") and tag not in INLINE | {"p", "div", "li"}:
                continue
            parent = stack[-1] if stack else ("", "", False, 0, 0)
            main = parent[3]
            if not main and (tag in MAIN_TAGS or "main" in words and tag in ("div", "section")) and not parent[2]:
                self.mains += 1
                main = self.mains
            furniture = parent[2] or hidden or tag in FURNITURE_TAGS and not (tag == "header" and main) or bool(words & FURNITURE_ROLES) or bool(words & FURNITURE_WORDS) and tag not in ("html", "body", "article", "main")
            count += 1
            path = f"{parent[1]}/{tag}{suffix}"
            if tag in CONTAINERS:
                place = beside[parent[4], path] = beside.get((parent[4], path), 0) + 1
                if place > 1:
                    path = f"{parent[1]}/{tag}#{place}{suffix}"
            if len(path) > LONG_PATH:  # deep nesting: the path so far goes on as its hash
                path = f"/~{_hash(path) & 0xFFFFFFFFFFFFFFFF:x}"
            stack.append((tag, path, furniture, main, count))
            if tag not in INLINE:
                self.marks.append(path)
        close_block()
        while stack:
            pop_to(len(stack) - 1)

    def slots(self) -> dict[str, int]:
        """Code points of free text under each element path and of each free text mark."""
        total: dict[str, int] = {}
        for text, own, furniture, _, around in self.blocks:
            if not furniture:
                for path in {p for _, p in around} | {_text_mark(own, text)}:
                    total[path] = total.get(path, 0) + len(text)
        return total


def host_of(url: str | None) -> str:
    """Host of an address in lower case; '' where there is none."""
    m = re.match(r"\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _text_mark(path: str, text: str) -> str:
    return f"={path}|{_hash(text) & 0xFFFFFFFFFFFFFFFF:x}"


def _marks(batches):
    """Partial occurrence vectors of a batch: one row for each host and mark.

    A mark's fingerprint is the sum over pages of hash(page, count); ``rank`` sums its first
    places; ``chars`` sums the free text under it; ``name`` is its hash (0 for texts).  Beside
    them, without mark, one row for each host and sequence of elements found once on a page.
    """
    for batch in batches:
        urls, sources = batch.column("url").to_pylist(), batch.column("html").to_pylist()
        sums: dict[tuple[str, str], list] = {}
        names: dict[str, int] = {}
        orders: dict[tuple[str, tuple], None] = {}
        for no, url, source in zip(batch.column("no").to_pylist(), urls, sources):
            page = Page(source or "")
            host = host_of(url)
            slots = page.slots()
            places: dict[str, list[int]] = {}
            for i, mark in enumerate(page.marks):
                places.setdefault(mark, []).append(i)
            once = [m for m, at in places.items() if len(at) == 1 and m[0] != "="]
            for mark in once:
                if mark not in names:
                    names[mark] = _hash(mark)
            orders[host, tuple(names[m] for m in once)] = None
            counted: dict[int, int] = {}
            for mark, at in places.items():
                s = sums.setdefault((host, mark), [0, 0, 0, 0, 0])
                s[0] += 1
                s[1] += len(at) == 1
                if len(at) not in counted:
                    counted[len(at)] = _hash(f"{no}:{len(at)}")
                s[2] = (s[2] + counted[len(at)]) & 0xFFFFFFFFFFFFFFFF
                s[3] += at[0]
                s[4] += slots.get(mark, 0)
        rows = [(h, m, s[0], s[1], s[2] - (1 << 64) if s[2] >> 63 else s[2], s[3], s[4], names.get(m, 0), None) for (h, m), s in sums.items()]
        rows += [(h, None, 0, 0, 0, 0, 0, 0, list(o)) for h, o in orders]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MARK_TYPES)] if rows else [pa.array([], t) for t in _MARK_TYPES], names=list(_MARK_NAMES))


_MARK_NAMES = ("host", "mark", "pages", "single", "vector", "rank", "chars", "name", "sequence")
_MARK_TYPES = (pa.string(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()))
_MARKS = "host string, mark string, pages long, single long, vector long, rank long, chars long, name long, sequence array<long>"


def _in_order(held: DataFrame, sequences: DataFrame) -> DataFrame:
    """The marks of each host's class that stand in the same order on every page.

    All of them are once on each page of the class, so a page in order holds just the class's
    sequence; elsewhere each mark that has a later one before it or an earlier one after it goes.
    """
    whole = held.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("c")).select("host", F.col("c.name").alias("class"))
    found = sequences.join(whole, "host").select("host", "class", F.array_intersect("sequence", "class").alias("here"))
    odd = found.where("size(here) > 0 and here <> class").select("host", "here", F.expr("transform(here, x -> array_position(class, x))").alias("at")).distinct()
    behind = "i > 0 and array_max(slice(at, 1, i)) > at[i]"
    ahead = "i + 1 < size(at) and array_min(slice(at, i + 2, size(at))) < at[i]"
    bad = odd.select("host", F.explode(F.expr(f"filter(here, (x, i) -> ({behind}) or ({ahead}))")).alias("name")).distinct()
    return held.join(bad, ["host", "name"], "left_anti")


def deduce_templates(pages: DataFrame, least_pages: int = 2) -> DataFrame:
    """``(host, template, texts)``: the trunk of each host as an ordered array of (rank, mark, chars), and its template texts as (mark, chars).

    ``pages(no, url, html)``; hosts with fewer than ``least_pages`` pages have no template.
    The trunk is the class that is once on most pages; an element enters if both its ends are
    in it and in order on every page.  A template text is on three pages and a tenth of the trunk's pages at least, so
    that repeated pages are no template.
    """
    parts = written(pages.mapInArrow(_marks, _MARKS), "parts")
    total = F.sum(F.col("vector").cast("decimal(38,0)"))
    marks = parts.where("mark is not null").groupBy("host", "mark").agg(F.max("name").alias("name"), F.sum("pages").alias("pages"), F.sum("single").alias("single"), total.alias("vector"), (F.sum("rank") / F.sum("pages")).alias("rank"), F.sum("chars").alias("chars"))
    marks = written(marks, "marks")
    classes = marks.where(f"pages >= {least_pages}").groupBy("host", "vector").agg(F.count("*").alias("size"), F.max("pages").alias("pages"), F.min(F.col("single") == F.col("pages")).alias("single"))
    largest = Window.partitionBy("host").orderBy(F.desc("pages"), F.desc("size"), "vector")
    # a host has few classes beside its pages, as vectors are those of elements, not of words
    trunk = classes.where("single").withColumn("place", F.row_number().over(largest)).where(f"place = 1 and pages >= {least_pages}").select("host", "vector", F.col("pages").alias("most"))
    held = marks.where("not startswith(mark, '=')").join(trunk, ["host", "vector"]).select("host", "mark", "rank", "chars", "name")
    held = written(_in_order(held, parts.where("sequence is not null").select("host", "sequence").distinct()), "trunk")
    ends = held.select("host", F.expr("ltrim('/', mark)").alias("bare")).groupBy("host", "bare").agg(F.count("*").alias("ends")).where("ends = 2")
    nested = held.withColumn("bare", F.expr("ltrim('/', mark)")).join(ends, ["host", "bare"], "left_semi")
    opened = nested.where("not startswith(mark, '//')")
    templates = opened.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "mark", "chars"))).alias("template"))
    steady = marks.where("single = pages and pages >= 3").join(trunk.select("host", "most"), "host").where("pages * 10 >= most")
    both = steady.where("not startswith(mark, '=')").groupBy("host", "vector", F.expr("ltrim('/', mark)").alias("bare")).agg(F.count("*").alias("ends")).where("ends = 2")
    own = steady.where("startswith(mark, '=')").withColumn("bare", F.regexp_extract("mark", r"(?s)^=/?(.*)\|", 1)).join(both, ["host", "vector", "bare"], "left_semi")
    return templates.join(own.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("mark", "chars"))).alias("texts")), "host", "left")


def main_text(source: str, slot: str | None, texts: frozenset | set = frozenset()) -> str:
    """The main text of one page: its blocks in the host's main slot, joined by one space."""
    page = Page(source)
    free = [b for b in page.blocks if not b[2]]
    found = _slot_blocks(free, slot, texts)
    # the exact check: what the slot gives must be the article, whole
    exact = [b for b in free if b[3]]
    if exact and found != exact:
        found = exact
    return " ".join(b[0] for b in found)


def _slot_blocks(free: list[tuple], slot: str | None, texts: frozenset | set) -> list[tuple]:
    """Blocks in the slot without template texts; a page of template texts only keeps them."""
    free = [b for b in free if _text_mark(b[1], b[0]) not in texts] or free if texts else free
    return [b for b in free if any(p == slot for _, p in b[4])] or free if slot else free


def _main_slot(template: list[tuple[str, int]], texts: list[tuple[str, int]] = ()) -> str | None:
    """The deepest container of the template that holds three fifths of the host's free text, template texts not counted."""
    free = dict(template)
    for text, chars in texts:
        path = text[1:].rpartition("|")[0]
        for around in {path, *(path[: m.start()] for m in re.finditer("/", path))} & free.keys():
            free[around] -= chars
    most = max(free.values(), default=0)
    plain = {m: _SUFFIX.sub("", m) for m in free}
    holders = [m for m, c in free.items() if most > 0 and c * 5 >= most * 3 and plain[m].rpartition("/")[2].partition("#")[0] in CONTAINERS | MAIN_TAGS]
    return max(holders, key=lambda m: (plain[m].count("/"), m), default=None)


def _slots(batches):
    for batch in batches:
        texts = [[(t["mark"], t["chars"]) for t in x or ()] for x in batch.column("texts").to_pylist()]
        found = [_main_slot([(t["mark"], t["chars"]) for t in x], y) for x, y in zip(batch.column("template").to_pylist(), texts)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string()), pa.array([[m for m, _ in x] for x in texts], pa.list_(pa.string()))], names=["host", "slot", "texts"])


def _extract(batches):
    for batch in batches:
        texts = []
        for source, slot, fixed in zip(batch.column("html").to_pylist(), batch.column("slot").to_pylist(), batch.column("texts").to_pylist()):
            texts.append(main_text(source or "", slot, frozenset(fixed or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Null html is empty text; a null or hostless url shares the host ''.  Rows that share an
    id and address count as one page for the template and are each extracted.  Pages of a
    host without a template are read by their own elements alone.
    """
    prepare(pages.sparkSession)
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    templates = deduce_templates(own.select(F.xxhash64("page_id", "url").alias("no"), "url", "html"))
    templates = written(templates.mapInArrow(_slots, "host string, slot string, texts array<string>"), "templates")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = own.withColumn("host", host).join(templates, "host", "left").select("page_id", "url", "html", "slot", "texts")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
