"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: opening tags with their path, and text blocks with theirs.
Pages are parsed once, into a durable table.  Tokens of a host's pages with the same
occurrence vector (how often the token is on each page) are an equivalence class.  A vector
is kept as an order-free sum of hashes, one a page, so classes come from one aggregation with
map-side combine, however many pages a host has or repeats.

A class is valid if it is on enough pages, and has more than one token or is once on each
page; it keeps those tokens that have the same place among the others on nearly all of its
pages, so it is ordered.  Valid classes nest: the parent of a class is the one, on as many
pages or more, whose span holds it most often.
That tree is the host's template.  On a page, the classes that stand there in their order,
within their parents, cut the page into slots.  The main text is that of the slots; the
page's markup only chooses among them: those inside the article, or, without one, all that
aren't menus, notices and the like.  A block that only one article's copies share is that
article's text and not its host's template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, join_hot, tidy

#: A class of tokens belongs to a host's template from so many pages, and from this part of the host's pages.
PAGES, PART = 4, 0.5
#: The part of a class's pages on which a token must have the same place in it.
AGREE = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/a-zA-Z!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|style|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements by kind, as HTML defines them.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noframes noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th img wbr".split()) - {"wbr"}
#: Elements that aren't part of an article's text.
ASIDE = frozenset("head nav footer aside form button select menu dialog fieldset search".split())
_CUE = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|sidebar|side-bar|aside|footer|masthead|topbar|ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|comment|comments|commentlist|respond|disqus|replies|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|newsletter|subscribe|signup|login|search|pagination|pager|widget|tags|skip|complementary|contentinfo|dialog)(?:$|[\s_-]|\d)", re.I)
#: A class name inside an article counts only if all of its parts are such words, and one is a cue.
_PLAIN = frozenset("area block body bottom box button buttons content container form group inner item items left links list panel posts right section top wrap wrapper".split())
_HEADING = re.compile(r"/h[1-6](?:[.#][^/]*)?$")
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])", re.I)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|post-content|post-body|entry-content|main-content|story|storybody|story-body)(?:$|[\s_-])", re.I)
#: Starting one of these ends an open one of the set.
_ENDS = {**{t: ("p",) for t in BLOCKS - {"body", "html", "head"}}, "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr", "td", "th"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",), "body": ("head",)}
_SCOPE = frozenset("table ul ol dl select article section div nav aside body html blockquote form".split())


def _strict(mark: str) -> bool:
    """Whether one of the names in mark says nothing but that it is marginal."""
    for name in mark.lower().split():
        parts = re.split(r"[_-]+", name.rstrip("0123456789"))
        if _CUE.search(name) and all(p in _PLAIN or _CUE.fullmatch(p) for p in parts if p):
            return True
    return False


class Page:
    """Blocks of a page: (path, text, in an article, left out, cue-marked paths inside the article), and its opening tags by path.

    html and body have no cues.  If all articles stand in cue-marked elements, these hold the
    page's text and their cues don't count.
    """

    def __init__(self, html: str):
        found: list[tuple[str, str, bool, bool, tuple[int, ...], tuple[str, ...]]] = []
        holders: set[int] = set()  # cue-marked elements that hold an article
        #: Tokens in page order: hash, and number of the block or -1.
        self.order: list[tuple[int, int]] = []
        # name, path, in an article, left out, cue-marked elements outside and inside of the article
        stack: list[tuple[str, str, bool, bool, tuple[int, ...], tuple[str, ...]]] = [("", "", False, False, (), ())]
        parts: list[str] = []
        at, n = 0, len(html)

        def flush():
            text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
            parts.clear()
            if text:
                _, path, *rest = stack[-1]
                self.order.append((_hash(f"{path}\0{text}"), len(found)))
                found.append((path, text, *rest))

        def close(k):
            del stack[k:]

        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                parts.append(html[at:])
                break
            if m.start() > at:
                parts.append(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if name in BLOCKS:
                    flush()
                elif name in SPACED:
                    parts.append(" ")
                if k:
                    close(k)
                continue
            if name in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else n
                continue
            if name in BLOCKS:
                flush()
            elif name in SPACED:
                parts.append(" ")
            for old in _ENDS.get(name, ()):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == old:
                        close(k)
                        break
                    if stack[k][0] in _SCOPE:
                        break
            if name in VOID or (name not in BLOCKS and name not in ASIDE and name not in ("td", "th", "span")):
                continue
            _, path, inside, out, outer, inner = stack[-1]
            label, marks, hidden = "", [], False
            if m[3].strip():
                for a in _ATTRIBUTE.finditer(m[3]):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key in ("class", "id", "role", "itemprop"):
                        marks.append(value)
                        label += f".{value}" if key != "id" else f"#{value}"
                    hidden |= key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I) is not None)
            named = name in ("article", "main")
            article = named or any(_ARTICLE.search(x) and not _CUE.search(x) for m in marks for x in m.split())
            whole = name in ("html", "body")
            cue = not whole and any(map(_strict if inside or article else _CUE.search, marks))
            path = f"{path}/{name}{label}"
            self.order.append((_hash(path), -1))
            if cue and inside:
                inner = (*inner, path)
            elif cue:
                outer = (*outer, at)
            if article and name not in ASIDE and (named or not cue):
                inside = True
                holders.update(outer)
            # a header belongs to its article, not to the page, when it stands inside one
            header = not inside and not whole and (name == "header" or any(map(_HEADER.search, marks)))
            out = out or hidden or header or name in ASIDE
            stack.append((name, path, inside, out, outer, inner))
        flush()
        if any(inside and not out and not outer for _, _, inside, out, outer, _ in found):
            holders = set()
        #: Path, text, in an article, left out, paths of cue-marked elements inside the article.
        self.blocks = [(path, text, inside, out or not holders.issuperset(outer), inner) for path, text, inside, out, outer, inner in found]

    def keys(self, own: str) -> tuple[int, int]:
        """What tells its article from others: the first heading, and the longest block; `own` if it has no text."""
        body = [b for b in self.blocks if b[2] and not b[3]] or [b for b in self.blocks if not b[3]]
        longest = max((t for _, t, *_ in body), key=len, default=own)
        return _hash(next((t for p, t, *_ in body if _HEADING.search(p)), longest)), _hash(longest)


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def host_of(url: str | None) -> str:
    """The host in lower case without a port; empty if there is none."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


# ---------------------------------------------------------------- slots of one page


class Layout:
    """A page's blocks with what markup says of them, and its tokens."""

    def __init__(self, tokens: list[int], block: list[int], texts: list[str], flags: list[int], cues: list[list[int]]):
        self.tokens, self.block, self.texts, self.flags, self.cues = tokens, block, texts, flags, cues

    @classmethod
    def of(cls, page: Page) -> Layout:
        flags = [inside + 2 * out for _, _, inside, out, _ in page.blocks]
        return cls([t for t, _ in page.order], [b for _, b in page.order], [t for _, t, *_ in page.blocks], flags, [[_hash(c) for c in b[4]] for b in page.blocks])

    def classes(self, of: dict[int, int]) -> dict[int, list]:
        """By class: position of its first and last token, and its tokens in order of their first places."""
        found: dict[int, list] = {}
        for at, t in enumerate(self.tokens):
            c = of.get(t)
            if c is None:
                continue
            if (known := found.get(c)) is None:
                found[c] = [at, at, {t: None}]
            else:
                known[1] = at
                known[2][t] = None
        return found

    def slots(self, template: Template) -> list[list[int]]:
        """Runs of blocks that no token of a class separates."""
        here = self.classes(template.of)
        fits = {c for c, (first, last, tokens) in here.items() if template.order.get(c) == _order(tokens)}
        fits = {c for c in fits if (up := template.parent.get(c)) not in fits or (here[up][0] <= here[c][0] and here[c][1] <= here[up][1])}
        out: list[list[int]] = [[]]
        for t, b in zip(self.tokens, self.block, strict=True):
            if template.of.get(t) in fits:
                if out[-1]:
                    out.append([])
            elif b >= 0:
                out[-1].append(b)
        return [s for s in out if s]

    def main_text(self, template: Template | None = None) -> str:
        """The blocks of the slots that hold the main text.

        A cue-marked element inside an article is left out if it belongs to the template, or
        if there is none.  An article that would be left without text stays whole.
        """
        template = template or Template()
        article = [b for b in range(len(self.texts)) if self.flags[b] == 1]
        slots = [b for slot in self.slots(template) for b in slot]
        if not article:
            return "\n".join(self.texts[b] for b in slots if not self.flags[b] & 2)
        plain = [b for b in article if not any(not template.of or c in template.of for c in self.cues[b])] or article
        own = set(slots)
        return "\n".join(self.texts[b] for b in [b for b in plain if b in own] or plain)


def _order(tokens) -> int:
    return _hash(",".join(map(str, tokens)))


class Template:
    """A host's valid classes: the class of each token, the order and the parent of each class."""

    def __init__(self, tokens=(), tree=()):
        by: dict[int, list] = {}
        for t in sorted(tokens, key=lambda t: t["place"]):
            by.setdefault(t["class"], []).append(t["token"])
        self.of = {t: c for c, own in by.items() for t in own}
        self.order = {c: _order(own) for c, own in by.items()}
        self.parent = {c["class"]: c["parent"] for c in tree}


# ---------------------------------------------------------------- over tables

_KEYS = ("title_low", "title_high", "longest_low", "longest_high")
_PARSED = "page_id long, url string, host string, own long, title long, longest long, tokens array<long>, block array<int>, texts array<string>, flags array<int>, cues array<array<long>>"


@tidy
def _parse(batches):
    for batch in batches:
        rows = []
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            # any number that tells pages apart; rows that repeat have the same
            own = _hash(f"{page}|{url}|{html}")
            read = Page(html or "")
            lay = Layout.of(read)
            rows.append((page, url, host_of(url), own, *read.keys(str(own)), lay.tokens, lay.block, lay.texts, lay.flags, lay.cues))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))]
        names = [f.split()[0] for f in _PARSED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)


def _widen(keys: list[int], title: int, longest: int) -> list[int]:
    keys[:] = min(keys[0], title), max(keys[1], title), min(keys[2], longest), max(keys[3], longest)
    return keys


_COUNTED = ", ".join(["host string, token long, low long, high long, pages long, times long", *(f"{k} long" for k in _KEYS)])


@tidy
def _count(batches):
    """By host and token: the sum of a hash of (page, occurrences) in two halves of 32 bits, pages, occurrences; token 0 is the host itself."""
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for host, own, title, longest, tokens, block in zip(*(batch.column(c).to_pylist() for c in ("host", "own", "title", "longest", "tokens", "block")), strict=True):
            texts = {t for t, b in zip(tokens, block, strict=True) if b >= 0}
            every = Counter(tokens)
            every[0] = 1
            marks = {times: xxhash.xxh3_64_intdigest(f"{own}|{times}") for times in set(every.values())}
            for token, times in every.items():
                # only blocks may be an article's own
                keys = [title, title, longest, longest] if token in texts or not token else [None] * 4
                kept = found.setdefault((host, token), [0, 0, 0, 0, *keys])
                kept[0] += marks[times] & 0xFFFFFFFF
                kept[1] += marks[times] >> 32
                kept[2] += 1
                kept[3] += times
                if kept[4] is not None:
                    kept[4:] = _widen(kept[4:], title, longest)
        rows = [(h, t, *v) for (h, t), v in found.items()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 10, [pa.string(), *[pa.int64()] * 9], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "token", "low", "high", "pages", "times", *_KEYS])


def classes(parsed: DataFrame, least: int = PAGES, part: float = PART) -> DataFrame:
    """(host, tokens: array of token, class and pages, n: the host's pages): tokens in equivalence classes on enough pages."""
    counted = parsed.select("host", "own", "title", "longest", "tokens", "block").mapInArrow(_count, _COUNTED)
    ends = [(F.min if k.endswith("low") else F.max)(k).alias(k) for k in _KEYS]
    tokens = durable(counted.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("low", "high", "pages", "times")), *ends, F.count("*").alias("parts")).where(f"pages >= {least}"))
    # a title that all of a host's pages have tells no articles apart; the longest block may
    hosts = durable(tokens.where("token = 0").select("host", F.col("pages").alias("all_pages"), F.expr("title_low < title_high").alias("by_title"), F.expr("longest_low < longest_high").alias("by_longest"), F.lit(0).cast("long").alias("n")))
    mine = join_hot(tokens.where("token <> 0"), hosts, "host").where(F.col("pages") >= F.lit(part) * F.col("all_pages"))
    # what only the copies of one article share
    copied = F.coalesce(F.expr("CASE WHEN by_title THEN title_low = title_high WHEN by_longest THEN longest_low = longest_high END"), F.lit(False))
    token = F.struct("token", F.xxhash64("low", "high", "pages").alias("class"), "pages")
    found = mine.groupBy("host", "low", "high", "pages").agg(F.collect_list(F.when(~copied, token)).alias("tokens"), F.count("*").alias("size"), F.first("times").alias("times"), F.first("all_pages").alias("n"))
    valid = found.where("size > 1 or (pages = n and times = pages)")
    return valid.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.first("n").alias("n"))


_SEEN = "host string, class long, token long, place long, pages long"


@tidy
def _observe(batches):
    """How often each token has which place in its class; as those of token 0, how often each class has which parent."""
    for batch in batches:
        seen: Counter = Counter()
        known: dict[str, tuple[dict, dict]] = {}
        for k, (host, tokens) in enumerate(zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
            if host not in known:
                listed = batch.column("template")[k].as_py()
                known[host] = {t["token"]: t["class"] for t in listed}, {t["class"]: t["pages"] for t in listed}
            of, pages = known[host]
            here = Layout(tokens, [], [], [], []).classes(of)
            # spans by start; the innermost open one on as many pages is the parent
            open_: list[tuple[int, int]] = []
            for c, (first, last, own) in sorted(here.items(), key=lambda x: (x[1][0], -x[1][1])):
                open_ = [o for o in open_ if o[0] > first]
                up = next((o[1] for o in reversed(open_) if o[0] > last and pages[o[1]] >= pages[c]), None)
                seen[host, c, 0, up] += 1
                seen.update((host, c, t, at) for at, t in enumerate(own))
                open_.append((last, c))
        rows = [(*k, n) for k, n in seen.items()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, [pa.string(), *[pa.int64()] * 4], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "class", "token", "place", "pages"])


def templates(parsed: DataFrame, least: int = PAGES, part: float = PART, agree: float = AGREE) -> DataFrame:
    """(host, template: tokens with class and place in it, tree: classes with their parents, n: pages), durable."""
    found = durable(classes(parsed, least, part))
    told = join_hot(parsed.select("host", "tokens"), found.withColumnRenamed("tokens", "template"), "host")
    seen = told.mapInArrow(_observe, _SEEN).groupBy("host", "class", "token", "place").agg(F.sum("pages").alias("pages"))
    best = seen.groupBy("host", "class", "token").agg(F.sum("pages").alias("whole"), F.max(F.struct("pages", "place")).alias("best"))
    best = durable(best.select("host", "class", "token", F.col("best.place").alias("place"), (F.col("best.pages") >= F.lit(agree) * F.col("whole")).alias("steady")))
    tokens = best.where("token <> 0 and steady").groupBy("host").agg(F.collect_list(F.struct("token", "class", "place")).alias("template"))
    tree = best.where("token = 0").groupBy("host").agg(F.collect_list(F.struct("class", F.col("place").alias("parent"))).alias("tree"))
    out = durable(tokens.join(tree, "host").join(found.select("host", "n"), "host"))
    forget(found, best)
    return out


@tidy
def _extract(batches):
    for batch in batches:
        out = []
        known: dict[str, Template] = {}
        columns = [batch.column(c).to_pylist() for c in ("host", "tokens", "block", "texts", "flags", "cues")]
        for k, (host, *lay) in enumerate(zip(*columns, strict=True)):
            if host not in known:
                known[host] = Template(batch.column("template")[k].as_py() or (), batch.column("tree")[k].as_py() or ())
            out.append(Layout(*lay).main_text(known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty html gives an empty text.  Pages of a null or odd url share the empty
    host.  A host with fewer than PAGES pages has no template; its pages are read by their
    own markup alone.  Repeated rows give repeated rows, and leave classes as they are.  Html
    is read whole, however long.  An empty table gives no rows.  Only page_id, url and html
    are read.
    """
    parsed = durable(pages.select("page_id", "url", "html").mapInArrow(_parse, _PARSED))
    found = templates(parsed)
    fields = parsed.select("page_id", "url", "host", "tokens", "block", "texts", "flags", "cues")
    return join_hot(fields, found, "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
