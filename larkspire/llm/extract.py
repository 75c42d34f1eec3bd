"""Main text of web pages by equivalence-class template deduction.

A token is an element start with its role: the hash of the tags (and of the class and id words) from the root down to it.
Its occurrence vector says how often it stands in each page of the host. Vectors are never built: a token's vector is
held as the number of its pages and the wrapping sum of a hash of (page, count), so partial sums meet in a shuffle and a
host that has a third of all pages is no larger than another. Tokens of a host with equal vectors form a class. Tokens
in half of the host's pages at least (so a host has no more of them than two pages have) are nested by their parents
into the host's template. A class is part of the template if it has two tokens at least, or its token is marked (article,
main, or by class words) or on nine pages of ten. Of these, containers (div, section, td and the like) of classes that stand once on a page
can be slots; classes that repeat (paragraphs, list items, teasers) and tokens of no class fill the slot they stand in.

The content slot is the lowest such element that holds the text that varies between pages: from the root, or from the
marked element with most text, down to the element that holds most of it, as long as that leaves no paragraphs or h1
behind. Text that is the same on every page of its token doesn't count for this, but is extracted where it stands in
the slot. Menus, headers, footers, asides, forms and scripts are found by their tags and left out wherever they stand.

Class words of sidebars, notices, adverts, comments and the like are only a hint, since wrappers have them too
(has-sidebar, comments-open), and say nothing on html, body, main and article. Elsewhere an element with such a word is
left out if it is a slot of the template beside or in the content slot: on two pages and one in twenty at least. One that
holds most of the text is opened and searched if what stands outside can't be the article: it has no article or main, and
either a mark or h1 stands inside alone, or there are paragraphs inside and next to no text outside.

Pages that lack the template's content token are read by the same rule as a host of one page.

Null and empty html give an empty text, as do pages without an article. Pages of the same id are read row by row. A null
url belongs to the host ''. Between tokens of equal text the one nearer to the root is taken, then the larger token. A very
long page costs memory in proportion to its length. An empty table gives an empty result. Extra columns are ignored.

A host may have a third of all pages: its tokens are summed in every task first, and pages meet their template by a
broadcast of checked size or, beyond it, by (host, salt) with the templates repeated for each salt.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspire.llm.common import ints, keeps, key, keyed, mapped, stored

# Elements that never hold article text, elements without end, and elements that begin a block.
DROPPED = frozenset("script style noscript template nav header footer aside form iframe svg canvas object embed button select textarea input menu dialog head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
# Class and id words of slots that aren't the article, and of those that are.
AWAY = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer header menu nav navbar navigation newsletter notice notices popup promo promotion related reply respond share sharing sidebar social sponsor sponsored subscribe widget widgets".split())
ARTICLE = frozenset("article articlebody body content entry main maincontent post story text".split())
#: What an element closes when it starts: a new p ends an open p, a new li an open li, and so on.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NONE, _CLOSED = frozenset(), frozenset("p li dt dd tr td th option".split())
SCOPE = frozenset("ul ol table dl div article section aside body html td th li blockquote main nav header footer form".split())

_NAME, _SPECIAL = re.compile(r"<(/?)([A-Za-z][^\s/>]*)"), re.compile("[\"'>]")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Elements that can be slots; all others fill the slot that they stand in.
CONTAINERS = frozenset("html body main article section div td center".split())
#: Shares: of a host's pages that a token of the template needs; of the text that an element needs to be gone down to, and a marked one to begin at; of the text that may be left right above.
#: Of a host's pages, that an element with a word of AWAY needs to be left out.
AGREED = 0.05
SUPPORT, MOST, MARKED, LOOSE = 0.5, 0.5, 0.2, 0.1
#: Odd pages of a large host don't count: so large a share of the pages is all, so large a share of the elements on a page of its own is once.
EVERY = 0.9
PARAGRAPH, CONTAINER, HEADING = 3, 2, 1
_KINDS = dict.fromkeys(CONTAINERS, CONTAINER) | {"h1": HEADING, "p": PARAGRAPH}


def _words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = " ".join("".join(m) for m in _NAMES.findall(attributes)).lower()
    return tuple(w for w in _SPLIT.split(found) if w)


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Where the > is that ends a tag whose attributes begin here: the first outside quotes, or the first at all if quotes don't end; -1 if there is none. dead holds quotes from which no end was found, so none is followed twice."""
    i, visited = at, []
    while m := _SPECIAL.search(html, i):
        i, c = m.start(), m[0]
        if c == ">":
            return i
        if i in dead:
            break
        visited.append(i)
        i = html.find(c, i + 1) + 1
        if not i:
            break
    dead.update(visited)
    return html.find(">", at)


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("start" or "end", tag, attributes) and ("text", text, "") in page order; raw text of scripts and the like is skipped. Takes time in proportion to the page, however broken it is."""
    at, done, n, last, dead = 0, 0, len(html), html.rfind(">"), set()
    while (i := html.find("<", at)) >= 0:
        tag = None
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = end + 3 if end >= 0 else n
        elif i > last:  # no tag can end any more
            at = n if html.find("<!--", i) < 0 else html.find("<!--", i)
            continue
        elif m := _NAME.match(html, i):
            end = _tag_end(html, m.end(), dead)
            if end < 0:
                at = i + 1
                continue
            tag, at = m[2].lower(), end + 1
        elif html[i + 1 : i + 2] in ("!", "?"):
            at = html.find(">", i) + 1
        else:
            at = i + 1
            continue
        if i > done:
            yield "text", html[done:i], ""
        done = at
        if tag is None:
            continue
        if m[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, html[m.end() : end]
        if tag in RAW:
            close = _ENDS[tag].search(html, at)
            done = at = close.end() if close else n
            yield "end", tag, ""
    if done < n:
        yield "text", html[done:], ""


class _Open:
    """An open element: its tag, token, whether it or what it stands in is left out, whether it is the article, what it stands in, and the characters of text below it."""

    __slots__ = ("tag", "token", "away", "inside", "up", "chars", "ends")

    def __init__(self, tag, token, away, inside, up=None):
        self.tag, self.token, self.away, self.inside, self.up, self.chars = tag, token, away, inside, up, 0
        #: Which of the tags that a start can close stand open up to the next element of SCOPE.
        above = _NONE if up is None or tag in SCOPE else up.ends
        self.ends = above | {tag} if tag in _CLOSED and tag not in above else above


_ROOT, _LONG = 0x51ED270B, (1 << 63) - 1
#: Templates are broadcast up to so many bytes; beyond that a host's pages are dealt to so many salts.
BROADCAST_BYTES, SALTS = 16 << 20, 64
_known: dict[tuple, int] = {}


def _token(parent: int, tag: str, words: tuple[str, ...]) -> int:
    key = (parent, tag, words)
    got = _known.get(key)
    if got is None:
        if len(_known) > 200_000:
            _known.clear()
        got = _known[key] = xxhash.xxh3_64_intdigest(f"{parent} {tag} {' '.join(words)}") >> 1
    return got


def rank(tag: str, words: tuple[str, ...]) -> int:
    """How much an element looks like the article's: 3 article, 2 main, 1 by its class words, 0 not."""
    if tag == "article" or "articlebody" in words:
        return 3
    if tag == "main":
        return 2
    return 1 if tag in ("div", "section", "td") and not ARTICLE.isdisjoint(words) else 0


def _away(tag: str, words: tuple[str, ...]) -> bool:
    """Whether class words hint that an element isn't the article's."""
    return not AWAY.isdisjoint(words) and tag not in ("html", "body", "main", "article")


def walk(html: str, shut: Collection[int] = ()):
    """Elements of DROPPED and of the tokens in shut are left out. ("open", element, words), ("close", element, ()) and ("text", element, text) with elements nested as browsers do, roughly."""
    stack, open_ = [_Open("", _ROOT, False, False)], Counter()

    def closed(tags):
        """Closes elements down to the first of these tags."""
        while True:
            e = stack.pop()
            open_[e.tag] -= 1
            yield "close", e, ()
            if e.tag in tags:
                return

    for kind, what, attributes in events(html):
        if kind == "text":
            yield "text", stack[-1], what
        elif kind == "start":
            closes = CLOSES.get(what) or (("p",) if what in BLOCKS else None)
            if closes and not stack[-1].ends.isdisjoint(closes):
                yield from closed(closes)
            words = _words(attributes)
            top = stack[-1]
            token = _token(top.token, what, words)
            e = _Open(what, token, top.away or what in DROPPED or token in shut, False, top)
            yield "open", e, words
            if what in VOID:
                yield "close", e, ()
            else:
                stack.append(e)
                open_[what] += 1
        elif open_[what]:
            yield from closed((what,))
    while len(stack) > 1:
        yield "close", stack.pop(), ()


class Token:
    """A token of a page or a host: its parent token, rank, kind, whether its class words hint that it is to be left out; how often it stands, characters of text in its whole subtree and right below it, and the least and largest hash of the latter."""

    __slots__ = ("parent", "rank", "kind", "away", "count", "chars", "own", "low", "high", "pages", "vector")

    def __init__(self, parent, rank, kind, away, count=0, chars=0, own=0, low=0, high=0, pages=1, vector=0):
        self.parent, self.rank, self.kind, self.away, self.count, self.chars, self.own, self.low, self.high = parent, rank, kind, away, count, chars, own, low, high
        self.pages, self.vector = pages, vector


def tokens(html: str) -> dict[int, Token]:
    """The tokens of a page, without elements of DROPPED."""
    out: dict[int, Token] = {}
    total = 0
    for kind, e, what in walk(html):
        if e.away:
            continue
        if kind == "open":
            got = out.get(e.token)
            if got is None:
                got = out[e.token] = Token(e.up.token, rank(e.tag, what), _KINDS.get(e.tag, 0), _away(e.tag, what))
            got.count += 1
        elif kind == "text":
            text = what.strip()
            if text:
                e.chars += len(text)
                total += len(text)
                if e.token != _ROOT:
                    got = out[e.token]
                    got.own += len(text)
                    got.low = (got.low + xxhash.xxh3_64_intdigest(text)) & _LONG
        else:
            out[e.token].chars += e.chars
            e.up.chars += e.chars
    out[_ROOT] = Token(0, 0, 0, False, 1, total)
    for got in out.values():
        got.high, got.vector = got.low, got.count
    return out


def choose(found: dict[int, Token], of: int, support: float = SUPPORT) -> tuple[int, list[int]]:
    """The content token of a host of so many pages (_ROOT if the text stands in no slot, 0 if there is none) and the tokens that are left out of it."""
    below: dict[int, list[int]] = {}
    for t, x in found.items():
        below.setdefault(x.parent, []).append(t)
    order, depth = [_ROOT], {_ROOT: 0}
    for t in order:
        for c in below.get(t, ()):
            depth[c] = depth[t] + 1
            order.append(c)
    valid = {t for t, x in found.items() if x.pages >= support * of}
    sizes = Counter((found[t].pages, found[t].vector) for t in valid)
    once = {t for t, x in found.items() if x.count * EVERY <= x.pages}
    slots = {
        t for t in valid
        if (x := found[t]).kind == CONTAINER and (x.rank or sizes[x.pages, x.vector] > 1 or x.pages >= EVERY * of) and (x.rank > 1 or t in once)
    }
    shut = {t for t, x in found.items() if x.away and x.pages >= min(of, max(2, AGREED * of))}
    text, loose, heads, inner = {}, {}, {}, {}
    while True:
        title, signs, closed, best = {}, {}, {}, {}
        for t in reversed(order):
            x, under = found[t], below.get(t, ())
            left = x.chars - sum(found[c].chars for c in under)
            if of > 1 and x.pages > 1 and x.low == x.high:  # the same text on every page
                left -= x.own
            kept = [c for c in under if c not in shut]
            text[t] = left + sum(text[c] for c in kept)
            loose[t] = left + sum(loose[c] for c in kept if c not in slots)
            heading = x.kind == HEADING and text[t] > 0
            heads[t] = sum(heads[c] for c in kept) + heading
            title[t] = text[t] if heading else sum(title[c] for c in kept)
            inner[t] = [s for c in kept for s in ([c] if c in slots else inner.pop(c))]
            closed[t] = [s for c in under for s in ([c] if c in shut else closed.pop(c))]
            best[t] = max([x.rank * (text[t] > 0), *(best[c] for c in kept)])
            # 2: a mark or h1 that stands alone, 1: paragraphs
            signs[t] = max([2 if t in once and (x.rank or heading) else int(x.kind == PARAGRAPH), *(signs[c] for c in kept)])
        rest = text[_ROOT] - title[_ROOT]
        most = max(closed[_ROOT], key=lambda t: (text[t], t), default=None)
        if most is None or best[_ROOT] > 1 or text[most] <= MOST * (text[most] + rest):
            break
        if not (signs[most] == 2 and not best[_ROOT] or signs[most] and rest < LOOSE * text[most]):
            break
        shut.remove(most)
    if not text[_ROOT]:
        return 0, []

    def share(t: int) -> float:
        return text[t] / found[t].pages

    def largest(these: list[int]) -> int | None:
        return max(these, key=lambda t: (share(t), -depth[t], t), default=None)

    marked = [t for t in slots if found[t].rank and share(t) >= MARKED * share(_ROOT)]
    at = largest(marked) or _ROOT
    while (c := largest(inner[at])) is not None and share(c) >= MOST * share(at):
        here, there = found[at].rank, found[c].rank
        if here and there <= here or (here or there < 2) and (loose[at] > LOOSE * text[at] or heads[at] > heads[c]):
            break
        at = c
    # Those in the slot, the outermost of each.
    under, out = [at], []
    for t in under:
        for c in below.get(t, ()):
            (out if c in shut else under).append(c)
    return at, out


def main_text(html: str | None, content: int, shut: Collection[int] = ()) -> str:
    """Blocks of the elements whose token is the content token, without those in shut; by the page's own tokens where it has none."""
    if not html:
        return ""
    text = _slots(html, content, shut) if content else None
    if text is None:
        own, shut = choose(tokens(html), 1)
        text = _slots(html, own, shut) if own else None
    return text or ""


def _slots(html: str, content: int, shut: Collection[int]) -> str | None:
    blocks, run, inside, seen = [], [], int(content == _ROOT), content == _ROOT

    def flush() -> None:
        if run:
            block = " ".join(_html.unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run.clear()

    for kind, e, what in walk(html, frozenset(shut)):
        if kind == "text":
            if inside and not e.away:
                run.append(what)
        elif kind == "open":
            if e.tag in BLOCKS:
                flush()
            elif e.tag == "br" and inside:
                run.append(" ")
            if e.token == content and not e.away:
                inside, seen = inside + 1, True
                e.inside = True
        else:
            if e.tag in BLOCKS:
                flush()
            if e.inside:
                flush()
                inside -= 1
    flush()
    return "\n".join(blocks) if seen else None


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, content and shut: the content token of the host's template, and the tokens in it that are left out."""
    columns = ["host", "token", *Token.__slots__]
    schema = "host string, token long, parent long, rank int, kind int, away boolean, count long, chars long, own long, low long, high long, pages long, vector long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keeps("extract", _known.clear)
        sums: dict[tuple[str, int], Token] = {}
        for pdf in batches:
            for host, page, text in zip(pdf["host"], pdf["page_id"], pdf["html"], strict=True):
                if not isinstance(text, str) or not text:
                    continue
                for token, x in tokens(text).items():
                    x.vector = xxhash.xxh3_64_intdigest(f"{page} {x.count}")
                    got = sums.get((host, token))
                    if got is None:
                        sums[host, token] = x
                    else:
                        got.pages += 1
                        got.vector = (got.vector + x.vector) & 0xFFFFFFFFFFFFFFFF
                        got.count, got.chars, got.own = got.count + x.count, got.chars + x.chars, got.own + x.own
                        got.low, got.high = min(got.low, x.low), max(got.high, x.high)
            if len(sums) > 200_000:
                yield rows(sums)
                sums = {}
        yield rows(sums)

    def rows(sums: dict) -> pd.DataFrame:
        for x in sums.values():
            x.vector -= (x.vector >> 63) << 64
        return pd.DataFrame([(*k, *(getattr(x, c) for c in Token.__slots__)) for k, x in sums.items()], columns=columns)

    def slot(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {int(t): Token(*values) for t, *values in pdf[columns[1:]].itertuples(index=False)}
        content, shut = choose(found, found[_ROOT].pages, support)
        return pd.DataFrame({"host": pdf["host"][:1], "content": [content], "shut": [shut]})

    parts = mapped(pages.select(_host().alias("host"), F.col("page_id").cast("string").alias("page_id"), "html"), run, schema, "extract")
    mixed = F.sum(F.col("vector").cast("decimal(38,0)")).cast("string").alias("vector")
    same = [F.max(c).alias(c) for c in ("parent", "rank", "kind", "away")]
    added = [F.sum(c).alias(c) for c in ("count", "chars", "own")]
    found = stored(parts.groupBy("host", "token").agg(*same, *added, F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages"), mixed), "tokens")
    most = found.where(F.col("token") == _ROOT).select("host", F.col("pages").alias("of"))
    # A host has at most 1 / AGREED times the tokens of a page here.
    return found.join(most, "host").where(F.col("pages") >= min(AGREED, support) * F.col("of")).drop("of").groupBy("host").applyInPandas(slot, "host string, content long, shut array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = stored(templates(pages), "templates")
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keeps("extract", _known.clear)
        for pdf in batches:
            text = [main_text(h if isinstance(h, str) else None, int(c or 0), () if x is None else x) for h, c, x in zip(pdf["html"], pdf["content"], pdf["shut"], strict=True)]
            yield pd.DataFrame({"page_id": ints(map(keyed, pdf["page_id"])), "url": pdf["url"], "text": text, "n_chars": np.fromiter(map(len, text), np.int64, len(text))})

    size = known.select(F.coalesce(F.sum(F.length("host") + 8 * F.size("shut") + 16), F.lit(0))).first()[0]
    rows = pages.select(key(F.col("page_id")).alias("page_id"), "url", "html", _host().alias("host"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    return mapped(joined.select("page_id", "url", "html", F.col("content").cast("string").alias("content"), "shut"), run, schema, "extract")
