"""Operator 13: main text of web pages by wrappers that are inferred host by host.

A page becomes a stream of text blocks, each named by the path of elements it
stands in. Repeated runs of paths fold into repeated groups, which leaves a
short skeleton. The skeletons of a host are aligned one after the other into
the host's wrapper, a union-free expression: what both streams have is one
text slot, what only one has becomes optional, folded runs stay repeated. Each
slot keeps how many pages have it, its text and link characters, and whether
its text is ever different. Tasks fold skeletons before any shuffle; a
host's are folded in shares by the skeleton's hash, then the shares'
wrappers are folded, row by row from a sorted partition, so that no task holds
a host's pages.

Every page is then aligned with its host's wrapper. Slots within menus,
headers, footers, sidebars, notices, adverts, forms and reader comments go, as
element names, roles and class names tell; so do slots that hold the template's own words (the same
on all pages, where others differ) and, where nothing marks the article, slots
of links and those outside the element that holds most of the text.

Defined cases: a null or empty page gives an empty text; a null or odd URL has
the host ''; a page whose host has no other is its own wrapper; unclosed and
crossed elements end with the element around them; an unclosed comment, script
or style takes the rest of the page; unknown character references stay as they
are; repeated rows give a row each; an empty table gives no rows; texts are
never cut; other columns are ignored.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Element names of the HTML standard by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template iframe noframes noembed svg canvas object audio video".split())
#: Elements that a start tag of the key ends, and those that no such implied end crosses.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
CLOSED_BY_BLOCKS = ("p",)
WALLS = frozenset("html body div section article main aside nav header footer form table ul ol dl blockquote td th figure details".split())
#: Words of element names, roles, ids and classes that mark what is not the article.
ASIDE = frozenset(
    "nav navbar navigation menu menubar toolbar breadcrumb breadcrumbs pagination pager toc header masthead banner topbar footer contentinfo copyright colophon aside sidebar rail complementary widget related recommended trending popular "
    "notice notices cookie cookies consent gdpr alert alertdialog dialog popup modal overlay toast disclaimer newsletter subscribe signup paywall ad ads advert adverts advertisement sponsor sponsored promo promoted adsense "
    "form login search comment comments respond reply replies disqus discussion share sharing social hidden button select textarea datalist optgroup option head title".split()
)
#: Of these, names that hold whatever they contain.
ALWAYS = frozenset("nav footer head title button select textarea datalist option hidden".split())
ARTICLE = ("article", "articlebody", "articlecontent", "postcontent", "postbody", "entrycontent", "storybody", "articletext")
BODY = ("main", "content", "post", "entry", "story", "maincontent", "pagecontent")
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dd dt figcaption".split())
#: Longest repeated group, in slots.
LONGEST_GROUP = 8
#: A slot's text is the template's own if this many pages have it and all alike.
SAME_ON = 3
#: Share of a page's text that the article's element has to hold.
MOST, HALF = 0.6, 0.4
#: Shares of a host whose wrappers are inferred side by side.
SHARES = 32
#: Slots a task keeps before it hands its tally on; alignments a task remembers; largest table of an alignment.
TALLY, REMEMBERED, TABLE = 200_000, 5_000, 4_000_000
#: Bytes of all wrappers up to which they are broadcast.
SMALL = 16 << 20
#: A host of more than this share of all pages has its wrapper broadcast; there are at most 1 / HEAVY_SHARE.
HEAVY_SHARE = 0.001

MARKUP = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
PARTS = re.compile(r"[^\W_\d]+")
WRAPPER = "host string, share int, tokens string, pages long, stats array<long>"
#: Numbers of a slot: pages that have it, blocks, characters, characters in links, least and greatest hash of its text.
NUMBERS = 6


@lru_cache(REMEMBERED)
def label(name: str, attributes: str) -> str:
    """An element's name with what its attributes tell: words of class, id, role and itemprop (digits as 0), and whether it is hidden."""
    if not attributes.strip(" /\n\t"):
        return name
    words = []
    for k, v in ATTRIBUTE.findall(attributes):
        k, v = k.lower(), v.strip("\"'")
        if k in ("class", "id", "role", "itemprop"):
            words += re.sub(r"\d+", "0", v).split()
        elif (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)) or (k == "aria-hidden" and v.lower() == "true"):
            words.append("hidden")
    if re.search(r"(?:^|\s)hidden(?=\s|/|$|=)", attributes):
        words.append("hidden")
    return ".".join([name, *dict.fromkeys(words)]).replace(">", "").replace("\n", "")


@lru_cache(REMEMBERED)
def marks(of: str) -> frozenset[str]:
    """Lower-case words of a label: its name, and the parts of its class names, also joined two by two."""
    name, *classes = of.split(".")
    out = {name}
    for c in classes:
        parts = [p.lower() for x in PARTS.findall(c) for p in re.sub(r"([a-z])([A-Z])", r"\1 \2", x).split()]
        out.update(parts)
        out.update(a + b for a, b in zip(parts, parts[1:]))
    return frozenset(out)


def blocks(html: str) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of a page's text blocks in page order; white space is one space."""
    out: list[tuple[str, str, int]] = []
    stack: list[str] = []
    names: list[str] = []
    text: list[str] = []
    skipped: list[str] = []
    link, linked, at = 0, 0, 0

    def end():
        nonlocal linked
        if text:
            t = " ".join("".join(text).split())
            if t:
                out.append((">".join(stack), t, min(linked, len(t))))
            text.clear()
        linked = 0
        skipped.clear()

    def pop(i: int):
        end()
        del stack[i:], names[i:]

    while True:
        m = MARKUP.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece and not skipped:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if link:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                link = max(0, link - 1)
            if name in INLINE:
                if skipped and skipped[-1] == name:
                    skipped.pop()
            elif name == "br":
                text.append("\n")
            elif name in names:
                for i in range(len(names) - 1, -1, -1):
                    if names[i] == name:
                        pop(i)
                        break
                    if name in PROSE and names[i] in WALLS:
                        break
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
            continue
        if name in INLINE:
            if name == "a":
                link += 1
            if m[3] and ("=" in m[3] or "hidden" in m[3]) and marks(label(name, m[3])) & ASIDE:
                skipped.append(name)
            elif skipped and skipped[-1] == name:
                skipped.append(name)
            continue
        if name in VOID:
            if name == "br":
                text.append("\n")
            elif name == "hr":
                end()
            continue
        ended = ENDS.get(name, ())
        for i in range(len(names) - 1, -1, -1):
            if names[i] in ended or names[i] in CLOSED_BY_BLOCKS:
                pop(i)
            elif names[i] in WALLS and not (ended and names[i] in ("td", "th")):
                break
        end()
        stack.append(label(name, m[3]))
        names.append(name)
        link = 0
    end()
    return out


def folded(paths: list[str]) -> tuple[list[str], list[int]]:
    """The stream with repeated groups of up to LONGEST_GROUP slots written once, and the slot of each block."""
    tokens, slot = list(paths), list(range(len(paths)))
    changed = True
    while changed:
        changed = False
        for unit in range(1, LONGEST_GROUP + 1):
            kept: list[str] = []
            to: list[int] = []
            i, n = 0, len(tokens)
            while i < n:
                group = tokens[i : i + unit]
                k = i + unit
                while len(group) == unit and tokens[k : k + unit] == group:
                    k += unit
                if k > i + unit:
                    base = len(kept)
                    kept += group
                    to += [base + j % unit for j in range(k - i)]
                    i = k
                else:
                    to.append(len(kept))
                    kept.append(tokens[i])
                    i += 1
            if len(kept) < n:
                changed = changed or unit > 1
                tokens, slot = kept, [to[s] for s in slot]
    return tokens, slot


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """(place in ``a``, place in ``b``) of a longest common subsequence."""
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = [(i, i) for i in range(head)]
    if x and y:
        if len(x) * len(y) > TABLE:
            inner = [(m.a + i, m.b + i) for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for i in range(m.size)]
        else:
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(len(x) - 1, -1, -1):
                row, below = best[i], best[i + 1]
                for j in range(len(y) - 1, -1, -1):
                    row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
            inner, i, j = [], 0, 0
            while i < len(x) and j < len(y):
                if x[i] == y[j]:
                    inner.append((i, j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        both += [(head + i, head + j) for i, j in inner]
    return both + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def added(a: list[int], b: list[int]) -> list[int]:
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], min(a[4], b[4]), max(a[5], b[5])]


class Wrapper:
    """Slots (paths) with their numbers, and the pages they come from. A slot that not all pages have is optional."""

    def __init__(self, tokens: list[str], stats: list[list[int]], pages: int):
        self.tokens, self.stats, self.pages = tokens, stats, pages

    def merge(self, tokens: list[str], stats: list[list[int]], pages: int) -> None:
        """Take another expression in: common slots are one, all others optional, in the order of both."""
        out_tokens, out_stats, i, j = [], [], 0, 0
        for x, y in [*aligned(self.tokens, tokens), (len(self.tokens), len(tokens))]:
            out_tokens += self.tokens[i:x] + tokens[j:y]
            out_stats += self.stats[i:x] + stats[j:y]
            if x < len(self.tokens):
                out_tokens.append(tokens[y])
                out_stats.append(added(self.stats[x], stats[y]))
            i, j = x + 1, y + 1
        self.tokens, self.stats, self.pages = out_tokens, out_stats, self.pages + pages

    def expression(self) -> str:
        """The wrapper as a regular expression over slots."""
        return " ".join(f"({t} #text)" + ("+" if s[1] > s[0] else "") + ("?" if s[0] < self.pages else "") for t, s in zip(self.tokens, self.stats))


def unflat(stats: list[int]) -> list[list[int]]:
    return [stats[i : i + NUMBERS] for i in range(0, len(stats), NUMBERS)]


def page_stats(page: list[tuple[str, str, int]], slot: list[int], n: int) -> list[list[int]]:
    """Numbers of a page's slots."""
    stats = [[1, 0, 0, 0, 0, 0] for _ in range(n)]
    texts: list[list[str]] = [[] for _ in range(n)]
    for (_, t, linked), s in zip(page, slot):
        x = stats[s]
        x[1] += 1
        x[2] += len(t)
        x[3] += linked
        texts[s].append(t)
    for x, t in zip(stats, texts):
        x[4] = x[5] = xxhash.xxh3_64_intdigest("\n".join(t).encode("utf-8", "replace")) >> 1
    return stats


def chosen(tokens: list[str], stats: list[list[int]]) -> list[bool]:
    """Which slots of a skeleton are the article, by what their paths tell and by the numbers of the host's wrapper."""
    paths = [t.split(">") if t else [] for t in tokens]
    words = {x: marks(x) for p in paths for x in p}
    article, body = frozenset(ARTICLE), frozenset(BODY)
    # elements with an article or a first heading inside are no side matter, whatever their class says
    around = set()
    for p in paths:
        for i, x in enumerate(p):
            if words[x] & article or x.split(".")[0] in ("main", "h1"):
                around.update(tuple(p[:j]) for j in range(1, i + 1))

    def side(p: list[str]) -> bool:
        inside = False
        for i, x in enumerate(p):
            w = words[x] & ASIDE
            name = x.split(".")[0]
            if w and (name in ALWAYS or "hidden" in w):
                return True
            if w and not (w <= {"header"} and inside) and tuple(p[: i + 1]) not in around:
                return True
            inside = inside or name in ("article", "main")
        return False

    free = [not side(p) for p in paths]
    plain = [max(0, s[2] - s[3]) / max(s[0], 1) for s in stats]
    same = [s[0] >= SAME_ON and s[4] == s[5] for s in stats]
    total = sum(t for t, f in zip(plain, free) if f)

    def within(kinds: frozenset[str]) -> tuple[float, tuple[str, ...]]:
        held: dict[tuple[str, ...], float] = {}
        for p, f, t in zip(paths, free, plain):
            if f:
                for i, x in enumerate(p):
                    if words[x] & kinds and x.split(".")[0] not in ("html", "body"):
                        k = tuple(p[: i + 1])
                        held[k] = held.get(k, 0) + t
        return max(((t, k) for k, t in held.items()), key=lambda x: (x[0], -len(x[1])), default=(0.0, ()))

    for kinds in (article, body):
        t, at = within(kinds)
        if at and t > 0 and t >= HALF * total:
            keep = [f and tuple(p[: len(at)]) == at for p, f in zip(paths, free)]
            break
    else:
        at = ()
        free = [f and (s[3] * 2 <= s[2] or "h1" in (p[-1].split(".")[0] if p else "")) for f, s, p in zip(free, stats, paths)]
        varied = [t if f and not c else 0.0 for t, f, c in zip(plain, free, same)]
        weights = varied if any(varied) else [t if f else 0.0 for t, f in zip(plain, free)]
        held: dict[tuple[str, ...], float] = {}
        for p, t in zip(paths, weights):
            for i in range(len(p)):
                k = tuple(p[:i])
                held[k] = held.get(k, 0) + t
        whole = sum(weights)
        deep = max((k for k, t in held.items() if t >= MOST * whole), key=len, default=())
        keep = [f and (tuple(p[: len(deep)]) == deep or p[-1].split(".")[0] == "h1") for p, f in zip(paths, free)]
    # the template's own words: the same on all pages, while the rest of what is kept differs and is longer
    leaf = [p[-1].split(".")[0] if p else "" for p in paths]
    own = [k and c and (x not in PROSE if at else x != "h1") for k, c, x in zip(keep, same, leaf)]
    if any(own) and sum(t for t, k, c in zip(plain, keep, same) if k and not c) > 2 * sum(t for t, o in zip(plain, own) if o):
        keep = [k and not o for k, o in zip(keep, own)]
    return keep


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit(""))


def skeletons(pages: DataFrame) -> DataFrame:
    """Skeletons of (host, html), summed within tasks, with a share of the host by the skeleton's hash."""
    def flush(tally):
        host, share, tokens, n, stats = [], [], [], [], []
        for (h, t), (k, s) in tally.items():
            host.append(h)
            share.append(xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) % SHARES)
            tokens.append(t)
            n.append(k)
            stats.append([x for y in s for x in y])
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(share, pa.int32()), pa.array(tokens, pa.string()), pa.array(n, pa.int64()), pa.array(stats, pa.list_(pa.int64()))], names=["host", "share", "tokens", "pages", "stats"])

    def run(batches):
        tally, size = {}, 0
        for batch in batches:
            html, hosts = batch.column("html"), batch.column("host").to_pylist()
            for i in range(batch.num_rows):
                page = blocks(html[i].as_py())
                if not page:
                    continue
                tokens, slot = folded([b[0] for b in page])
                stats, k = page_stats(page, slot, len(tokens)), (hosts[i], "\n".join(tokens))
                if k in tally:
                    n, old = tally[k]
                    tally[k] = n + 1, list(map(added, old, stats))
                else:
                    tally[k] = 1, stats
                    size += len(tokens)
                    if size >= TALLY:
                        yield flush(tally)
                        tally, size = {}, 0
        if tally:
            yield flush(tally)

    return pages.mapInArrow(run, WRAPPER)


def merged(parts: DataFrame) -> DataFrame:
    """One wrapper for each (host, share) of ``parts``, folded row by row from sorted partitions; its share is 0."""
    def run(batches):
        at, wrapper = None, None

        def done():
            stats = [x for s in wrapper.stats for x in s]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([0], pa.int32()), pa.array(["\n".join(wrapper.tokens)], pa.string()), pa.array([wrapper.pages], pa.int64()), pa.array([stats], pa.list_(pa.int64()))], names=["host", "share", "tokens", "pages", "stats"])

        for batch in batches:
            for r in batch.to_pylist():
                tokens, stats = r["tokens"].split("\n"), unflat(r["stats"])
                if at == (r["host"], r["share"]):
                    wrapper.merge(tokens, stats, r["pages"])
                    continue
                if wrapper is not None:
                    yield done()
                at, wrapper = (r["host"], r["share"]), Wrapper(tokens, stats, r["pages"])
        if wrapper is not None:
            yield done()

    return parts.repartition("host", "share").sortWithinPartitions("host", "share", "tokens").mapInArrow(run, WRAPPER)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, tokens, pages and stats: the wrapper of each host of ``pages`` (host, html)."""
    return merged(merged(skeletons(pages))).drop("share")


def extracted(joined: DataFrame) -> DataFrame:
    """row (as given) and text of (row, html, tokens, stats)."""
    schema = joined.select("row").schema.add("text", "string")

    def run(batches):
        remembered: dict = {}
        for batch in batches:
            html, known, numbers = batch.column("html"), batch.column("tokens"), batch.column("stats")
            texts = []
            for i in range(batch.num_rows):
                page = blocks(html[i].as_py())
                tokens, slot = folded([b[0] for b in page])
                of = known[i].as_py() if page else None
                k = (of, "\n".join(tokens))
                keep = remembered.get(k)
                if keep is None:
                    stats = page_stats(page, slot, len(tokens))
                    if of is not None:
                        all_stats = unflat(numbers[i].as_py())
                        for x, y in aligned(of.split("\n"), tokens):
                            stats[y] = all_stats[x]
                    keep = chosen(tokens, stats)
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    remembered[k] = keep
                texts.append(" ".join(b[1] for b, s in zip(page, slot) if keep[s]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return joined.select("row", "html", "tokens", "stats").mapInArrow(run, schema)


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every row of ``pages``."""
    rows = pages.select(F.struct(F.col(key).alias("key"), F.col(url).alias("url")).alias("row"), host_of(F.col(url).cast("string")).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    known = written(wrappers(rows.select("host", "html")), "wrappers")
    size = known.agg(F.sum(F.length("tokens") * 4 + F.size("stats") * 8), F.sum("pages")).first()
    of = known.select("host", "tokens", "stats")
    if (size[0] or 0) <= SMALL:
        joined = rows.join(F.broadcast(of), "host", "left")
    else:
        heavy = F.col("pages") > HEAVY_SHARE * size[1]
        few = F.broadcast(known.where(heavy).select("host", "tokens", "stats"))
        joined = rows.join(few, "host").unionByName(rows.join(few.select("host"), "host", "left_anti").join(known.where(~heavy).select("host", "tokens", "stats"), "host", "left"))
    return extracted(joined).select(F.col("row.key").alias(key), F.col("row.url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
