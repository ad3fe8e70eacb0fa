"""HTML extraction by union-free wrappers.

Each page becomes a token stream of block elements and text slots. The streams of a host's pages are aligned one after
another: equal tokens match, adjacent repeats become repeated groups, what only one side has becomes optional, and
texts become slots. The result is a union-free regular expression, the wrapper of the host. Each slot of it gathers
what all pages have there: texts, characters, characters in links or in furniture by name, and a sketch of how many
different texts (the lowest hashes). A page is read by aligning its own stream with its host's wrapper: its text is in
the wrapper's article slots.

Which slots these are: a slot is a template's if its texts are the same ones on many pages, and links if most of it is
linked; the text that is left has its mass in one part of the wrapper, found by going down from the root while one
single container holds most of it. Names of elements, classes and roles count as evidence beside that, not against it:
where slots of furniture by name, or repeated ones, hold most of a host's text, that evidence is dropped. A class names
furniture if it is made of such words alone. Inside that part, linked texts that are there once are the
article's, and a heading that recurs goes with what it heads.

Scale: a task emits one row for each different stream of a host, with its slots' sums. Rows of a host are aligned in
groups of about `FAN`, the results again, until a host's are few; so a hot host is split and never in one task as a
whole. Wrappers are written to the shared folder and joined to the pages; Spark broadcasts them only if that table is
below its threshold, and can split the join of a hot host otherwise.

Defined results: a null page is an empty one (text ''); a null or odd url gives the host ''; elements nested deeper
than `DEEP` bound blocks but are no tokens, so their text is their ancestor's; a part of a page that its wrapper does
not match is text where the wrapper's parts around it are; a page of which its wrapper reads nothing is read by the one
that it makes alone; repeated pages give repeated rows and count once as evidence; an `a` without href is no link, and a link ends with its
block at the latest. Two lists of siblings are aligned with a bit for each pair, after their equal ends.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|math|select|object|canvas)\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*>|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>",
    re.S | re.I,
)
HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's elements by kind.
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary dialog center head hr menu search hgroup".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
BOILER = frozenset("nav header footer aside form head menu dialog search button label input fieldset".split())
BOXES = frozenset("html body article main section div td center dd table tbody tr form details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"html", "body"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Words that name page furniture in class, id and role attributes, and words that go with them.
FURNITURE = frozenset("ad ads advert adverts advertisement adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notification alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo masthead header comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe signup login popup modal overlay widget pagination pager search skip hidden".split())
BESIDE = frozenset("site page main top bottom left right global primary secondary print list item items box bar wrap wrapper container area block inner outer content link links button buttons icon icons media tools posts articles stories slot label form section body text".split()) - {"section", "body", "text"}

DEEP = 48  # levels of elements that are tokens
FAN = 64  # streams of a host that are aligned in one group
SKETCH = 16  # hashes that a slot keeps
SHARE, FEW = 0.1, 10  # a slot with fewer different texts a page is a template's, on so many pages at least
MOST = 0.6  # of the mass that the container of the text holds

# A wrapper is a list of nodes [token, optional?, repeated?, children, slot]; "#" is a text slot and "()" a repeated
# group. A slot is [texts, characters, of them in links, of them in furniture by name, lowest hashes, blocks of the page].


def furniture(name: str) -> bool:
    """Whether one of the names in an attribute is made of furniture's words: site-header is, section-header is not."""
    for x in name.lower().split():
        parts = [w for w in re.split(r"[^a-z]+", x) if w]
        if any(w in FURNITURE for w in parts) and all(w in FURNITURE or w in BESIDE or len(w) < 3 for w in parts):
            return True
    return False


def parse(page: str) -> tuple[list[str], list]:
    """The page's text blocks, and its token stream as a folded tree whose slots name the blocks."""
    root: list = []
    stack = [("", False, root)]  # tag, in furniture by name, children
    blocks: list[str] = []
    text: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                _, named, children = stack[-1]
                if not children or children[-1][0] != "#":
                    children.append(["#", 0, 0, [], [0, 0, 0, 0, [], []]])
                n = len(joined)
                merge(children[-1][4], [1, n, min(links, n), n * named, [xxhash.xxh3_64_intdigest(joined) >> 12], [len(blocks)]])
                blocks.append(joined)
        links = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            links += len(piece) * (in_link > 0)
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = int(not m["close"] and HREF.search(m["attrs"] or "") is not None)
        elif tag in BLOCKS:
            in_link = 0  # a link ends with its block, or one that is left open would hold the rest of the page
        if m["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                flush()
                del stack[depth:]
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            flush()
            continue
        names = [x.lower() if k.lower() != "itemprop" else x for k, *xs in NAMES.findall(m["attrs"]) if (x := "".join(xs).strip())] if m["attrs"] else []
        named = tag in BOILER or tag not in HEADINGS and tag != "p" and any(map(furniture, names)) or "hidden" in m["attrs"].split()
        if tag in VOID or tag not in BLOCKS and not named:
            continue
        flush()
        if tag in CLOSES_P and stack[-1][0] == "p":
            stack.pop()
        if tag in ENDS:
            same, bound = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bound:
                    break
                if stack[k][0] in same:
                    del stack[k:]
                    break
        _, above, children = stack[-1]
        if len(stack) <= DEEP:
            sig = tag + "".join(f"[{re.sub(r'[0-9]+', '', x)[:40]}]" for x in names)
            node = [sig, 0, 0, [], None]
            children.append(node)
            children = node[3]
        if tag != "hr" and not m["attrs"].endswith("/"):
            stack.append((tag, above or named, children))
    if at < len(page):
        text.append(page[at:])
    flush()
    return blocks, fold(root)


def merge(a: list, b: list) -> None:
    """Add the slot b to the slot a."""
    for k in range(4):
        a[k] += b[k]
    a[4] = sorted({*a[4], *b[4]})[:SKETCH]
    a[5] += b[5]


def combine(a: list, b: list) -> list:
    if a[4]:
        slot = [*a[4][:5], list(a[4][5])]
        merge(slot, b[4])
        return [a[0], a[1] | b[1], a[2] | b[2], [], slot]
    return [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3]), None]


def name(node: list) -> str:
    return node[0] if node[0] != "()" else "(" + " ".join(map(name, node[3])) + ")"


def fold(nodes: list) -> list:
    """Adjacent repeats become repeated groups, of one element or of two or three in turn."""
    return grouped([[*node[:3], fold(node[3]), node[4]] for node in nodes])


def grouped(nodes: list) -> list:
    out: list = []
    for node in nodes:
        if out and name(out[-1]) == name(node):
            out[-1] = combine(out[-1], node)
            out[-1][2] = int(node[0] != "#")
        else:
            out.append(node)
    for period in (2, 3):
        i = 0
        while i + 2 * period <= len(out):
            names = [name(x) for x in out[i : i + period]]
            if len(set(names)) > 1 and names == [name(x) for x in out[i + period : i + 2 * period]]:
                group = [combine(a, b) for a, b in zip(out[i : i + period], out[i + period : i + 2 * period], strict=True)]
                end = i + 2 * period
                while names == [name(x) for x in out[end : end + period]]:
                    group = [combine(a, b) for a, b in zip(group, out[end : end + period], strict=True)]
                    end += period
                out[i:end] = [["()", 0, 1, group, None]]
            i += 1
    return out


def matched(xs: list, ys: list) -> list[tuple]:
    """Two streams by their longest common subsequence: pairs of nodes, None where a side has none."""
    a, b = [name(x) for x in xs], [name(y) for y in ys]
    if a == b:
        return list(zip(xs, ys, strict=True))
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((k for k in range(most) if a[-1 - k] != b[-1 - k]), most)
    n, m = len(a) - head - tail, len(b) - head - tail
    # one bit for each place of b, from its end: 0 where the subsequence of what follows in a grows there by one
    where: dict[str, int] = {}
    for k in range(m):
        where[b[head + m - 1 - k]] = where.get(b[head + m - 1 - k], 0) | 1 << k
    full = (1 << m) - 1
    rows = [full]
    for i in range(n - 1, -1, -1):
        same = rows[-1] & where.get(a[head + i], 0)
        rows.append((rows[-1] + same | rows[-1] - same) & full)
    rows.reverse()

    def best(i: int, j: int) -> int:
        return m - j - (rows[i] & (1 << m - j) - 1).bit_count()

    out, i, j = list(zip(xs[:head], ys[:head], strict=True)), 0, 0
    while i < n or j < m:
        x, y = head + i, head + j
        if i < n and j < m and a[x] == b[y]:
            out.append((xs[x], ys[y]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best(i + 1, j) >= best(i, j + 1):
            out.append((xs[x], None))
            i += 1
        else:
            out.append((None, ys[y]))
            j += 1
    return out + list(zip(xs[head + n :], ys[head + m :], strict=True))


def align(xs: list, ys: list) -> list:
    """The wrapper of two streams; what is in one only becomes optional."""
    pairs = matched(xs, ys)
    out = [combine(x, y) if x and y else [(x or y)[0], 1, *(x or y)[2:]] for x, y in pairs]
    return out if all(x and y for x, y in pairs) else grouped(out)


def expression(nodes: list) -> str:
    """The wrapper as a regular expression over tags; #TEXT is a slot."""
    parts = []
    for token, optional, repeated, children, _ in nodes:
        inner = expression(children)
        body = "#TEXT" if token == "#" else inner if token == "()" else f"<{token}>{inner}</{token.split('[')[0]}>"
        mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[optional, repeated]
        parts.append(f"({body}){mark}" if mark else body)
    return "".join(parts)


def different(hashes: list[int]) -> float:
    """How many different ones, from the lowest hashes (of 52 bits)."""
    return len(hashes) if len(hashes) < SKETCH else (SKETCH - 1) * 2**52 / (hashes[-1] + 1)


def decide(nodes: list, pages: list[int]) -> list:
    """The wrapper with, in place of each slot's sums, whether it is the article's. pages: lowest hashes of the pages."""
    count = different(pages)

    def value(slot: list, evidence: tuple[bool, bool]) -> int:
        """Characters of a slot that may be the article's: none of a template's, of links, or of furniture by name."""
        _, chars, linked, named, hashes, _ = slot
        by_name, by_texts = evidence
        if by_texts and count >= FEW and different(hashes) < max(1.5, SHARE * count):
            return 0
        return 0 if by_name and named else max(0, chars - 2 * linked)

    def mass(node: list, evidence: tuple) -> int:
        return value(node[4], evidence) if node[4] else sum(mass(x, evidence) for x in node[3])

    root = ["", 0, 0, nodes, None]
    every = mass(root, (False, False))
    evidence = next((e for e in ((True, True), (True, False), (False, True)) if 2 * mass(root, e) >= every), (False, False))
    at = root
    while at[3]:
        boxes = [x for x in at[3] if not x[4] and x[0] != "()" and not x[2] and re.match(r"\w+", x[0])[0] in BOXES]
        best = max(boxes, key=lambda x: mass(x, evidence), default=None)
        titles = any(x is not best and not x[4] and re.sub(r"\[.*", "", x[0]) in HEADINGS and mass(x, evidence) for x in at[3])
        if best is None or titles or mass(best, evidence) < MOST * max(1, mass(at, evidence)):
            break
        at = best

    def own(slot: list) -> bool:
        """Whether a slot in the container is the article's: linked text is, where most of it is there only once."""
        texts, chars, _, named, hashes, _ = slot
        once = count >= FEW and 2 * different(hashes) >= texts and not (evidence[0] and named)
        return bool(value(slot, evidence) or once and chars)

    def marked(xs: list, inside: bool, group: bool = False) -> list:
        out = [[*x[:3], marked(x[3], inside or x is at, x[0] == "()"), inside and own(x[4]) if x[4] else None] for x in xs]
        heads = [re.sub(r"\[.*", "", x[0]) in HEADINGS for x in xs]
        for k in range(len(xs)) if inside else ():  # a heading that recurs goes with what follows it, in a group in turn
            headed = [y for y, is_head in zip(out, heads) if not is_head] if group else out[k + 1 : k + 2]
            if heads[k] and any(map(has_article, headed)):
                out[k][3] = [[*x[:4], not (evidence[0] and x[4][3])] if x[4] else y for x, y in zip(xs[k][3], out[k][3], strict=True)]
        return out

    return marked(nodes, at is root)


def has_article(node: list) -> bool:
    return bool(node[4]) or any(map(has_article, node[3]))


def article_blocks(page: list, wrapper: list) -> list[int]:
    """The numbers of the page's blocks that are in the wrapper's article slots."""
    out: list[int] = []

    def every(node: list) -> None:
        if node[4]:
            out.extend(node[4][5] if not node[4][3] else [])
        for x in node[3]:
            every(x)

    def read(xs: list, ys: list) -> None:
        here = any(y[4] for y in ys) or sum(map(has_article, ys)) > 1  # not on the way to the container
        for x, y in matched(xs, ys):
            if x and y:
                if x[4]:
                    out.extend(x[4][5] if y[4] else [])
                else:
                    read(x[3], y[3])
            elif x and here:
                every(x)

    read(page, wrapper)
    return sorted(out)


def main_text(page: str, wrapper: list) -> str:
    """The page's blocks in the article slots of the wrapper, joined by newlines."""
    blocks, tree = parse(page)
    found = article_blocks(tree, wrapper)
    if not found and blocks:
        found = article_blocks(tree, decide(tree, [0]))
    return "\n".join(blocks[k] for k in found)


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def bare(nodes: list) -> list:
    """A page's stream without the numbers of its blocks."""
    return [[*x[:3], bare(x[3]), [*x[4][:5], []] if x[4] else None] for x in nodes]


def shape(nodes: list) -> str:
    return "".join(f"{x[0]}{'?' * x[1]}{'+' * x[2]}({shape(x[3])})" for x in nodes)


def aligned(streams: list[tuple[list, list]]) -> tuple[list, list]:
    """(wrapper, lowest hashes of the pages) of several, in an order that does not depend on how they came."""
    streams = sorted(streams, key=lambda s: (shape(s[0]), json.dumps(s)))
    wrapper, pages = streams[0]
    for tree, more in streams[1:]:
        wrapper, pages = align(wrapper, tree), sorted({*pages, *more})[:SKETCH]
    return wrapper, pages


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, slots) for each host: its wrapper as an expression, and as JSON with its article slots marked."""
    src = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))

    def dump(stream: tuple) -> str:
        return json.dumps(stream, separators=(",", ":"))

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found: dict = {}
            seen: set = set()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = xxhash.xxh3_64_intdigest(page) >> 12
                if (host, key) in seen:
                    continue
                seen.add((host, key))
                tree = bare(parse(page)[1])
                one = (host, shape(tree))
                found[one] = aligned([found[one], (tree, [key])]) if one in found else (tree, [key])
            return {"host": [h for h, _ in found], "stream": [dump(x) for x in found.values()]}

        return f

    def together(rows: pa.Table) -> pa.Table:
        return pa.table({"host": rows.column("host")[:1], "stream": pa.array([dump(aligned([tuple(json.loads(x)) for x in rows.column("stream").to_pylist()]))])})

    parts = written(map_rows(src, "host string, stream string", make), "streams")
    rounds = 0
    while (most := parts.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]) > FAN:
        rounds += 1  # dealt anew in each round, alike however the rows came
        salt = F.pmod(F.xxhash64("stream", F.lit(rounds)), F.lit(-(-most // FAN)))
        parts = written(parts.groupBy("host", salt.alias("salt")).applyInArrow(together, "host string, stream string"), "streams")
    hosts = parts.groupBy("host").applyInArrow(together, "host string, stream string")

    def make_wrapper():
        def f(batch: pa.RecordBatch) -> dict:
            found = [json.loads(s) for s in batch.column(1).to_pylist()]
            return {"host": batch.column(0), "wrapper": [expression(w) for w, _ in found], "slots": [dump(decide(w, p)) for w, p in found]}

        return f

    return map_rows(hosts, "host string, wrapper string, slots string", make_wrapper)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, host) for each page."""
    wrappers = written(infer_wrappers(pages, url_col, html_col).select("host", "slots"), "wrappers")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), F.coalesce(F.col(html_col), F.lit("")).alias("page"), host_of(url_col).alias("host"))
    kind, ukind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def make():
        known: dict = {}

        def f(batch: pa.RecordBatch) -> dict:
            texts = []
            for page, host, slots in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = json.loads(slots)
                texts.append(main_text(page, known[host]))
            return {id_col: batch.column(0), url_col: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "host": batch.column(3)}

        return f

    return map_rows(src.join(wrappers, "host", "left").select("id", "u", "page", "host", "slots"), f"`{id_col}` {kind}, `{url_col}` {ukind}, text string, n_chars long, host string", make)
