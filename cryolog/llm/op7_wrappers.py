"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of block tags and texts.  The streams of a host are aligned token by token, each token by its place: the
blocks around it.  Where two streams differ, the wrapper takes up an optional group (a block that only some pages have), a
repeated group (a block that comes more than once in its place) or a slot (a place whose texts are not the same); texts
that every page has in a place stay constants of the wrapper.  Aligning is linear in the tokens, does not depend on the
order of pages, and its result is again a wrapper: tasks align what they read, host by host, and only their wrappers are
shuffled and aligned with each other, so a hot host is no large group.  A block with more than MOST_NAMES kinds of blocks
in it tells them apart by tag only from there on.

The smallest container with most of the slots' text is the region of the main text; there, links and blocks with the
names of menus, footers and the like don't count.  A page's main text is what its slots in the region hold: constants and
blocks whose text is nearly all links on the host's pages go.  A host of fewer than LEAST_PAGES different pages has no
constants: there all text counts.  A page without the host's region gives its article or main, or else its body.

A null or empty page has an empty text.  A null or odd address is a host of its own kind, the empty one.  Repeated rows
are pages of their own; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARE, LINKS, LEAST_PAGES, MOST_NAMES, HOSTS_HELD = 0.6, 0.8, 5, 200, 2000

# fixed values of HTML
RAW = "script|style|noscript|template|textarea|svg|iframe|object"
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set("html head body title main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address nav header footer aside form fieldset select option button label details summary dialog menu hr center".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("html body main article section div td".split())
NOISE_TAGS = set("head title nav header footer aside form fieldset select option button label dialog menu".split())
NOISE_WORDS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def stream(page: str) -> Iterator[tuple[str, str, float]]:
    """("<", block, 0), (">", block, 0) and ("T", text, share of it in links) in page order; a block is its tag and its names."""
    stack: list[str] = []
    text: list[str] = []
    linked = within = 0

    def flush() -> Iterator[tuple[str, str, float]]:
        nonlocal linked
        raw = "".join(text)
        if words := html.unescape(raw).split():
            yield "T", " ".join(words), linked / len(raw)
        text.clear()
        linked = 0

    def close(down_to: int) -> Iterator[tuple[str, str, float]]:
        yield from flush()
        while len(stack) > down_to:
            yield ">", stack.pop(), 0

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            text.append(m["text"])
            linked += within * len(m["text"])
            continue
        tag = (m["tag"] or "").lower()
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            within = 0 if m["end"] else 1
        if tag not in BLOCKS or tag in VOID and tag != "hr":
            continue
        tags = [s.partition(" ")[0] for s in stack]
        if m["end"]:
            if tag in tags:
                yield from close(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tags and tags[-1] == "p":
            yield from close(len(stack) - 1)
            tags.pop()
        if tag in CLOSES:
            while tags and tags[-1] in CLOSES[tag]:
                yield from close(len(stack) - 1)
                tags.pop()
        yield from flush()
        if tag == "hr":
            continue
        names = sorted({w for groups in _NAMES.findall(m["rest"] or "") for w in re.findall(r"[a-z]+", "".join(groups).lower())})
        stack.append(" ".join([tag, *names]))
        yield "<", stack[-1], 0
    yield from close(0)


def is_noise(block: str) -> bool:
    tag, *names = block.split(" ")
    return tag in NOISE_TAGS or not NOISE_WORDS.isdisjoint(names)


def place(outer: int, block: str) -> int:
    """Number of the place of ``block`` in the place ``outer``; the page itself is place 0."""
    return xxhash.xxh3_64_intdigest(block, seed=outer) >> 1


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode(errors="replace")) >> 1


class Wrapper:
    """``nodes``: by place, [outer place, block, pages with it, whether it is repeated, characters of its own texts, those
    in links, constants (number of the text: its characters), a few numbers of the pages' texts]."""

    def __init__(self, nodes: dict[int, list] | None = None, by_tag: set[int] | None = None):
        self.nodes, self.by_tag = nodes or {0: [0, "", 0, False, 0, 0.0, {}, []]}, by_tag or set()

    @classmethod
    def of(cls, page: str) -> Wrapper:
        one = cls()
        path, texts = [0], []
        one.nodes[0][2] = 1
        for kind, value, linked in stream(page):
            if kind == "<":
                at = place(path[-1], value)
                if at in one.nodes:
                    one.nodes[at][3] = True
                else:
                    one.nodes[at] = [path[-1], value, 1, False, 0, 0.0, {}, []]
                path.append(at)
            elif kind == ">":
                path.pop()
            else:
                node = one.nodes[path[-1]]
                node[4] += len(value)
                node[5] += linked * len(value)
                node[6][_number(value)] = len(value)
                texts.append(value)
        print_ = [_number("\n".join(texts))]
        for node in one.nodes.values():
            node[7] = print_ if node[6] else []
        return one.narrowed()

    def align(self, other: Wrapper) -> Wrapper:
        """The wrapper of the pages of both."""
        by_tag = self.by_tag | other.by_tag
        out, other = self._told_by(by_tag), other._told_by(by_tag)
        for at, b in other.nodes.items():
            a = out.nodes.get(at)
            if a is None:
                out.nodes[at] = b
            elif not (a[7] and b[7]):  # a place that has texts in one of them only
                full = a if a[7] else b
                out.nodes[at] = [a[0], a[1], a[2] + b[2], a[3] or b[3], *full[4:]]
            else:
                constant = {k: n for k, n in a[6].items() if k in b[6]}
                out.nodes[at] = [a[0], a[1], a[2] + b[2], a[3] or b[3], a[4] + b[4], a[5] + b[5], constant, sorted({*a[7], *b[7]})[:LEAST_PAGES]]
        return out.narrowed()

    def _told_by(self, by_tag: set[int]) -> Wrapper:
        """The wrapper with the blocks in the places ``by_tag`` told apart by their tag only."""
        if by_tag == self.by_tag:
            return self
        new = Wrapper(by_tag=set(by_tag))
        new.nodes[0] = self.nodes[0]
        moved, loose = {0: 0}, {0: False}
        for at, node in self.nodes.items():  # an outer place stands before what is in it
            if not at:
                continue
            outer = moved[node[0]]
            block = node[1].partition(" ")[0] if outer in by_tag else node[1]
            moved[at] = to = place(outer, block)
            loose[at] = loose[node[0]] or outer in by_tag
            known = new.nodes.get(to)
            if known is None:
                new.nodes[to] = [outer, block, *node[2:6], {} if loose[at] else node[6], node[7]]
            else:  # kinds that are one place now have no constants: what is one in some of them need not be in all
                new.nodes[to] = [outer, block, max(known[2], node[2]), True, known[4] + node[4], known[5] + node[5], {}, sorted({*known[7], *node[7]})[:LEAST_PAGES]]
        return new

    def narrowed(self) -> Wrapper:
        out = self
        while True:
            kinds: dict[int, int] = {}
            for at, node in out.nodes.items():
                if at and node[0] not in out.by_tag:
                    kinds[node[0]] = kinds.get(node[0], 0) + 1
            wide = {at for at, n in kinds.items() if n > MOST_NAMES}
            if not wide:
                return out
            out = out._told_by(out.by_tag | {next(at for at in out.nodes if at in wide)})  # the outermost first, then its insides anew

    def dumps(self) -> str:
        return json.dumps([[[at, *node] for at, node in self.nodes.items()], sorted(self.by_tag)])

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        nodes, by_tag = json.loads(text)
        return cls({at: [*node[:6], {int(k): n for k, n in node[6].items()}, node[7]] for at, *node in nodes}, set(by_tag))

    def pattern(self) -> str:
        """The wrapper as a regular expression over blocks: # is a slot, = a constant text."""
        inside: dict[int, list[int]] = {}
        for at, node in self.nodes.items():
            if at:
                inside.setdefault(node[0], []).append(at)

        def shown(at: int) -> str:
            outer, block, pages, many, chars, _, constant, _ = self.nodes[at]
            text = "" if not chars else "=" if sum(constant.values()) * pages == chars else "#"
            some = pages < self.nodes[outer][2]
            return f"<{block}>{text}{''.join(map(shown, inside.get(at, ())))}</>" + ("*" if some and many else "?" if some else "+" if many else "")

        return "".join(map(shown, inside.get(0, ())))

    def rules(self) -> dict:
        """What extraction needs: the region's place, places where blocks are told apart by tag, places whose text is
        nearly all links, and constants in the region, as numbers of place and text."""
        noisy: dict[int, bool] = {0: False}
        weight, chars, links = ({at: 0.0 for at in self.nodes} for _ in range(3))
        slots = {}
        for at, (outer, block, pages, _, n, linked, constant, prints) in self.nodes.items():
            noisy[at] = noisy[outer] or bool(block) and is_noise(block)
            told = len(prints) >= LEAST_PAGES
            slots[at] = 0.0 if noisy[at] else max(0.0, n - linked - (sum(constant.values()) * pages if told else 0))
        for at in reversed(self.nodes):  # inner places before their outer ones
            node = self.nodes[at]
            weight[at] += slots[at]
            chars[at] += node[4]
            links[at] += node[5]
            if at:
                for sums in (weight, chars, links):
                    sums[node[0]] += sums[at]
        region = 0
        for at, node in self.nodes.items():
            if at and node[0] == region and node[1].partition(" ")[0] in CONTAINERS and weight[at] >= SHARE * weight[0] > 0:
                region = at
        inside = {region}
        drop, constants = [], []
        for at, node in self.nodes.items():
            if at != region and node[0] not in inside:
                continue
            if at:
                inside.add(at)
            if at != region and node[1].partition(" ")[0] != "p" and chars[at] and links[at] >= LINKS * chars[at]:
                drop.append(at)
            if len(node[7]) >= LEAST_PAGES:
                constants += [place(at, str(k)) for k in node[6]]
        return {"region": region, "by_tag": sorted(self.by_tag), "drop": drop, "constants": constants}


def extract(page: str, rules: dict | None) -> str:
    """The text of a page's slots in the region of ``rules``; of a page without it, of its article or main, or else of its
    body, without blocks that are noise by name."""
    rules = rules or {"region": 0, "by_tag": [], "drop": [], "constants": []}
    region, by_tag, drop, constants = rules["region"], set(rules["by_tag"]), set(rules["drop"]), set(rules["constants"])
    path, noise = [0], [False]
    inside, own, every, met = [], [], [], not region
    for kind, value, _ in stream(page):
        if kind == "<":
            path.append(place(path[-1], value.partition(" ")[0] if path[-1] in by_tag else value))
            noise.append(noise[-1] or is_noise(value))
            continue
        if kind == ">":
            path.pop()
            noise.pop()
            continue
        if noise[-1]:
            continue
        every.append(value)
        if not region or region in path:
            met = True
            if drop.isdisjoint(path) and place(path[-1], str(_number(value))) not in constants:
                inside.append(value)
    if met and inside or not every:
        return "\n".join(inside)
    names: list[str] = []
    for kind, value, _ in stream(page):
        if kind == "<":
            names.append(value)
        elif kind == ">":
            names.pop()
        elif not any(map(is_noise, names)) and any(n.partition(" ")[0] in ("article", "main") for n in names):
            own.append(value)
    return "\n".join(own or every)


_PARTS = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper of every host of ``pages`` (host, html)."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = Wrapper.of(page or "")
                held[host] = held[host].align(new) if host in held else new
            if len(held) >= HOSTS_HELD:
                yield common.batch(_PARTS, zip(*((h, w.dumps()) for h, w in held.items()), strict=True))
                held = {}
        if held:
            yield common.batch(_PARTS, zip(*((h, w.dumps()) for h, w in held.items()), strict=True))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held = None, None
        for b in batches:
            out = []
            for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held is not None and h == host:
                    held = held.align(Wrapper.loads(w))
                    continue
                if held is not None:
                    out.append((host, held.dumps()))
                host, held = h, Wrapper.loads(w)
            if out:
                yield common.batch(_PARTS, zip(*out, strict=True))
        if held is not None:
            yield common.batch(_PARTS, [[host], [held.dumps()]])

    parts = pages.select("host", "html").mapInArrow(infer, "host string, wrapper string")
    return parts.repartition("host").sortWithinPartitions("host").mapInArrow(gather, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    common.small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    rules_of = pa.schema([("host", pa.string()), ("rules", pa.string())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.batch(rules_of, [b.column(0).to_pylist(), [json.dumps(Wrapper.loads(w).rules()) for w in b.column(1).to_pylist()]])

    rules = common.stored(wrappers(named).mapInArrow(told, "host string, rules string"), "rules")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in batches:
            texts = []
            for page, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if r != last:
                    last, known = r, r and json.loads(r)
                texts.append(extract(page or "", known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], schema=schema)

    joined = named.join(rules, "host", "left").select("page_id", "url", "html", "rules")
    return joined.mapInArrow(scan, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
