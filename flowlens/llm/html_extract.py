"""Main text of web pages by union-free wrapper inference.

The layouts of all pages of a host are aligned.  A page is a tree of elements
whose leaves are text slots (runs of text with its inline mark-up and
paragraphs).  Equal neighbours are folded into repeated groups, the folded
sequences are aligned, and what one page has and the other has not becomes
optional.  What results is a wrapper: a regular expression without unions over
elements and text slots.  Of the host's pages each different layout is aligned
once, in groups of a few, then what they gave, until one is left.

The wrapper decides which slots hold the article: texts that most of a host's
pages share in the same place are constants of its template, and the article is
the element that gathers the varying text outside of links.  In an element that
is marked as the article a constant stays, unless it is mostly links or stands
in an element for promotion.  A page that the wrapper does not fit, as one is too
long to align, is cut at the same element.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize, spread

#: Layouts that are aligned in one group, on average.
ALIGNED = 64
#: Longest group of neighbours that is folded as a repeat; cells of a table of alignment or matching; nesting that is kept apart.
PERIOD, CELLS, DEPTH = 6, 400_000, 60
#: Wrappers that are broadcast, and their characters, at most.
WRAPPERS, WRAPPER_CHARS = 2000, 64 << 20
#: A text belongs to the template if this share of the host's pages have it, of so many different ones at least.
SHARED, DIFFERENT = 0.8, 3
#: Share of an element's text that the element inside it must hold for the article to lie there.
HOLDS = 0.6

#: Elements without content, elements whose content is no markup,
#: elements that do not end a block, elements that hold no article text,
#: elements that a sibling closes (with those that hold them), containers, and
#: names that pages give to elements beside the article or to comments on it.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg".split())
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = set("head nav footer aside form menu button select option dialog".split())
SIBLINGS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr", "option": "select"}
CONTAINERS = set("html body main article section div table tbody tr td center".split())
NAMES = set(
    "ad ads advert advertisement adverts sponsored sidebar navbar navigation breadcrumb breadcrumbs "
    "comment comments comment-list comments-area cookie-banner cookie-consent newsletter newsletter-signup".split()
)
#: Parts of names of reader comments, and of those who wrote one; elements that such names say nothing
#: about; names of elements for promotion, where a constant is no article text.
COMMENT, WRITER, WHOLE = {"comment", "comments"}, {"author", "user", "username", "commenter", "avatar"}, {"html", "body", "main", "article"}
PROMOTION = set("share social related promo promotion subscribe signup follow newsletter".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# --- trees ------------------------------------------------------------------


class Element:
    """A label (tag and first class), children, and whether something in it names a writer; children are elements and runs."""

    __slots__ = ("label", "named", "children", "signed")

    def __init__(self, label: str, named: bool = False):
        self.label, self.named, self.children, self.signed = label, named, [], False

    @property
    def tag(self) -> str:
        return self.label.split(".")[0]


class Run:
    """Text between two tags that matter: its blocks, how many of its characters are in links, and a hash of place and text."""

    __slots__ = ("blocks", "linked", "chars", "hash")

    def __init__(self, blocks: list[str], linked: int, place: str = ""):
        self.blocks, self.linked = blocks, linked
        self.chars = sum(map(len, blocks))
        self.hash = xxhash.xxh64_intdigest("\n".join([place, *blocks]).encode("utf-8", "surrogatepass")) >> 1

    @property
    def links(self) -> bool:
        return 2 * self.linked >= self.chars


def tree(page: str | None) -> Element:
    """The page's elements and runs.  Comments, declarations, raw content and a tag cut off by the end are left out."""
    page = page or ""
    root = Element("")
    path, own, blocks, links, linked = [root], [], [], 0, 0

    def end_block() -> None:
        block = " ".join("".join(own).split())
        own.clear()
        if block:
            blocks.append(block)

    def end_run() -> None:
        nonlocal linked, blocks
        end_block()
        if blocks:
            path[-1].children.append(Run(blocks, linked, " ".join(e.label for e in path)))
        blocks, linked = [], 0

    def close(tag: str) -> None:
        for depth in range(len(path) - 1, 0, -1):
            if path[depth].tag == tag:
                end_run()
                del path[depth:]
                return

    at, n = 0, len(page)
    while at < n:
        piece = _TOKEN.match(page, at).group()
        at += len(piece)
        found = _NAME.match(piece)
        if not found:
            if piece[:2] not in ("<!", "<?"):
                text = html.unescape(piece)
                own.append(text)
                linked += len(text.strip()) if links else 0
            continue
        if piece[-1] != ">":
            break
        tag, ends = found.group(1).lower(), piece[1] == "/"
        if tag == "a":
            links = 0 if ends else 1
        if tag in RAW and not ends:
            if piece[-2:] != "/>":
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if tag in INLINE:
            path[-1].signed |= not ends and "class" in piece and _signed(_attributes(piece))
            continue
        if tag in VOID:
            end_block()
            continue
        if ends:
            close(tag)
            end_block()
            continue
        values = _attributes(piece)
        named = any(w in NAMES for words in values.values() for w in words) or tag not in WHOLE and any(_parts(w) & COMMENT for words in values.values() for w in words)
        if path[-1].tag == "p":
            close("p")
        if tag == "p" and not named:
            end_block()
            continue
        if tag in SIBLINGS:
            for e in reversed(path):
                if e.tag == tag or tag in ("dt", "dd") and e.tag in ("dt", "dd") or tag in ("td", "th") and e.tag in ("td", "th"):
                    close(e.tag)
                    break
                if e.tag in SIBLINGS[tag].split():
                    break
        if tag == "body":
            close("head")
        if len(path) > DEPTH:
            end_block()
            continue
        end_run()
        first = re.sub(r"\d+", "", values["class"][0]) if values.get("class") else ""
        path[-1].children.append(Element(f"{tag}.{first}" if first else tag, named))
        path.append(path[-1].children[-1])
        path[-1].signed = tag not in WHOLE and _signed(values)
    end_run()
    _find_comments(root, False)
    return root


def _attributes(piece: str) -> dict[str, list[str]]:
    return {k.lower(): (a or b or c).lower().split() for k, a, b, c in _ATTRIBUTE.findall(piece)}


def _parts(word: str) -> set[str]:
    """First and last part of a name."""
    parts = re.split("[-_]", word)
    return {parts[0], parts[-1]}


def _signed(values: dict[str, list[str]]) -> bool:
    return any(_parts(w) & WRITER for w in values.get("class", ()))


def _find_comments(e: Element, inside: bool) -> bool:
    """Marks reader comments: neighbours of one kind in an article that each hold a writer and a text.  Returns whether ``e`` names a writer."""
    inside |= e.tag in ("article", "main")
    inner = [c for c in e.children if isinstance(c, Element)]
    signed = [_find_comments(c, inside) for c in inner]
    alike: dict[str, list[Element]] = {}
    for c, writer in zip(inner, signed, strict=True):
        if inside and writer and c.tag not in WHOLE:
            alike.setdefault(c.label, []).append(c)
    for group in alike.values():
        if len(group) > 1 and all(sum(len(r.blocks) for r in runs(c)) > 1 for c in group):
            for c in group:
                c.named = True
    return e.signed or any(signed)


def runs(e: Element) -> Iterator[Run]:
    for c in e.children:
        if isinstance(c, Run):
            yield c
        else:
            yield from runs(c)


# --- wrappers ---------------------------------------------------------------
# An item is [kind, how often, label, body]: kind "#" a slot, "=" a constant of the template, "e" an element
# with its body, "g" a group of neighbours; how often "" once, "?" at most once, "*" any number.  Slots get a
# number, then whether they are kept, as their body.


def _sign(item: list) -> str:
    return f"({' '.join(map(_sign, item[3]))})" if item[0] == "g" else item[0] + item[2]


def _folded(e: Element, constants: frozenset[int]) -> list[list]:
    items = []
    for c in e.children:
        if isinstance(c, Element):
            items.append(["e", "", c.label + "!" * c.named, _folded(c, constants)])
        elif c.hash in constants:
            items.append(["=", "", str(c.hash), None])
        else:
            items.append(["#", "", "", None])
    return _fold(items)


def _fold(items: list[list]) -> list[list]:
    """Equal neighbours, and neighbouring groups of them, as repeats."""
    signs, out, i = [_sign(x) for x in items], [], 0
    while i < len(items):
        size = next((k for k in range(1, PERIOD + 1) if signs[i : i + k] == signs[i + k : i + 2 * k] and len(signs) >= i + 2 * k and "(" not in "".join(signs[i : i + k])), 0)
        if not size:
            out.append(items[i])
            i += 1
            continue
        body, own = items[i : i + size], signs[i : i + size]
        i += size
        while signs[i : i + size] == own:
            body = [_merged(a, b) for a, b in zip(body, items[i : i + size], strict=True)]
            i += size
        out.append([*body[0][:1], "*", *body[0][2:]] if size == 1 else ["g", "*", "", body])
    return out


def _merged(a: list, b: list) -> list:
    """One item for two of the same sign."""
    often = max(a[1], b[1], key=["", "?", "*"].index)
    if a[0] == "e":
        return ["e", often, a[2], align(a[3], b[3])]
    if a[0] == "g":
        return ["g", often, "", [_merged(x, y) for x, y in zip(a[3], b[3], strict=True)]]
    return [a[0], often, a[2], None]


def align(a: list[list], b: list[list]) -> list[list]:
    """A wrapper for both: equal parts merge, the rest becomes optional.  Parts too long to align are optional whole."""
    signs = [_sign(x) for x in a], [_sign(x) for x in b]
    if len(a) * len(b) <= CELLS:
        steps = SequenceMatcher(None, *signs, autojunk=False).get_opcodes()
    else:
        same = next((i for i, (x, y) in enumerate(zip(*signs)) if x != y), min(len(a), len(b)))
        steps = [("equal", 0, same, 0, same), ("replace", same, len(a), same, len(b))]
    out: list[list] = []
    for kind, i, j, k, m in steps:
        if kind == "equal":
            out += [_merged(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[x[0], x[1] or "?", *x[2:]] for x in (*a[i:j], *b[k:m])]
    return out


def match(items: list[list], e: Element, constants: frozenset[int]) -> list[tuple[Run, list]] | None:
    """The runs below ``e`` with their items; None if the items do not fit it."""
    children, n, m = e.children, len(items), len(e.children)
    if n * m > CELLS:
        return None
    label = [c.label + "!" * c.named if isinstance(c, Element) else None for c in children]

    @lru_cache(maxsize=None)
    def single(key: int, item_at: tuple[int, ...], at: int) -> list | None:
        item = items[item_at[0]] if len(item_at) == 1 else items[item_at[0]][3][item_at[1]]
        child = children[at]
        if item[0] == "e":
            return match(item[3], child, constants) if label[at] == item[2] else None
        if label[at] is not None or (item[0] == "=") != (child.hash in constants) or item[0] == "=" and item[2] != str(child.hash):
            return None
        return [(child, item)]

    def one(i: int, at: int) -> tuple[int, list] | None:
        """What item i takes from child ``at`` on: how many children, and their runs."""
        if items[i][0] != "g":
            found = single(0, (i,), at) if at < m else None
            return None if found is None else (1, found)
        taken: list = []
        for k in range(len(items[i][3])):
            found = single(1, (i, k), at + k) if at + k < m else None
            if found is None:
                return None
            taken += found
        return len(items[i][3]), taken

    after = [j == m for j in range(m + 1)]
    choice: list[list] = []
    for i in range(n - 1, -1, -1):
        often, fits, chosen = items[i][1], [False] * (m + 1), [None] * (m + 1)
        for j in range(m, -1, -1):
            got = one(i, j)
            if got and (fits if often == "*" else after)[j + got[0]]:
                fits[j], chosen[j] = True, got
            elif often and after[j]:
                fits[j] = True
        after = fits
        choice.append(chosen)
    if not after[0]:
        return None
    out, at = [], 0
    for i, chosen in enumerate(reversed(choice)):
        while chosen[at]:
            out += chosen[at][1]
            at += chosen[at][0]
            if items[i][1] != "*":
                break
    return out


# --- what a wrapper keeps ---------------------------------------------------


def _excluded(label: str) -> bool:
    return label.endswith("!") or label.rstrip("!").split(".")[0] in OUTSIDE


def _weigh(items: list[list], mass: dict[int, int]) -> int:
    """Characters of the varying text under the items, outside of links and of elements that hold no article."""
    total = 0
    for x in items:
        if x[0] == "#":
            total += mass.get(x[3], 0)
        elif x[0] in "eg" and not (x[0] == "e" and _excluded(x[2])):
            total += _weigh(x[3], mass)
    return total


def _elements(items: list[list]) -> Iterator[list]:
    for x in items:
        if x[0] == "e":
            yield x
        elif x[0] == "g":
            yield from _elements(x[3])


def _articles(items: list[list]) -> bool:
    return any(not _excluded(x[2]) and (x[2].split(".")[0] in ("article", "main") or _articles(x[3])) for x in _elements(items))


def _promotes(label: str) -> bool:
    return label.rstrip("!").partition(".")[2] in PROMOTION


def _mark(items: list[list], inside: bool, constants: bool = False) -> None:
    """Slots, and constants where told so, get whether they are kept: under the article and in no element that holds other things."""
    for x in items:
        if x[0] in "#=":
            x[3] = inside and (x[0] == "#" or constants)
        elif x[0] == "g":
            _mark(x[3], inside, constants)
        else:
            _mark(x[3], inside and not _excluded(x[2]), constants and not _promotes(x[2]))


def _mark_articles(items: list[list]) -> None:
    for x in items:
        if x[0] in "#=":
            x[3] = False
        elif x[0] == "g":
            _mark_articles(x[3])
        elif _excluded(x[2]):
            _mark(x[3], False)
        elif x[2].split(".")[0] in ("article", "main"):
            _mark(x[3], True, True)
        else:
            _mark_articles(x[3])


def _mark_heaviest(items: list[list], mass: dict[int, int]) -> list[str]:
    """Marks the slots of the innermost container with most of the text; its path of labels."""
    whole, path = _weigh(items, mass), []
    while True:
        inner = [x for x in _elements(items) if x[2].rstrip("!").split(".")[0] in CONTAINERS and not _excluded(x[2])]
        best = max(inner, key=lambda x: _weigh(x[3], mass), default=None)
        if best is None or not whole or _weigh(best[3], mass) < HOLDS * whole or best[1] == "*":
            break
        _mark_others(items, best)
        items, path = best[3], [*path, best[2]]
        whole = _weigh(items, mass)
    beside = lambda x: _top(path) and x[0] == "e" and x[2].split(".")[0] == "header"
    _mark([x for x in items if not beside(x)], True)
    _mark([x for x in items if beside(x)], False)
    return path


def _top(path: list[str]) -> bool:
    """The page itself, where a header is the site's and not the article's."""
    return not path or path[-1].split(".")[0] in ("html", "body")


def _mark_others(items: list[list], but: list) -> None:
    for x in items:
        if x[0] == "g":
            _mark_others(x[3], but)
        elif x is not but:
            _mark([x], False)


def _number(items: list[list], at: int = 0) -> int:
    for x in items:
        if x[0] == "#":
            x[3] = at
            at += 1
        elif x[0] in "eg":
            at = _number(x[3], at)
    return at


def _combined(layouts: Iterable[list[list]]) -> list[list]:
    items: list[list] | None = None
    for own in layouts:
        items = own if items is None else align(items, own)
    return items or []


def _weights(items: list[list], t: Element, constants: frozenset[int]) -> Iterator[tuple[int, int]]:
    """Slots of a page, and characters outside of links in each."""
    for run, item in match(items, t, constants) or []:
        if item[0] == "#":
            yield item[3], max(0, run.chars - run.linked)


def _marked(items: list[list], mass: dict[int, int], constants: frozenset[int]) -> dict:
    path = None
    if _articles(items):
        _mark_articles(items)
    else:
        path = _mark_heaviest(items, mass)
    return {"items": items, "path": path, "constants": sorted(constants)}


def infer(pages: list[str], constants: frozenset[int] = frozenset()) -> dict:
    """The wrapper of a few pages with its slots marked, the article's path, and the constants."""
    trees = [tree(p) for p in dict.fromkeys(pages)]
    items = _combined(_folded(t, constants) for t in trees)
    _number(items)
    mass: dict[int, int] = {}
    for t in trees:
        for slot, chars in _weights(items, t, constants):
            mass[slot] = mass.get(slot, 0) + chars
    return _marked(items, mass, constants)


def _at_path(root: Element, path: list[str]) -> Element:
    for label in path:
        found = next((c for c in root.children if isinstance(c, Element) and c.label + "!" * c.named == label), None)
        if found is None:
            break
        root = found
    return root


def _inside(e: Element, constants: frozenset[int], inside: bool, keep: bool = False) -> Iterator[Run]:
    """Runs of a page that no wrapper fits: those in articles, or all, but for what holds no article; constants where told so."""
    for c in e.children:
        if isinstance(c, Run):
            if inside and (c.hash not in constants or keep and not c.links):
                yield c
        elif not (c.named or c.tag in OUTSIDE or c.tag == "header" and _top([e.label] if e.label else [])):
            marked = c.tag in ("article", "main")
            yield from _inside(c, constants, inside or marked, (keep or marked) and not _promotes(c.label))


def extracted(page: str | None, wrapper: dict | None = None) -> tuple[str, bool]:
    """Blocks of the page's main text, one a line, and whether the wrapper (its own, if none is given) fits it."""
    wrapper = wrapper or infer([page or ""])
    constants, root = frozenset(wrapper["constants"]), tree(page)
    found = match(wrapper["items"], root, constants)
    if found is not None:
        kept = [run for run, item in found if item[3] and not (item[0] == "=" and run.links)]
    elif wrapper["path"] is None:
        kept = list(_inside(root, constants, False))
    else:
        kept = list(_inside(_at_path(root, wrapper["path"]), constants, True))
    return "\n".join(b for run in kept for b in run.blocks), found is not None


def main_text(page: str | None, wrapper: dict | None = None) -> str:
    return extracted(page, wrapper)[0]


# --- Spark ------------------------------------------------------------------


_TEXTS = "__host string, text long, n long, pages long"


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each host and text the pages that hold it, and bits of which different pages these are; text -1 for all pages."""
    for batch in batches:
        seen: dict[tuple[str, int], list[int]] = {}
        for host, page in zip(batch["__host"], batch["html"], strict=True):
            own = list(runs(tree(page)))
            bit = 1 << (max(own, key=lambda r: (r.chars, r.hash)).hash % 63 if own else 0)
            for h in {-1, *(r.hash for r in own)}:
                count = seen.setdefault((host, h), [0, 0])
                count[0] += 1
                count[1] |= bit
        rows = [(host, h, n, bits) for (host, h), (n, bits) in seen.items()]
        yield pd.DataFrame(rows, columns=["__host", "text", "n", "pages"]).astype({"__host": "object", "text": "int64", "n": "int64", "pages": "int64"})


def template_texts(rows: DataFrame) -> DataFrame:
    """__host and constants, the texts that most of its pages share; for hosts that have such."""
    counts = rows.select("__host", "html").mapInPandas(_texts, _TEXTS).groupBy("__host", "text").agg(F.sum("n").alias("n"), F.bit_or("pages").alias("pages"))
    counts = materialize(counts.where("n > 1"), "page-texts")
    whole = counts.where("text = -1").select("__host", F.col("n").alias("all"))
    shared = join_small(counts.where((F.col("text") >= 0) & (F.bit_count("pages") >= DIFFERENT)), whole, ["__host"]).where(F.col("n") >= SHARED * F.col("all"))
    return materialize(shared.groupBy("__host").agg(F.array_sort(F.collect_list("text")).alias("constants")), "templates")


def _constants(values: object) -> frozenset[int]:
    return frozenset() if values is None else frozenset(int(x) for x in values)


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different layouts of a batch: pages with repeats folded, texts left out."""
    for batch in batches:
        found = {(host, json.dumps(_folded(tree(page), _constants(own)))) for host, page, own in zip(batch["__host"], batch["html"], batch["constants"], strict=True)}
        yield pd.DataFrame(sorted(found), columns=["__host", "items"]).astype("object")


def _align_layouts(group: pd.DataFrame) -> pd.DataFrame:
    items = _combined(json.loads(x) for x in sorted(group["items"]))
    return pd.DataFrame({"__host": [group["__host"].iloc[0]], "items": [json.dumps(items)]})


def _aligned(rows: DataFrame) -> DataFrame:
    """__host and items, the layouts of all its pages aligned; ``rows`` with constants."""
    layouts = materialize(rows.select("__host", "html", "constants").mapInPandas(_layouts, "__host string, items string").distinct(), "layouts")
    most, parts = layouts.groupBy("__host").count().agg(F.max("count")).first()[0] or 0, 1
    while parts * ALIGNED < most:
        parts *= ALIGNED
    while True:
        part = F.pmod(F.xxhash64("items"), F.lit(parts)).alias("part")
        layouts = materialize(layouts.groupBy("__host", part).applyInPandas(_align_layouts, "__host string, items string"), "layouts")
        if parts == 1:
            return layouts
        parts //= ALIGNED


def _slot_weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        mass: dict[tuple[str, int], int] = {}
        for host, page, own, wrapper in zip(batch["__host"], batch["html"], batch["constants"], batch["__wrapper"], strict=True):
            for slot, chars in _weights(_loaded(wrapper), tree(page), _constants(own)):
                mass[host, slot] = mass.get((host, slot), 0) + chars
        rows = [(host, slot, chars) for (host, slot), chars in mass.items()]
        yield pd.DataFrame(rows, columns=["__host", "slot", "chars"]).astype({"__host": "object", "slot": "int32", "chars": "int64"})


def _numbered(layouts: pd.Series) -> pd.Series:
    out = []
    for items in map(json.loads, layouts):
        _number(items)
        out.append(json.dumps(items))
    return pd.Series(out, dtype="object")


def _with_articles(layouts: pd.Series) -> pd.Series:
    return pd.Series([_articles(json.loads(x)) for x in layouts], dtype="bool")


def _mark_hosts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for items, own, mass in zip(batch["items"], batch["constants"], batch["mass"], strict=True):
            weights = {} if mass is None else {int(x["slot"]): int(x["chars"]) for x in mass}
            made.append(json.dumps(_marked(json.loads(items), weights, _constants(own))))
        yield pd.DataFrame({"__host": batch["__host"], "__wrapper": made}).astype("object")


@lru_cache(maxsize=4096)
def _loaded(wrapper: str) -> dict:
    return json.loads(wrapper)


_TEXT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = batch[["page_id", "url"]].copy()
        out["text"] = [main_text(page, _loaded(wrapper) if wrapper else None) for page, wrapper in zip(batch["html"], batch["__wrapper"], strict=True)]
        out["n_chars"] = [len(t) for t in out["text"]]
        yield out[["page_id", "url", "text", "n_chars"]]


def _wrapped(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``rows`` with the __wrapper of their host; equal ones of many hosts are told once."""
    number = wrappers.select("__host", F.xxhash64("__wrapper").alias("__w"))
    texts = materialize(wrappers.groupBy(F.xxhash64("__wrapper").alias("__w")).agg(F.first("__wrapper").alias("__wrapper")), "wrapper-texts")
    chars = texts.agg(F.sum(F.length("__wrapper"))).first()[0] or 0
    return join_small(join_small(rows, number, ["__host"], "left"), texts, ["__w"], "left", WRAPPERS if chars <= WRAPPER_CHARS else 0).drop("__w")


def infer_hosts(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """__host and __wrapper, inferred from all its pages; where no article is marked, all of them weigh the slots."""
    known = join_small(rows.where(F.length("html") > 0).select("__host", "html"), templates, ["__host"], "left")
    items = materialize(_aligned(known).select("__host", F.pandas_udf(_numbered, "string")("items").alias("items")), "wrapper-items")
    bare = materialize(items.where(~F.pandas_udf(_with_articles, "boolean")("items")).select("__host", F.col("items").alias("__wrapper")), "bare-wrappers")
    ready = items.join(templates, "__host", "left")
    if bare.isEmpty():
        ready = ready.withColumn("mass", F.lit(None).cast("array<struct<slot int, chars long>>"))
    else:
        weighed = _wrapped(known, bare).where("__wrapper is not null").mapInPandas(_slot_weights, "__host string, slot int, chars long")
        mass = weighed.groupBy("__host", "slot").agg(F.sum("chars").alias("chars"))
        ready = ready.join(mass.groupBy("__host").agg(F.collect_list(F.struct("slot", "chars")).alias("mass")), "__host", "left")
    return materialize(ready.mapInPandas(_mark_hosts, "__host string, __wrapper string"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages, and pages without main text, give an empty text.
    Pages with a null url share one host.  Repeated rows are extracted one by
    one.  An empty table gives an empty result.  Columns other than page_id,
    url and html are ignored.

    A host is never gathered: its template texts and the weights of its slots
    are added up map-side, and of its layouts each different one is aligned.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("__host")))
    wrappers = infer_hosts(rows, template_texts(rows))
    return _wrapped(rows, wrappers).select("page_id", "url", "html", "__wrapper").mapInPandas(_extract, _TEXT)
