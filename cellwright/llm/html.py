"""Main text of web pages by site style trees: what a host repeats across its pages isn't content."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, pieces

#: A branch seen on at least this many pages of a host is removed when its importance is lower than this.
LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.25
#: A marked branch stays that is at least this important and without which the host's pages keep at most this share of their text.
CONTENT_IMPORTANCE, LEFT_AT_MOST = 0.75, 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)"
    r"(?P<attributes>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9]+")
_CUE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without content, with raw content, of their own line, and those that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select xmp noembed noframes".split())
#: Of these, the ones that reach to the page's end when they are never closed, and those that may close themselves.
TO_THE_END, SELF_CLOSING = frozenset("script style textarea title".split()), frozenset(["svg", "math"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_PARAGRAPH = frozenset(["p"])
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())

# Elements, roles and words of class or id that mark what is not the article.
SIDE_TAGS = frozenset("nav aside footer form button dialog menu head search fieldset label".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget comment comments disqus reply "
    "replies share sharing social related recommended newsletter subscribe subscription signup login pagination pager masthead "
    "toolbar skip copyright tags".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tbody tr td th dl dt dd figure figcaption section article main".split())


class Node:
    """An open element. ``path`` is a number for the styles from the page's root down to it, ``mark`` that of the outermost marked element."""

    __slots__ = ("tag", "path", "mark", "root", "plain", "children", "block", "frame")

    def __init__(self, tag: str, path: int, mark: int, root: bool, plain: bool, parent: Node | None) -> None:
        self.tag, self.path, self.mark, self.root, self.plain = tag, path, mark, root, plain
        self.children: list[str] = []
        self.block = self if parent is None or tag in BLOCKS else parent.block
        # open elements by tag since the nearest scope, itself excluded
        self.frame: Counter[str] = Counter() if parent is None or tag in SCOPES else parent.frame


@dataclass
class Page:
    """Text blocks ``(path, text, mark, root, plain)`` and element styles ``(path, children)`` of a page, in page order."""

    blocks: list[tuple[int, str, int, bool, bool]] = field(default_factory=list)
    styles: list[tuple[int, str]] = field(default_factory=list)


def path_number(parent: int, style: str) -> int:
    """A number for a path from that of its parent; 0 is no path."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(style.encode("utf-8", "replace"), parent % (1 << 64)) >> 1) + 1


def decoded(text: str) -> str:
    """Character references decoded once, runs of white space as one blank, none at the ends."""
    if "&" in text:
        # most references are ampersands, and what one decodes to is never read again
        text = "&".join([entities.unescape(part) if "&" in part else part for part in text.split("&amp;")])
    return " ".join(text.split())


def parse(page: str, read: Callable[[str], str] = decoded) -> Page:
    """The page as a tree, as far as blocks need it: paths of element styles, unclosed and stray tags repaired.

    ``read`` makes a block's text from its source; blocks for which it gives an empty text are left out. Paths are numbers, open
    elements are counted by scope, and what follows the last ``>`` is text, so time and memory grow with the page's length.
    """
    out, words = Page(), []
    bottom = Node("", 0, 0, False, False, None)
    stack, open_tags = [bottom], Counter()
    at, end, last_tag = 0, len(page), page.rfind(">")
    unclosed: set[str] = set()

    def flush() -> None:
        if words:
            text = read("".join(words))
            words.clear()
            if text:
                top = stack[-1]
                out.blocks.append((top.block.path, text, top.mark, top.root, top.block.plain))

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            open_tags[node.tag] -= 1
            if node.tag not in SCOPES:
                node.frame[node.tag] -= 1
            out.styles.append((node.path, ",".join(node.children)))

    while at < end:
        if at > last_tag:  # no tag can end any more
            words.append(page[at:])
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            words.append(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in BLOCKS:
                flush()
            if (open_tags if tag in SCOPES else stack[-1].frame)[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in BLOCKS:
            flush()
            shut = CLOSED_BY.get(tag, _PARAGRAPH)
            while True:
                frame, depth = stack[-1].frame, len(stack) - 1
                if any(frame[t] > 0 for t in shut) or frame["p"] > 0:
                    while stack[depth].tag not in shut and stack[depth].tag != "p":
                        depth -= 1
                elif any(open_tags[t] > 0 for t in shut & SCOPES):
                    while stack[depth].tag not in SCOPES:
                        depth -= 1
                    if stack[depth].tag not in shut:
                        break
                else:
                    break
                close(depth)
                if stack[-1].tag not in shut:
                    break
        if tag in RAW:
            if tag in unclosed or tag in SELF_CLOSING and m["attributes"].endswith("/"):
                continue
            if closing := re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at):
                at = closing.end()
            elif tag in TO_THE_END:
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag in VOID:
            words.append(" ")
            continue
        attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m["attributes"])} if m["attributes"] else {}
        names = f"{attributes.get('id', '')} {attributes.get('class', '')}".strip()
        role = attributes.get("role", "").lower()
        top = stack[-1]
        root = top.root or tag in ("article", "main") or role == "main"
        style = f"{tag}.{_NUMBER.sub('#', names)}" if names else tag
        path = path_number(top.path, style)
        marked = tag in SIDE_TAGS or role in SIDE_ROLES or (tag == "header" and not top.root)
        if names and tag not in ("html", "body", "main"):
            marked = marked or not SIDE_WORDS.isdisjoint(w.lower() for w in _CUE_WORD.findall(names))
        top.children.append(style)
        node = Node(tag, path, top.mark or (path if marked else 0), root, root and tag in FLOW and not names, top)
        open_tags[tag] += 1
        if tag not in SCOPES:
            node.frame[tag] += 1
        stack.append(node)
    flush()
    close(1)
    return out


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def style_tree(pages: DataFrame) -> DataFrame:
    """``(host, path, marked, pages, content, presentation, importance, share, left)`` of every node of every host's style tree.

    The pages of a host are merged by the path of element styles (tag, id and class, digits masked). Every block enters: under its
    own path, or under the outermost element of a marked branch. A node's features are the texts of its blocks; a feature on ``n``
    of the node's ``m`` pages has entropy ``log n / log m``, and content importance is one less the mean entropy, so text
    that every page repeats counts 0. Presentation importance is the entropy of the child sequences over the pages. A node
    is as important as the larger of the two; one seen on one page has importance 1. ``share`` is the mean share of the
    pages' text that the node holds, ``left`` the mean share outside all marked branches.

    Pages count features before the shuffle by (host, path, feature), so a host with a third of all pages is spread out; only
    counts meet by node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = parse(page, str.strip)
                sizes: Counter[tuple[int, bool]] = Counter()
                rows = set()
                for path, text, mark, _, _ in tree.blocks:
                    rows.add((host, mark or path, mark > 0, 0, crc32(text.encode("utf-8", "replace")), 0.0, 0.0))
                    sizes[mark or path, mark > 0] += len(text)
                total = sum(sizes.values())
                left = sum(n for (_, marked), n in sizes.items() if not marked) / max(total, 1)
                held = {path: marked for path, marked in sizes}
                rows |= {(host, path, held[path], 1, crc32(c.encode("utf-8", "replace")), 0.0, 0.0) for path, c in tree.styles if path in held}
                rows |= {(host, path, marked, 2, 0, n / total, left) for (path, marked), n in sizes.items()}
                out += rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["host", "path", "marked", "kind", "feature", "share", "left"])

    made = "host string, path bigint, marked boolean, kind bigint, feature bigint, share double, left double"
    features = _with_host(pages).select("host", "html").mapInArrow(run, made)
    counts = features.groupBy("host", "path", "marked", "kind", "feature").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.sum("left").alias("left"))
    counts = cut(counts, "features")
    n, log = F.col("n"), lambda c: F.log(c.cast("double"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    nodes = counts.groupBy("host", "path", "marked").agg(
        F.sum(of(2, n)).alias("pages"), F.avg(of(0, log(n))).alias("mean_log"), F.sum(of(1, n)).alias("shapes"),
        F.sum(of(1, n * log(n))).alias("shape_logs"), F.sum(of(2, F.col("share"))).alias("shares"), F.sum(of(2, F.col("left"))).alias("lefts"),
    )
    m = F.col("pages")
    content = F.when(m > 1, 1 - F.col("mean_log") / log(m)).otherwise(1.0)
    shape = F.when((m > 1) & (F.col("shapes") > 0), (log(F.col("shapes")) - F.col("shape_logs") / F.col("shapes")) / log(m)).otherwise(0.0)
    return nodes.select(
        "host", "path", "marked", "pages", content.alias("content"), shape.alias("presentation"), F.greatest(content, shape).alias("importance"),
        (F.col("shares") / m).alias("share"), (F.col("lefts") / m).alias("left"),
    )


def _text(page: str, low: frozenset[int], rescued: frozenset[int]) -> str:
    blocks = [b for b in parse(page).blocks if not b[2] or b[2] in rescued]
    if any(root for _, _, _, root, _ in blocks):
        blocks = [b for b in blocks if b[3]]
    # running text of a marked article is content even on a site that repeats it
    important = [b for b in blocks if b[4] or b[0] not in low]
    return "\n".join(text for _, text, *_ in important or blocks)


def main_text(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, content_importance: float = CONTENT_IMPORTANCE
) -> DataFrame:
    """``(page_id, url, text)``: the article of every page, one line a block; empty if there is none.

    The host's style tree decides on its nodes, the elements, roles and names that mark menus, headers, footers, sidebars,
    notices, adverts, forms and comments being the prior: an unmarked node is content unless its importance over at least
    ``least_pages`` pages is below ``least_importance``; a marked branch is not, unless over as many pages its importance is
    at least ``content_importance`` and hardly any text would be left without it. If a page marks its article, only that
    counts. If nothing would be left, the unmarked blocks stay. Scripts and styles never enter.

    A null html is empty; a null or odd url is a page of the host ''. Every row of ``pages`` gives one row; other columns are never read. Pages
    of any length and nesting are read in time and memory in proportion. An empty table gives an empty result. Only the nodes
    on which the tree overrules the prior join the pages by host; Spark sends them to all tasks while they are few and
    else splits hosts with many pages.
    """
    seen = F.col("pages") >= least_pages
    low = ~F.col("marked") & seen & (F.col("importance") < least_importance)
    rescued = F.col("marked") & seen & (F.col("importance") >= content_importance) & (F.col("left") < LEFT_AT_MOST) & (F.col("share") > 0.5)
    verdicts = style_tree(pages).where(low | rescued).groupBy("host").agg(
        F.collect_list(F.when(low, F.col("path"))).alias("low"), F.collect_list(F.when(rescued, F.col("path"))).alias("rescued")
    )
    verdicts = cut(verdicts, "verdicts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = [batch.column(c).to_pylist() for c in ("html", "low", "rescued")]
            texts = [_text(page, frozenset(gone or ()), frozenset(kept or ())) for page, gone, kept in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    joined = _with_host(pages).join(verdicts, "host", "left").select("page_id", "url", "html", "low", "rescued")
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")
