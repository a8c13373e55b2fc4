"""Main-text extraction that learns each site's template from recurring subtrees.

Pages are parsed to trees; block subtrees are hashed over tag names and text (attributes
are left out, so tracking ids do not matter). Spark counts, per host, the distinct pages in
which each hash occurs, and subtrees that recur on many pages of a host are deleted. Two
rules go with that: elements whose tag, role, class or id names them as page furniture are
dropped on every page, also on hosts with few pages; and text blocks inside the article
element are the article's own words, however often a sentence recurs, so there only
containers are deleted. Copies of one page count as one page of the host.

Results: the kept blocks in page order, character references decoded, white space inside a
block turned into one space, joined by one newline. Null html and html without text give
the empty string. Null or unreadable urls have no host and learn no template. Page ids are
never keys, so null, tied and repeated rows each give their own result; an empty table
gives no rows. A very long or deeply nested page takes linear time and is parsed whole. Extra columns
may be kept; one named `text` gives way to the result.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, packed, scratch_table, unpacked

# Fixed values of HTML: element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption option optgroup legend summary li dd dt".split())
#: Opening the key closes an open element of the value, up to the bound.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
DROP_TAGS = set(
    "head script style noscript template svg canvas object embed iframe noembed noframes audio video map nav footer aside "
    "form button select textarea input datalist dialog menu title xmp search".split()
)
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class and id names that mark page furniture.
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsored promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars masthead topbar toolbar "
    "cookie cookies consent gdpr disclaimer popup modal newsletter subscribe "
    "signup login teaser widget widgets pagination pager comments commentlist disqus".split()
)
#: Words that do so only alone or among these: `share`, `related-posts`, but not `social-science` or `comment-theory`.
WEAK_WORDS = set("share sharing social related recommended recommendations notice notices alert alerts overlay comment respond replies reply skip subscription sponsor footer".split())
COMPANIONS = set(
    "link links button buttons bar box list lists item items post posts article articles story stories icon icons block blocks section area "
    "container wrapper wrap inner panel media site page top bottom left right to the content main form thread text message nav by and id".split()
)
PAGE_HEADER_WORDS = {"header"}
#: Class names that begin like this describe an element's surroundings, not the element.
ABOUT_OTHERS = set("has no with without not is".split())
#: Of an article or main element only these whole names count.
NO_ARTICLE = set("comment reply ad advert advertisement sponsored promo related teaser".split())
#: Longer words that begin like this count as well.
DROP_STEMS = ("advert", "cookie", "commentlist", "commentform", "commentbox", "sponsor", "newsletter", "sidebar", "breadcrumb", "footer", "navbar", "navmenu", "subscri")
#: Containers that may be deleted inside an article when they recur; its text blocks may not.
CONTAINERS = set("div section aside nav ul ol dl menu table form header footer figure details fieldset".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead tfoot figcaption caption".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$|["'])""", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "n_text", "holds")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.kids, self.hash, self.n_text, self.holds = tag, attrs, [], 0, 0, False


def _close(node: Node) -> None:
    """Hash a finished subtree over its tag, text and children."""
    parts, n = [node.tag], 0
    for k in node.kids:
        if k.__class__ is str:
            if t := " ".join(k.split()):
                parts.append(t)
                n += len(t)
        else:
            parts.append(str(k.hash))
            n += k.n_text
            node.holds |= k.holds or k.tag in ("article", "main")
    node.n_text = n
    node.hash = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Open:
    """The open elements, and for each tag name where they stand: to find one takes no search, so deep pages take linear time."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def innermost(self, tags) -> int:
        """Where the innermost open element of the tags stands; 0, the root's place, if there is none."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def close_from(self, place: int) -> None:
        """End the element at `place` and all within it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            if self.at[node.tag]:
                self.at[node.tag].pop()
            _close(node)

    def end(self, tag: str) -> None:
        """An end tag: its innermost element ends unless a cell or table lies between. A stray one is nothing."""
        place = self.innermost((tag,))
        if place and (tag in TABLE_ENDS or place >= self.innermost(("td", "th", "table"))):
            self.close_from(place)

    def end_before(self, tags, bound) -> None:
        """What an opening tag ends: open elements of `tags` that stand within the innermost of `bound`."""
        while (place := self.innermost(tags)) > self.innermost(bound):
            self.close_from(place)


#: End tags that reach across cells.
TABLE_ENDS = {"tr", "table", "tbody", "thead", "tfoot", "td", "th", "body", "html"}
P_BOUND = {"td", "th", "table", "div", "article", "section", "li", "body"}


def parse(page: str) -> Node:
    """A forgiving tree: unclosed and misnested elements end where their surroundings do. One pass, no recursion."""
    root = Node("#root", "")
    open_, at, end, tag_at = _Open(root), 0, len(page), _TAG
    stack = open_.stack
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack[-1].kids.append(page[at:lt])
        if lt == end:
            break
        m = tag_at.match(page, lt)
        if m is None:
            two = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif two in ("!", "?") or (two == "/" and lt + 2 < end):
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            elif two.isascii() and two.isalpha() and page.find(">", lt) < 0:
                at = end  # a tag that the page's end cuts off
            elif two.isascii() and two.isalpha() and tag_at is _TAG:
                tag_at = _BARE_TAG  # a quote is never closed; ignore quotes from here on
                at = lt
            else:
                stack[-1].kids.append("<")
                at = lt + 1
            continue
        at, closing, tag, attrs = m.end(), m[1], m[2].lower(), m[3]
        if closing:
            open_.end(tag)
            continue
        if tag in CLOSES_P and open_.at["p"]:
            open_.end_before(("p",), P_BOUND - {tag})
        if tag in CLOSES:
            open_.end_before(*CLOSES[tag])
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            _close(node)
        elif tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            node.kids.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            _close(node)
        else:
            open_.push(node)
    open_.close_from(0)
    return root


def is_furniture(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id name the element as something beside the article. `inside`: within the article."""
    if node.tag in DROP_TAGS or (node.tag == "header" and not inside):
        return True
    if not node.attrs or node.tag in ("html", "body"):
        return False
    for name, value in _ATTR.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "role":
            if value.lower() in DROP_ROLES and not node.holds:
                return True
        elif node.tag in ("article", "main"):
            if NO_ARTICLE & set(value.lower().split()):
                return True
        elif not node.holds and any(_names_furniture(n, inside) for n in value.split()):
            return True
    return False


def _names_furniture(name: str, inside: bool) -> bool:
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    if not words or words[0] in ABOUT_OTHERS:
        return False
    if any(w in DROP_WORDS or w.startswith(DROP_STEMS) or (not inside and w in PAGE_HEADER_WORDS) for w in words):
        return True
    return any(w in WEAK_WORDS for w in words) and all(w in WEAK_WORDS or w in COMPANIONS for w in words)


def _is_main(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return True
    return "main" in node.attrs and any(n.lower() == "role" and v.strip("\"'").lower() == "main" for n, v in _ATTR.findall(node.attrs))


def content_roots(root: Node) -> list[Node]:
    """The outermost articles that are not furniture; without one, the main elements; else the whole tree."""
    articles, mains, stack = [], [], [(root, False)]
    while stack:
        node, in_main = stack.pop()
        if is_furniture(node, in_main):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if _is_main(node) and not in_main:
            mains.append(node)
            in_main = True
        stack.extend((k, in_main) for k in reversed(node.kids) if k.__class__ is not str)
    return articles or mains or [root]


def blocks(root: Node, template: frozenset = frozenset()) -> list[str]:
    """The text blocks of the page's content without furniture and without `template` subtrees."""
    out: list[str] = []
    roots = content_roots(root)
    for top in roots:
        held = top is not root
        words: list[str] = []

        def end_block():
            if words and (t := " ".join("".join(words).split())):
                out.append(t)
            words.clear()

        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                end_block()
            elif item.__class__ is str:
                words.append(_html.unescape(item))  # a reference never reaches across a tag
            elif item is not top and is_furniture(item, held):
                if item.tag in BLOCK:
                    end_block()
            elif item is not top and item.hash in template and item.tag in (CONTAINERS if held else BLOCK):
                end_block()
            elif item.tag in ("br", "wbr"):
                words.append(" " if item.tag == "br" else "")
            else:
                if item.tag in BLOCK:
                    end_block()
                    stack.append(None)
                stack.extend(reversed(item.kids))
        end_block()
    return out


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url) if url else None
    return m[1].lower() if m else None


def recurring_candidates(root: Node) -> set[int]:
    """Hashes of the subtrees that could be deleted: any block outside the article, containers inside."""
    tops = content_roots(root)
    held = {id(t) for t in tops if t is not root}
    found, stack = set(), [(root, False)]
    while stack:
        node, inside = stack.pop()
        now = inside or id(node) in held
        if node.n_text and node.tag not in ("#root", "html", "body", "head", "article", "main") and node.tag in (CONTAINERS if now else BLOCK):
            found.add(node.hash)
        stack.extend((k, now) for k in node.kids if k.__class__ is not str)
    return found


_OCC = "k1 long, k2 long, host string, page long, h long"


def _occurrences(batches):
    """One row for each candidate subtree of a page, and one with a null hash for the page itself."""
    for batch in batches:
        out: list[tuple] = []
        for url, page, k1, k2 in zip(*(batch.column(n).to_pylist() for n in ("url", "html", "k1", "k2"))):
            if (host := host_of(url)) is None or not page:
                continue
            root = parse(page)
            # copies of an article are one page, whatever surrounds them
            sig = xxhash.xxh64_intdigest("\n".join(blocks(root)).encode("utf-8", "surrogatepass")) - (1 << 63)
            out.append((k1, k2, host, sig, None))
            out += [(k1, k2, host, sig, h) for h in recurring_candidates(root)]
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=["k1", "k2", "host", "page", "h"])


def _texts(batches):
    for batch in batches:
        texts = []
        for page, marks in zip(batch.column("__html").to_pylist(), batch.column("marks").to_pylist()):
            texts.append("\n".join(blocks(parse(page), frozenset(marks or ()))) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], names=["__row", "text"])


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, min_pages: int = 5, min_share: float = 0.05, enough: int = 50) -> DataFrame:
    """The `keep` columns (all but html by default) with `text`.

    A subtree is template when it occurs in at least `min_pages` distinct pages of its host
    and in at least `min_share` of them; `enough` pages are enough on a host of any size.
    """
    names = [c for c in pages.columns if c != html] if keep is None else keep
    key = [F.xxhash64(url, html).alias("k1"), F.xxhash64(html, url, F.lit(1)).alias("k2")]
    occ = scratch_table(pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), *key).mapInArrow(_occurrences, _OCC), "subtrees")
    hosts = occ.filter("h IS NULL").groupBy("host").agg(F.countDistinct("page").alias("pages"))
    counts = occ.filter("h IS NOT NULL").groupBy("host", "h").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= min_pages)
    template = scratch_table(counts.join(hosts, "host").filter(F.col("n") >= F.least(F.lit(float(enough)), min_share * F.col("pages"))).select("host", "h"), "template")
    marks = occ.filter("h IS NOT NULL").select("k1", "k2", "host", "h").join(template, ["host", "h"])
    marks = scratch_table(marks.groupBy("k1", "k2").agg(F.collect_set("h").alias("marks")), "marks")
    rows = pages.select(packed(pages, names, "text"), F.col(html).cast("string").alias("__html"), *key)
    forget(occ, template)
    joined = rows.join(marks, ["k1", "k2"], "left").select("__row", "__html", "marks")
    return unpacked(joined.mapInArrow(_texts, joined.select("__row").schema.add("text", "string")), "text")
