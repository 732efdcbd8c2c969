"""Main text of web pages: blocks are told apart by a minimum cut between content and boilerplate.

Each block's classifier costs are its edges to the two terminals; neighbours in page order and
blocks near each other in the element tree are tied by smoothness edges. The blocks on the content
side of the cut are the text.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from launchgrid.llm.common import ship, slices

# Names of the markup language.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video".split())
FORMS = frozenset("form select option optgroup button textarea datalist fieldset legend label dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
CLOSES = {  # an opening tag ends these, up to the nearest of its scope
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
OUTLINE = BLOCKS - {"p", "dd", "dt", "li"}  # a paragraph ends before any block, at the latest at one of these

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style|aria-label)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

GOOD_NAMES = frozenset("article content post entry story main maincontent body text articlebody postbody entrycontent prose".split())
BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion promotions banner banners
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs toc pagination pager skip header masthead topbar toolbar footer foot bottombar copyright colophon
    legal imprint sidebar sidebars aside rail widget widgets related recommended recommendations more trending popular teaser teasers outbrain taboola
    share sharing social follow notice notices cookie cookies consent gdpr privacy alert alerts warning disclaimer modal popup overlay dialog toast subscribe subscription
    newsletter signup signin login register paywall form search searchbox rating ratings vote poll tags tagcloud hidden print byline meta""".split())
TALK_NAMES = frozenset("comment comments commentlist commentbox reply replies respond responses discussion disqus feedback guestbook reviews thread".split())
TALK_TITLES = re.compile(r"^\W*(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses?|replies|discussion|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?|opiniones)\b[\W\d]*$", re.I)
BOILER = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bnewsletter\b|\bsubscribe\b|\bsign (?:in|up)\b|\blog ?in\b|\badvertisement\b|\bprivacy policy\b|\bterms of (?:use|service)\b"
                    r"|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b", re.I)

# Log-odds of a block being content, in the cut's unit of cost. Set by hand: no page carries labels.
TAG_COST = {"article": 2.5, "main": 2.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "header": -3.0, "menu": -6.0, "search": -6.0, "dialog": -6.0, "head": -20.0, "title": -20.0,
            "address": -1.5, "form": -6.0, "fieldset": -6.0, "select": -20.0, "option": -20.0, "optgroup": -20.0, "button": -20.0, "textarea": -20.0, "datalist": -20.0, "legend": -6.0, "label": -3.0}
GOOD_NAME, BAD_NAME, TALK_NAME, HIDDEN = 1.5, -6.0, -8.0, -20.0
OUTSIDE = -3.0        # outside the article, on a page that has one
NEXT, NEAR = 0.8, 0.5  # smoothness of neighbours in page order, and of blocks of one parent


@dataclass
class Block:
    text: str
    path: tuple[int, ...]   # numbers of the enclosing elements, outermost first
    prior: float            # from the names of these
    in_article: bool
    tag: str
    linked: int             # characters within links


def _name_cost(tag: str, attrs: str) -> tuple[float, bool]:
    """(cost, whether that is of readers' talk) of an element by its name and attributes."""
    cost, talk = TAG_COST.get(tag, 0.0), False
    if attrs and not attrs.isspace():
        for m in _NAMES.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                cost += HIDDEN
            elif key in ("class", "id", "role", "itemprop", "aria-label"):
                names = [n for n in value.split() if not n.lower().startswith(("has-", "with-", "no-"))]  # of what an element has around it
                words = {w.lower() for n in names for w in (*_PARTS.findall(_CAMEL.sub(" ", n)), n)}
                if words & TALK_NAMES:
                    talk = True
                    cost += TALK_NAME
                elif words & {"header", "meta"} and words & {"article", "entry", "post", "story"}:
                    continue  # the head of an article is no page header
                elif tag not in ("html", "body", "article", "main") and words & BAD_NAMES:
                    cost += BAD_NAME
                elif words & GOOD_NAMES:
                    cost += GOOD_NAME
    return cost, talk


def blocks(html: str) -> list[Block]:
    """The page's blocks of text in page order; markup that is not closed or not opened is tolerated."""
    out: list[Block] = []
    stack: list[list] = []          # [tag, number, cost, holds an article, talk]
    number, at, links = 0, 0, 0
    held: list[tuple[str, int]] = []

    def flush():
        nonlocal held
        if not held:
            return
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            whole = sum(len(t) for t, _ in held)
            linked = len(text) * sum(len(t) for t, inside in held if inside) // max(1, whole)
            costs = [e[2] for e in stack]
            prior = min(costs, default=0.0) if min(costs, default=0.0) < 0 else max(costs, default=0.0)
            around = [e for e in stack if e[0] in BLOCKS]
            out.append(Block(text, tuple(e[1] for e in around), prior, any(e[3] for e in stack), around[-1][0] if around else "", linked))
        held = []

    def close(names, scope):
        nonlocal links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if any(e[0] in BLOCKS for e in stack[i:]):
                    flush()
                links -= sum(e[0] == "a" for e in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    def text_of(raw: str):
        if raw:
            held.append((unescape(raw) if "&" in raw else raw, links))

    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            text_of(html[at:])
            break
        text_of(html[at: m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                held.append((m[0][9:-3], links))
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if closing:
            if tag in BLOCKS:
                flush()
            if tag == "br":
                held.append((" ", links))
            elif any(e[0] == tag for e in stack):
                close({tag}, () if tag in OUTLINE else {"table", "article", "body"})
            continue
        if tag in RAW:
            done = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not (m[3] or m[6] or "").endswith("/"):
                at = done.end() if done else end if tag in ("script", "style") else at
            continue
        if tag in ("br", "wbr"):
            held.append((" " if tag == "br" else "", links))
            continue
        if tag in BLOCKS:
            flush()
            if tag != "p" and any(e[0] == "p" for e in stack):
                close({"p"}, OUTLINE)
            elif tag == "p":
                close({"p"}, OUTLINE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in VOID:
            continue
        attrs = m[3] if m[3] is not None else m[6] or ""
        if tag not in BLOCKS and not attrs and tag != "a":
            stack.append([tag, 0, 0.0, False, False])
            continue
        number += 1
        cost, talk = _name_cost(tag, attrs)
        if tag == "header" and any(e[3] for e in stack):
            cost -= TAG_COST["header"]  # the head of an article is no page header
        stack.append([tag, number, cost, tag in ("article", "main") and not talk, talk])
        links += tag == "a"
    flush()
    return out


def scores(page: list[Block]) -> list[float]:
    """Log-odds of each block being content."""
    inside = sum(len(b.text) - b.linked for b in page if b.in_article and b.prior >= 0)
    out = []
    talk_from = None  # once a title announces readers' comments, what follows under its parent is theirs
    for b in page:
        words, n = b.text.count(" ") + 1, len(b.text)
        s = b.prior
        if b.prior >= 0:
            s += min(words, 40) / 15 - 0.8                      # long blocks are content
            s += 0.5 if re.search(r"[.!?]\W*$", b.text) else 0  # so are whole sentences
            if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                s += 1.0
        s -= 5.0 * (b.linked / n) ** 2 if b.linked else 0.0
        if inside >= 100 and not b.in_article:
            s += OUTSIDE
        if words <= 30 and BOILER.search(b.text):
            s -= 2.0 if not b.in_article else 0.5
        depth = len(b.path)
        if words <= 5 and TALK_TITLES.match(b.text) and (b.tag[:1] == "h" or b.tag in ("div", "strong", "b", "summary")):
            talk_from = b.path[: max(1, depth - 1)]
        if talk_from is not None:
            if b.path[: len(talk_from)] == talk_from:
                s += TALK_NAME
            else:
                talk_from = None
        out.append(s)
    return out


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in page order by their distance in the tree, and blocks that follow each other in one parent."""
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            a = page[i - 1]
            shared = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                shared += 1
            out.append((i - 1, i, NEXT / max(1.0, (len(a.path) + len(b.path) - 2 * shared) / 2)))
        parent = b.path[:-1]
        if parent in last and last[parent] < i - 1:
            out.append((last[parent], i, NEAR))
        last[parent] = i
    return out


def min_cut(score: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut; the smallest such side.

    A node costs -score on the content side if that is positive, else its score on the other side; a tie
    costs its weight if its ends part. Maximum flow by shortest augmenting levels (blocking flows).
    """
    n = len(score)
    give, take = [max(s, 0.0) for s in score], [max(-s, 0.0) for s in score]  # what the terminals still can pass
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in ties:
        near[a].append(len(to)), near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    small = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if give[i] > small)
        for i in queue:
            level[i] = 0
        reached, limit = False, n + 1
        while queue:
            i = queue.popleft()
            if take[i] > small:
                reached, limit = True, level[i]
            if level[i] >= limit:
                continue
            for e in near[i]:
                j = to[e]
                if level[j] < 0 and room[e] > small:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        step = [0] * n
        for s in range(n):
            while level[s] == 0 and give[s] > small:
                path, i = [], s
                while True:  # walk down the levels, back where they end
                    if take[i] > small:
                        break
                    while step[i] < len(near[i]):
                        e = near[i][step[i]]
                        if room[e] > small and level[to[e]] == level[i] + 1 <= limit:
                            break
                        step[i] += 1
                    if step[i] < len(near[i]):
                        path.append(near[i][step[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        step[i] += 1
                    else:
                        break
                if take[i] <= small:
                    break
                flow = min([give[s], take[i], *(room[e] for e in path)])
                give[s] -= flow
                take[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def main_text(html: str | None) -> str:
    """The content blocks of a page, one to a line."""
    page = blocks(html or "")
    keep = min_cut(scores(page), edges(page))
    return "\n".join(b.text for b, k in zip(page, keep) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Pages are taken one by one, without a shuffle. A null or empty page has the text "". Repeated rows
    stay each, null keys and urls stay null, other columns are not read. An empty table gives no rows.
    """
    ship(pages.sparkSession)
    src = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
