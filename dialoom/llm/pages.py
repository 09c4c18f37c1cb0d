"""Main text of web pages by a minimum cut.

A page is cut into blocks of text, nodes of a graph. A classifier gives each
block a cost for being content and one for being boilerplate: the capacities
of its edges to two terminals. Neighbours in page order, and neighbours among
the children of one element, are tied by edges that cost their capacity if
only one end is content. The minimum cut, found by maximum flow, is the
labelling of least cost.

The classifier adds what a block's ancestors say (elements and class names of
articles, menus, footers, adverts and the like) to log-odds of its text,
learnt from the blocks whose ancestors are clear.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import batches, extend, free_name, sliced, table, tidy

# Elements by what they mean for the text in them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("template noscript svg select button object canvas audio video datalist label option optgroup".split())
BLOCKS = frozenset(
    "html body article section nav aside h1 h2 h3 h4 h5 h6 hgroup header footer address main p pre blockquote ol ul menu li dl dt dd figure figcaption div center details "
    "summary dialog fieldset legend form table caption colgroup thead tbody tfoot tr td th search".split())
MENU_TAGS = frozenset("nav aside footer form menu dialog search".split())
MENU_ROLES = frozenset("navigation complementary contentinfo search banner dialog alertdialog alert form menu menubar".split())

# Words in class names and ids that tell what an element holds.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond responses discussion feedback reactions guestbook".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar pagination pager ad ads adv advert adverts advertisement advertising adsense adsbygoogle "
    "adslot sponsor sponsored sponsors promo promos promoted promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations trending popular widget widgets copyright search skip paywall disclaimer announcement infobar rail side sidenav teaser teasers "
    "topnav mainnav sitenav submenu megamenu dropdown tabs sitemap foot ftr colophon imprint logo brand tagline advertorial adbox adbanner adunit adspace adcontainer taboola outbrain".split())
INLINE_NOISE = frozenset("ad ads advert advertisement adsbygoogle adslot sponsored hidden".split())
HEADER_WORDS = frozenset("header head hdr".split())
CONTENT_WORDS = frozenset("article content post entry story".split())
MAIN_WORDS = frozenset("main maincontent articlebody bodytext".split())
#: Words before a name that make it say something of the page, not of the element: `has-sidebar`, `no-ads`.
ABOUT = frozenset("has with no without not hide".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

PLAIN, CONTENT, HEADER, NOISE, NOISE_TAG, COMMENTS, DROP = range(7)


def _names(value: str) -> Iterator[frozenset[str]]:
    """The words of each name in a class or id, but those of names that say what is elsewhere or missing."""
    for name in value.split():
        found = [w.lower() for w in _WORDS.findall(name)]
        if found and found[0] not in ABOUT and found[-1] != "free":
            yield frozenset(found)


def _meaning(tag: str, attributes: str) -> int:
    """What an element says of the text in it."""
    found = {}
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(key.lower(), html.unescape(a or b or c))
    role, names = found.get("role", "").lower(), [w for key in ("class", "id") for w in _names(found.get(key, ""))]
    unseen = "hidden" in found or "display:none" in re.sub(r"\s", "", found.get("style", "").lower())
    if tag in UNSEEN or unseen:
        return DROP
    if tag not in BLOCKS:
        return DROP if any(w & INLINE_NOISE for w in names) else PLAIN
    if tag in ("html", "body"):
        return PLAIN
    if any(w & COMMENT_WORDS for w in names):
        return COMMENTS
    if tag in MENU_TAGS or role in MENU_ROLES:
        return NOISE_TAG
    if any(w & NOISE_WORDS for w in names):
        return NOISE
    if tag in ("article", "main") or role in ("main", "article"):
        return CONTENT
    if any(w & CONTENT_WORDS for w in names):
        return CONTENT if not any(w & HEADER_WORDS for w in names) else PLAIN
    if tag == "header" or any(w & HEADER_WORDS for w in names):
        return HEADER
    return CONTENT if any(w & MAIN_WORDS for w in names) else PLAIN


_meaning_of_common = lru_cache(8192)(_meaning)


def meaning(tag: str, attributes: str) -> int:
    return _meaning_of_common(tag, attributes) if len(attributes) < 200 else _meaning(tag, attributes)


@dataclass
class Page:
    """Elements (parent, tag, meaning) in page order and blocks of text: (element, text, characters in links)."""

    parent: list[int]
    tag: list[str]
    says: list[int]
    blocks: list[tuple[int, str, int]]


#: What an opening element closes if it is open, and the elements that such a search doesn't leave.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_KEEPS_P = frozenset("td th table button caption".split())


def read_page(source: str) -> Page:
    """One pass over a page's tags, lenient as browsers are: missing ends are supplied, stray ones don't count.

    A tag or comment without an end takes the rest of the page.
    """
    page = Page([-1], ["html"], [PLAIN], [])
    parent, tags, says, blocks = page.parent, page.tag, page.says, page.blocks
    stack, counts = [0], {}
    pieces: list[str] = []
    in_link, linked, dropped, at, end = False, 0, 0, 0, len(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                e = stack[-1]
                while tags[e] not in BLOCKS:
                    e = parent[e]
                blocks.append((e, text, linked))
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if not dropped:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                linked += len(text) - text.count(" ")

    def pop() -> None:
        nonlocal dropped
        e = stack.pop()
        counts[tags[e]] -= 1
        dropped -= says[e] == DROP

    def close(names, stops=frozenset()) -> None:
        """Close the innermost open element of `names`, and all in it, unless one of `stops` is in between."""
        if any(counts.get(n) for n in names):
            for i in range(len(stack) - 1, 0, -1):
                t = tags[stack[i]]
                if t in names:
                    while len(stack) > i:
                        pop()
                    return
                if t in stops:
                    return

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = False
            if tag in BLOCKS:
                flush()
                close((tag,))
            elif counts.get(tag):
                close((tag,), BLOCKS)
            continue
        if tag in RAW:
            gone = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = gone.end() if gone else end
            continue
        if tag in BLOCKS:
            flush()
            if counts.get("p"):
                close(("p",), _KEEPS_P)
            if tag in _CLOSES:
                close(*_CLOSES[tag])
        elif tag == "a":
            in_link = True
        elif tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        kind = meaning(tag, m.group(3))
        if tag in BLOCKS or kind == DROP:
            parent.append(stack[-1])
            tags.append(tag)
            says.append(kind)
            stack.append(len(tags) - 1)
            counts[tag] = counts.get(tag, 0) + 1
            dropped += kind == DROP
    flush()
    return page


#: Evidence of ancestors, in log-odds of being content.
IN_ARTICLE, IN_CONTENT, IN_NOISE = 4.0, 2.0, -8.0


def evidence(page: Page) -> list[float]:
    """What the ancestors of each block say.

    An element that holds the page's main content isn't what its class names
    say, comments excepted; a header is one of the page unless it is in some
    content; an article in a comment or sidebar is a part of that.
    """
    parent, tags, says = page.parent, page.tag, page.says
    n = len(tags)
    own = [0] * n
    for e, text, linked in page.blocks:
        own[e] += max(len(text) - linked, 0)
    for e in range(n - 1, 0, -1):
        own[parent[e]] += own[e]
    best = max((e for e in range(n) if says[e] == CONTENT), key=lambda e: (own[e], -e), default=-1)
    holds, e = set(), best
    while e > 0:
        e = parent[e]
        holds.add(e)
    value = [0.0] * n
    for e in range(1, n):
        up, kind = value[parent[e]], says[e]
        if up < 0:
            value[e] = up
        elif kind == COMMENTS or (kind == NOISE_TAG and not (e in holds and tags[e] == "form") and tags[parent[e]] != "blockquote"):
            value[e] = IN_NOISE
        elif (kind == NOISE and e not in holds) or (kind == HEADER and up == 0 and e not in holds):
            value[e] = IN_NOISE
        elif kind == CONTENT:
            value[e] = max(up, IN_ARTICLE if tags[e] == "article" else IN_CONTENT)
        else:
            value[e] = up
    return [value[e] for e, _, _ in page.blocks]


# Features of a block's text, each in a few steps; a pattern is one of their combinations.
_STEPS = (6, 4, 2, 4, 2)
_FORMS = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 1), **dict.fromkeys(("li", "dt", "dd"), 2), **dict.fromkeys(("td", "th", "caption", "figcaption"), 3)}
_RIGHTS = re.compile(r"\xa9|\(c\)|all rights reserved", re.I)


def pattern(tag: str, text: str, linked: int) -> int:
    """Words, share of links, a full stop at the end, form, and a claim of rights, as one number."""
    words = min((text.count(" ") + 1).bit_length() - 1, 5)
    chars = len(text) - text.count(" ")
    share = 0 if not linked else min(1 + 3 * min(linked, chars) // (chars + 1), 3)
    stop = text[-1] in ".!?…。！？:;”\"»"
    rights = len(text) < 1000 and _RIGHTS.search(text) is not None
    return (((words * 4 + share) * 2 + stop) * 4 + _FORMS.get(tag, 0)) * 2 + rights


def _features() -> np.ndarray:
    """A row of indicators, one for each step of each feature, for each pattern."""
    grid = np.indices(_STEPS).reshape(len(_STEPS), -1)
    return np.concatenate([(grid[i][:, None] == np.arange(k)).astype(float) for i, k in enumerate(_STEPS)], axis=1)


#: Log-odds of each step before anything is learnt: long texts with few links and a full stop are content.
_PRIOR = np.array([-1.0, -0.7, -0.3, 0.2, 0.8, 1.2, 0.3, 0.0, -1.0, -2.0, -0.3, 0.5, 0.0, 1.2, -0.2, -0.3, 0.2, -2.0])


def fitted(content: np.ndarray, noise: np.ndarray, strength: float = 20.0) -> np.ndarray:
    """Log-odds of each pattern: logistic regression on the patterns' counts, drawn to the prior by `strength` blocks."""
    x, w = _features(), _PRIOR.copy()
    n = content + noise
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (content - n * p) - strength * (w - _PRIOR)
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + strength * np.eye(len(w)), slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return x @ w


def fit(df: DataFrame, html_col: str = "html", max_pages: int = 5000) -> np.ndarray:
    """Log-odds of text patterns, learnt from blocks whose ancestors are clear.

    Learnt on some `max_pages` pages (all, if there are fewer), taken by the
    hash of their source; what reaches the driver is a count for each pattern.
    """
    source = F.col(f"`{html_col}`")
    total = df.count()
    some = df.select(source.alias("html")).where(source.isNotNull() & (F.pmod(F.xxhash64(source), F.lit(max(total, 1))) < max_pages))

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bool], int] = {}
        for batch in sliced(arrived):
            for source in batch.column(0):
                page = read_page(source.as_py())
                for (e, text, linked), said in zip(page.blocks, evidence(page)):
                    if said:
                        key = pattern(page.tag[e], text, linked), said > 0
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_pylist([{"pattern": k, "content": c, "n": n} for (k, c), n in seen.items()], pa.schema([("pattern", pa.int32()), ("content", pa.bool_()), ("n", pa.int64())]))
        tidy()

    with batches(df.sparkSession, 512, 2 << 20):
        rows = some.mapInArrow(run, "pattern int, content boolean, n long").groupBy("pattern", "content").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, int(np.prod(_STEPS))))
    for r in rows:
        counts[int(r["content"]), r["pattern"]] = r["n"]
    return fitted(counts[1], counts[0])


#: Capacities in whole units, so that flows are exact.
UNIT = 1000
#: What neighbours in page order and among one element's children are tied by, and the most that text says, in log-odds.
NEXT, SIBLING, TEXT_LIMIT = 1.0, 0.5, 3.0


def edges(page: Page) -> list[tuple[int, int, int]]:
    """Smoothness edges (block, block, capacity): of neighbours, the weaker the further apart in the tree, and of siblings."""
    parent, out, last = page.parent, [], {}
    for i, (e, _, _) in enumerate(page.blocks):
        if i:
            a, b, apart = page.blocks[i - 1][0], e, 0
            while a != b and apart < 7:  # the later of two elements is never an ancestor of the other
                a, b = (parent[a], b) if a > b else (a, parent[b])
                apart += 1
            out.append((i - 1, i, int(UNIT * NEXT / (1 + apart))))
        holder = parent[e] if parent[e] >= 0 else 0
        if holder in last and last[holder] != i - 1:
            out.append((last[holder], i, int(UNIT * SIBLING)))
        last[holder] = i
    return out


def min_cut(gain: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: a block of gain g costs g as boilerplate if g > 0, -g as content if g < 0; a tie with one end in each costs its capacity.

    A block that outweighs all its ties is decided, and pulls its neighbours;
    the rest is cut by maximum flow. Of several least labellings, the flow
    takes the one with the least content.
    """
    n = len(gain)
    gain, near = list(gain), [{} for _ in range(n)]
    for i, j, w in ties:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    pull = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(gain[i]) < pull[i]:
            continue
        label[i] = gain[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                pull[j] -= w
                del near[j][i]
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inside = _max_flow([gain[i] for i in rest], [{place[j]: w for j, w in near[i].items()} for i in rest])
        for i, c in zip(rest, inside):
            label[i] = c
    return label


def _max_flow(gain: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Dinic's algorithm with blocks' terminals folded into their gain; whether each block is on the source's side.

    What a block may still take from the source or give to the sink is its
    gain; a tie's residual capacity is kept in both directions.
    """
    n = len(gain)
    give, take = [max(g, 0) for g in gain], [max(-g, 0) for g in gain]
    links = [list(x) for x in near]

    def levels() -> tuple[list[int], bool]:
        level, queue, found = [-1] * n, deque(), False
        for i in range(n):
            if give[i]:
                level[i] = 0
                queue.append(i)
        while queue:
            i = queue.popleft()
            found = found or take[i] > 0
            for j in links[i]:
                if level[j] < 0 and near[i][j]:
                    level[j] = level[i] + 1
                    queue.append(j)
        return level, found

    while True:
        level, found = levels()
        if not found:
            return [x >= 0 for x in level]
        arc = [0] * n
        for s in range(n):
            while give[s] and level[s] == 0:
                path = [s]
                while path:
                    i = path[-1]
                    if take[i]:
                        break
                    while arc[i] < len(links[i]):
                        j = links[i][arc[i]]
                        if near[i][j] and level[j] == level[i] + 1:
                            path.append(j)
                            break
                        arc[i] += 1
                    else:
                        path.pop()
                        if path:
                            arc[path[-1]] += 1
                if not path:
                    break
                flow = min(give[s], take[path[-1]], *(near[a][b] for a, b in zip(path, path[1:])))
                give[s] -= flow
                take[path[-1]] -= flow
                for a, b in zip(path, path[1:]):
                    near[a][b] -= flow
                    near[b][a] += flow


def main_text(source: str | None, odds: list[float]) -> str:
    """A page's content blocks, joined by blank lines; `odds` are those of text patterns."""
    if not source:
        return ""
    page = read_page(source)
    gain = []
    for (e, text, linked), said in zip(page.blocks, evidence(page)):
        of_text = odds[pattern(page.tag[e], text, linked)]
        gain.append(int(UNIT * (said + max(-TEXT_LIMIT, min(TEXT_LIMIT, of_text)))))
    return "\n\n".join(text for (_, text, _), keep in zip(page.blocks, min_cut(gain, edges(page))) if keep)


def extract(df: DataFrame, odds: np.ndarray | None = None, *, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """`df` with a column of each page's main text; `odds` from `fit`, learnt from `df` itself if not given.

    Null and empty pages, and those without content, have an empty text.
    Pages are independent of each other, repeated ones have equal texts. If
    `out_col` is taken, the new column has underscores before its name.
    """
    learnt = (fit(df, html_col) if odds is None else odds).tolist()
    place = df.columns.index(html_col)

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([main_text(x.as_py(), learnt) for x in batch.column(place)], pa.string())]

        return work

    return extend(df, f"`{free_name(df, out_col)}` string", compute)


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
