"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A classifier, a logistic regression over features of the block (ancestors'
tags, classes and roles, links, length, punctuation, telltale words) and of its place in the page (inside the page's article, inside
the element that holds most of its running text), gives each block log-odds of being content. These are the capacities from the
source (content) or to the sink (boilerplate). Neighbours in page order and neighbours under one parent are tied by smoothness
edges. The maximum flow's minimum cut is the labelling of least total cost: blocks still reachable from the source are content.

No page comes with labels, so the classifier is fitted on generated pages whose labels are known (``generated``): regions of a page
in varied order, with and without semantic tags, under telling, untelling or no class names. The fit takes about a second, is
the same on every run, and is done once on the driver; the weights travel with the tasks.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty
from .shingles import parts

#: Fixed values of HTML: tags that start a block, that have no content, whose text is not shown.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object svg canvas math audio video title textarea select noframes".split())
RAW = frozenset("script style textarea title iframe noframes noscript xmp".split())
#: Fixed values of HTML: what an opening tag closes if it is open, and the tags that hold such an open tag in.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: Tags around a block, and words of class, id and role, that count for or against content, in units of evidence.
TAGS_AGAINST = {"nav": 2, "footer": 2, "aside": 2, "form": 2, "menu": 2, "dialog": 2, "header": 1, "button": 1, "fieldset": 1, "label": 1, "search": 2}
TAGS_FOR = frozenset(("article", "main"))
WORDS_AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager sidebar widget widgets footer foot "
    "header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter "
    "subscribe subscription signup login register share sharing social related recommended recommendations trending "
    "comment comments commentlist respond reply replies disqus discussion copyright legal disclaimer form search contentinfo "
    "complementary banner alertdialog tags taglist toolbar".split()
)
#: Of these, those that an article further inside does not clear (it is one of theirs), and those that with a word for content mean its title.
STICKY = frozenset("comment comments commentlist respond reply replies disqus discussion related recommended recommendations trending".split())
TITLED = frozenset("header masthead".split())
WORDS_FOR = frozenset("article content main post entry story body text".split())
#: Words that notices, adverts, forms, comment headings and legal lines use, in four languages.
TELLTALE = frozenset(
    "cookie cookies consent privacy policy tracking accept agree gdpr advert advertisement advertising sponsored promoted buy sale discount newsletter subscribe subscription "
    "signup login register password copyright rights reserved terms imprint disclaimer comments comment reply replies share follow menu search "
    "datenschutz zustimmen akzeptieren einwilligung anzeige werbung gesponsert kaufen rabatt abonnieren anmelden registrieren passwort impressum rechte vorbehalten kommentare kommentar antworten teilen suche "
    "confidentialité accepter consentement publicité annonce sponsorisé acheter abonnez inscription connexion droits réservés mentions légales commentaires commentaire répondre partager recherche "
    "privacidad aceptar consentimiento publicidad anuncio patrocinado comprar suscríbete suscribirse registrarse contraseña derechos reservados aviso comentarios comentario responder compartir buscar".split()
)
#: Elements that may hold a page's main part.
HOLDERS = frozenset(("", "body", "div", "section", "article", "main", "td", "form", "center"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOP = re.compile(r"[.!?;:。।]")
_TEXT_WORDS = re.compile(r"[^\W\d_]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Element(NamedTuple):
    tag: str
    key: int  # in page order, so the keys of what is inside follow
    loose: int  # evidence against content that an article or main element further inside clears
    firm: int  # and that it does not
    favour: int  # classes named after content
    inside: bool  # an article or main element is around, or is this
    hidden: bool
    link: bool
    form: int  # key of the outermost form around


class Block(NamedTuple):
    text: str
    parent: int
    tag: str
    loose: int
    firm: int
    favour: int
    inside: bool
    linked: float  # share of its characters in links
    form: int


class Page(NamedTuple):
    blocks: list[Block]
    above: list[int]  # of each element the key of the one around it
    holds: list[bool]  # whether it may hold the main part


def _element(tag: str, attributes: str, key: int, above: Element) -> Element:
    loose, firm, favour, hidden, inside = above.loose, above.firm, 0, tag in HIDDEN, above.inside or tag in TAGS_FOR
    if tag in TAGS_FOR:
        loose = 0  # a page's wrapper may be a form, or be named after the sidebar that it also holds
    if tag != "form" and not (tag == "header" and above.inside):  # an article's own header holds its title; forms count at the end
        loose += TAGS_AGAINST.get(tag, 0)
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
            elif name in ("class", "id", "role") and tag not in ("body", "html"):
                words = set(_WORDS.findall(_CAMEL.sub(" ", html.unescape(value)).lower()))
                against = words & WORDS_AGAINST - {tag}
                if words & WORDS_FOR and against <= TITLED:
                    favour = 1
                elif against & STICKY or against and tag in TAGS_FOR:
                    firm += 2
                elif against:
                    loose += 2
    form = 0 if tag in TAGS_FOR else above.form or (key if tag == "form" else 0)
    return Element(tag, key, min(loose, 4), min(firm, 4), max(above.favour, favour), inside, above.hidden or hidden, above.link or tag == "a", form)


def blocks(page: str) -> list[Block]:
    """The shown blocks of text of a page in page order; markup that is cut off or wrongly nested is read as browsers would, roughly."""
    return parse(page).blocks


def parse(page: str) -> Page:
    """One pass in linear time: of each tag the places on the stack of open elements are kept, so nothing walks along the stack."""
    out: list[Block] = []
    root = Element("", 0, 0, 0, 0, False, False, False, 0)
    stack, above, holds = [root], [0], [True]
    where: dict[str, list[int]] = {}  # places on the stack by tag
    block_at, holder_at = [0], [0]  # places of block-level elements but p, and of all block-level ones
    parts: list[str] = []
    linked = 0
    owner = root

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, owner.key, owner.tag, owner.loose, owner.firm, owner.favour, owner.inside, min(1.0, linked / len(text)), owner.form))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, owner
        top = stack[-1]
        if text and not top.hidden:
            if not parts or not parts[-1].strip():
                owner = stack[holder_at[-1]]
            if owner.loose + owner.firm < top.loose + top.firm:
                owner = owner._replace(loose=top.loose, firm=top.firm)
            parts.append(text)
            if top.link:
                linked += len(text.strip())

    def pop_to(place: int) -> None:
        while len(stack) > place:
            gone = stack.pop().tag
            where[gone].pop()
            if gone in BLOCK:
                holder_at.pop()
                if gone != "p":
                    block_at.pop()

    at, raw = 0, ""
    while True:
        if raw:
            end = _END[raw].search(page, at)
            if raw not in HIDDEN:
                add(page[at : end.start() if end else len(page)])
            if stack[-1].tag == raw:
                pop_to(len(stack) - 1)
            at, raw = (end.end() if end else len(page)), ""
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            add(" ")
        if m[1]:
            if where.get(tag):
                pop_to(where[tag][-1])
            continue
        closed = CLOSES.get(tag) or ({"p"} if tag in BLOCK else ())
        if closed:
            place = max((where[t][-1] for t in closed if where.get(t)), default=0)
            scope = max((where[t][-1] for t in SCOPE[tag] if where.get(t)), default=0) if tag in SCOPE else block_at[-1]
            if place > scope:
                pop_to(place)
        if tag in VOID:
            continue
        e = _element(tag, m[3], len(above), stack[-1])
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            holder_at.append(len(stack))
            if tag != "p":
                block_at.append(len(stack))
        above.append(stack[-1].key)
        holds.append(tag in HOLDERS)
        stack.append(e)
        if tag in RAW and not m[3].endswith("/"):
            raw = tag
    flush()
    if not _wrapped(out):
        out = [b if not b.form else b._replace(loose=min(4, b.loose + TAGS_AGAINST["form"])) for b in out]
    return Page(out, above, holds)


def _wrapped(found: list[Block]) -> bool:
    """Whether one form holds most of the page's text, running text included: then it wraps the page and says nothing."""
    size: dict[int, int] = {}
    for b in found:
        size[b.form] = size.get(b.form, 0) + len(b.text)
    key = max(size, key=size.get, default=0)
    return bool(key) and size[key] > sum(size.values()) / 2 and any(b.form == key and (b.tag in ("h1", "h2") or b.tag == "p" and len(b.text) > 200) for b in found)


def _main_part(page: Page) -> tuple[int, int]:
    """First and last key of the innermost element that holds most of the page's running text, links and noted boilerplate aside, in several blocks."""
    mass, several, last = [0.0] * len(page.above), [0] * len(page.above), list(range(len(page.above)))
    for b in page.blocks:
        if not b.loose and not b.firm:
            mass[b.parent] += len(b.text) * (1 - b.linked)
            several[b.parent] += 1
    for key in range(len(mass) - 1, 0, -1):
        up = page.above[key]
        mass[up] += mass[key]
        several[up] += several[key]
        last[up] = max(last[up], last[key])
    best = max((k for k in range(len(mass)) if page.holds[k] and several[k] > 1 and mass[k] >= 0.6 * mass[0]), default=0)
    return best, last[best]


FEATURES = ("one", "loose", "firm", "favour", "inside", "outside", "off_main", "linked", "all_links", "words", "stops", "few_words", "heading", "paragraph", "item", "telltale", "much_telltale", "telltale_inside", "sign")


def features(page: Page) -> np.ndarray:
    """blocks x FEATURES."""
    first, last = _main_part(page)
    article = sum(len(b.text) for b in page.blocks if b.inside and not b.loose and not b.firm) >= 0.3 * sum(len(b.text) for b in page.blocks if not b.loose and not b.firm)
    rows = []
    for b in page.blocks:
        words, away = b.text.count(" ") + 1, not first <= b.parent <= last or article and not b.inside
        told = [w for w in _TEXT_WORDS.findall(b.text[:2000].lower()) if w in TELLTALE] if words <= 60 else []  # a feature of short blocks
        rows.append((
            1, b.loose / 2, b.firm / 2, b.favour, b.inside, article and not b.inside, not first <= b.parent <= last, b.linked, b.linked > 0.8, min(words, 40) / 20, min(len(_STOP.findall(b.text[:2000])), 3) / 3,
            words < 4, b.tag in ("h1", "h2", "h3"), b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "dd", "dt", "td"), away and bool(told), away * min(1.0, 6 * len(told) / words), not away and min(1.0, 3 * len(told) / words), b.text[:1] in "©→»|",
        ))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


class Labeller(NamedTuple):
    weights: np.ndarray
    adjacent: float  # smoothness between neighbours in page order
    sibling: float  # and between neighbours under one parent

    def odds(self, page: Page) -> list[float]:
        """Log-odds of each block's being content."""
        return (features(page) @ self.weights).tolist()

    def edges(self, page: Page) -> list[tuple[int, int, float]]:
        out = [(i - 1, i, self.adjacent) for i in range(1, len(page.blocks))]
        last: dict[int, int] = {}
        for i, b in enumerate(page.blocks):
            if b.parent in last:
                out.append((last[b.parent], i, self.sibling))
            last[b.parent] = i
        return out

    def label(self, page: Page) -> list[bool]:
        """Which blocks are content."""
        odds = self.odds(page)
        return minimum_cut([max(0.0, o) for o in odds], [max(0.0, -o) for o in odds], self.edges(page))


#: Pages that the classifier is fitted on, those that the smoothness is chosen on, and the choices.
FIT, CHOOSE, SMOOTH = 500, 150, ((0.2, 0.4), (0.4, 0.8), (0.6, 1.0), (0.8, 1.5))


def generated(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its content blocks: invented words in regions with varied tags, class names and order."""
    semantic, naming = rng.random() < 0.5, rng.choice(("told", "told", "told", "untold", "none"))
    plain = rng.choice(("p", "p", "p", "div"))
    content: set[str] = set()
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiouäéí") for _ in range(rng.randint(1, 4)))

    def text(least: int, most: int, ends: str = ".") -> str:
        words = [word() for _ in range(rng.randint(least, most))]
        for k in range(9, len(words), rng.randint(7, 14)):
            words[k] += rng.choice((".", ",", ".", "?"))
        return (" ".join(words)).capitalize() + ends

    def telling(least: int, most: int) -> str:
        words = [word() for _ in range(rng.randint(least, most))]
        for _ in range(rng.randint(1, max(1, len(words) // 3))):
            words[rng.randrange(len(words))] = rng.choice(sorted(TELLTALE))
        return " ".join(words).capitalize() + rng.choice((".", "", "!"))

    def named(*names: str) -> str:
        if naming == "none" or rng.random() < 0.1:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(names) if naming == "told" else word()}"'

    def region(tag: str, inner: str, *names: str) -> str:
        tag = tag if semantic and rng.random() < 0.9 else rng.choice(("div", "div", "section"))
        return f"<{tag}{named(*names)}>{inner}</{tag}>"

    def links(n: int, most: int) -> str:
        items = [f'<a href="/{k}">{text(1, most, "")}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)

    def keep(tag: str, least: int, most: int, ends: str = ".") -> str:
        own = text(least, most, ends) if rng.random() < 0.9 else telling(max(2, least), max(2, most))
        content.add(own)
        if rng.random() < 0.15 and " " in own:
            head, tail = own.split(" ", 1)
            return f'<{tag}><a href="#">{head}</a> {tail}</{tag}>'
        return f"<{tag}>{own}</{tag}>"

    def advert() -> str:
        inner = text(2, 25) if rng.random() < 0.6 else telling(3, 20)
        return region("div" if rng.random() < 0.7 else "aside", rng.choice(("{}", "<p>{}</p>", '<a href="#">{}</a>')).format(inner), "ad", "advert", "sponsored", "ad-slot banner", "promo")

    def story() -> str:
        out = [keep("h1", 2, 9, "")] if rng.random() < 0.9 else []
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12))):
            kind = rng.random()
            if kind < 0.78:
                out.append(keep(plain if rng.random() < 0.97 else "div", 2, rng.choice((12, 40, 120))))
            elif kind < 0.84:
                out.append(keep("h2", 1, 6, ""))
            elif kind < 0.92:
                out.append("<ul>" + "".join(keep("li", 1, 14, "") for _ in range(rng.randint(2, 6))) + "</ul>")
            else:
                out.append(keep("blockquote", 4, 40))
            if rng.random() < 0.07:
                out.append(advert())
        body = "".join(out)
        if semantic and rng.random() < 0.3:
            head, _, rest = body.partition("</h1>")
            body = f"<header>{head}</h1></header>{rest}" if rest else body
        return body

    def comments() -> str:
        own = "".join(f"<div{named('comment', 'comment-body')}><b>{word()}</b><p>{text(4, 40)}</p></div>" for _ in range(rng.randint(1, 4)))
        return region("section", f"<h2>{rng.choice(('Comments', 'Kommentare', 'Commentaires', 'Comentarios', telling(1, 3)))}</h2>{own}", "comments", "comment-list", "discussion")

    body = story()
    main = region("article", body, "article", "post", "entry-content", "story", "content")
    if rng.random() < 0.3:
        main = region("main", main, "main", "content", "page")
    top = [region("nav", links(rng.randint(2, 8), 3), "nav", "menu", "navbar")] if rng.random() < 0.9 else []
    if rng.random() < 0.5:
        top.append(region("header", f"<p>{text(1, 8, '')}</p>", "header", "masthead", "topbar"))
    if rng.random() < 0.4:
        top.append(region("div", f"<p>{telling(6, 30)}</p>" + ("<button>OK</button>" if rng.random() < 0.5 else ""), "cookie-notice", "consent", "notice"))
    if rng.random() < 0.5:
        top.append(advert())
    low = [advert()] if rng.random() < 0.3 else []
    if rng.random() < 0.35:
        low.append(region("aside", (f"<p>{text(4, 25)}</p>" if rng.random() < 0.5 else "") + links(rng.randint(2, 6), 9), "sidebar", "related", "widget"))
    if rng.random() < 0.3:
        low.append(comments())
    if rng.random() < 0.25:
        low.append(f"<form{named('newsletter', 'signup')}><p>{telling(4, 14)}</p><label>{word()}</label><input name=q></form>")
    if rng.random() < 0.85:
        low.append(region("footer", rng.choice(("{}", "<p>{}</p>")).format(rng.choice(("&copy; ", "", "2024 ")) + (telling(4, 16) if rng.random() < 0.6 else text(3, 20))), "footer", "legal", "copyright"))
    rng.shuffle(top)
    rng.shuffle(low)
    if rng.random() < 0.15 and low:
        top.append(low.pop())
    inner = "".join([*top, main, *low])
    if rng.random() < 0.3:
        inner = f"<div{named('wrapper', 'page', 'layout')}>{inner}</div>"
    return f"<html><body>{inner}</body></html>", content


def fit(seed: int = 11) -> Labeller:
    """Weights by Newton's method on generated pages; the smoothness that labels most blocks of further ones rightly."""
    rng = random.Random(seed)
    pages = [(parse(page), texts) for page, texts in (generated(rng) for _ in range(FIT + CHOOSE))]
    x = np.vstack([features(p) for p, _ in pages[:FIT]])
    y = np.array([b.text in texts for p, texts in pages[:FIT] for b in p.blocks], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    right = lambda own: sum(s == (b.text in texts) for page, texts in pages[FIT:] for b, s in zip(page.blocks, own.label(page), strict=True))
    return max((Labeller(w, *smooth) for smooth in SMOOTH), key=right)


@functools.cache
def labeller() -> Labeller:
    return fit()


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: maximum flow by blocking flows (two-way edges), then reach in the residual graph."""
    n = len(source)
    through = [min(a, b) for a, b in zip(source, sink, strict=True)]
    give, take = [a - f for a, f in zip(source, through, strict=True)], [b - f for b, f in zip(sink, through, strict=True)]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        near[a].append(len(to))
        to.append(b)
        near[b].append(len(to))
        to.append(a)
        room += [c, c]
    least = 1e-9
    while True:
        level = [0 if g > least else -1 for g in give]
        queue = deque(i for i in range(n) if not level[i])
        goal = False
        while queue:
            x = queue.popleft()
            goal = goal or take[x] > least
            for e in near[x]:
                y = to[e]
                if room[e] > least and level[y] < 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        if not goal:
            return [v >= 0 for v in level]
        upto = [0] * n
        for start in range(n):
            while give[start] > least and level[start] == 0:
                path: list[int] = []
                x = start
                while take[x] <= least:
                    while upto[x] < len(near[x]):
                        e = near[x][upto[x]]
                        if room[e] > least and level[to[e]] == level[x] + 1:
                            break
                        upto[x] += 1
                    else:
                        if not path:
                            break
                        x = to[path.pop() ^ 1]
                        upto[x] += 1
                        continue
                    path.append(e)
                    x = to[e]
                else:
                    push = min([give[start], take[x], *(room[e] for e in path)])
                    give[start] -= push
                    take[x] -= push
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    continue
                break


def main_text(page: str | None, own: Labeller | None = None) -> str:
    """The content blocks of a page, joined by newlines; empty for a null or a page without any."""
    found = parse(page or "")
    if not found.blocks:
        return ""
    stay = (own or labeller()).label(found)
    return "\n".join(b.text for b, s in zip(found.blocks, stay, strict=True) if s)


def _extract(own: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, whole.num_columns - 1)):
            texts = [main_text(t, own) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text and n_chars (code points), one row per row of pages.

    A null html counts as empty and gives the empty text. Inside a block white space becomes one space and character references
    are decoded; blocks come in page order. Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(thrifty(_extract(labeller())), rows.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema)
