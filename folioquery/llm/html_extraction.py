"""Main text of web pages by tree scoring (operator 8).

A page is read into a tree below one body, which is there whether or not the
page says so. Paragraphs pass points for their length and commas to their
ancestors, in full to the parent, half to the next and less further up; a
container's sum is discounted by its link density, and by half if a word of its
class or id speaks against it. The best container is kept, with its siblings and
those of its wrappers that read like it: anything but lists of links and
containers that speak against themselves. If the page marks its article (article,
main, role main), that is the container, and a sibling of it has to be another
one, a heading, a paragraph, hold a heading, or score a fifth of it.

Furniture is taken out beforehand: by element (scripts, forms' parts, menus; nav,
aside, footer, and header outside the article), by role, and by class or id where
a whole token names it (``sidebar``, ``cookie-banner``; not ``has-sidebar`` or
``market-share``). An element named so is no furniture if it holds more than half
of the page's text, links aside, and the page's article mark or title, or all its
text: then it is a wrapper.

Defined results: a null or empty page gives an empty text, as does a page of
furniture only; a fragment or plain text is the content of a body; a page without
any container that scores is kept whole but for furniture; start tags that
imply an end (p, li, dt, dd, tr, td, th, option, headings) close their likes, other
unclosed elements end with their parent and stray end tags mean nothing; a tag
cut off at the end is dropped; equal rows give equal results; an empty table
gives no rows; further columns are not read. Time grows with a page's length.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

OUT = "page_id long, url string, text string"

#: Elements without content, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in a head; any other ends it.
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: A start tag of the first ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {h: HEADINGS for h in HEADINGS}
#: An implied end does not reach beyond these.
SCOPE = frozenset("body table td th ul ol dl article section div main aside nav footer header form blockquote".split())
#: Elements that are never text, elements that are furniture unless they wrap the page, and roles that are.
NEVER = frozenset("head title script style noscript template nav iframe button select textarea input svg canvas object embed audio video dialog menu".split())
CONTROLS = frozenset("button input select textarea".split())
FURNITURE = frozenset("footer aside form header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words that name furniture, alone or with the plain words below.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs adsbygoogle adsense alert alerts pagination pager footer masthead topbar toolbar comment comments commentlist disqus reply replies respond notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets skip hidden".split()
)
PLAIN = frozenset("site page main global top bottom left right primary secondary box bar list section container wrapper wrap area block slot unit item items post posts article articles link links button buttons icons form header inner outer content body text title thread panel row col column group image".split())
#: Nouns that name furniture whatever stands before them, and words that do wherever they stand.
HEADS = frozenset("ad ads advert adverts advertisement advertisements comment comments commentlist sidebar sidenav pagination newsletter signup login popup modal notice notices alert alerts nav navbar navigation footer".split())
ANYWHERE = frozenset("breadcrumb breadcrumbs gdpr adsbygoogle adsense".split())
#: Words that with a plain one behind them name a notice, and words that alone name furniture only around links or controls.
NOTICES, WEAK = frozenset("cookie cookies consent".split()), frozenset("share sharing social".split())
#: Words that turn the sense of a class: an element that has a sidebar is none.
TURNED = frozenset("has with without no non not is".split())
MARKS = frozenset("article main".split())
CONTAINERS = frozenset("article main div section td body".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dd div section article main body figcaption".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
COMMAS = re.compile("[,،、，]")
CUT_OFF = re.compile("<(?=[A-Za-z/!?]|$)")
BODY = 1
NAMED, LOWER, BARE = 1, 2, 3


def named(token: str) -> int:
    """What one token of a class or id says: furniture, a lower score, furniture around links or controls, or nothing.

    The last word that is not plain is the token's noun. A noun of HEADS decides, with
    any words before it; other furniture words decide only where no unknown word stands
    beside them, and lower the score elsewhere.
    """
    words = [w for w in SPLIT.split(CAMEL.sub(r"\1-\2", token).lower()) if w]
    if not any(w in WORDS for w in words) or any(w in TURNED for w in words):
        return 0
    if len(words) == 1 and words[0] in WEAK:
        return BARE
    nouns = [w for w in words if w not in PLAIN and not w.isdigit()]
    if nouns[-1] in HEADS or any(w in ANYWHERE for w in words) or (words[-1] in PLAIN and any(w in NOTICES for w in words)):
        return NAMED
    return NAMED if all(w in WORDS for w in nouns) else LOWER


class Page(HTMLParser):
    """Elements in page order, each with its parent, and texts with their element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent = ["#", "body"], [-1, 0]
        self.never, self.named, self.lower, self.mark, self.bare = ([False, False] for _ in range(5))
        self.items: list[tuple[int, str | None]] = []  # (element, text); a None text ends a block
        self.open, self.many = [0, BODY], {"body": 1}
        self.known: dict[str, int] = {}

    def _look(self, tag: str, attrs) -> tuple[bool, bool, bool, bool, bool]:
        """Never text; named furniture; named against; marked as the article; furniture around links or controls."""
        never, furniture, lower, mark, bare = tag in NEVER, tag in FURNITURE, False, tag in MARKS, False
        in_article = self.many.get("article", 0) + self.many.get("main", 0) > 0
        if tag == "header":
            furniture = not in_article
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                never = True
            elif name == "role":
                mark = mark or value.lower() == "main"
                furniture = furniture or value.lower() in ROLES
            elif name in ("class", "id"):
                for token in value.split():
                    if token not in self.known:
                        self.known[token] = named(token)
                    furniture = furniture or (self.known[token] == NAMED and not (tag == "header" and in_article))
                    lower = lower or self.known[token] in (LOWER, BARE)
                    bare = bare or self.known[token] == BARE
        return never, furniture, lower, mark and not furniture, bare

    def _pop(self, tags, until) -> None:
        """Closes open elements from one of ``tags`` on, unless one of ``until`` lies in between."""
        if not any(self.many.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, BODY, -1):
            tag = self.tag[self.open[i]]
            if tag in tags:
                for e in self.open[i:]:
                    self.many[self.tag[e]] -= 1
                del self.open[i:]
                return
            if tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self._pop({"head"}, ())
            return
        if tag not in IN_HEAD:
            self._pop({"head"}, ())
        if tag in BLOCKS:
            self._pop({"p"}, SCOPE)
        if tag in ENDS:
            self._pop(ENDS[tag], SCOPE - ENDS[tag])
        at = self.open[-1]
        if tag in BLOCKS and tag not in ("td", "th"):
            self.items.append((at, None))
        elif tag in ("br", "td", "th"):
            self.items.append((at, " "))
        if tag not in VOID:
            never, furniture, lower, mark, bare = self._look(tag, attrs)
            self.tag.append(tag)
            self.parent.append(at)
            self.never.append(self.never[at] or never)
            self.named.append(furniture)
            self.lower.append(lower)
            self.mark.append(mark)
            self.bare.append(bare)
            self.open.append(len(self.tag) - 1)
            self.many[tag] = self.many.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag in BLOCKS and tag not in ("td", "th"):
            self.items.append((self.open[-1], None))
        self._pop({tag}, () if tag in BLOCKS else SCOPE)
        if tag in BLOCKS and tag not in ("td", "th"):
            self.items.append((self.open[-1], None))

    def handle_data(self, data):
        if self.many.get("head") and self.tag[self.open[-1]] == "head" and not data.isspace():
            self._pop({"head"}, ())
        at = self.open[-1]
        if not self.never[at]:
            self.items.append((at, data))


class Scored:
    """A page's furniture, points, text and link lengths by element."""

    def __init__(self, page: Page):
        self.tag, self.parent, n = page.tag, page.parent, len(page.tag)
        own, commas, self.block, self.linked = [0] * n, [0] * n, list(range(n)), [False] * n
        for i in range(1, n):
            up = self.parent[i]
            self.linked[i] = self.tag[i] == "a" or self.linked[up]
            self.block[i] = i if self.tag[i] in BLOCKS else self.block[up]
        texts = [(e, t) for e, t in page.items if t and not t.isspace()]
        plain, whole = [0] * n, [0] * n
        for e, text in texts:
            whole[e] += len(text)
            plain[e] += 0 if self.linked[e] else len(text)
        whole, controls = self._up(whole), self._up([t in CONTROLS for t in self.tag])
        heads = [self.tag[i] == "h1" and not page.never[i] for i in range(n)]
        plain, heads, marks = self._up(plain), self._up(heads), self._up(page.mark)
        self.drop = [False] * n
        for i in range(1, n):
            wraps = page.named[i] and 2 * plain[i] > plain[0] and (marks[i] or heads[i] or plain[i] == plain[0])
            strip = page.bare[i] and (2 * plain[i] <= whole[i] or (controls[i] > 0 and plain[i] < 80))
            self.drop[i] = self.drop[self.parent[i]] or page.never[i] or strip or (page.named[i] and not (wraps and self.tag[i] not in ("footer", "aside")))
        self.size, self.links = [0] * n, [0] * n
        for e, text in texts:
            if not self.drop[e]:
                length = len(" ".join(text.split()))
                own[self.block[e]] += length
                commas[self.block[e]] += len(COMMAS.findall(text))
                self.size[e] += length
                self.links[e] += length if self.linked[e] else 0
        raw = [0.0] * n
        for i in range(1, n):
            if own[i] and self.tag[i] in PARAGRAPHS:
                p = (1 if own[i] >= 25 else 0.1) + commas[i] + min(own[i] / 100, 3)
                to, share, step = (i if self.tag[i] in CONTAINERS else self.parent[i]), 1.0, 0
                while to >= BODY and share > 1e-3:
                    raw[to] += p * share
                    step += 1
                    share = 0.5 if step == 1 else 1 / (3 * step)
                    to = self.parent[to]
        self.size, self.links = self._up(self.size), self._up(self.links)
        self.heads, self.titled = self._up([self.tag[i] in HEADINGS and not self.drop[i] and self.size[i] > 0 for i in range(n)]), heads
        self.against = page.lower
        self.points = [p * (1 - self.density(i)) * (0.5 if page.lower[i] else 1) for i, p in enumerate(raw)]
        self.mark = [m and not d for m, d in zip(page.mark, self.drop)]

    def _up(self, values: list) -> list:
        """Sums over subtrees; parents come before their children."""
        out = [int(v) for v in values]
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def density(self, i: int) -> float:
        return self.links[i] / self.size[i] if self.size[i] else 1.0

    def keep(self) -> set[int]:
        """The best container, its siblings and those of its wrappers."""
        found = [i for i in range(1, len(self.tag)) if self.points[i] > 0 and not self.drop[i]]
        if not found:
            return {BODY}
        best = max(found, key=lambda i: (self.points[i], -i))
        up = best
        while up > BODY and not self.mark[up]:
            up = self.parent[up]
        marked = self.mark[up]
        best = up if marked else best
        kept, least = {best}, max(1.0, 0.2 * self.points[best])
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.tag)):
            children.setdefault(self.parent[i], []).append(i)
        first = True
        while best > BODY:
            up = self.parent[best]
            if self.size[up] > self.size[best]:
                kept.update(i for i in children[up] if i != best and not self.drop[i] and self._like(i, least, marked, first))
                first = False
            if marked and not first:
                break
            best = up
        return kept

    def _like(self, i: int, least: float, marked: bool, first: bool) -> bool:
        """Whether a sibling belongs to the article."""
        if not self.size[i] or self.points[i] >= least:
            return self.size[i] > 0
        if self.density(i) >= 0.5 or self.against[i]:
            return False
        if self.tag[i] in HEADINGS or self.tag[i] == "p":
            return True
        if marked:
            return self.mark[i] or (self.heads[i] > 0 and self.links[i] == 0)
        return first or self.points[i] > 0 or self.heads[i] > 0


def main_text(html: str | None) -> str:
    """Blocks of the article, joined by an empty line."""
    if not html:
        return ""
    if cut := CUT_OFF.search(html, html.rfind(">") + 1):
        html = html[: cut.start()]
    page = Page()
    page.feed(html)
    page.close()
    scored = Scored(page)
    keep = scored.keep()
    # text that stands bare beside a kept container belongs to it, unless the article is marked
    bare = {scored.parent[i] for i in keep if i > BODY and not scored.mark[i]}
    inside = [False] * len(page.tag)
    for i in range(1, len(inside)):
        inline = scored.parent[i] in bare and page.tag[i] not in BLOCKS and scored.density(i) < 0.5
        inside[i] = (i in keep or inside[page.parent[i]] or inline) and not scored.drop[i]
    blocks, now = [], []
    for e, text in [*page.items, (0, None)]:
        if text is None:
            if line := " ".join("".join(now).split()):
                blocks.append(line)
            now = []
        elif inside[e] or (e in bare and not scored.drop[e]):
            now.append(text)
    return "\n\n".join(blocks)


def _extract(batches):
    for batch in batches:
        text = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    return pages.select(pages["page_id"], pages["url"], pages["html"]).mapInArrow(_extract, OUT)
