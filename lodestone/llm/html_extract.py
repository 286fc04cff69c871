"""HTML extraction: streamed parser events become lines, whose smoothed text-to-tag ratios are clustered to select content regions.

Lines of elements that are no article by the standard's definition, such as nav, footer, aside and form, are left out, and
lower the ratios around them. For all other text the ratios decide: each line has the logarithm of its unlinked characters
for each tag, smoothed over its neighbours; a region is a container's own text; two clusters of line values give the
threshold that a region's mean must reach. An article element, or a class that names adverts, comments and the like,
moves a region's mean but settles nothing by itself.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import long, map_texts

#: Width of the Gaussian, in lines, and how many widths it reaches.
SIGMA = 1.5
REACH = 3
#: What a class that names boilerplate, and an article element, add to the logarithm of a region's ratio.
MARKED = -4.0
WITHIN = 1.5
#: Clusters whose means are nearer than this are one: then there is no threshold.
APART = 1.0

# Elements of the HTML standard by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg iframe object select textarea button datalist canvas audio video title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
REGIONS = frozenset("article main section div td body".split())
OWN = frozenset(("article", "main"))
#: Elements whose class, id or role can name boilerplate; a paragraph's names say nothing.
NAMED = frozenset("article section div header td table ul ol dl details figure center span".split())
#: What can stand in a head; any other start tag ends an open head, whose end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag that ends an open element of its kind.
ENDS = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words of a class, id or role that name what is not the article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs masthead header footer cookie cookies notice notices consent gdpr popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus pagination pager widget toolbar copyright legal disclaimer alert complementary contentinfo search hidden".split()
)
#: Words that make a header part of the article.
INSIDE = frozenset("article post entry content story main".split())
_WORDS = re.compile(r"[a-z]+")


class Lines(HTMLParser):
    """Collects the lines of a page: text, its logarithmic ratio, whether its element is left out, and its region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float, bool, int]] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, hidden, left out, region
        self.weight: list[float] = [0.0]  # of each region, what names and elements add
        self.own: set[int] = set()
        self.buffer: list[str] = []
        self.tags = self.linked = self.chars = 0

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        if text:
            _, _, out, region = self.open[-1] if self.open else ("", False, False, 0)
            free = len(text) * (1 - min(self.linked / max(self.chars, 1), 1))
            self.lines.append((text, float(np.log1p(free / max(self.tags, 1))), out, region))
            self.tags = 0
        self.buffer.clear()
        self.linked = self.chars = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD and tag != "head":
            self.open.pop()
        if tag in VOID:
            if tag in ("br", "hr"):
                self.buffer.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        while self.open and tag in ENDS.get(self.open[-1][0], ()):
            self.open.pop()
        if tag in BLOCKS and "p" in (names := [x[0] for x in self.open]):
            at = len(names) - 1 - names[::-1].index("p")
            if not any(n in BLOCKS for n in names[at + 1 :]):
                del self.open[at:]  # a block ends an open paragraph, with what is inline in it
        _, hidden, out, region = self.open[-1] if self.open else ("", False, False, 0)
        named = frozenset(_WORDS.findall(" ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower())) if tag in NAMED and attrs else frozenset()
        inside = region in self.own or bool(named & INSIDE)
        out = out or tag in BOILERPLATE or tag == "header" and not inside or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        marked = bool(named & (MARKS - {"header"} if inside else MARKS)) and tag in BLOCKS
        if marked or tag in REGIONS and region not in self.own:
            # what is named boilerplate is a region of its own wherever it stands; what it holds shares its weight
            weight = MARKED if marked else min(self.weight[region], 0.0)
            if tag in OWN and not out and weight == 0:
                weight = WITHIN
                self.own.add(len(self.weight))
            region = len(self.weight)
            self.weight.append(weight)
        self.open.append((tag, hidden or tag in HIDDEN, out, region))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in ("table", "article", "main", "body") and tag not in BLOCKS:
                return  # an inline end tag reaches no further out

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.open.pop()  # text can't stand in a head
        if not (self.open and self.open[-1][1]):
            self.buffer.append(data)
            size = len(data.strip())
            self.chars += size
            if any(x[0] == "a" for x in self.open[-4:]):
                self.linked += size


def smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; beyond the page's ends there is nothing to count."""
    reach = int(np.ceil(SIGMA * REACH))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return (np.convolve(x, k) / np.convolve(np.ones(len(x)), k))[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """The middle between the means of two clusters of values; below all of them if the clusters are not APART."""
    low, high = x.min(), x.max()
    for _ in range(50):
        above = x > (low + high) / 2
        if above.all() or not above.any():
            break
        was, low, high = (low, high), x[~above].mean(), x[above].mean()
        if was == (low, high):
            break
    return (low + high) / 2 if high - low >= APART else float(x.min()) - 1


def main_text(html: str | None) -> str:
    """The article of a page: the lines of its content regions, in page order, joined by one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, weight = parser.lines, parser.weight
    kept = [k for k, x in enumerate(lines) if not x[2]]
    if all(weight[lines[k][3]] < 0 for k in kept):
        return ""  # nothing but what is named boilerplate
    ratios = smooth(np.array([0.0 if x[2] else x[1] for x in lines]))
    values = np.array([ratios[k] + weight[lines[k][3]] for k in kept])
    region, size = np.array([lines[k][3] for k in kept]), np.array([len(lines[k][0]) for k in kept], float)
    regions, at = np.unique(region, return_inverse=True)
    mass = np.bincount(at, size)
    mean = np.bincount(at, size * values) / mass
    chosen = mean >= threshold(values)
    chosen[np.argmax(np.log(mass) + mean)] = True
    return " ".join(lines[k][0] for k, r in zip(kept, at, strict=True) if chosen[r])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds text_col, the main text of each page, and n_chars, its code points.

    Null and empty pages, and pages of boilerplate alone, give an empty text. Broken markup is read as far as it goes.
    Whole pages are read; a row's result depends on its page alone, so ties and repeated rows repeat it. Input columns
    with a result's name are replaced; an empty table gives an empty result.
    """

    def make():
        def run(htmls):
            found = [main_text(h) for h in htmls]
            return [found, [len(t) for t in found]]

        return run

    return map_texts(pages, html_col, [T.StructField(text_col, T.StringType()), long("n_chars")], make, keep)
