"""HTML extraction by two passes of block rules.

Pass 1 reads one page into blocks and decides the clear ones: a block inside a boilerplate container (menu, header,
footer, sidebar, notice, advert, form, comments) or made mostly of links is boilerplate; a block with enough characters
and enough stop words is text. All others - short ones, long ones without stop words - stay open. Pass 2 gives each open
block the label of its nearest decided neighbours: if both agree, that label; otherwise the nearer one's. The ends of the
page count as boilerplate neighbours, the ends of an article or main element as text neighbours, so that an article whose
paragraphs are all short is kept. Where a page marks an article, blocks outside it are boilerplate.

A class or id is only a hint: it never marks an article or main element itself, and a main element inside a wrapper that
is boilerplate by name alone (``content-sidebar-wrap``) is content. So is an article, unless the page has content outside
such wrappers: then it is a comment or a teaser. Real containers (nav, aside, form, roles, hidden) hold for all in them.

Each page is one row and is handled alone: no shuffle, memory of one page. The tokenizer is linear in the page: a tag,
comment, script or style that never closes ends the page, as in a browser.

Defined cases: null or empty html gives an empty text; markup without any block of text gives an empty text; null page_id
or url go through; repeated rows give repeated results.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import map_texts

MIN_CHARS = 70            # a block this long with enough stop words is text
STOP_SHARE = 0.10
LINK_SHARE = 0.5
# Frequent function words of the languages read here; a parameter of the operator.
STOP_WORDS = frozenset("""
the of and to in is was for on that with as by it are this be at from or an have not which but
der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch an werden aus er hat dass sie nach bei um am
le la les de des du et en un une que qui dans pour par sur au avec il est pas plus ce sont ou ne se
el los las y del que en un una por con para es al lo como más su pero sus o este no
""".split())

BLOCKS = frozenset("""html body head title p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
blockquote pre section article main aside nav header footer form fieldset figure figcaption address details summary hr dialog
option legend center""".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())    # their content is not markup
SILENT = frozenset("""script style textarea title noscript template iframe noembed noframes svg math select button datalist object
canvas audio video head xmp""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
BOILER_NAMES = frozenset("""ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner menu nav navbar
navigation breadcrumb breadcrumbs sidebar masthead header topbar footer cookie cookies consent gdpr notice notification popup modal
overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations
comment comments commentlist disqus replies respond discussion widget toolbar pagination pager copyright skip""".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    text: str
    links: int               # characters of it inside links
    boiler: bool             # inside a boilerplate container
    content: int             # number of the article or main element around it, 0 if none
    named: bool = False      # that is an article inside a container which is boilerplate by name alone


@dataclass(slots=True)
class _Open:
    tag: str
    boiler: bool
    content: int
    silent: bool
    real: bool = False       # boilerplate by more than a name
    named: bool = False


def _is_boiler(tag: str, raw: str, content: int) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether by more than its class or id."""
    if tag in BOILER_TAGS or (tag == "header" and not content):
        return True, True
    by_name = False
    if not raw.strip() or tag in ("html", "body", "main", *HEADINGS):
        return False, False
    for name, *values in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), unescape("".join(values)).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, True
        if name == "role" and value in BOILER_ROLES:
            return True, True
        if name in ("class", "id") and tag != "article" and not BOILER_NAMES.isdisjoint(_NAME.findall(value)):
            # an article's own header holds its heading
            by_name |= not (content and {"header"} == BOILER_NAMES.intersection(_NAME.findall(value)))
    return by_name, False


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order; character references decoded, white space turned into single spaces."""
    stack = [_Open("", False, 0, False)]
    out: list[Block] = []
    text: list[str] = []
    links = in_link = contents = at = 0
    end = len(html)

    def close() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            top = stack[-1]
            out.append(Block(joined, min(links, len(joined)), top.boiler, top.content, top.named))
        text.clear()
        links = 0

    while at < end:
        mark = html.find("<", at)
        mark = end if mark < 0 else mark
        if mark > at and not stack[-1].silent:
            piece = unescape(html[at:mark])
            text.append(piece)
            if in_link:
                links += len("".join(piece.split()))
        if mark == end:
            break
        if html.startswith("<!--", mark):
            stop = html.find("-->", mark + 4)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), mark):
            stop = html.find(">", mark)
            at = end if stop < 0 else stop + 1
            continue
        if not re.match(r"</?[a-zA-Z]", html[mark:mark + 3]):
            if not stack[-1].silent:
                text.append("<")
            at = mark + 1
            continue
        found = _TAG.match(html, mark)
        if not found:
            break                                  # a tag that never ends
        at, tag, closing = found.end(), found[2].lower(), bool(found[1])
        if tag == "br":
            text.append(" ")
        if closing:
            if tag in BLOCKS:
                close()
            if tag == "a":
                in_link = max(0, in_link - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in BLOCKS and any(x.tag in BLOCKS for x in stack[i + 1:]):
                        break                      # a stray inline end tag doesn't close blocks
                    if len(stack) > i and (stack[-1].boiler, stack[-1].content) != (stack[i - 1].boiler, stack[i - 1].content):
                        close()
                    del stack[i:]
                    break
            continue
        if tag in BLOCKS:
            close()
            in_link = 0
            if stack[-1].tag == "p" or (tag == "li" and stack[-1].tag == "li"):
                stack.pop()                        # implied end tag
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS | RAW | {"a"}:
            continue
        if tag == "a":
            in_link += 1
        top = stack[-1]
        contents += tag in CONTENT and not top.content
        content = top.content or (contents if tag in CONTENT else 0)
        own, real = _is_boiler(tag, found[3], content)
        freed = tag in CONTENT and not top.content and top.boiler and not top.real
        boiler, real, named = own or (top.boiler and not freed), real or top.real, top.named or (freed and tag == "article")
        if boiler and not top.boiler and tag not in BLOCKS:
            close()
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if not stop:
                break
            at = stop.start()
        stack.append(_Open(tag, boiler, content, top.silent or tag in SILENT, real, named))
    close()
    return out


def labels_of(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """True for text. The two passes described above."""
    if any(b.content and not b.boiler and not b.named for b in blocks):
        blocks = [replace(b, boiler=b.boiler or b.named) for b in blocks]
    marked = any(b.content and not b.boiler for b in blocks)
    label: list[bool | None] = []
    for b in blocks:                                               # pass 1
        words = b.text.lower().split()
        if b.boiler or (marked and not b.content) or b.links > LINK_SHARE * len(b.text.replace(" ", "")):
            label.append(False)
        elif len(b.text) >= MIN_CHARS and sum(w.strip(".,;:!?") in stop_words for w in words) >= STOP_SHARE * len(words):
            label.append(True)
        else:
            label.append(None)
    out = [bool(x) for x in label]
    before = nearest(blocks, label, range(len(blocks)))
    after = nearest(blocks, label, range(len(blocks) - 1, -1, -1))
    for i, known in enumerate(label):                              # pass 2
        if known is None:
            (near, a), (far, b) = sorted((before[i], after[i]), key=lambda x: (x[0], not x[1]))
            out[i] = a                             # equal labels, or the nearer one; at equal distance text wins
    return out


def nearest(blocks: list[Block], label: list[bool | None], order: range) -> list[tuple[int, bool]]:
    """For each block the distance to, and the label of, the decided neighbour that comes before it in ``order``."""
    out, inside, far, last = [(0, False)] * len(blocks), None, 0, False
    for i in order:
        if blocks[i].content != inside:            # an edge of the page or of an article is a neighbour too
            inside, far, last = blocks[i].content, 0, blocks[i].content > 0
        far += 1
        out[i] = (far, last)
        if label[i] is not None and not (blocks[i].boiler and blocks[i].content):
            far, last = 0, label[i]
    return out


def main_text(html: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, labels_of(blocks, stop_words), strict=True) if keep)


def extract_text(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    def work(raw: list[bytes]) -> dict[str, pa.Array]:
        return {"text": pa.array([main_text(x.decode("utf-8", "replace"), stop_words) for x in raw], pa.string())}

    made = map_texts(pages.select("page_id", "url", "html"), "text string", work, text="html", keep=("page_id", "url"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
