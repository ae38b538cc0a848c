"""Main text of web pages by block rules in two passes.

Pass 1 cuts a page into blocks and decides each by what encloses it, its share of linked text, its
length and its density of stop words: good, bad, near or short. Pass 2 gives the undecided ones the
label of their nearest decided neighbours. Kept blocks are joined by a line feed in page order.

A null, empty or text-less page gives an empty text; unclosed, stray and cut-off tags are read as
browsers do where it matters (a block ends where the next begins); repeated pages are read each;
other columns, whatever their names, pass through untouched if they are kept and are not read otherwise.
Pages are read whole by one scan in linear time, however long or broken; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for on was as with be by are this from at or an which not but have had has he she they his her their you we i
    le la les un une des du de et est en que qui dans pour pas sur par plus ce avec au aux il elle ne se son sa ses ou mais nous vous
    der die das und ist von zu den mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie
    el los las y del se por con una su para es al lo como más o pero sus ya fue este ha sí porque esta entre cuando muy sin sobre también
    """.split()
)
SHORT, LONG = 70, 200
SPARSE, DENSE = 0.2, 0.3
STRAY = 0.1  # of a page's words: with fewer stop words its language is none of the known ones
MOST_LINKED = 0.33

#: Elements whose content is no text of the page.
SILENT = frozenset("head title script style noscript template svg math canvas object iframe audio video select option optgroup datalist textarea button map".split())
#: Elements that hold no main text.
ASIDE = frozenset("nav aside footer form menu dialog fieldset search address".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|disclaimers?|popups?|modals?|overlays?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|widgets?|footers?|masthead|toolbars?|share|sharing|social|related|recommended|newsletters?|subscri(?:be|ption)|signup|login|comments?|comment-?list|replies|disqus|pagination|pager|skip(?:-?link)?|search|contentinfo|complementary|copyright)(?:$|[\s_-]|\d)",
    re.I,
)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:(?:site|page|top|global|main)[_-]?header|header)(?:$|[\s_-])", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag up to its end. What a part has matched is never given back, so the time is linear.
_REST = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+""")
_CLOSED = {x: re.compile(rf"</{x}\b[^>]*+(?:>|$)", re.I) for x in ("script", "style", "title", "textarea", "noscript", "iframe")}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: float
    main: bool
    aside: bool
    label: str = ""


def tags(page: str) -> Generator[tuple[int, int, str, bool, str], int | None, None]:
    """(start, end, lower-case name, closing, attributes) of each piece of markup, by one scan; comments and the like have no name.

    A < that opens no tag is text; a comment without an end takes the rest of the page. A caller may send the place to go on from.
    """
    at = page.find("<")
    while at >= 0:
        two = page[at + 1 : at + 2]
        closing = two == "/"
        m = _NAME.match(page, at + 1 + closing)
        name, attributes, end = "", "", -1
        if m:
            rest = _REST.match(page, m.end())
            if page.startswith(">", rest.end()):
                name, attributes, end = m.group().lower(), rest.group(), rest.end() + 1
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            end = stop + 3 if stop >= 0 else len(page)
        elif page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at + 9)
            end = stop + 3 if stop >= 0 else len(page)
        elif two and two in "!?/":
            end = page.find(">", at) + 1
            if not end:  # nothing closes it, nor anything like it that follows
                return
        on = at + 1
        if end >= 0:
            on = yield at, end, name, closing, attributes
            on = max(end, on or 0)
        at = page.find("<", on)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with what encloses them."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, aside, main
    text: list[str] = []
    linked = 0
    in_link = 0
    silent: str | None = None

    def end() -> None:
        nonlocal linked, text
        if text:
            whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                _, aside, main = stack[-1] if stack else ("", False, False)
                out.append(Block(whole, min(1.0, linked / len(whole)), main, aside))
        text, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(raw)
            if in_link:
                linked += len(entities.unescape(raw).strip())

    open_: Counter[str] = Counter()  # names on the stack
    at, on, found = 0, None, tags(page)
    while True:
        try:
            start, at_end, name, closing, attributes = found.send(on)
        except StopIteration:
            break
        on = None
        if silent is None:
            add(page[at:start])
        at = at_end
        if not name:
            continue
        if silent is not None:
            if closing and name == silent:
                silent = None
            continue
        if name in SILENT and not closing:
            if name in BLOCKS or name in ("head", "title"):
                end()
            if name in ("script", "style", "title", "textarea", "noscript", "iframe"):  # raw text: only its own end tag counts
                stop = _CLOSED[name].search(page, at)
                at = on = stop.end() if stop else len(page)
            elif name == "head":
                pass  # what it holds is silent by itself, and its end tag may be missing
            elif not attributes.rstrip().endswith("/"):
                silent = name
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in BLOCKS:
            end()
            if closing:
                while open_[name]:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
            elif name not in VOID:
                if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd")):
                    open_[stack.pop()[0]] -= 1
                _, aside, main = stack[-1] if stack else ("", False, False)
                names = " ".join(x for g in _ROLE.findall(attributes) for x in g if x) if attributes else ""
                own = name in ASIDE or bool(names) and bool(_BAD_NAME.search(names))
                own = own or (not main and (name == "header" or bool(names) and bool(_HEADER_NAME.search(names)) or names == "banner"))
                if name in ("body", "html", "article", "main"):
                    own = name in ASIDE
                stack.append((name, aside or own, main or name in ("article", "main") or names == "main"))
                open_[name] += 1
            in_link = 0 if name not in ("div", "span") else in_link
    if silent is None and at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!]", rest)  # a tag that the page's end cut off
        add(rest[: cut.start()] if cut else rest)
    end()
    return out


def density(block: Block, stop_words: frozenset[str]) -> tuple[int, int]:
    """Stop words and words of a block."""
    words = _WORD.findall(block.text.lower())
    return sum(w in stop_words for w in words), len(words)


def decide(block: Block, stop_words: frozenset[str] = STOP_WORDS, usual: float = DENSE) -> str:
    """Pass 1. An article or main element lowers what length and density are asked for, and low density counts there
    only if it is clearly (three deviations) below the page's usual share of stop words; in a language that is not
    known, length and link share alone decide."""
    n = len(block.text)
    if block.aside or block.linked > (0.6 if block.main else MOST_LINKED):
        return "bad"
    if block.main and block.linked > MOST_LINKED:
        return "short"
    if not block.main and (block.text[0] in "©®" or "©" in block.text[:80]):
        return "bad"
    short, long, sparse, dense = (SHORT // 2, SHORT, SPARSE / 2, DENSE - SPARSE / 2) if block.main else (SHORT, LONG, SPARSE, DENSE)
    if n < short:
        return "near" if block.main else "short" if block.linked == 0 else "bad"
    hits, words = density(block, stop_words)
    share = hits / max(1, words)
    if usual < STRAY or share >= dense:
        return "good" if n > long else "near"
    if block.main and hits >= words * usual - 3 * (words * usual * (1 - usual)) ** 0.5:
        return "near"
    return "near" if share >= sparse else "bad"


def usual_density(found: list[Block], stop_words: frozenset[str]) -> float:
    """The share of stop words on a page, in blocks that nothing else speaks against."""
    counts = [density(b, stop_words) for b in found if not b.aside and b.linked <= MOST_LINKED]
    return sum(h for h, _ in counts) / max(1, sum(n for _, n in counts))


def inherit(labels: list[str]) -> list[str]:
    """Pass 2: undecided blocks follow the nearest decided ones; where both are as near, near blocks are good and short ones bad."""
    n = len(labels)
    before: list[tuple[int, str]] = []
    last = (n + 1, "bad")
    for x in labels:
        last = (1, x) if x in ("good", "bad") else (last[0] + 1, last[1])
        before.append(last)
    out, last = [""] * n, (n + 1, "bad")
    for i in range(n - 1, -1, -1):
        x = labels[i]
        last = (1, x) if x in ("good", "bad") else (last[0] + 1, last[1])
        if x in ("good", "bad"):
            out[i] = x
        elif before[i][1] == last[1]:
            out[i] = last[1]
        elif before[i][0] != last[0]:
            out[i] = before[i][1] if before[i][0] < last[0] else last[1]
        else:
            out[i] = "good" if x == "near" else "bad"
    return out


def extract(page: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    found = blocks(page)
    if not found:
        return ""
    usual = usual_density(found, stop_words)
    labels = [decide(b, stop_words, usual) for b in found]
    inner = [i for i, b in enumerate(found) if b.main and not b.aside]  # what stands around a container says nothing of its blocks
    of_inner = [labels[i] for i in inner]
    if "good" not in of_inner:
        of_inner = ["good" if x == "near" else x for x in of_inner]
    for i, x in zip(inner, inherit(of_inner), strict=True):
        labels[i] = x
    if "good" not in labels:  # a page of short texts only: what nothing speaks against
        labels = ["good" if x == "near" else x for x in labels]
        if "good" not in labels:
            labels = ["good" if x == "short" else x for x in labels]
    return "\n".join(b.text for b, x in zip(found, inherit(labels), strict=True) if x == "good")


def _run(keep: list[str], column: str, stop_words: frozenset[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, stop_words) if h else "" for h in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return run


def main_text(pages: DataFrame, keep: list[str], column: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """The kept columns, text and n_chars of every page."""
    kept = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return shared.in_arrow(pages.select(*keep, column), _run(keep, column, stop_words), f"{kept}, text string, n_chars long")
