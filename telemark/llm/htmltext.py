"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks
on their own: those inside a menu, header, footer, sidebar, form, notice,
advert or comment section are out, and so are those that are mostly links; a
block with enough words and enough stop words among them is in.  A long block
with few links is also in without stop words, if it is written in sentences or
the page is in none of the listed languages; letters of scripts without spaces
count as words.  Short or undecided blocks are decided in the second pass, by
the nearest decided block on either side (the following one, if both are as
near: a heading goes with its paragraph).  The
borders of an article count as decided neighbours: inside one they are in,
outside they are out, so that a short paragraph is not lost to the footer next
to it.  The borders of the page decide nothing; on a page without an article
and without any block that is in, the undecided blocks are its main text, if
they have ``FEW_WORDS`` together.

White space inside a block becomes one space; blocks are joined by an empty
line.  Nothing else is dropped or capped.

Defined results: a null or empty page and one without main text give the empty
string; broken markup (open tags, cut pages, stray ``<``) is read as far as it
goes: only a script, style, title, textarea or iframe without its end tag takes
the rest of the page, while an open button, object and the like ends at the next
block-level tag or with its parent; formulas are text, and so is ``noscript``
in an article; repeated rows stay; extra columns stay, and an input column named
``text`` gives way.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemark.llm import common as C

MAX_LINK_DENSITY = 0.35
LONG_WORDS = 25
FEW_WORDS = 8
STOP_LOW, STOP_HIGH = 0.08, 0.20
FEW_LINKS = 0.10

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in is it that was for on are as with be at by this from or an have not but his they which one you were all her she there would their we him been has when who will no if out so what up about into them can only other time some could these two may then do first any my now such like our over me even most made after also did many off before must well back through years much where your way down should because each just those how too little good very make still see own work long here get both between being under never day same another know while last might great since against right come used take three",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir ihr wenn kann was",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas il plus ne se ce avec ou sont son ont aux sa cette mais été nous vous je elle lui leur comme si tout bien être fait ces entre sans peut même",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos",
    "it": "di e il la che in un è per non una sono con del si da come le dei al nel più alla gli ha lo i della delle anche ma se questo",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar door over",
}
_STOP = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}

#: Tags by what they do to the text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "head")
HELD = ("noscript", "template", "object", "svg", "select", "button", "canvas", "audio", "video")
OUT_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
IN_TAGS = frozenset(("article", "main"))
#: Words of a class, id or role that mark a part as out.
OUT_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion
 nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot colophon sidebar sidebars aside widget widgets related recommended
 cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social
 comment comments commentlist disqus respond reply replies discussion pagination pager copyright search searchbox complementary contentinfo skip""".split())
#: Words that name a part of a page whatever stands in it.
PART_WORDS = frozenset("""site page main top bottom left right inner outer upper lower primary secondary global local mobile desktop box bar block area wrap wrapper
 container content contents section panel list item items entry link links button buttons btn icon icons slot unit form field input body text title heading label
 thread region zone row col column group post posts article articles story stories news feed user author count google js the this a and of for by to""".split())
#: Ends of sentences, and letters of scripts that are written without spaces.
_SENTENCE = re.compile(r"[.!?…։؟۔।॥።](?:[\s\"'»”’)]|\Z)|[。！？｡]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|[^<]+|<", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_INNER = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)", re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_HELD_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in HELD}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _marks_out(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is out by its tag or its attributes."""
    if tag in IN_TAGS or tag in ("html", "body"):
        return False
    # an article's own head or foot (title, byline) is part of it
    if tag in OUT_TAGS and not (inside and tag in ("header", "fieldset")):
        return True
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role", "aria-label"):
            for token in [value] if name == "aria-label" else value.split():
                words = {w.lower() for w in _PART.findall(token)}
                marks = words & OUT_WORDS
                # each part of the name must speak of the page's frame: share-buttons does, share-price does not
                framed = all(w in OUT_WORDS or w in PART_WORDS or w.isdigit() for w in words)
                if marks and framed and not (inside and marks == {"header"}):
                    return True
    return False


class _Block:
    __slots__ = ("text", "links", "out", "inside", "item")

    def __init__(self, out: bool, inside: int, item: bool):
        self.text, self.links, self.out, self.inside, self.item = [], 0, out, inside, item


def _held_end(page: str, at: int, tag: str, closable: bool) -> int:
    """Where an element that is out ends whose start tag ends at ``at``: behind
    its own end tag.  If it is left open (its parent ends, an article or for a
    button or list of options the next one starts, or the page ends before),
    it ends at the first block-level tag or at the end of its parent."""
    opened, first = [], None
    for m in _INNER.finditer(page, at):
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name in opened:
                while opened.pop() != name:
                    pass
            elif name == tag:
                return m.end()
            else:
                return m.start() if first is None else first
            continue
        if name in IN_TAGS or name == tag and tag in ("button", "select"):
            return m.start() if first is None else first
        if first is None and name in BLOCK and name not in ("option", "optgroup", "legend"):
            first = m.start()
        if first is not None and not closable:
            return first
        if name not in VOID and not m[4].endswith("/"):
            opened.append(name)
    return len(page) if first is None else first


def blocks(page: str) -> list[_Block]:
    """The page's blocks in order, with the text, the characters in links,
    whether they lie in a part that is out, and the number of their article."""
    found: list[_Block] = []
    stack: list[tuple[str, bool, int, bool]] = []       # tag, out, article, list item
    state, link, article = ("", False, 0, False), 0, 0
    now = _Block(False, 0, False)
    last_end: dict[str, int] = {}       # of held elements

    def close():
        nonlocal now
        if now.text:
            found.append(now)
        now = _Block(state[1], state[2], state[3])

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m[2] is not None and "<" in m[3] and m.end() == end and page[-1] != ">":
            m = _LOOSE.match(page, at)      # an unbalanced quote: the tag ends at the next >
        at, tag = m.end(), m[2] if m.re is _LOOSE or m.lastindex else None
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                now.text.append(s)
                if link:
                    now.links += len(s.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCK:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        state = stack[-1] if stack else ("", False, 0, False)
                        break
                link = 0
                close()
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        state = stack[-1] if stack else ("", False, 0, False)
                        close()
                        break
            continue
        if tag in _RAW_END and not m[3].endswith("/"):
            stop = _RAW_END[tag].search(page, at)
            if tag == "head" and not stop:
                continue
            at = stop.end() if stop else end
            now.text.append(" ")
            continue
        if tag in _HELD_END and not m[3].endswith("/") and not (tag == "noscript" and state[2]):
            if tag not in last_end:
                last_end[tag] = max((e.start() for e in _HELD_END[tag].finditer(page)), default=-1)
            at = _held_end(page, at, tag, last_end[tag] >= at)
            now.text.append(" ")
            continue
        if tag == "br":
            now.text.append(" ")
        elif tag == "a":
            link += 1
        elif tag in VOID:
            if tag == "hr":
                close()
        elif tag in BLOCK:
            link = 0
            for k in range(len(stack) - 1, -1, -1):     # what this start tag closes
                if stack[k][0] == "p" or stack[k][0] in _CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE.get(tag, ()) or stack[k][0] in ("div", "section", "article", "main", "aside", "td", "th", "li"):
                    break
            state = stack[-1] if stack else ("", False, 0, False)
            inside = state[2]
            if tag in IN_TAGS and not inside:
                article += 1
                inside = article
            state = (tag, state[1] or _marks_out(tag, m[3], bool(inside)), inside, state[3] or tag == "li")
            stack.append(state)
            close()
        elif m[3] and _marks_out(tag, m[3], bool(state[2])):
            # an inline element that is out: a block of its own
            state = (tag, True, state[2], state[3])
            stack.append(state)
            close()
    close()
    return found


def _stop_density(words: list[str], stop: frozenset) -> float:
    return sum(w in stop for w in words) / len(words)


def _size(text: str, words: list[str]) -> int:
    """Words; a letter of a script without spaces counts as one."""
    return max(len(words), len(_UNSPACED.findall(text)))


def _nearest(kept: list, marks: list[bool | None], order: range) -> dict[int, tuple[bool | None, int]]:
    """For each block in this order, the label of the last decided block or
    article border before it, and how many blocks it is away."""
    found, sec, label, at = {}, 0, None, order.start
    for i in order:
        b = kept[i][0]
        if b.inside != sec:
            sec, label, at = b.inside, bool(b.inside), i - order.step
        found[i] = label, abs(i - at)
        if marks[i] is not None and not b.out:
            label, at = marks[i], i
    return found


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    kept = []
    for b in blocks(page):
        text = " ".join(entities.unescape("".join(b.text)).split())
        if text:
            kept.append((b, text, [w.strip(".,;:!?()\"'").lower() for w in text.split(" ")]))
    if not kept:
        return ""
    every = [w for _, _, words in kept for w in words]
    stop = max(_STOP.values(), key=lambda s: sum(w in s for w in every))
    listed = _stop_density(every, stop) >= STOP_LOW
    # first pass: True, False, or None for undecided
    marks: list[bool | None] = []
    for b, text, words in kept:
        density = min(1.0, b.links / len(text))
        stops = _stop_density(words, stop)
        if b.out:
            marks.append(False)
        elif density > MAX_LINK_DENSITY and (b.item or not b.inside):
            marks.append(False)
        elif len(words) >= LONG_WORDS and stops >= STOP_LOW or len(words) >= FEW_WORDS and stops >= STOP_HIGH:
            marks.append(True)
        elif density <= FEW_LINKS and _size(text, words) >= LONG_WORDS and (not listed or _SENTENCE.search(text)):
            marks.append(True)
        else:
            marks.append(None)
    # second pass: the nearest decided blocks within the same article, its borders included
    n = len(marks)
    before = _nearest(kept, marks, range(n))
    after = _nearest(kept, marks, range(n - 1, -1, -1))
    bare = (not any(b.inside for b, _, _ in kept) and True not in marks
            and sum(_size(text, words) for (_, text, words), m in zip(kept, marks) if m is None) >= FEW_WORDS)
    final = list(marks)
    for i in range(n):
        if marks[i] is None:
            (left, x), (right, y) = before[i], after[i]
            if kept[i][0].inside:
                final[i] = left or right
            elif left is None or right is None:
                final[i] = left or right or bare
            else:
                final[i] = (left if x < y else right) or bare
    return "\n\n".join(text for (_, text, _), keep in zip(kept, final) if keep)


def extract(pages: DataFrame, html_col="html") -> DataFrame:
    """``pages`` with ``text``, the main text of ``html_col``."""
    pages = C.add(pages, text=F.lit(""))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in pages.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            text = [main_text(h) for h in b.column(html_col).to_pylist()]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(text, pa.string()))

    return pages.mapInArrow(run, schema)
