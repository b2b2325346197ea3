"""Operator 10: main text of web pages by two passes of block rules.

The first pass cuts a page at block-level tags and classifies each block by stop-word density, length and link density as good, bad, near
good or short. The second resolves the ambiguous ones: a short or near-good block takes the label of the nearest decided neighbours.
"""

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters below which a block is short, and above which stop words make it good; densities of stop words; most of a block in links.
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINK_MAX = 70, 200, 0.12, 0.18, 0.2

STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our me even most made after also",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais ou avec son cette aux ces elle été ont sa on ses leur être fait comme lui nous tout je même où si deux peut très sans était entre",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede",
}
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks inside these are bad whatever their text.
FURNITURE = frozenset("nav footer aside form select menu".split())

#: Elements of which nothing is shown, and what may stand in a head besides them and its title.
HIDDEN = frozenset("script style noscript template svg".split())
HEAD_TAGS = frozenset("meta link base basefont bgsound".split())

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9]*))")
#: The rest of a tag: up to its >, or to the next < where it has none. Possessive, and an unclosed quote is a sign like others: no step back.
_REST = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+""")
_LANG = re.compile(r"""(?<![\w-])lang\s*=\s*["']?([a-zA-Z]{2})""", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in (*HIDDEN, "title")}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")

SETS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
ALL_STOP_WORDS = frozenset().union(*SETS.values())

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("blocks", T.IntegerType()), T.StructField("good", T.IntegerType())])


def tokens_of(html):
    """(text before, tag name or None, whether an end tag, attributes) along a page, without comments, hidden elements and the head.

    A head without end tag ends at the first text or tag that can't stand in one. Every step goes on from where the last one ended, so the
    time is in proportion to the page, whatever is left open in it.
    """
    at, n, head, untitled = 0, len(html), False, False
    while m := _OPEN.search(html, at):
        before, at, name = html[at : m.start()], m.end(), m[2]
        head = head and not before.strip()
        if name is None:
            end = html.find("-->" if m[0] == "<!--" else ">", at)
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            yield before, None, False, ""
            continue
        name, closing = name.lower(), bool(m[1])
        end = _REST.match(html, at).end()
        rest, at = html[at:end], end + html.startswith(">", end)
        if not closing and name in HIDDEN:
            m = _CLOSE[name].search(html, at)
            end = html.find(">", m.end()) if m else -1
            at = n if end < 0 else end + 1
            yield before, None, False, ""
        elif head and name == "title" and not closing:
            m = None if untitled else _CLOSE[name].search(html, at)
            untitled = m is None  # then there is none further on either
            at = html.find("<" if untitled else ">", m.end() if m else at)
            at = n if at < 0 else at + (not untitled)
            yield before, None, False, ""
        elif head and name in HEAD_TAGS:
            yield before, None, False, ""
        elif name == "head":
            head = not closing
            yield before, None, False, ""
        else:
            head = False
            yield before, name, closing, rest
    yield html[at:], None, False, ""


def blocks_of(html):
    """((text, characters in links, heading, furniture) of each block that has text, the page's language or None)."""
    out, text, linked, link, heading, furniture, language = [], [], 0, 0, False, 0, None

    def close():
        nonlocal text, linked
        whole = _SPACE.sub(" ", "".join(text)).strip()
        if whole:
            out.append((whole, min(linked, len(whole)), heading, furniture > 0))
        text, linked = [], 0

    for piece, name, closing, rest in tokens_of(html):
        if piece:
            piece = entities.unescape(piece)
            text.append(piece)
            if link:
                linked += len(_SPACE.sub(" ", piece).strip())
        if name is None:
            text.append(" ")
        elif name == "a":
            link = max(0, link - 1) if closing else 1
        elif name in BLOCK_TAGS:
            close()
            if name in HEADINGS:
                heading = not closing
            elif name in FURNITURE:
                furniture = max(0, furniture + (-1 if closing else 1))
            elif name == "html" and language is None and (m := _LANG.search(rest)):
                language = m[1].lower()
    close()
    return out, language


def first_pass(block, stop):
    text, linked, _, furniture = block
    if furniture or linked > LINK_MAX * len(text) or "©" in text:
        return "bad"
    if len(text) < LENGTH_LOW:
        return "bad" if linked else "short"
    tokens = _WORD.findall(text.lower())
    density = sum(w in stop for w in tokens) / len(tokens) if tokens else 0.0
    if density >= STOP_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(labels):
    """Near-good blocks take the better of their nearest decided neighbours, short ones the common label of both sides.

    Where a short block's sides differ, it is good only if a near-good block stands between it and the bad side. A missing side is bad.
    """
    n = len(labels)
    before, after, last = ["bad"] * n, ["bad"] * n, "bad"
    for i in range(n):
        before[i] = last
        last = labels[i] if labels[i] in ("good", "bad") else last
    last = "bad"
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = labels[i] if labels[i] in ("good", "bad") else last
    out = []
    for i, x in enumerate(labels):
        if x == "near":
            x = "good" if "good" in (before[i], after[i]) else "bad"
        elif x == "short":
            if before[i] == after[i]:
                x = before[i]
            else:
                step, k = (1, i + 1) if after[i] == "bad" else (-1, i - 1)
                while 0 <= k < n and labels[k] == "short":
                    k += step
                x = "good" if 0 <= k < n and labels[k] == "near" else "bad"
        out.append(x)
    return out


def extract_page(html):
    """(main text with a line for each block, number of blocks, number of good blocks) of a page."""
    blocks, language = blocks_of(html)
    stop = SETS.get(language, ALL_STOP_WORDS)
    labels = second_pass([first_pass(b, stop) for b in blocks])
    # a heading goes with the block that follows it
    for i in range(len(blocks) - 2, -1, -1):
        if blocks[i][2] and labels[i] == "bad" and not blocks[i][3] and not blocks[i][1] and labels[i + 1] == "good":
            labels[i] = "good"
    good = [b[0] for b, x in zip(blocks, labels, strict=True) if x == "good"]
    return "\n".join(good), len(blocks), len(good)


@F.arrow_udf(RESULT)
def extractor(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        got = [(None, 0, 0) if (h := x.as_py()) is None else extract_page(h) for x in pages]
        yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), *(pa.array([g[k] for g in got], pa.int32()) for k in (1, 2))], names=["text", "blocks", "good"])


def extract(df, id_col="page_id", html_col="html"):
    """Rows (page_id, text, blocks, good), one for each input row, repeated rows included.

    A null page has a null text; an empty page, or one without a good block, the empty text. An unclosed tag ends at the next "<", unclosed
    comments and scripts at the end of the page. Whole pages are read, however long, in time in proportion to their length. A null id is
    kept, an empty table gives an empty result. Other columns are neither read nor returned.
    """
    return df.select(F.col(id_col).alias("page_id"), extractor(F.col(html_col)).alias("r")).select("page_id", "r.text", "r.blocks", "r.good")
