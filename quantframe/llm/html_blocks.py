"""HTML pages as sequences of leaf blocks: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed sets from the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is code, form input or no part of the page. Text in others, such as ``noscript`` or ``object``, is for the field to judge.
SKIPPED_TAGS = frozenset("script style textarea svg iframe title".split())
#: An open element of the value ends where the key starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
IN_PARAGRAPH = BLOCK_TAGS - {"body", "html", "head", "button", "label", "legend", "option", "select", "caption", "tr",
                             "td", "th", "tbody", "thead", "tfoot"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-z][-a-z:]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAMED = ("class", "id", "role", "itemprop", "aria-label", "data-label")
#: Marks main text in training pages; never a feature.
LABEL = "data-label"
PART = re.compile(r"[a-z]+|\d+")


@dataclass
class Block:
    path: tuple[tuple[str, str], ...]
    text: str
    link_chars: int


def parse(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. White space is single and trimmed, references are decoded.

    Unclosed and stray tags are read as browsers do in the cases above; a ``<`` that starts no tag is text.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = in_link = 0
    where: tuple[tuple[str, str], ...] = ()

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(where, text, linked))
        parts, linked = [], 0

    def close(tags) -> None:
        """Close the innermost open element of ``tags`` and what it holds."""
        nonlocal in_link
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                in_link -= sum(1 for t, _ in stack[i:] if t == "a")
                del stack[i:]
                return

    def has(tag: str) -> bool:
        return any(t == tag for t, _ in stack)

    def add(text: str) -> None:
        nonlocal linked, where
        if not parts:
            if not text.strip():
                return
            where = tuple(stack)
        parts.append(text)
        if in_link:
            linked += len(text)

    at, lowered = 0, None
    search = TOKEN.search
    while (m := search(page, at)) is not None:
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCK_TAGS:
                flush()
            elif tag == "br":
                add(" ")
            if has(tag):
                close((tag,))
            continue
        if tag in SKIPPED_TAGS:
            if not m.group(3).endswith("/"):
                lowered = page.lower() if lowered is None else lowered
                if len(lowered) != len(page):  # a letter changed its length; offsets would be off
                    lowered = page.translate(LOWER)
                end = lowered.find(f"</{tag}", at)
                if end < 0:
                    at = len(page)
                else:
                    close_at = page.find(">", end)
                    at = len(page) if close_at < 0 else close_at + 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in IN_PARAGRAPH and has("p"):
                close(("p",))
            if tag in ENDS:
                _close_sibling(stack, tag, close)
        if tag not in VOID_TAGS and not m.group(3).endswith("/"):
            names = "\n".join(f"{k.lower()}={a or b or c}" for k, a, b, c in ATTRIBUTE.findall(m.group(3))
                              if k.lower() in NAMED) if m.group(3) else ""
            stack.append((tag, names))
            in_link += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return blocks


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LISTS = frozenset(("ul", "ol", "dl", "menu", "table", "select"))


def _close_sibling(stack: list[tuple[str, str]], tag: str, close) -> None:
    """End an open element of the same list or table."""
    for t, _ in reversed(stack):
        if t in LISTS:
            return
        if t in ENDS[tag]:
            close(ENDS[tag])
            return


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    """Features of the ancestors: tags, and the parts of their class, id and role names."""
    found = {f"t:{t}" for t, _ in path}
    found.add(f"p:{path[-1][0]}" if path else "p:")
    for _, names in path:
        for item in names.split("\n"):
            key, _, value = item.partition("=")
            if key != LABEL:
                for part in PART.findall(value.lower()):
                    found.add(f"c:{part}")
                    if len(part) > 5:
                        found.add(f"c:{part[:5]}*")
    return sorted(found)


def text_features(block: Block, i: int, n: int) -> list[str]:
    """Features of the text and its place among n blocks."""
    text = block.text
    words = text.count(" ") + 1
    share = block.link_chars / max(len(text), 1)
    return [
        "bias", f"n:{min(words.bit_length(), 8)}", f"l:{min(int(share * 4), 4)}", f"e:{text[-1] in '.!?:;…'}",
        f"s:{text.count('. ') > 0}", f"k:{'©' in text}", f"at:{min(i, 3)}",
        f"left:{min(n - 1 - i, 3)}"]
