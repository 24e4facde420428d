"""Forms of a text in which spelling tricks make no difference."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

#: Tags within a line of text: they don't part words. Others do.
_INLINE = "a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_INLINE_TAG = regex.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", regex.I)
_TAG = regex.compile(r"<(?:/?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?|!--.*?--|![a-z][^<>]*)>", regex.I | regex.S)
_LINK = regex.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)")
#: Format characters, fillers and selectors that are not seen; control characters that are not white space.
_UNSEEN = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵ㅤﾠ︀-️\U000e0100-\U000e01ef\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: The same for text of ASCII in lower case, by the standard engine.
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def without_markup(text: str) -> str:
    """`text` without tags, with the characters that entities name, and with links as their captions."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    return text


def plain(text: str) -> str:
    """`text` without unseen characters, in compatibility form and without case."""
    if text.isascii():
        return text.lower() if text.isprintable() else _UNSEEN.sub("", text).lower()
    text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).casefold()
    return unicodedata.normalize("NFKC", text)


def words(text: str) -> list[str]:
    """Runs of letters and digits of the plain form without markup."""
    shown = plain(without_markup(text))
    return (_ASCII_WORD if shown.isascii() else _WORD).findall(shown)


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """`words` with the place of each in `text`; an empty list if a word can't be placed exactly."""
    pieces: list[tuple[str, int, int]] = []
    at = 0
    marks = [(m.start(), m.end(), "") for m in _INLINE_TAG.finditer(text)]
    taken = {s for s, _, _ in marks}
    marks += [(m.start(), m.end(), " ") for m in _TAG.finditer(text) if m.start() not in taken]
    marks += [(m.start(), m.end(), html.unescape(m[0])) for m in regex.finditer(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", text)]
    for start, end, shown in sorted(marks):
        if start < at:
            continue
        pieces += [(c, i, i + 1) for i, c in enumerate(text[at:start], at)]
        pieces += [(c, start, end) for c in shown]
        at = end
    pieces += [(c, i, i + 1) for i, c in enumerate(text[at:], at)]
    shown = "".join(c for c, _, _ in pieces)
    for m in reversed(list(_LINK.finditer(shown))):
        inner = m.span(1)
        pieces[m.start() : m.end()] = pieces[inner[0] : inner[1]]
    pieces = [p for p in pieces if not _UNSEEN.match(p[0])]
    out: list[tuple[str, int, int]] = []
    i = 0
    while i < len(pieces):
        j = i + 1
        while j < len(pieces) and unicodedata.combining(pieces[j][0]):
            j += 1
        out += [(c, pieces[i][1], pieces[j - 1][2]) for c in plain("".join(p[0] for p in pieces[i:j]))]
        i = j
    joined = "".join(c for c, _, _ in out)
    spans = [(m[0], out[m.start()][1], out[m.end() - 1][2]) for m in _WORD.finditer(joined)]
    return spans if [w for w, _, _ in spans] == words(text) else []
