"""HTML split into tags and text, in one pass that takes linear time.

Tags, attributes and their quotes are read as the standard library's reader does (Python 3.13),
odd ones too. A well-formed construct is one match, without backtracking. After the first odd
one a page is read attribute by attribute, and places from which a tag was found not to end are
never tried again; so no markup, however odd, is scanned more than a few times.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import repeat

_NAME = r"[a-zA-Z][^\t\n\r\f />\x00]*+"
_GAP = r"(?:\s|/(?!>))*+"
# a value in quotes or bare; else an empty one before a quote that is never closed; else one that begins at the last of several "="
_VALUE = r"\s*+(?:=++\s*+(?:'[^']*+'|\"[^\"]*+\"|(?!['\"])[^>\s]*+)|=++\s++(?=['\"])|==++[^>\s]*+)\s*+"
_ATTR = rf"(?<=['\"\s/])[^\s/>][^\s/=>]*+(?:{_VALUE})?+{_GAP}"
_TAG = re.compile(rf"<(?P<tag>{_NAME}){_GAP}(?:{_ATTR})*+(?P<alone>/?)>|</(?:\s*+(?P<end>[a-zA-Z][-.a-zA-Z0-9:_]*+)\s*+>|(?P<odd>{_NAME})[^>]*+>|[^>]*+>)")
_ONE_ATTR = re.compile(_ATTR)
_GAP_AT = re.compile(_GAP)
_NAME_ENDS = re.compile(r"[\t\n\r\f />\x00]|\Z")
_RUN = re.compile("<++")
_COMMENT = re.compile(r"<!--.*?--\s*+>", re.S)
_SECTION = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata)(?![-_.a-zA-Z0-9])", re.I)
_CONDITION = re.compile(r"<!\[(?:if|else|endif)(?![-_.a-zA-Z0-9])", re.I)
_SECTION_END, _CONDITION_END = re.compile(r"\]\s*+\]\s*+>"), re.compile(r"\]\s*+>")
_UNREAD_END = {tag: re.compile(rf"</\s*+{tag}\s*+>", re.I) for tag in ("script", "style")}
_LONG_REFERENCE = re.compile(r"&#(?:0*+[0-9]{8,}|[xX]0*+[0-9a-fA-F]{8,});?|&#([xX]?)0+(?=[0-9a-fA-F])")

#: Kinds of parts.
TEXT, OPEN, CLOSE, ALONE = "text", "open", "close", "alone"
Part = tuple[str, str, str]


#: References that most texts have alone; "&" comes last, as it may begin another.
_COMMON = (("&nbsp;", "\u00a0"), ("&#160;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8217;", "\u2019"), ("&amp;", "&"))


def unescape(text: str) -> str:
    """Character references decoded; numbers of any length, those beyond Unicode as U+FFFD."""
    left = text.count("&")
    if not left:
        return text
    if left == sum(text.count(name) for name, _ in _COMMON):
        for name, char in _COMMON:
            text = text.replace(name, char)
        return text
    try:
        return html.unescape(text)
    except ValueError:  # more digits than int() reads
        return html.unescape(_LONG_REFERENCE.sub(lambda m: "�" if m[1] is None else f"&#{m[1]}", text))


class _Page:
    """A page and what is known of it once an odd construct was met."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.odd = False
        self.dead: set[int] = set()  # places within tags from which no tag ends
        self.name_end = -1
        self.never: set[str] = set()  # kinds of sections that were found not to end

    def tag(self, at: int) -> tuple[str | None, bool, int]:
        """(name, whether alone, end) of the tag that begins at ``at``; end -1 if it never does; no name if it is text."""
        page = self.page
        if self.name_end <= at:
            self.name_end = _NAME_ENDS.search(page, at + 1).start()
        if page[self.name_end : self.name_end + 1] == "\0":
            return None, False, self.name_end
        if at > self.last:
            return None, False, -1
        place = _GAP_AT.match(page, self.name_end).end()
        while place not in self.dead:
            if page.startswith(("/>", ">"), place):
                alone = page[place] == "/"
                return page[at + 1 : self.name_end], alone, place + 1 + alone
            self.dead.add(place)
            m = _ONE_ATTR.match(page, place)
            if m is None:
                break
            place = m.end()
        return None, False, -1

    def declared(self, at: int) -> int:
        """The end of a comment, declaration, section or instruction; -1 if it has none."""
        page = self.page
        if page.startswith("<!--", at):
            return self._ends("--", at, _COMMENT.match)
        if page.startswith("<![", at):
            for kind, begins, ends in (("]]", _SECTION, _SECTION_END), ("]", _CONDITION, _CONDITION_END)):
                if begins.match(page, at):
                    return self._ends(kind, at + 3, ends.search)
        return page.find(">", at + 2) + 1 if at + 2 <= self.last else -1

    def _ends(self, kind: str, at: int, find) -> int:
        m = None if kind in self.never else find(self.page, at)
        if m is None:
            self.never.add(kind)
        return m.end() if m else -1


def parts(page: str, whole: bool = True) -> Iterator[Part]:
    """(kind, tag, text) of a page in order: open, close or alone with a tag in lower case, or text.

    Scripts and styles are passed over with their text; one that never ends is the page's end. In a
    ``whole`` page a construct that never ends is text up to the next ">", or else the next "<".
    Otherwise the page may go on, and reading stops at such a construct, or before a last text that
    may end in a part of a character reference. A section of unknown name is passed over to its ">".
    """
    known = _Page(page)
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            cut = page.rfind("&", max(at, size - 34))
            if whole or cut < 0 or re.search(r"[\s;]", page[cut:]):
                yield TEXT, "", unescape(page[at:])
            return
        if begin > at:
            yield TEXT, "", unescape(page[at:begin])
        m = None if known.odd or begin > known.last else _TAG.match(page, begin)
        kind, end = "", -1
        if m:
            end = m.end()
            if tag := m["tag"]:
                kind = ALONE if m["alone"] else OPEN
            elif tag := m["end"] or m["odd"]:
                kind = CLOSE
        elif (first := page[begin + 1 : begin + 2]) == "/":
            m = _TAG.match(page, begin) if begin < known.last else None
            if m:
                tag, end = m["end"] or m["odd"], m.end()
                kind = CLOSE if tag else ""
        elif first.isascii() and first.isalpha():
            known.odd = True
            tag, alone, end = known.tag(begin)
            if tag:
                kind = ALONE if alone else OPEN
            elif end > 0:
                yield TEXT, "", page[begin:end]
        elif first in ("!", "?"):
            end = known.declared(begin)
        elif first:
            end = max(begin + 1, _RUN.match(page, begin).end() - 1)
            yield from repeat((TEXT, "", "<"), end - begin)
        if kind:
            yield kind, tag.lower(), ""
            if kind == OPEN and (ends := _UNREAD_END.get(tag.lower())):
                m = ends.search(page, end)
                if m is None:
                    return
                yield CLOSE, tag.lower(), ""
                end = m.end()
        elif end < 0:
            if not whole:
                return
            end = page.find(">", begin + 1) + 1 if begin < known.last else 0
            end = end or page.find("<", begin + 1)
            end = end if end > 0 else size if not first else begin + 1
            yield TEXT, "", unescape(page[begin:end])
        at = end
