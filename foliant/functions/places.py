"""Places of tags and of notable lines in long texts, found by substring search in one pass each."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from foliant.functions.text import HEADING

_ASCII = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"\S+")
#: How lines begin that may be notable; the patterns of ``functions.text`` decide.
BEGINNINGS = ("item", "part", "executive officers of", "signature", "pursuant to the requirements of section 13")
_BLANKS = " \t\u00a0"
#: Headings that may have no title beside them; the pattern of ``functions.text`` decides.
_BARE = re.compile(r"\W*(?:part\W+[ivx]+\W*)?item\W*\d{1,2}\W?[a-d]?\W*(?:[a-z]{1,2}\W*)?", re.I)
_HEADING = re.compile(HEADING.replace("(?id)", "(?ia)", 1))
_FIGURE = re.compile(r"[\d$%]")


def small_letters(text: str) -> str:
    """The text in small letters, of the same length (but for a few letters, then only A-Z is changed)."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII)


def _field(text: str, low: str, tag: str, begin: int, end: int) -> str:
    """The word behind the first tag at the start of a line of a block that has one."""
    at = low.find(tag, begin, end)
    while at >= 0:
        if at == begin or text[at - 1] == "\n":
            m = _WORD.match(text, at + len(tag), end)
            if m:
                return m[0]
        at = low.find(tag, at + 1, end)
    return ""


def blocks_in(text: str) -> Iterator[tuple[str, str, str, int, int, int]]:
    """(type, sequence, filename, start, where the body begins, where it ends) of each <DOCUMENT> block; one without an end goes to the text's."""
    low = small_letters(text)
    at = low.find("<document>")
    while at >= 0:
        begin = at + len("<document>")
        close = low.find("</document>", begin)
        end = close if close >= 0 else len(text)
        opens = low.find("<text>", begin, end)
        first = opens + len("<text>") if opens >= 0 else begin
        shut = low.find("</text>", first, end) if opens >= 0 else -1
        kind, sequence, filename = (_field(text, low, tag, begin, end) for tag in ("<type>", "<sequence>", "<filename>"))
        yield kind.upper(), sequence, filename, at, first, shut if shut >= 0 else end
        at = low.find("<document>", close + len("</document>")) if close >= 0 else -1


def notable_in(text: str, window: int, words: tuple[str, ...]) -> tuple[list[tuple[int, str, str]], bool, bool]:
    """(lines, again, said) of a text.

    lines: (start, line, what follows) of each line that begins like a notable one, in order. What follows is given,
    within the window, behind a heading that may have no title beside it; else it is empty. again: whether two headings
    are of one code. said: whether one of the words, in small letters, stands in the text.
    """
    low = small_letters(text)
    starts = set()
    for word in BEGINNINGS:
        at = low.find(word)
        while at >= 0:
            begin = at
            while begin and low[begin - 1] in _BLANKS:
                begin -= 1
            if not begin or low[begin - 1] == "\n":
                starts.add(begin)
            at = low.find(word, at + len(word))
    lines, codes, again = [], set(), False
    for begin in sorted(starts):
        end = text.find("\n", begin)
        end = end if end >= 0 else len(text)
        line = text[begin:end]
        lines.append((begin, line, text[end : end + window] if _BARE.fullmatch(line) else ""))
        if m := _HEADING.match(line):
            code = m[1] + (m[2] or "").upper()
            again = again or code in codes
            codes.add(code)
    return lines, again, any(w in low for w in words)


def _in_word(text: str, at: int) -> bool:
    """Whether the character belongs to a word, as the patterns take it: a letter, a digit, a mark on either, or an underscore."""
    if text[at] < "\x80":
        return text[at].isalnum() or text[at] == "_"
    while at >= 0 and unicodedata.category(text[at]) == "Mn":
        at -= 1
    return at >= 0 and (text[at].isalpha() or text[at].isdecimal())


def last_word(low: str, words: tuple[str, ...], begin: int, end: int) -> int | None:
    """Where the last of the words stands, as a word, in low[begin:end]; null if none does."""
    best = begin - 1
    for at, word in sorted(((low.rfind(word, begin, end), word) for word in words), reverse=True):
        while at > best and ((at and _in_word(low, at - 1)) or (at + len(word) < len(low) and _in_word(low, at + len(word)))):
            at = low.rfind(word, best + 1, at + len(word) - 1)
        best = max(best, at)
    return best if best >= begin else None


def figures_in(text: str, begin: int, end: int) -> int:
    """How many digits, and signs of dollars and percents, stand in text[begin:end]."""
    try:
        part = text[begin:end].encode("latin-1")  # has the ten digits alone
    except UnicodeEncodeError:
        return len(_FIGURE.findall(text, begin, end))
    return len(part) - len(part.translate(None, b"0123456789$%"))


def stretches_in(text: str, lines: list[tuple], words: dict[str, tuple[str, ...]], figured: tuple[str, ...], least: int) -> Iterator[tuple[int | None, list[int | None]]]:
    """(figures, the last place of each code's words) of the text from each line up to the next one, the last up to the end.

    lines: see ``notable_in``. Figures are counted behind a heading of a code in ``figured``, words looked for behind one of
    their code, both only in texts of ``least`` characters; else null.
    """
    low = small_letters(text) if len(text) >= least else ""
    counted, codes = False, dict.fromkeys(words, False)
    for (begin, line, _), end in zip(lines, [*(x[0] for x in lines[1:]), len(text)]):
        if low and (m := _HEADING.match(line)):
            code = m[1] + (m[2] or "").upper()
            counted = counted or code in figured
            if code in codes:
                codes[code] = True
        yield figures_in(text, begin, end) if counted else None, [last_word(low, words[c], begin, end) if there else None for c, there in codes.items()]


_STR, _INT = StringType(), IntegerType()
_HEAD = [("type", pa.string()), ("sequence", pa.string()), ("filename", pa.string()), ("start", pa.int32())]


def _spark(fields: list[tuple[str, pa.DataType]]) -> ArrayType:
    return ArrayType(StructType([StructField(name, _STR if kind == pa.string() else _INT) for name, kind in fields]))


_PLACED = [*_HEAD, ("first", pa.int32()), ("last", pa.int32())]
_LINE = [("start", pa.int32()), ("raw", pa.string()), ("after", pa.string())]


def _lists(found: Iterator[Iterable[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    names = [name for name, _ in fields]
    return pa.array([None if row is None else [dict(zip(names, x)) for x in row] for row in found], pa.list_(pa.struct(fields)))


def _each(texts: pa.Array) -> Iterator[str | None]:
    """The texts one by one: a batch's are never all there as Python strings."""
    return (t.as_py() for t in texts)


@F.arrow_udf(_spark(_PLACED))
def block_places(texts: pa.Array) -> pa.Array:
    """type, sequence, filename, start, first, last (of the body) of a submission's blocks."""
    return _lists((None if t is None else blocks_in(t) for t in _each(texts)), _PLACED)


def notable_lines(window: int, words: tuple[str, ...]):
    """UDF: lines (start, raw, after), again, said of a text (see ``notable_in``)."""

    @F.arrow_udf(StructType([StructField("lines", _spark(_LINE)), StructField("again", BooleanType()), StructField("said", BooleanType())]))
    def find(texts: pa.Array) -> pa.Array:
        found = [(None, None, None) if t is None else notable_in(t, window, words) for t in _each(texts)]
        flags = (pa.array((row[i] for row in found), pa.bool_()) for i in (1, 2))
        return pa.StructArray.from_arrays([_lists((row[0] for row in found), _LINE), *flags], ["lines", "again", "said"])

    return find


_STRETCH = [*_LINE, ("figures", pa.int32()), ("last", pa.list_(pa.int32()))]


def notable_stretches(window: int, words: tuple[str, ...], vocabulary: dict[str, tuple[str, ...]], figured: tuple[str, ...], least: int):
    """UDF: as ``notable_lines``, each line with figures and last of the text up to the next one (see ``stretches_in``)."""
    line = StructType([*_spark(_LINE).elementType.fields, StructField("figures", _INT), StructField("last", ArrayType(_INT))])

    @F.arrow_udf(StructType([StructField("lines", ArrayType(line)), StructField("again", BooleanType()), StructField("said", BooleanType())]))
    def find(texts: pa.Array) -> pa.Array:
        rows, ends, flags = [], [0], []
        for t in _each(texts):
            lines, *said = ([], None, None) if t is None else notable_in(t, window, words)
            rows += [(*x, *more) for x, more in zip(lines, stretches_in(t, lines, vocabulary, figured, least))] if lines else []
            ends.append(len(rows))
            flags.append(said)
        columns = [pa.array([row[i] for row in rows], kind) for i, (_, kind) in enumerate(_STRETCH)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [name for name, _ in _STRETCH]))
        return pa.StructArray.from_arrays([lists, *(pa.array([x[i] for x in flags], pa.bool_()) for i in (0, 1))], ["lines", "again", "said"])

    return find
