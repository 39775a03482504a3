"""The chunking rule of one document's normalized text, as generators over its lines: what narrow jobs call row by row. Offsets count
code points. White space and digits are ASCII, as in the SQL the results are compared with."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from permlens.functions import text as T

WHITE = " \t\n\x0b\f\r"
# Headings, sentence ends, list items; `.` and the end of a line as the SQL's engines take them.
HEADING = re.compile(r"(#{1,6})[ \t\n\x0b\f\r]+([^\n\r\x85\u2028\u2029]+?)[ \t\n\x0b\f\r]*#*[ \t\n\x0b\f\r]*(?=[\n\r\x85\u2028\u2029]?\Z)")
SENTENCE_END = re.compile(r"""[.!?]["')\]]{0,2}[ \t\n\x0b\f\r]+""")
ENDED = re.compile(r"""[.!?]["')\]]{0,2}\Z""")
LIST_LINE = re.compile(r"\n[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]")
LIST_ITEM = re.compile(r"[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]")
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


@dataclass
class Line:
    number: int
    start: int
    text: str
    is_fence: bool
    in_fence: bool
    level: int | None = None
    section_no: int = 0
    section_path: str = ""


@dataclass
class Piece:
    section_no: int
    section_path: str
    start: int
    end: int
    text: str
    cut: bool = False


@dataclass
class Measured:
    piece: Piece
    before: int
    after: int
    repeat: tuple[int, int] | None
    sentences: list = field(default_factory=list)


def count_words(text: str) -> int:
    return len(WORD.findall(text))


def lines(text: str, markdown: bool) -> Iterator[Line]:
    start, fences, section, path = 0, 0, 0, {}
    for number, line in enumerate(text.split("\n")):
        fence = markdown and line.strip(WHITE).startswith("```")
        fences += fence
        found = HEADING.match(line) if markdown and not fence and fences % 2 == 0 and line.startswith("#") else None
        if found:
            section += 1
            level = len(found[1])
            path = {n: h for n, h in path.items() if n < level} | {level: found[2]}
        yield Line(number, start, line, fence, fences % 2 == 1, level if found else None, section, T.PATH_SEPARATOR.join(path.values()))
        start += len(line) + 1


def paragraphs(text: str, markdown: bool) -> Iterator[tuple[Piece, bool]]:
    """Runs of lines between headings and blank lines; a blank line inside a fence does not end one. With whether it holds a fence."""
    held: list[Line] = []
    end = Line(-1, -1, "", False, False)
    for line in (*lines(text, markdown), end):
        if line.level is None and (line.in_fence or line.text.strip(WHITE)):
            held.append(line)
        elif held:
            body = "\n".join(x.text for x in held).rstrip(WHITE)
            if body:
                yield Piece(held[0].section_no, held[0].section_path, held[0].start, held[0].start + len(body), body), any(x.is_fence for x in held)
            held = []


def sentence_parts(text: str) -> list[str]:
    """The sentences with the white space that follows each. A list item on a new line begins one, unless the sentence before it has just
    ended there."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    items = []
    for m in LIST_LINE.finditer(text):
        at = bisect_left(ends, m.start() + 1)
        if at == len(ends) or ends[at] >= m.end():
            items.append(m.start() + 1)
    cuts = sorted({0, len(text), *ends, *items})
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def cut(text: str, reach: Callable[[int], int | None], most: int) -> list[tuple[int, int]]:
    """(offset, length) of pieces, each up to where reach lets one that begins at an offset end at most (None: the rest fits): up to the last
    line break before that, else the last white space, else all of it. White space between pieces belongs to neither. Only offsets move,
    so a text without any break costs no more than its length."""
    at, out, n = 0, [], len(text)
    for _ in range(most):
        stop = reach(at)
        if stop is None:
            break
        line = text.rfind("\n", at + 1, stop)
        space = max(text.rfind(c, at + 1, stop) for c in WHITE)
        until = line + 1 if line >= 0 else space if space >= 0 else stop
        end = until
        while end > at and text[end - 1] in WHITE:
            end -= 1
        out.append((at, end - at))
        at = until
        while at < n and text[at] in WHITE:
            at += 1
    return out + ([(at, n - at)] if at < n else [])


def pieces(text: str, markdown: bool, max_words: int) -> Iterator[Piece]:
    """What the packer may not split: paragraphs, sentences of long ones, and cut parts of what is over the character limit."""
    limit = T.MAX_CHUNK_CHARS
    for paragraph, atomic in paragraphs(text, markdown):
        parts = [paragraph.text] if atomic or count_words(paragraph.text) <= max_words else sentence_parts(paragraph.text)
        start = paragraph.start
        for part in parts:
            body = part.rstrip(WHITE)
            long = len(body) > limit
            spans = cut(body, lambda at, n=len(body): at + limit if n - at > limit else None, -(-len(body) // limit) * 3 + 3) if long else [(0, len(body))]
            for off, size in spans:
                yield Piece(paragraph.section_no, paragraph.section_path, start + off, start + off + size, body[off : off + size], long)
            start += len(part)


def measured(text: str, markdown: bool, max_words: int, overlap: int) -> Iterator[list[Measured]]:
    """Each section's pieces with the words before and after them and the earliest sentence, at most `overlap` words back, that a chunk
    which follows may repeat: (place, words before it)."""
    words, section, held, seen, previous = 0, None, [], [], None
    for piece in pieces(text, markdown, max_words):
        if section != piece.section_no:
            if held:
                yield held
            section, held, seen, previous = piece.section_no, [], [], None
        at = piece.start
        m = Measured(piece, words, words, None)
        for number, part in enumerate(sentence_parts(piece.text)):
            sentence = part.rstrip(WHITE)
            if number == 0:
                back = [(p, w) for p, w in seen if words - overlap <= w <= words - 1]
                m.repeat = min(back, default=None)
            opens = at if number else None
            if number == 0 and previous and previous[1] < at:
                if ENDED.search(previous[0]):
                    opens = at + len(sentence) - len(sentence.lstrip(WHITE))
                elif LIST_ITEM.match(sentence):
                    opens = at
            if opens is not None:
                seen = [x for x in seen if x[1] >= words - overlap] + [(opens, words)]
            previous = sentence, at + len(sentence)
            words += count_words(sentence)
            at += len(part)
        m.after = words
        held.append(m)
    if held:
        yield held


def pack(section: list[Measured], max_words: int) -> Iterator[tuple[int, int]]:
    """Spans of chunks: pieces in order as long as they fit; the next chunk begins with the sentences it may repeat, if they fit."""
    start = words = end = -1
    cut_before = False
    for m in section:
        fits = lambda s, w, m=m: m.after - w <= max_words and m.piece.end - s <= T.MAX_CHUNK_CHARS
        if start < 0:
            start, words = m.piece.start, m.before
        elif not fits(start, words):
            yield start, end
            repeats = m.repeat is not None and not cut_before and not m.piece.cut and m.repeat[0] > start and fits(*m.repeat)
            start, words = m.repeat if repeats else (m.piece.start, m.before)
        end, cut_before = m.piece.end, m.piece.cut
    yield start, end


def embedded_path(path: str) -> str:
    """The innermost headings whose joined length fits the limit; a single longer one is cut."""
    kept, *rest = reversed(path.split(T.PATH_SEPARATOR))
    for part in rest:
        if len(kept) + len(part) + len(T.PATH_SEPARATOR) > T.PATH_MAX_CHARS:
            break
        kept = part + T.PATH_SEPARATOR + kept
    return kept[: T.PATH_MAX_CHARS]


def packed(text: str, markdown: bool, max_words: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, section path) of a document's chunks, in order."""
    return sorted((a, b, s[0].piece.section_path) for s in measured(text, markdown, max_words, overlap) for a, b in pack(s, max_words))


def fitted(text: str, spans: list[tuple[int, int, str]], max_tokens: int) -> Iterator[tuple[int, int, str]]:
    """The chunks, those over the model's limit cut. Tokens are words plus the special tokens."""
    for start, end, path in spans:
        room = max(1, max_tokens - T.SPECIAL_TOKENS - count_words(embedded_path(path)))
        content = text[start:end]
        n = count_words(content)
        if n <= room:
            yield start, end, path
            continue
        words = [m.span() for m in WORD.finditer(content)]
        starts = [w[0] for w in words]

        def reach(at: int, words=words, starts=starts, room=room) -> int | None:
            first = bisect_left(starts, at)
            return words[first + room - 1][1] if len(words) - first > room else None

        for off, size in cut(content, reach, -(-n // room) * 3 + 3):
            yield start + off, start + off + size, path
