"""One pass over the lines or pieces of a text, with a small state: time grows with the text, not with its square."""

from __future__ import annotations

import re
from collections.abc import Iterator

HEAD = re.compile(r"(#{1,6}) ")
MARKS = re.compile(r"#+ ")


def header_sections(text: str, strip_headers: bool) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(content, active titles) of the parts between header lines; parts of blanks only are left out."""
    active: list[tuple[int, str]] = []  # levels rise
    lines: list[str] = []

    def section() -> Iterator[tuple[str, list[tuple[str, str]]]]:
        content = "\n".join(lines)
        if content.strip(" "):
            yield content, [(f"Header {level}", title) for level, title in active]

    for line in text.split("\n"):
        head = HEAD.match(line)
        if head:
            yield from section()
            level = len(head[1])
            while active and active[-1][0] >= level:
                active.pop()
            active.append((level, MARKS.sub("", line, count=1).strip(" ")))
            lines = [] if strip_headers else [line]
        else:
            lines.append(line)
    yield from section()


def cut(text: str, sep: str) -> list[str]:
    """Pieces that keep their separator in front."""
    return [p for p in text.replace(sep, "\x01" + sep).split("\x01") if p]


def pieces(text: str, size: int) -> Iterator[tuple[str, tuple[int, int]]]:
    """(piece, group): pieces of one group may share a chunk; a piece that is too long has a group of its own."""
    top = cut(text, "\n\n") if "\n\n" in text else [text] if text else []
    outer = 0
    for part in top:
        if len(part) < size:
            yield part, (2 * outer, 0)
            continue
        inner = 0
        for piece in cut(part, ".\n"):
            long = len(piece) >= size
            yield piece, (2 * outer + 1, 2 * inner + long)
            inner += long
        outer += 1


def packed(text: str, size: int, overlap: int) -> Iterator[tuple[str, bool]]:
    """(chunk, whether it is one piece that is too long); pieces fill a chunk up to ``size`` characters."""
    held: list[str] = []  # pieces of the open chunk
    total, group = 0, None
    for piece, of in pieces(text, size):
        n = len(piece)
        if held and not (of == group and total + n <= size):
            yield "".join(held), len(held) == 1 and len(held[0]) >= size
            back, kept = 0, len(held)
            if of == group:
                while kept and back + len(held[kept - 1]) <= min(overlap, size - n):
                    kept -= 1
                    back += len(held[kept])
            held, total = held[kept:], back
        held.append(piece)
        total, group = total + n, of
    if held:
        yield "".join(held), len(held) == 1 and len(held[0]) >= size
