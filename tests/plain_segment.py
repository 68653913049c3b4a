"""Sections and chunks by plain loops, for comparison."""

import re

from veridoc.operators.segment import FENCES, MOST, OVERLAP, PREFACE

HEADING = re.compile(r"(#{1,6})[ \t]+(.+?)[ \t\x0b\f\r]*")
_EDGE = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000)))


def headings(body: str):
    """(offset, level, title) of each heading outside code fences; a fence that stays open hides all that follows."""
    at, fence = 0, None
    for line in body.split("\n"):
        mark = line.lstrip(_EDGE)[:3]
        if fence is None and mark in FENCES:
            fence = mark
        elif fence is not None:
            fence = None if mark == fence else fence
        elif m := HEADING.fullmatch(line):
            title = re.sub(r"[ \t]*#+$", "", m[2].strip(_EDGE)).strip(_EDGE) or m[2].strip(_EDGE)
            yield at, len(m[1]), title
        at += len(line) + 1


def split_sections(body: str | None):
    """(title, level, path, start, end); a blank text has none, a blank preface is left out."""
    if body is None or not body.strip(_EDGE):
        return
    found = list(headings(body))
    first = found[0][0] if found else len(body)
    if body[:first].strip(_EDGE):
        yield PREFACE, 0, PREFACE, 0, first
    path: list[tuple[int, str]] = []
    for (start, level, title), end in zip(found, [h[0] for h in found[1:]] + [len(body)], strict=False):
        path = [p for p in path if p[0] < level] + [(level, title)]
        yield title, level, " > ".join(t for _, t in path), start, end


def windows(body: str, most: int = MOST, overlap: int = OVERLAP):
    """(start, end) of chunks of at most ``most`` characters; one ends after the last line end of its second half."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("the size must be positive and the overlap below it")
    start = 0
    while len(body) - start > most:
        line = body.rfind("\n", start, start + most)
        end = line + 1 if line >= start + most // 2 else start + most
        yield start, end
        start = max(start + 1, end - overlap)
    yield start, len(body)
