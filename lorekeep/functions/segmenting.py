"""Markdown and plain-text sections, for the one operator that folds over a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

_HEADING = re.compile(r"\s*#{1,6} (.*)", re.S)


def cut_bytes(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most limit UTF-8 bytes, cut between characters; joined they are the text."""
    data = text.encode()
    at = 0
    while len(data) - at > limit:
        end = at + limit
        while data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end].decode()
        at = end
    yield data[at:].decode()


def packed_paragraphs(body: str, limit: int) -> list[str]:
    """FN-26: paragraphs joined as long as they fit into limit bytes."""
    out, held = [], ""
    for paragraph in body.split("\n\n"):
        if held and len(held.encode()) + 2 + len(paragraph.encode()) > limit:
            out.append(held)
            held = ""
        *full, held = cut_bytes(f"{held}\n\n{paragraph}" if held else paragraph, limit)
        out += full
    return [*map(str.strip, out), *([held.strip()] if held.strip() else [])]


def segment_text(text: str, limit: int = 2000) -> list[tuple[str | None, str]]:
    """EXT-01: (heading, content) in order; a heading holds for what follows it, and empty sections give nothing."""
    sections: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if found := _HEADING.fullmatch(line):
            sections.append((found[1].strip(), []))
        else:
            sections[-1][1].append(line)
    out = []
    for name, lines in sections:
        body = "\n".join(lines).strip()
        if body:
            out += [(name, part) for part in ([body] if len(body.encode()) <= limit else packed_paragraphs(body, limit))]
    return out
