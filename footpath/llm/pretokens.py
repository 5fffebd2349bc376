"""Splitting text into pieces that byte-level BPE encodes independently of each other."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex

#: The characters with the property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: A chunk is a run without white space with the one space before it, or white space.  The public
#: pattern never matches across such a chunk's end, so the chunks can be split one by one.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Separators that Python, but not the Unicode property, takes for white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WHITE_RUN = re.compile(f"[{WHITE}]+")


def words_of(text: str) -> list[str]:
    """Maximal runs without white space."""
    return [w for w in WHITE_RUN.split(text) if w] if ODD_SPACE.search(text) else text.split()


def unassigned(chunk: str) -> bool:
    """Whether a library with other Unicode tables could class a character differently."""
    return not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk if c > "ɏ")


#: A private character, which is neither letter nor number nor white space to anyone.
OTHER = "\ue000"


def pre_tokens(chunk: str, own: regex.Pattern, known: Callable[[str], bool]) -> list[str]:
    """The pattern's matches.  Libraries' tables differ in age: of the characters that Python's tables don't have, those
    that aren't ``known`` to the library are taken for neither letters nor numbers."""
    if not unassigned(chunk):
        return own.findall(chunk)
    seen = "".join(OTHER if unicodedata.category(c) == "Cn" and not known(c) else c for c in chunk)
    return [chunk[m.start() : m.end()] for m in own.finditer(seen)]


def pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


#: The characters by which byte-level vocabularies write bytes.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(PRINTABLE))}


def byte_string(text: str) -> str:
    """A text as a byte-level vocabulary writes it."""
    return text.encode().decode("latin-1").translate(BYTE_CHARS)


def split_spaces(text: str) -> list[str]:
    """The text cut at single spaces; each piece but the first has lost the space before it.

    Only if no piece is empty or has white space at an end are the pieces (with that space) chunks;
    ``plain`` tells that of a piece.
    """
    return text.split(" ")


def plain(piece: str) -> bool:
    return bool(piece) and piece[0] not in WHITE and piece[-1] not in WHITE
