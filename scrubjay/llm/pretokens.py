"""Splitting text the way two public tokenizer files do, before any merge."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex
from tokenizers import normalizers

# Unicode White_Space, the meaning of \s in both tokenizers (Python's \s differs).
SPACE = r"\t-\r \x85\xa0  -     　"
# Fixed value: the published splitting rule of the word-level vocabulary.
WORD_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable character standing for each byte: itself if printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_NFC_LOWER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def lower_nfc(text: str) -> str:
    """NFC, then each character lowered alone.

    Up to the combining marks Python and the tokenizer library agree; above,
    their Unicode versions may differ and the library's normaliser decides.
    """
    if text.isascii():
        return text.lower()
    if max(text) < "\u0300":
        return unicodedata.normalize("NFC", text).lower()
    return _NFC_LOWER.normalize_str(text)


class Splitter:
    """``split(text)``: pretokens, with the contents of special tokens as pretokens of their own."""

    def __init__(self, pattern: str, specials: list[str], normalise=None):
        self._find = regex.compile(pattern).findall
        self._special = set(specials)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")
        self._normalise = normalise

    def split(self, text: str) -> list[str]:
        if not any(s in text for s in self._special):
            return self._find(self._normalise(text) if self._normalise else text)
        out: list[str] = []
        for part in self._cut.split(text):
            if part in self._special:
                out.append(part)
            elif part:
                out += self._find(self._normalise(part) if self._normalise else part)
        return out


LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text, out = "".join(map(chr, points)), np.full(0x110000, OTHER, np.uint8)
    number = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, f"[{SPACE}]+")):
        for m in regex.finditer(pattern, text):
            out[number[m.start():m.end()]] = kind
    return out


def byte_level_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pretokens of the byte-level vocabulary begin in texts laid end to end.

    ``points``: code points; ``begins``: first position of every text that is
    not empty. Runs of one class are pretokens. One blank before a run other
    than white space belongs to it; white space before such a run is split
    before its last character. An apostrophe that begins a pretoken takes one of the
    endings s, t, m, d, re, ve, ll with it.
    """
    n = len(points)
    kind = np.zeros(n + 1, np.uint8)  # 0 past the end
    kind[:n] = _classes()[points]
    new = np.zeros(n + 1, bool)
    new[begins] = True
    new[n] = True
    start = new.copy()
    start[1:n] |= kind[1:n] != kind[:n - 1]
    follows = ~new[1:]  # position i + 1 is of the same text
    start[:n] |= (kind[:n] == WHITE) & follows & (kind[1:] != WHITE)
    held = np.flatnonzero((points[:-1] == 0x20) & (kind[1:n] != WHITE) & follows[:-1]) + 1
    start[held] = False
    for i in np.flatnonzero((points == 0x27) & start[:n]).tolist():
        rest = points[i + 1:i + 3]
        same = follows[i:i + 2]
        if not len(rest) or not same[0]:
            continue
        if chr(rest[0]) in "stmd":
            size = 2
        elif len(rest) == 2 and same[1] and chr(rest[0]) + chr(rest[1]) in ("re", "ve", "ll"):
            size = 3
        else:
            continue
        start[i + 1] = False
        start[i + size] = True
    return np.flatnonzero(start[:n])
