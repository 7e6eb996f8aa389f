"""Characters as the tokenizers library sees them: its letters, numbers, lower case and normal form.

Its tables are not of one Unicode version, nor of Python's or the regex package's. Python's tables (15.1 or 16) are taken, and
what differs is listed here.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import regex

#: White space; fixed values.
SPACES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Letters of Unicode 16; fixed values.
LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
#: Numbers of Unicode 16; fixed values.
NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Lower case of Unicode 17: (first, last, lower case of the first); fixed values.
LOWER = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70),
    (0x16EA0, 0x16EB8, 0x16EBB),
]
#: Marks that its normal form, of an older Unicode, does not know as such: nothing is reordered or composed across one; fixed values.
UNKNOWN_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]


def _inside(ranges: Iterable[tuple[int, int]]) -> str:
    """The inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _spans(codes: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


SPACE = _inside(SPACES)
_MARKS = re.compile(f"([{_inside(UNKNOWN_MARKS)}])")
_LOWER = {c: chr(low + c - a) for a, b, low in LOWER for c in range(a, b + 1)}


@lru_cache(maxsize=1)
def letters_numbers() -> tuple[list[int], list[int]]:
    """Code points of all letters and of all numbers."""
    major = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    of = lambda kind, more: sorted({c for c, k in enumerate(major) if k == kind}.union(*(range(a, b + 1) for a, b in more)))
    return of("L", LETTERS), of("N", NUMBERS)


def composed(text: str) -> str:
    """NFC. A text that is in the newer normal form is in the older one too."""
    if unicodedata.is_normalized("NFC", text):
        return text
    return "".join([unicodedata.normalize("NFC", part) for part in _MARKS.split(text)])


def lowered(text: str) -> str:
    """Lower case, character by character."""
    return text.translate({ord(c): _LOWER.get(ord(c)) or c.lower() for c in set(text)})


def _words(letter: str, number: str, space: str) -> str:
    """The splitting pattern of byte-level vocabularies; fixed values."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


_ASCII = re.compile(_words("A-Za-z", "0-9", r"\t-\r "))
_FAST = regex.compile(_words(r"\p{L}", r"\p{N}", SPACE))


@lru_cache(maxsize=1)
def _exact() -> tuple[frozenset[str], re.Pattern]:
    """Characters that the regex package takes for others than the library does, and the pattern for texts that have any."""
    letters, numbers = letters_numbers()
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = [set(regex.findall(rf"\p{{{kind}}}", every)) for kind in "LN"]
    differ = (found[0] ^ set(map(chr, letters))) | (found[1] ^ set(map(chr, numbers)))
    return frozenset(differ), re.compile(_words(_inside(_spans(letters)), _inside(_spans(numbers)), SPACE))


def pieces(text: str) -> list[str]:
    """Words, numbers, marks and blanks as byte-level vocabularies split a text."""
    if text.isascii():
        return _ASCII.findall(text)
    differ, pattern = _exact()
    return _FAST.findall(text) if differ.isdisjoint(text) else pattern.findall(text)
