"""Cutting texts where two tokenizers' units end anyway, and what is remembered of the parts."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: The pre-tokenizer pattern of the byte-level vocabularies. Fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters behind which a mark starts a piece of its own.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def word_splitter(pattern: str, lines: bool = True, marks: str = string.punctuation) -> Callable[[str], list[str]]:
    """Cuts a text into words that no match of ``pattern`` crosses; the text itself for a pattern nothing is known of.

    No match of BYTE_LEVEL reaches over the place between a visible character and a space or line feed behind it, nor between a
    lone line feed and a visible character, nor between a letter and a mark. More white space than one character stays with the
    word behind it, as the pattern looks ahead; what Python takes for white space includes all that the pattern does. ``lines``
    says whether a lone line feed is a word of its own, ``marks`` which marks may start a word within a run of visible characters.
    """
    if pattern != BYTE_LEVEL:
        return lambda text: [text]
    mark, feed = f"[{re.escape(marks)}]" if marks else r"(?!)", r"\n" if lines else ""
    visible = rf"[^\s{re.escape(marks)}]+|(?<![{LETTERS}]){mark}|[^\S {feed}]\s*"
    alone = r"\n(?!\s)|" if lines else ""
    return re.compile(rf"{alone}(?=[\s\S])\s*(?:{mark})?(?:{visible})*").findall


def piece_splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text; ASCII texts take the standard library, which is faster."""
    full = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return full
    ascii_only = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]")
    for name, kind in ((r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", r"[\t-\r ]"), (r"\S", r"[^\t-\r ]")):
        ascii_only = ascii_only.replace(name, kind)
    plain = re.compile(ascii_only).findall
    return lambda text: plain(text) if text.isascii() else full(text)


def joinable(tokens: Iterable[bytes]) -> np.ndarray:
    """For two bytes, whether any token holds them side by side."""
    table = np.zeros((256, 256), bool)
    for token in tokens:
        for left, right in zip(token, token[1:]):
            table[left, right] = True
    return table


def parts_of(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts sequences of bytes, laid end to end, where no token reaches over.

    Gives each part's sequence, and for each byte its part and its place in it. No sequence may be empty.
    """
    first = np.zeros(len(flat), bool)
    ends = np.cumsum(sizes)
    first[ends - sizes] = True
    first[1:] |= ~table[flat[:-1], flat[1:]]
    starts = np.flatnonzero(first)
    part = np.cumsum(first) - 1
    return np.searchsorted(ends, starts, "right"), part, np.arange(len(flat)) - starts[part]


class Remembered:
    """What was found for the words met lately: at most twice ``most`` beside those of one batch, the oldest go first."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def split(self, wanted: Iterable[str]) -> tuple[dict, list[str]]:
        """What is known of the wanted, and the rest."""
        here, rest = {}, []
        for word in wanted:
            found = self.young.get(word)
            if found is None and (found := self.old.get(word)) is not None:
                self.young[word] = found
            if found is None:
                rest.append(word)
            else:
                here[word] = found
        return here, rest

    def keep(self, found: dict, names: Iterable[str]) -> None:
        for name in names:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[name] = found[name]
