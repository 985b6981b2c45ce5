"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, schemes and identifier cues. Nothing else
is looked at: small parsers expand each anchor to the left and right, validate what they read and give its bounds. The
work is linear in the text, also where a text is one long run of letters or digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, UPPER

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "ssn", "login")
#: The shapes of the base kinds behind their anchors.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: The operator's own cues, in lower case, and the shapes looked for right behind them.
CUES = ("iban", "account", "ssn", "social security")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?))?[\x20:#]{1,3}([0-9]{6,17})(?![0-9])", re.IGNORECASE | re.ASCII)
_SSN = re.compile(r"(?:\x20number)?[\x20:#]{1,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.IGNORECASE | re.ASCII)
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]{1,64}:[^\s/@:]{1,64}@[A-Za-z0-9.-]+")
_SHAPES = {"iban": ("iban", _IBAN), "account": ("account", _ACCOUNT), "ssn": ("ssn", _SSN), "social security": ("ssn", _SSN)}
_LOWERED = str.maketrans(UPPER, LOWER)


@cache
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789", *CUES):
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    doubled = sum(map(int, "".join(str(2 * int(c)) for c in digits[-2::-2])))
    return (sum(map(int, digits[::-2])) + doubled) % 10 == 0


def _mod_97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind's place in BASE + ADDED, start, end) by kind, then start; a null text has none."""
    if not text:
        return []
    ends = dict.fromkeys((*BASE, *ADDED), 0)
    found = []

    def add(kind: str, start: int, end: int, right: bool = True) -> None:
        ends[kind] = end
        if right:
            found.append(((*BASE, *ADDED).index(kind), start, end))

    for last, anchor in _anchors().iter(text.translate(_LOWERED)):
        if anchor == "@":
            start = last
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                add("email", start, m.end())
        elif anchor == "+":
            if last >= ends["phone"] and (m := _PHONE.match(text, last)):
                add("phone", last, m.end(), 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15)
        elif anchor == "://":
            if last >= ends["login"] and (m := _LOGIN.match(text, last + 1)):
                add("login", last + 1, m.end())
        elif len(anchor) == 1:  # a digit; only the first of a run can begin anything
            runs_on = last > 0 and text[last - 1] in "0123456789"
            if last >= ends["ip"] and not runs_on and (m := _IP.match(text, last)):
                add("ip", last, m.end(), all(map(_small, m[0].split("."))))
            if last >= ends["card"] and (m := _CARD.match(text, last)):
                digits = _NOT_DIGIT.sub("", m[0])
                add("card", last, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        else:
            kind, shape = _SHAPES[anchor]
            if (m := shape.match(text, last + 1)) and m.start(1) >= ends[kind]:
                add(kind, m.start(1), m.end(1), kind != "iban" or _mod_97(m[1].replace(" ", "")))
    return sorted(found)


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_spans and spans as text.

    Spans are kind:start:end in code points, end exclusive. Matches of one kind never overlap; those of different kinds may.
    A null or empty text has no spans; repeated rows stay; an empty table gives an empty table; other columns are ignored.
    The scan needs no shuffle, so a hot source or key changes nothing.
    """
    names = (*BASE, *ADDED)
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"

    @F.pandas_udf(schema)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = find_spans(text)
                said = [f"{names[k]}:{start}:{end}" for k, start, end in spans]
                base = sum(k < len(BASE) for k, _, _ in spans)
                counts = [sum(k == kind for k, _, _ in spans) for kind in range(len(BASE))]
                rows.append((*counts, ",".join(said[:base]), ",".join(said)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col).cast("string")).alias("s")).select("doc_id", "s.*")
