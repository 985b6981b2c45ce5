"""Reading settings against a declared list of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any


def _required(value: Any) -> str:
    if value is None:
        raise ValueError("is missing")
    return str(value)


def _list(value: Any) -> list:
    if not isinstance(value, list):
        raise ValueError("has to be a list")
    return value


def _names(values: Iterable[Any]) -> tuple[str, ...]:
    return tuple(filter(None, (str(v).strip() for v in values)))


#: What a value becomes, by its kind; a blank title counts as left out.
KINDS: dict[str, Callable[[Any], Any]] = {
    "required": _required,
    "text": str,
    "title": lambda value: str(value).strip() or None,
    "word": lambda value: str(value).strip().lower(),
    "count": int,
    "flag": bool,
    "list": _list,
    "names": _names,
}
#: Kinds that a setting must have a value for.
_NEEDED = ("required", "list")


def read_settings(given: Mapping[str, Any], declared: Iterable[tuple[str, str, Any]]) -> dict[str, Any]:
    """Every declared setting by key; keys that are not declared are ignored."""
    read = {}
    for key, kind, default in declared:
        try:
            read[key] = KINDS[kind](given.get(key)) if key in given or kind in _NEEDED else default
        except (TypeError, ValueError) as fault:
            raise ValueError(f"setting {key!r}: {fault}") from fault
    return read
