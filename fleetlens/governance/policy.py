"""What statements may do."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from fleetlens import fixed
from fleetlens.settings import read_settings


@dataclass(frozen=True)
class Policy:
    """Allow-lists and limits; an empty source or table list allows all, the others nothing."""

    allowed_sources: tuple[str, ...] = ()
    allowed_tables: tuple[str, ...] = ()
    writable_tables: tuple[str, ...] = ()
    procedures: tuple[str, ...] = ()
    default_limit: int = fixed.DEFAULT_ROW_LIMIT
    max_limit: int = fixed.MAX_ROW_LIMIT
    max_sql_chars: int = fixed.MAX_SQL_CHARS
    query_timeout: int = fixed.QUERY_TIMEOUT_SECONDS

    @classmethod
    def from_config(cls, cfg: Mapping[str, Any]) -> Policy:
        """From a configuration; the fields stand in the order of the declared settings."""
        return cls(*read_settings(cfg, fixed.POLICY_SETTINGS).values())

    def table_allowed(self, name: str) -> bool:
        return not self.allowed_tables or name in self.allowed_tables or name.split(".", 1)[-1] in self.allowed_tables
