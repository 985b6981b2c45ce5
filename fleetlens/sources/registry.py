"""Named data sources."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fleetlens import fixed
from fleetlens.settings import read_settings
from fleetlens.sources.jdbc import Partitioning, jdbc_options

LISTING = "name string, label string, type string, host string, port int, `user` string, rowLimit string, readOnly boolean, display string"


class UnknownSource(LookupError):
    """No source of that name is configured."""

    code = 404


@dataclass(frozen=True)
class Source:
    """Where tables come from. ``service`` names the database behind it, ``row_limit`` how it spells a row cap."""

    name: str
    type: str
    label: str
    service: str
    path: str = ""
    host: str = ""
    port: int = 0
    user: str = ""
    password: str = field(default="", repr=False)
    read_only: bool = True
    row_limit: str = ""

    @property
    def display(self) -> str:
        return self.name if self.label == self.name else f"{self.label} ({self.name})"


#: Choices of settings that are not free.
_CHOICES = {"type": [*fixed.SOURCE_TYPES, "parquet"], "rowLimit": ["", *fixed.ROW_LIMIT_MODES]}


def source_of(given: Mapping[str, Any]) -> Source:
    """A source as configured; what is left out follows from its name and type."""
    read = read_settings(given, fixed.SOURCE_SETTINGS)
    for key, choices in _CHOICES.items():
        if read[key] not in choices:
            raise ValueError(f"source {read['name']!r}: {key} {read[key]!r} is not supported")
    schema = read.pop("schema")
    follows = {
        "label": read["name"],
        "service": read["name"] if schema is None else schema,
        "port": fixed.SOURCE_PORTS.get(read["type"], 0),
    }
    read |= {key: value for key, value in follows.items() if read[key] is None}
    return Source(read_only=read.pop("readOnly"), row_limit=read.pop("rowLimit"), **read)


@dataclass(frozen=True)
class Registry:
    sources: Mapping[str, Source]
    allowed: tuple[str, ...] = ()
    query_timeout: int = fixed.QUERY_TIMEOUT_SECONDS
    connect_timeout: int = fixed.CONNECT_TIMEOUT_SECONDS

    @classmethod
    def from_config(cls, cfg: Mapping[str, Any]) -> Registry:
        listed, *rest = read_settings(cfg, fixed.REGISTRY_SETTINGS).values()
        return cls({source.name: source for source in map(source_of, listed)}, *rest)

    def get(self, name: str) -> Source:
        try:
            return self.sources[name]
        except KeyError:
            raise UnknownSource(f"source {name!r} is not configured") from None

    def names(self) -> list[str]:
        """Sorted names, cut to the allowed ones when any are named."""
        return [n for n in sorted(self.sources) if not self.allowed or n in self.allowed]

    def list(self, spark: SparkSession, engine: str | None = None) -> DataFrame:
        """The permitted sources without their passwords."""
        shown = [self.sources[n] for n in self.names()]
        rows = [
            (s.name, s.label, s.type, s.host, s.port, s.user, s.row_limit, s.read_only, s.display)
            for s in shown
            if engine is None or s.type == engine
        ]
        return spark.createDataFrame(rows, LISTING)

    def open(
        self, spark: SparkSession, name: str, table: str, partitioning: Partitioning | None = None, ranges: list[str] | None = None
    ) -> DataFrame:
        """A table of a source, lazily; filters and columns are pushed into the scan.

        ``ranges`` are conditions that share out a remote table, one task each, in place of equal strides.
        """
        source = self.get(name)
        if source.type == "parquet":
            return spark.read.parquet(f"{source.path.rstrip('/')}/{table}.parquet")
        options = jdbc_options(source, table, self.query_timeout, self.connect_timeout, partitioning)
        if ranges:
            url, remote = options.pop("url"), options.pop("dbtable")
            return spark.read.jdbc(url, remote, predicates=ranges, properties=options)
        return spark.read.format("jdbc").options(**options).load()
