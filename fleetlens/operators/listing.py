"""Folder listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def listing_keys(name: str = "pathSuffix", kind: str = "type") -> list[Column]:
    """Folders before everything else, then by name in language order."""
    return [
        F.when(F.col(kind) == "DIRECTORY", 0).otherwise(1).asc(),
        F.collate(F.col(name), "UNICODE").asc(),
        F.col(name).asc(),
    ]


def sort_listing(df: DataFrame, folder: str = "dir") -> DataFrame:
    """Every folder's entries in display order.

    One sort by range over folder and name together: a folder with most of the entries is
    spread over as many tasks as its size needs.
    """
    return df.orderBy(F.col(folder).asc(), *listing_keys())
