"""Slash-separated paths."""

from pyspark.sql import Column, functions as F

from fleetlens import fixed


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(folder, F.lit("/"), name))


def resolve_path(cwd: Column, typed: Column) -> Column:
    """The folder meant by what was typed while in ``cwd``; typing nothing stays there."""
    wanted = F.btrim(typed, F.lit(fixed.TYPED_BLANKS))
    full = F.when(F.startswith(wanted, F.lit("/")), wanted).otherwise(join_path(cwd, wanted))
    tidy = F.rtrim(F.regexp_replace(full, "/{2,}", "/"), F.lit("/"))
    return F.when(wanted == "", cwd).when(tidy == "", "/").otherwise(tidy)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def parent_path(path: Column) -> Column:
    """Everything before the last slash; the root has no parent."""
    before = F.regexp_extract(path, r"(?s)\A(.*)/", 1)
    return F.when(path != "/", F.when(before == "", "/").otherwise(before))


def ancestors(path: Column) -> Column:
    """The path of every crumb, shallowest first, the path itself last."""
    parts = segments(path)
    crumbs = F.transform(
        parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    )
    return crumbs


def path_parts(path: Column) -> Column:
    """Segments, depth, parent and crumbs in one struct."""
    parts = segments(path)
    return F.struct(
        parts.alias("segments"),
        F.size(parts).alias("depth"),
        parent_path(path).alias("parent"),
        ancestors(path).alias("ancestors"),
    )
