"""File names, media types and addresses on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.values import MEDIA_TYPES


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without its point; empty where there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]+)\z", 1))


def media_type(path: Column) -> Column:
    """By extension; ``application/octet-stream`` if it is unknown."""
    ext = extension(path)
    return F.coalesce(*(F.when(ext == k, F.lit(v)) for k, v in MEDIA_TYPES.items()), F.lit("application/octet-stream"))


def media_extension(kind: Column) -> Column:
    """By media type; ``bin`` if it is unknown."""
    first = {v: k for k, v in reversed(MEDIA_TYPES.items())}
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in first.items()), F.lit("bin"))


def title_of(path: Column) -> Column:
    """A title from a file's name."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"\.[^.]+\z", ""), "[_-]+", " ")


def resolved(folder: Column, link: Column) -> Column:
    """A link within a folder, its ``.`` and ``..`` steps taken."""
    steps = F.split(F.concat_ws("/", folder, link), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when((s == "") | (s == "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.array_join(walked, "/")


def stored_at(user: Column, document: Column, ext: Column) -> Column:
    return F.concat(F.concat_ws("/", user, document), F.lit("."), ext)


def is_own(path: Column, user: Column) -> Column:
    """Whether a stored file lies in a user's folder."""
    return F.startswith(path, F.concat(user, F.lit("/")))
