"""Columns derived from file paths."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file sources report it: absolute, with its scheme, encoded, without ``..``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.makeQualified(path).toUri().normalize().toString().rstrip("/")


def _bare(uri: Column) -> Column:
    """A URI without the slashes that an empty authority may or may not have."""
    return F.regexp_replace(uri, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def relative(path: Column, root: str) -> Column:
    """Path below ``root``, a root from ``qualified``.  A path elsewhere is an error."""
    file, start = _bare(path), _bare(F.lit(root + "/"))
    tail = F.when(F.startswith(file, start), F.substring(file, F.length(start) + 1, F.length(file))).otherwise(
        F.raise_error(F.concat(F.lit("not below " + root + ": "), path))
    )
    return F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B")))


def folder(rel: Column) -> Column:
    """Parent of a relative path, ``.`` at the root."""
    parent = F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", ".").otherwise(parent)


def file_name(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def _part(source_folder: Column, n: int) -> Column:
    parts = F.filter(F.split(source_folder, r"[/\\]"), lambda p: (p != "") & (p != "."))
    return F.coalesce(F.get(parts, F.lit(n)), F.lit(""))


def client(source_folder: Column) -> Column:
    return _part(source_folder, 0)


def dossier(source_folder: Column) -> Column:
    return _part(source_folder, 1)
