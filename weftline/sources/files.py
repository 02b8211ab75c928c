"""File and directory sources, sinks, limits and the taxonomy of errors."""

from __future__ import annotations

import contextlib
import os
import signal
import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.detect import glob_matches

#: Exit codes of error kinds.
EXIT_CODES = {"unsupported": 2, "ambiguous": 2, "extraction-failed": 3, "security-rejected": 4, "validation-failed": 1, "usage-error": 2, "not-found": 2, "capability-unavailable": 2, "partial-failure": 5}
IGNORED = (".git", "node_modules", "dist", "build", "coverage")


@dataclass(frozen=True)
class Limits:
    """What an input may have at most."""

    file_bytes: int = 100 << 20
    chars: int = 20 << 20
    sections: int = 50_000
    files: int = 50_000
    total_bytes: int = 2 << 30
    seconds: float = 60.0


def skip_reason(relative: Column, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True) -> Column:
    """Why a file of a tree is left out: by its first part from the root that isn't to be entered; null if it is read."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    any_of = lambda path, globs: F.array_max(F.array(*[glob_matches(path, g) for g in globs])) if globs else F.lit(False)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.element_at(parts, n).alias("name"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n < F.size(parts)).alias("folder")))

    def why(p: Column) -> Column:
        return (
            F.when(F.startswith(p["name"], F.lit(".")), "hidden")
            .when(p["folder"] & p["name"].isin(*IGNORED), "ignored-directory")
            .when(any_of(p["path"], exclude), "excluded-by-pattern")
            .when(p["folder"] & F.lit(not recursive), "directory-not-recursed")
        )

    first = F.get(F.filter(F.transform(prefixes, why), lambda r: r.isNotNull()), F.lit(0))
    wanted = any_of(relative, include) if include else F.lit(True)
    return F.coalesce(first, F.when(~wanted & (F.size(folders) >= 0), "not-included-by-pattern"))


def listing(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, relative, length, skip_reason) of the files under root; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    relative = F.regexp_replace("path", "^.*?" + _quoted(base) + "/+", "")
    return found.select("path", relative.alias("relative"), "length", skip_reason(relative, include, exclude, recursive).alias("skip_reason"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def walk(root: str) -> Iterator[tuple[str, str]]:
    """(relative path, reason) of a driver-local tree's entries that a distributed listing can't show as they are.

    Those are symlinks, odd files, and names that Spark's listing leaves out: hidden ones and those with an underscore first.
    """
    for folder, folders, files in os.walk(root, followlinks=False):
        for name in sorted([*folders, *files]):
            path = os.path.join(folder, name)
            shown = os.path.relpath(path, root).replace(os.sep, "/")
            if os.path.islink(path):
                yield shown, "symlink" if os.path.exists(path) else "unreadable"
            elif name.startswith("."):
                yield shown, "hidden"
            elif name.startswith("_"):
                yield shown, "unlisted"
            elif not os.path.isdir(path) and not os.path.isfile(path):
                yield shown, "not-a-regular-file"


def read(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(path, filename, declared, content, error_code): one row a file that isn't skipped; too large ones without content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    relative = F.regexp_replace("path", "^.*?" + _quoted(base) + "/+", "")
    live = rows.where(skip_reason(relative, include, exclude, recursive).isNull())
    large = F.col("length") > limits.file_bytes
    return live.select("path", filename(F.lit(None).cast("string"), F.col("path")).alias("filename"), F.lit(None).cast("string").alias("declared"), F.when(~large, F.col("content")).alias("content"), F.when(large, "security-rejected").alias("error_code"))


def filename(given: Column, path: Column, url: Column | None = None) -> Column:
    """The name given, else the path's last part, else the URL's."""
    tail = lambda c: F.nullif(F.element_at(F.split(F.regexp_replace(c, r"[?#].*$", ""), "/"), -1), F.lit(""))
    return F.coalesce(given, tail(path), *([tail(url)] if url is not None else []))


def texts(rows: DataFrame, text: str = "text", name: str | None = None) -> DataFrame:
    """Strings as inputs: UTF-8, text/plain."""
    label = F.concat(F.lit("text:"), F.coalesce(F.col(name), F.lit("inline"))) if name else F.lit("text:inline")
    return rows.select("*", label.alias("source_uri"), F.lit("text/plain").alias("declared"), F.col(text).cast("binary").alias("content"))


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds error_code, the first of the rules that holds; earlier codes stay."""
    code = F.coalesce(*[F.when(F.coalesce(wrong, F.lit(False)), name) for name, wrong in rules.items()])
    return rows.withColumn("error_code", F.coalesce("error_code", code) if "error_code" in rows.columns else code)


def failing(rows: DataFrame) -> DataFrame:
    """rows, but reading one with an error_code fails the job."""
    return rows.withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.raise_error(F.concat(F.lit("input refused: "), "error_code")).cast("string")))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those in quarantine."""
    return rows.where("error_code is null").drop("error_code"), rows.where("error_code is not null")


@contextlib.contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Stops one document's parser in a Python worker; elsewhere than on a main thread it doesn't limit."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError(f"took more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document): JSON files, each whole."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def write_texts(rows: DataFrame, path: str, column: str = "text") -> None:
    """One text a line block, ending with a line break."""
    rows.select(F.regexp_replace(column, r"\n$", "").alias("value")).write.mode("overwrite").text(path)
