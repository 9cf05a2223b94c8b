"""A source tree as a table of files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.ignore import BUILT_IN, Rule, compile_rules, ignored, selected

#: Language by file extension; languages whose definitions can reach one another by bare name; project markers.
LANGUAGES = {
    ".tsx": "tsx", ".jsx": "tsx", ".mts": "typescript", ".cts": "typescript", ".ts": "typescript", ".mjs": "typescript", ".cjs": "typescript", ".js": "typescript", ".pyi": "python", ".py": "python", ".go": "go", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".swift": "swift", ".php": "php", ".r": "r", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".cs": "c_sharp",
}
FAMILIES = (("typescript", "tsx"), ("java", "kotlin", "scala", "clojure"), ("c", "cpp"))
MARKERS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "Gemfile", "mix.exs")
CONTAINER = r"(?i)^(dockerfile(\..*)?|(docker-)?compose\.ya?ml)$"

#: Files that a task opens, about.
FILES_A_TASK = 500


def walk(root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Sorted paths under root that no ignore rule drops. A dropped directory isn't entered; deeper rules come later and so win."""
    out: list[str] = []

    def enter(directory: str, rules: list[Rule]) -> None:
        full = os.path.join(root, directory)
        own = os.path.join(full, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = rules + compile_rules(f.read(), directory)
        for name in sorted(os.listdir(full)):
            path = f"{directory}/{name}" if directory else name
            is_dir = os.path.isdir(os.path.join(root, path)) and not os.path.islink(os.path.join(root, path))
            if is_dir and name not in BUILT_IN and not ignored(path, True, rules):
                enter(path, rules)
            elif not is_dir and not ignored(path, False, rules) and selected(path, include or [], exclude or []):
                out.append(path)

    enter("", [])
    return sorted(out)


FOUND = "path string, content string, size long, mtime timestamp, file_ord int"


def _open(root: str):
    """Listed files to FOUND; a file that can't be read, or isn't UTF-8, gives nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, order in zip(frame["path"], frame["file_ord"], strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        raw, at = f.read(), os.fstat(f.fileno()).st_mtime_ns
                    rows.append((path, raw.decode("utf-8"), len(raw), pd.Timestamp(at // 1000, unit="us", tz="UTC"), order))
                except (OSError, UnicodeDecodeError):
                    continue
            out = pd.DataFrame(rows, columns=["path", "content", "size", "mtime", "file_ord"])
            yield out.astype({"size": "int64", "file_ord": "int32", "mtime": "datetime64[us, UTC]"})

    return run


LISTED = "path string, file_ord int, size long, mtime timestamp"


def listing(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """LISTED: the source and container files of a tree with their size and time; nothing is opened."""
    base, rows = root.removeprefix("file://").rstrip("/"), []
    for p in walk(base, include, exclude):
        if os.path.splitext(p)[1].lower() in LANGUAGES or _container(p):
            try:
                stat = os.stat(os.path.join(base, p))
            except OSError:
                continue
            rows.append((p, len(rows), stat.st_size, datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, UTC)))
    return spark.createDataFrame(rows, LISTED)


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, listed: DataFrame | None = None) -> DataFrame:
    """FILES of a tree: listed where the session runs, opened by the executors; files that aren't UTF-8 are left out.

    Only source files and container files are opened, whatever their names begin with. root is a folder that all
    executors can read. listed: the files to open (path, file_ord), where that is known.
    """
    base = root.removeprefix("file://").rstrip("/")
    listed = (listed if listed is not None else listing(spark, root, include, exclude)).select("path", "file_ord")
    parts = max(1, min(listed.count() // FILES_A_TASK + 1, 10_000))
    return listed.repartition(parts, "path").mapInPandas(_open(base), FOUND)


def _container(path: str) -> bool:
    return re.match(CONTAINER, os.path.basename(path)) is not None


def family(path: str = "path"):
    """The family of a path's language, null where the extension is unknown."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    heads = {x: f[0] for f in FAMILIES for x in f}
    return F.element_at(F.create_map(*(x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(heads.get(v, v))))), ext)


def scopes(paths: DataFrame) -> DataFrame:
    """prefix, label, markers of directories that hold a project marker."""
    name, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    own = paths.select(folder.alias("prefix"), name.alias("marker")).filter(F.col("marker").isin(*MARKERS))
    return own.groupBy("prefix").agg(F.sort_array(F.collect_set("marker")).alias("markers")).select("prefix", F.when(F.col("prefix") == "", "root").otherwise(F.substring_index("prefix", "/", -1)).alias("label"), "markers")


def snapshot(files: DataFrame) -> DataFrame:
    """path, size, mtime in microseconds."""
    return files.select("path", "size", F.unix_micros("mtime").alias("mtime"))
