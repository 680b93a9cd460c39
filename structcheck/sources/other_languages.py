"""Files of other languages, and types of files that a caller's own parser reads. For Java and C++ see `declarations`.

A parser takes the text of a file and yields dictionaries with the fields of `extraction.TYPE`. It runs in the tasks that
hold the files, so it must be importable, or picklable, there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structcheck.functions.tables import dealt

from .extraction import TYPE

#: Extensions of C++ files and folders that are left out.
CPP_EXTENSIONS = ("cpp", "cc", "cxx", "h", "hpp", "hxx")
CPP_SKIPPED = (
    "build", "cmake-build-debug", "cmake-build-release", "cmake-build-minsizerel", "cmake-build-relwithdebinfo", "out", ".git", ".svn",
    "third_party", "thirdparty", "external", "extern", "deps", "node_modules", "__pycache__", "venv", ".venv", "vendor", "_build",
    "bazel-bin", "bazel-out", "bazel-testlogs", "conan", ".conan2", "vcpkg", "vcpkg_installed",
)


def cpp_files(files: DataFrame) -> DataFrame:
    """The C++ files of `files` (with a column path), by extension and folder."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    wanted = F.lower(F.substring_index("path", ".", -1)).isin(*CPP_EXTENSIONS) & F.col("path").contains(".")
    return files.filter(wanted & ~F.arrays_overlap(folders, F.array(*map(F.lit, CPP_SKIPPED))))


def java_kind(annotation: Column, enum: Column, record: Column, interface: Column) -> Column:
    """The kind of a Java type by what it is, an annotation before an enum, a record and an interface."""
    return F.when(annotation, "annotation").when(enum, "enum").when(record, "record").when(interface, "interface").otherwise("class")


def extract(files: DataFrame, parser: Callable[[str], Iterable[dict]] | None) -> DataFrame:
    """`files` (repo, path, content): repo, path, pos and the fields of a type, for each that `parser` yields."""
    if parser is None:
        raise NotImplementedError("no parser for this language is installed; give one")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(r, p, i, json.dumps(t)) for r, p, c in b.itertuples(index=False) for i, t in enumerate(parser(c or ""))]
            yield pd.DataFrame(rows, columns=["repo", "path", "pos", "value"])

    made = dealt(files.select("repo", "path", "content"), "repo", "path").mapInPandas(run, "repo string, path string, pos int, value string")
    return made.select("repo", "path", "pos", F.from_json("value", TYPE).alias("t")).select("repo", "path", "pos", "t.*")
