"""Walking a source tree by its ignore files.

The tree is listed on the driver, folder by folder, so ignored folders are never entered; only names are held there. Files
are read by the executors. Hidden files and files that begin with an underscore belong to a source tree, which Spark's own
file sources leave out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Extensions that are indexed.
INDEXED = ("py", "ts", "tsx", "js", "jsx", "mjs", "sh", "bash", "html", "htm", "rs", "swift", "sql", "md", "mdx")
#: Folders of virtual environments, and how deep their packages may lie.
ENVIRONMENTS = ("venv", ".venv", "env", ".env", ".tox")
ENVIRONMENT_DEPTH = 6
IGNORE_FILES = (".gitignore", ".codeweftignore")
FILES_PER_TASK = 256


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: what it matches below ``base``, whether it takes back, whether it is for folders only."""

    base: str
    pattern: re.Pattern
    back: bool
    folders: bool


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def rules_of(text: str, base: str = "") -> list[Rule]:
    """The rules of an ignore file that lies in the folder ``base``."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        glob = _regex(line.lstrip("/"))
        try:
            out.append(Rule(base, re.compile(glob if anchored else "(?:.*/)?" + glob), back, folders))
        except re.error:
            continue
    return out


def ignored(path: str, folder: bool, rules: list[Rule]) -> bool:
    """Whether a path below the root is left out; of several rules that match it the last one counts."""
    for r in reversed(rules):
        if r.folders and not folder or r.base and not path.startswith(r.base + "/"):
            continue
        if r.pattern.fullmatch(path[len(r.base) + 1 if r.base else 0 :]):
            return not r.back
    return False


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + root)


def list_files(root: str, extensions: tuple[str, ...], obey: bool = True, skip: tuple[str, ...] = (".git",)) -> list[str]:
    """Paths below ``root`` of all files with one of the extensions, in order; ``obey`` ignore files or not. Folders with a name of
    ``skip`` are not entered."""
    from pyarrow import fs

    system, top = _files(root)
    top = top.rstrip("/")
    if system.get_file_info(top).type != fs.FileType.Directory:
        return []
    out: list[str] = []

    def text(path: str) -> str:
        with system.open_input_file(path) as f:
            return f.read().decode("utf-8", "replace")

    todo: list[tuple[str, list[Rule]]] = [("", [])]
    while todo:
        folder, rules = todo.pop()
        here = sorted(system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"))), key=lambda x: x.base_name)
        names = {x.base_name for x in here if x.type == fs.FileType.File}
        if obey:
            extra = [rules_of(text(f"{top}/{folder}/{n}" if folder else f"{top}/{n}"), folder) for n in IGNORE_FILES if n in names]
            exclude = f"{top}/.git/info/exclude"
            if not folder and system.get_file_info(exclude).type == fs.FileType.File:
                extra.insert(0, rules_of(text(exclude)))
            rules = [*rules, *(r for e in extra for r in e)]
        for x in here:
            path = f"{folder}/{x.base_name}" if folder else x.base_name
            if x.type == fs.FileType.Directory:
                if x.base_name not in skip and not (obey and ignored(path, True, rules)):
                    todo.append((path, rules))
            elif x.base_name.rsplit(".", 1)[-1].lower() in extensions and "." in x.base_name and not (obey and ignored(path, False, rules)):
                out.append(path)
    return sorted(out)


def stub_files(root: str) -> list[str]:
    """Paths of the type stubs of installed packages; ignore files do not matter there."""
    out = [f"node_modules/@types/{p}" for p in list_files(f"{root}/node_modules/@types", ("ts",), obey=False)]
    for env in ENVIRONMENTS:
        for p in list_files(f"{root}/{env}", ("pyi",), obey=False):
            at = f"/{p}".find("/site-packages/")
            if at >= 0 and p[:at].count("/") < ENVIRONMENT_DEPTH:
                out.append(f"{env}/{p}")
    return out + [f".build/{p}" for p in list_files(f"{root}/.build", ("swiftinterface",), obey=False)]


def read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """``path``, ``content`` of files below ``root``, read by the executors; what is no UTF-8 is read with marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _files(root)
        for pdf in batches:
            for p in pdf["path"]:
                with system.open_input_file(f"{top.rstrip('/')}/{p}") as f:
                    yield pd.DataFrame({"path": [p], "content": [f.read().decode("utf-8", "replace")]})

    names = spark.createDataFrame([(p,) for p in paths], "path string")
    return names.repartition(max(1, -(-len(paths) // FILES_PER_TASK)), "path").mapInPandas(run, "path string, content string")
