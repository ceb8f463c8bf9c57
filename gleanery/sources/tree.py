"""A folder tree as a data source: read in parallel, filtered before files are opened, and followed as a stream.

The root is a folder that driver and executors see under the same path (a shared mount, or one machine). The driver lists
the upper levels only; a task walks and reads the folders of its part. `spark.read.format("tree").load(root)`.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

from gleanery.sources.readers import SKIPPED

SCHEMA = "path string, folder string, name string, extension string, size long, modified timestamp, doc string"


@dataclass(frozen=True)
class Part(InputPartition):
    """Folders to walk whole, and folders of which only the own files count; mtimes in ns of (after, until]."""

    whole: tuple[str, ...]
    flat: tuple[str, ...]
    after: int = -1
    until: int = 1 << 62


@dataclass
class Spec:
    root: str
    pattern: str = "*.md"
    ignore: tuple[str, ...] = ()
    parts: int = 16
    content: bool = True
    wanted: dict[str, set[str]] = field(default_factory=dict)  # extension and folder, from pushed filters
    prefixes: list[str] = field(default_factory=list)
    since: int = -1

    @staticmethod
    def of(options: dict) -> Spec:
        root = (options.get("path") or "").removeprefix("file://").rstrip("/")
        if not root:
            raise ValueError("the tree source needs a path")
        ignore = tuple(x for x in options.get("ignore", "").split(",") if x)
        return Spec(root, options.get("pattern", "*.md"), ignore, int(options.get("parts", "16")), options.get("content", "true").lower() != "false")

    def passes(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        folder, ext = path.rsplit("/", 1)[0] if "/" in path else "", name.rsplit(".", 1)[-1] if "." in name[1:] else ""
        if not fnmatch.fnmatch(name, self.pattern) or any(fnmatch.fnmatch(path, p) for p in self.ignore):
            return False
        have = {"folder": folder, "extension": ext, "name": name, "path": path}
        return all(have[c] in v for c, v in self.wanted.items()) and all(path.startswith(p) for p in self.prefixes)

    def folders(self, at: str) -> tuple[list[str], list[str]]:
        """Names of the folders and files below a folder that count; none where it is gone."""
        try:
            with os.scandir(os.path.join(self.root, at)) as found:
                entries = [(e.name, e.is_dir(follow_symlinks=False)) for e in found if not e.name.startswith(".")]
        except (FileNotFoundError, NotADirectoryError):
            return [], []
        join = lambda n: f"{at}/{n}" if at else n
        return sorted(join(n) for n, d in entries if d and n not in SKIPPED), sorted(join(n) for n, d in entries if not d)

    def split(self, after: int = -1, until: int = 1 << 62) -> list[Part]:
        """Parts of about the same number of folders, from as few levels as give enough of them."""
        level, flat = [""], []
        while level and len(level) < self.parts and len(flat) < 64 * self.parts:
            flat += level
            level = [f for at in level for f in self.folders(at)[0]]
        n = max(1, min(self.parts, len(level) + len(flat)))
        return [Part(tuple(level[k::n]), tuple(flat[k::n]), after, until) for k in range(n)]

    def files(self, part: Part) -> Iterator[tuple[str, os.stat_result]]:
        todo = list(part.whole)
        for at in part.flat:
            yield from self.stats(self.folders(at)[1], part)
        while todo:
            folders, files = self.folders(todo.pop())
            todo += folders
            yield from self.stats(files, part)

    def stats(self, files: list[str], part: Part) -> Iterator[tuple[str, os.stat_result]]:
        for path in files:
            if self.passes(path):
                try:
                    s = os.stat(os.path.join(self.root, path))
                except FileNotFoundError:  # gone meanwhile
                    continue
                if max(part.after, self.since) < s.st_mtime_ns <= part.until:
                    yield path, s

    def rows(self, part: Part) -> Iterator[tuple]:
        for path, s in self.files(part):
            doc = None
            if self.content:
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                        doc = f.read()
                except FileNotFoundError:
                    continue
            name = path.rsplit("/", 1)[-1]
            yield path, path.rsplit("/", 1)[0] if "/" in path else "", name, name.rsplit(".", 1)[-1] if "." in name[1:] else "", s.st_size, datetime.fromtimestamp(s.st_mtime_ns / 1e9, timezone.utc), doc


class TreeReader(DataSourceReader):
    def __init__(self, spec: Spec):
        self.spec = spec

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and lists on path, folder, name and extension, prefixes of path, and lower bounds of modified;
        all others are Spark's."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("path", "folder", "name", "extension"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.spec.wanted[column] = self.spec.wanted.get(column, values) & values
            elif isinstance(f, StringStartsWith) and column == "path":
                self.spec.prefixes.append(f.value)
            else:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column == "modified":
                    self.spec.since = max(self.spec.since, int((f.value.timestamp() - 1) * 1e9))  # a bound a second lower; Spark applies the exact one
                yield f

    def partitions(self):
        return self.spec.split()

    def read(self, partition: Part):
        return self.spec.rows(partition)


class TreeStream(DataSourceStreamReader):
    """Files that are new or changed since the offset, which is the newest change seen, in ns. Deleted files are not seen
    here: a scan of the tree and `store.removed` find them. A file that gets an older time than the offset is not seen."""

    def __init__(self, spec: Spec):
        self.spec = spec

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        parts = self.spec.split()
        return {"modified": max((s.st_mtime_ns for p in parts for _, s in self.spec.files(p)), default=-1)}

    def partitions(self, start: dict, end: dict):
        return self.spec.split(start["modified"], end["modified"])

    def read(self, partition: Part):
        return self.spec.rows(partition)


class Tree(DataSource):
    """Options: pattern (of names, *.md by default), ignore (patterns of paths, with commas), parts, content (false: no doc)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(Spec.of(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(Spec.of(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known as "tree", with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
