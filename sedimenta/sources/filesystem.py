"""A folder tree as a data source: ``spark.read.format("file_tree")``.

Spark's own file readers drop hidden and empty files and see no folders or
links; this source lists all of them. Each top-level entry of a root is a
partition, so subtrees are walked side by side.
"""

from __future__ import annotations

import os
import stat as st

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedimenta.functions.bytesafe import escape

#: An entry that cannot be listed or looked at is a row with its error, never an absent one.
TREE_SCHEMA = "path string, name string, dir string, rel string, root_idx int, size long, holes long, mod_unix long, is_dir boolean, dev long, ino long, nlink int, unreadable boolean, error string"


def skipped(name: str) -> bool:
    return name.startswith(("@", ".")) or name in ("#recycle", "#snapshot", "lost+found")


def distinct_roots(roots: list[str], recurse: bool) -> list[str]:
    """Roots by length; one equal to, or in a recursive scan below, one kept before is dropped."""
    kept: list[str] = []
    for r in sorted({os.path.realpath(r) for r in roots}, key=lambda r: (len(r), r)):
        if not any(r == k or recurse and r.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(r)
    return kept


class Subtree(InputPartition):
    def __init__(self, root_idx: int, root: bytes, top: bytes | None):
        super().__init__(None)
        self.root_idx, self.root, self.top = root_idx, root, top


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.recurse = options.get("recurse", "true") == "true"
        self.with_dirs = options.get("with_dirs", "true") == "true"
        self.roots = distinct_roots(options["roots"].split(os.pathsep), self.recurse)

    def partitions(self):
        parts = []
        for i, root in enumerate(self.roots):
            raw = os.fsencode(root)
            try:
                tops = sorted(os.listdir(raw))
            except OSError:
                tops = []
            parts.append(Subtree(i, raw, None))
            parts += [Subtree(i, raw, t) for t in tops]
        return parts

    def _row(self, part: Subtree, path: bytes, s: os.stat_result | None, error: str = ""):
        name, folder = os.path.basename(path), os.path.dirname(path)
        rel = os.path.relpath(path, part.root)
        is_dir = s is not None and st.S_ISDIR(s.st_mode)
        size = 0 if s is None or is_dir else s.st_size
        holes = 0 if s is None or is_dir else size - min(s.st_blocks * 512, size)
        ident = (0, 0, 1) if s is None else (s.st_dev, s.st_ino, s.st_nlink)
        return (escape(path), escape(name), escape(folder), escape(rel), part.root_idx, size, holes, None if s is None else int(s.st_mtime), is_dir, *ident, bool(error), error)

    def read(self, part: Subtree):
        if part.top is None:
            try:
                os.listdir(part.root)
            except OSError as e:
                yield self._row(part, part.root, None, e.strerror or "error")
            return
        todo = [os.path.join(part.root, part.top)]
        while todo:
            path = todo.pop()
            try:
                s = os.lstat(path)
            except OSError as e:
                yield self._row(part, path, None, e.strerror or "error")
                continue
            if st.S_ISREG(s.st_mode):
                yield self._row(part, path, s)
            if not st.S_ISDIR(s.st_mode):
                continue
            name = os.fsdecode(os.path.basename(path))
            if self.with_dirs and (self.recurse or not skipped(name)):
                yield self._row(part, path, s)
            if not self.recurse or skipped(name):
                continue
            try:
                todo += [os.path.join(path, n) for n in sorted(os.listdir(path), reverse=True)]
            except OSError as e:
                yield self._row(part, path, None, e.strerror or "error")


class FileTree(DataSource):
    """Options: roots (separated by the system's path separator), recurse, with_dirs."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options)


def walk(spark: SparkSession, roots: list[str], recurse: bool = True, with_dirs: bool = True):
    """Entries under the roots; errors are rows with ``unreadable`` set."""
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(roots=os.pathsep.join(roots), recurse=str(recurse).lower(), with_dirs=str(with_dirs).lower()).load()


def self_mounts(mounts: str, own_hosts: set[str]) -> list[str]:
    """Mount points of network file systems that this host serves itself; a server that is not named counts as itself."""
    out = []
    for line in mounts.splitlines():
        fields = line.split()
        if len(fields) < 3 or fields[2] not in ("nfs", "nfs4", "cifs", "smb3", "fuse.sshfs"):
            continue
        device = fields[0]
        host = device[2:].split("/")[0] if device.startswith("//") else device.rpartition(":")[0].rpartition("@")[2]
        if not host or host.strip("[]").lower() in own_hosts:
            point = fields[1]
            for code, char in (("\\040", " "), ("\\011", "\t"), ("\\012", "\n"), ("\\134", "\\")):
                point = point.replace(code, char)
            out.append(point)
    return sorted(out)
