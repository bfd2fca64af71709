"""Splitting binary files into byte ranges that tasks read on their own."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

SPLIT_BYTES = 64 * 1024 * 1024


@dataclass
class FilePart(InputPartition):
    """Share ``part`` of ``parts`` equal shares of a file's records."""

    path: str
    part: int
    parts: int
    name: str = ""  # path below the folder that was read: what tells clouds apart

    def rows(self, total: int) -> tuple[int, int]:
        return total * self.part // self.parts, total * (self.part + 1) // self.parts


def open_file(path: str):
    """Random-access stream; any file system Arrow knows (local, HDFS, S3, ...)."""
    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return system.open_input_file(inner)


def list_parts(path: str, suffix: str, split_bytes: int) -> list[FilePart]:
    """Parts of the file, or of all files with the suffix below the folder. Only sizes are looked at."""
    uri = path if "://" in path else "file://" + path
    system, inner = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = [i for i in system.get_file_info(fs.FileSelector(inner, recursive=True))
                 if i.type == fs.FileType.File and i.path.lower().endswith(suffix)]
    else:
        raise FileNotFoundError(path)
    root = inner.rstrip("/") + "/" if info.type == fs.FileType.Directory else os.path.dirname(inner) + "/"
    prefix = uri[:uri.index("://") + 3] if not uri.startswith("file://") else ""
    out = []
    for i in sorted(found, key=lambda i: i.path):
        parts = max(1, -(-i.size // split_bytes))
        out += [FilePart(prefix + i.path, k, parts, i.path.removeprefix(root)) for k in range(parts)]
    return out
