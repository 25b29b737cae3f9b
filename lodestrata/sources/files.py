"""Files by path or URI, on any file system that Arrow knows."""

from __future__ import annotations

import fnmatch
import os

import pyarrow.fs as pafs


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path inside it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def matching(pattern: str) -> list[str]:
    """Files whose last part fits a pattern, in order, as they can be opened again."""
    fs, inside = located(pattern)
    folder, _, name = inside.rpartition("/")
    found = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.is_file and fnmatch.fnmatch(i.base_name, name))
    scheme = pattern.split("://")[0] + "://" if "://" in pattern else ""
    return [scheme + p for p in found]
