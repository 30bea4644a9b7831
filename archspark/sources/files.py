"""File systems of paths: a plain path or a URI of any file system Arrow knows (file, hdfs, s3, gs, ...)."""

from __future__ import annotations

import os
import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it; works on the driver and in tasks alike."""
    if re.match(r"[A-Za-z][\w+.\-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def list_files(system: fs.FileSystem, folder: str, recursive: bool = False) -> list[str]:
    """Paths of the files in a folder, sorted."""
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(folder, recursive=recursive)) if x.type == fs.FileType.File)
