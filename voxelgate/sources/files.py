"""Files of any file system that Arrow can open, for code that runs in tasks: plain paths, file:, hdfs:, s3:, gs:, abfs:."""

from __future__ import annotations

import glob
from fnmatch import fnmatchcase
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what stood before that path."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path, ""
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), path[: len(path) - len(rest.lstrip("/")) - 1]
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path.removesuffix(inner)


def open_input(path: str) -> pa.NativeFile:
    system, inner, _ = located(path)
    return system.open_input_file(inner)


def size(path: str) -> int:
    system, inner, _ = located(path)
    return system.get_file_info(inner).size


def exists(path: str) -> bool:
    system, inner, _ = located(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def delete(path: str) -> None:
    """Deletes a file or a folder, if it is there."""
    system, inner, _ = located(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind != fs.FileType.NotFound:
        system.delete_file(inner)


def read_bytes(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()


def write_whole(path: str, content: bytes) -> None:
    """Writes a file that is seen whole or not at all, by way of a name of its own."""
    system, inner, _ = located(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    partial = f"{inner}.partial"
    with system.open_output_stream(partial) as f:
        f.write(content)
    system.move(partial, inner)


def names(folder: str) -> list[str]:
    """Names in a folder, in order; of a folder that isn't there, none."""
    system, inner, _ = located(folder)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)))


def expand(path: str) -> list[str]:
    """The files that a path, folder or pattern names, in order."""
    system, inner, before = located(path)
    if glob.has_magic(inner):
        parts = PurePosixPath(inner).parts
        fixed = next(i for i, p in enumerate(parts) if glob.has_magic(p))
        base = str(PurePosixPath(*parts[:fixed])) if fixed else "."
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
        fits = lambda p: len(p) == len(parts) and all(fnmatchcase(a, b) for a, b in zip(p, parts, strict=True))
        files = [i.path for i in found if i.type == fs.FileType.File and fits(PurePosixPath(i.path).parts)]
    else:
        info = system.get_file_info(inner)
        files = [inner] if info.type == fs.FileType.File else []
        if info.type == fs.FileType.Directory:
            files = [i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File]
    if not files:
        raise FileNotFoundError(f"nothing to read at {path}")
    return sorted(before + f for f in files)
