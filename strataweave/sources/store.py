"""Small files that executors write and read: whole, by their path, on any file system that pyarrow knows.

A file appears under its name at once and complete: it is written beside it and
renamed. So a task that is lost leaves nothing half-written, and one that runs
again finds what it finished before.
"""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in its terms; Hadoop's short ``file:`` form is understood."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path))
    return fs.FileSystem.from_uri(path)


def write(path: str, data: bytes) -> None:
    """``data`` as the file ``path``, folders included; a file of that name is replaced."""
    system, name = at(path)
    folder, last = name.rsplit("/", 1)
    beside = f"{folder}/.{last[:80]}-{uuid.uuid4().hex}"
    if isinstance(system, fs.LocalFileSystem):  # the same in fewer calls
        try:
            out = open(beside, "wb")
        except FileNotFoundError:
            os.makedirs(folder, exist_ok=True)
            out = open(beside, "wb")
        with out:
            out.write(data)
        os.replace(beside, name)
        return
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, name)


def read(path: str) -> bytes | None:
    """The whole file, none if it is not there."""
    system, name = at(path)
    if isinstance(system, fs.LocalFileSystem):
        try:
            with open(name, "rb") as data:
                return data.read()
        except (FileNotFoundError, NotADirectoryError):
            return None
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(name) as data:
        return data.read()


def move(path: str, to: str) -> None:
    """Rename a file of one file system, folders included; a file of that name is replaced."""
    system, name = at(path)
    target = at(to)[1]
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    system.move(name, target)


def delete(path: str) -> None:
    """A folder and all in it, if it is there."""
    system, name = at(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)
