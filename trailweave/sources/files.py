"""Files that Python workers read themselves: shared folders and object stores by URI."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that Python workers can use for a shared folder or store, and the path in it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def exists(uri: str) -> bool:
    fs, path = open_fs(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def read_bytes(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)
