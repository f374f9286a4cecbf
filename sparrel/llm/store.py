"""Files in the shared folder: by path for ``file:``, by pyarrow's file systems for other schemes."""

from __future__ import annotations

import os
from functools import cache
from urllib.parse import unquote, urlparse


@cache
def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)[0]


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def writer(uri: str):
    """A file to write; its folder is made if need be."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    parts = urlparse(uri)
    system = _system(uri.rsplit("/", 1)[0])
    name = (parts.netloc if parts.scheme in ("s3", "gs", "abfs") else "") + parts.path
    system.create_dir(name.rsplit("/", 1)[0].lstrip("/") if parts.scheme == "s3" else name.rsplit("/", 1)[0])
    return system.open_output_stream(name)


def reader(uri: str):
    """A file to read at any place: seek() and read()."""
    if path := _local(uri):
        return open(path, "rb")
    parts = urlparse(uri)
    return _system(uri.rsplit("/", 1)[0]).open_input_file((parts.netloc if parts.scheme in ("s3", "gs", "abfs") else "") + parts.path)
