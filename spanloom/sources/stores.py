"""Random access to binary files: in local and shared folders, and by URI in every store that Arrow opens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def opened(path: str) -> Iterator:
    """A file with ``seek``, ``read`` and ``size``."""
    store, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    with store.open_input_file(inner) as file:
        yield file


def read_at(file, at: int, n: int) -> bytes:
    file.seek(at)
    got = file.read(n)
    if len(got) < n:
        raise ValueError(f"the file ends at {at + len(got)}, {n} bytes were expected at {at}")
    return got


def whole(path: str) -> bytes:
    with opened(path) as file:
        return file.read()
