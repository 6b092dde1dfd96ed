"""Opening files by path or URI, from any executor."""

from __future__ import annotations

from typing import BinaryIO


def open_input(path: str) -> BinaryIO:
    """A seekable stream of a local path, a file: URI, or a URI of a store that pyarrow reads."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(path)
    return store.open_input_file(name)
