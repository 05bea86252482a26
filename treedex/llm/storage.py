"""Files in the shared folder, by URI: on a mounted path with open(), elsewhere through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _fs(uri: str):
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return None, unquote(u.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, chunks) -> int:
    """Write chunks under a name of this attempt's own, then rename: a retried task leaves one whole file."""
    store, path = _fs(uri)
    temp, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    if store is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp, "wb") as f:
            for c in chunks:
                f.write(c)
                size += len(c)
        os.replace(temp, path)
    else:
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(temp) as f:
            for c in chunks:
                f.write(c)
                size += len(c)
        store.move(temp, path)
    return size


def get(uri: str, start: int, length: int) -> bytes:
    """Bytes [start, start + length) of a file, fewer at its end."""
    store, path = _fs(uri)
    if store is None:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(length)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)
