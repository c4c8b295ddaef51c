"""Files that tasks write to and read from the shared folder, in any store that pyarrow knows.

A file's name holds a fresh number, and readers learn it from a table that only successful tasks feed. So a task that is repeated after a loss leaves an
unread file behind, never a mixed one. Bytes are stored as given: pyarrow would compress once more by a file's name.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, stem: str, suffix: str):
    """A new file's URI and its stream."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def stream(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def random_access(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
