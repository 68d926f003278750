"""Files in folders that all executors share: any store that pyarrow reaches, one handle a task."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


class Sink:
    """A file that gets a name of its own for every attempt: a task run twice never shares one.

    Only names that a finished task returned are read later, so files of lost attempts are ignored.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.stream = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends and returns the offset at which ``data`` starts."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


def opened(folder: str, name: str):
    """A seekable handle on a file of ``folder``."""
    store, path = filesystem(folder)
    return store.open_input_file(f"{path}/{name}")
