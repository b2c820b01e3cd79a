"""Binary files in the shared folder, through pyarrow's file systems.

Tasks write a file under an attempt-unique name and move it to its final
one; a row that names the file is returned only afterwards.  Readers open
only files that such rows name, so retried or speculative attempts and lost
executors leave at most unread files behind.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def file_system(uri: str):
    """(file system, path) of ``uri``; plain paths are local."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def make_dir(uri: str) -> None:
    f, path = file_system(uri)
    f.create_dir(path, recursive=True)


@contextmanager
def committed(uri: str):
    """A binary sink for ``uri``; the file appears whole or not at all."""
    f, path = file_system(uri)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with f.open_output_stream(attempt) as sink:
        yield sink
    f.move(attempt, path)


class Ranges:
    """Random access to one file by byte ranges."""

    def __init__(self, uri: str):
        f, path = file_system(uri)
        self._file = f.open_input_file(path)
        self.size = self._file.size()

    def read(self, offset: int, n: int) -> bytes:
        return self._file.read_at(n, offset)

    def close(self) -> None:
        self._file.close()

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.close()
