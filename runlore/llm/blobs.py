"""Binary files in the shared folder, by any URI that pyarrow can open (a local path, file://, hdfs://, s3://)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class BlobWriter:
    """A file that appears under its name only when it is whole, so that a task that fails or runs twice leaves no half."""

    def __init__(self, uri: str):
        self._fs, self._path = _at(uri)
        folder, _, name = self._path.rpartition("/")
        self._fs.create_dir(folder, recursive=True)
        self._draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._draft)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()
        self._fs.move(self._draft, self._path)


def open_blob(uri: str):
    """A file to read, with seek()."""
    filesystem, path = _at(uri)
    return filesystem.open_input_file(path)
