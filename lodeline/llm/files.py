"""Byte files on whatever file system a URI names, from executors."""

from __future__ import annotations

from urllib.parse import unquote, urlparse


def _system(uri: str):
    """(file system, path): the local one for file: and plain paths, else whatever pyarrow knows (hdfs, s3, gs)."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def open_read(uri: str):
    system, path = _system(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_write(uri: str):
    system, path = _system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)
