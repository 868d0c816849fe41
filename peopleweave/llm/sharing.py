"""Binary files in the folder that the driver and all executors share."""
from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path or ``file:`` is the mounted shared disk."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@contextmanager
def writing(uri: str):
    """A stream that appears under its name only when complete, so a repeated or lost task leaves no half file."""
    system, path = located(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as stream:
        yield stream
    system.move(part, path)


def reading(uri: str):
    """A file with random access."""
    system, path = located(uri)
    return system.open_input_file(path)
