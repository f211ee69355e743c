"""Files that executors write and read themselves, in the shared folder: by plain calls where that is a mounted
path, else through Arrow's file systems."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse


def _local(path: str) -> str | None:
    """The mounted path of a file: address or a plain path; None for other stores."""
    parts = urlparse(path)
    return parts.path if parts.scheme in ("", "file") else None


@contextmanager
def create(path: str):
    """A new binary file at `path`, seen there only once it is whole; a second attempt at the same path replaces it."""
    own = _local(path)
    if own is None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        name = f"{at}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(name) as out:
            yield out
        system.move(name, at)
        return
    os.makedirs(os.path.dirname(own), exist_ok=True)
    part = f"{own}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as out:
            yield out
        os.replace(part, own)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise


def open_input(path: str):
    """A seekable binary file."""
    own = _local(path)
    if own is None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(own, "rb")


def list_names(folder: str) -> list[str]:
    """Names of the files in a folder; none if there is no such folder."""
    own = _local(folder)
    if own is None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        return [x.base_name for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.is_file]
    return [x.name for x in os.scandir(own) if x.is_file()] if os.path.isdir(own) else []


def remove(path: str) -> None:
    own = _local(path)
    if own is None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        system.delete_file(at)
    elif os.path.exists(own):
        os.remove(own)
