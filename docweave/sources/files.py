"""File access inside tasks: plain paths locally, URIs through Arrow's file systems."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyarrow import fs


def local_path(path: str) -> str | None:
    """The operating system's name for a path, None if it is on another file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _remote(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def list_names(folder: str, only_folders: bool) -> list[str]:
    """Names in a folder; nothing if it is missing, closed to us or no folder, like ``glob``.

    Any other error is raised, so that the task is tried again: a store that does not answer
    must not look like an empty folder.
    """
    local = local_path(folder or ".")
    if local is not None:
        try:
            with os.scandir(local) as found:
                return [entry.name for entry in found if not only_folders or entry.is_dir()]
        except (FileNotFoundError, PermissionError, NotADirectoryError):
            return []
    system, inner = _remote(folder.rstrip("/"))
    infos = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [i.base_name for i in infos if not only_folders or i.type == fs.FileType.Directory]


def exists(path: str) -> bool:
    local = local_path(path)
    if local is not None:
        return os.path.lexists(local)
    system, inner = _remote(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def change_time(path: str) -> int | None:
    """When a file was last changed, made or moved here, in nanoseconds; None if it has gone."""
    local = local_path(path)
    if local is not None:
        try:
            return os.stat(local).st_ctime_ns
        except FileNotFoundError:
            return None
    system, inner = _remote(path)
    return system.get_file_info(inner).mtime_ns


def make_folder(path: str) -> None:
    local = local_path(path)
    if local is not None:
        os.makedirs(local, exist_ok=True)
    else:
        system, inner = _remote(path)
        system.create_dir(inner)


def read_bytes(path: str) -> bytes:
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as file:
            return file.read()
    system, inner = _remote(path)
    with system.open_input_stream(inner) as stream:
        return stream.read()


#: Stores whose objects appear whole when they are closed; a move there would be a copy.
OBJECT_STORES = ("s3", "gcs", "abfs")


class ChangedFile(OSError):
    """The file is not as it was when it was read."""


def replace_text(path: str, text: str, expected: str) -> None:
    """Replace a file that still has the digest (SHA-256) it was read with.

    A file that has the new text already is left alone: a repeated task, or a job that goes on
    where it was lost, does no harm. The digest is compared when all that is left to do is to move the
    draft; a writer that changes the file within that move can still be lost.
    """
    data = text.encode()
    wanted = sha256(data).hexdigest()

    def now() -> str:
        try:
            return sha256(read_bytes(path)).hexdigest()
        except FileNotFoundError:
            raise ChangedFile(f"{path} has gone since it was read") from None

    def check() -> None:
        if now() != expected:
            raise ChangedFile(f"{path} has changed since it was read")

    if now() != wanted:
        write_text(path, text, check)


def _unchecked() -> None:
    """Nothing to look at before a file is replaced."""


def write_text(path: str, text: str, check: Callable[[], None] = _unchecked) -> None:
    """Whole file or nothing: a repeated or lost task leaves no half-written file.

    ``check`` runs last; if it raises, the file stays as it is."""
    data = text.encode()
    local = local_path(path)
    if local is None:
        _write_remote(path, data, check)
        return
    draft = f"{local}.{uuid.uuid4().hex}.part"
    try:
        with open(draft, "wb") as file:
            file.write(data)
        try:
            os.chmod(draft, os.stat(local).st_mode & 0o7777)
        except FileNotFoundError:
            pass  # a new file
        check()
        os.replace(draft, local)
    except BaseException:
        if os.path.lexists(draft):
            os.unlink(draft)
        raise


def _write_remote(path: str, data: bytes, check: Callable[[], None] = _unchecked) -> None:
    system, inner = _remote(path)
    if system.type_name in OBJECT_STORES:
        check()
        with system.open_output_stream(inner) as stream:
            stream.write(data)
        return
    draft = f"{inner}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(draft) as stream:
            stream.write(data)
        check()
        system.move(draft, inner)
    except BaseException:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise
