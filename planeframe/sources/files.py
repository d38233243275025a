"""Files by local path or URI: whole reads, atomic writes, listing, removal. Remote stores go through pyarrow's file systems."""

from __future__ import annotations

import contextlib
import ctypes
import os
import shutil
import uuid

import pyarrow.fs as pafs


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def local(path: str) -> str:
    return path.removeprefix("file://")


def _fs(path: str):
    return pafs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    if is_local(path):
        return os.path.exists(local(path))
    fs, name = _fs(path)
    return fs.get_file_info(name).type != pafs.FileType.NotFound


def read(path: str) -> bytes:
    if is_local(path):
        with open(local(path), "rb") as f:
            return f.read()
    fs, name = _fs(path)
    with fs.open_input_file(name) as f:
        return f.read()


def read_or_none(path: str) -> bytes | None:
    """The bytes of a file, None where there is none: one request, not two."""
    try:
        return read(path)
    except FileNotFoundError:
        return None


def opened(path: str):
    """A file for random reads."""
    if is_local(path):
        return open(local(path), "rb")
    fs, name = _fs(path)
    return fs.open_input_file(name)


def stream(path: str):
    """A file for one sequential write; its folders are made."""
    if is_local(path):
        try:
            return open(local(path), "wb")
        except FileNotFoundError:
            os.makedirs(os.path.dirname(local(path)) or ".", exist_ok=True)
            return open(local(path), "wb")
    fs, name = _fs(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    return fs.open_output_stream(name)


def temporary(path: str) -> str:
    folder, name = os.path.split(path)
    return f"{folder}/.{name}.{uuid.uuid4().hex}.tmp" if folder else f".{name}.{uuid.uuid4().hex}.tmp"


def replace(source: str, target: str) -> None:
    if is_local(target):
        os.replace(local(source), local(target))
    else:
        fs, name = _fs(target)
        fs.move(_fs(source)[1], name)


def write(path: str, raw: bytes, flush: bool = True) -> None:
    """Writes a temporary file beside ``path``, flushes it to disk and moves it there: readers see the old or the new file whole.

    Without ``flush`` the file is safe only after ``settle``."""
    hidden = temporary(path)
    try:
        with stream(hidden) as f:
            f.write(raw)
            if flush and is_local(path):
                f.flush()
                os.fsync(f.fileno())
        replace(hidden, path)
    except BaseException:
        with contextlib.suppress(OSError):
            remove(hidden)
        raise


def many():
    """``write`` without flush as a function for the very many small files of one task: a folder is made once and temporary names share their random part."""
    mark, made = uuid.uuid4().hex, ""

    def put(path: str, raw: bytes) -> None:
        nonlocal made
        if not is_local(path):
            return write(path, raw, flush=False)
        folder, _, name = local(path).rpartition("/")
        if folder != made:
            os.makedirs(folder or ".", exist_ok=True)
            made = folder
        hidden = os.path.join(folder, f".{name}.{mark}.tmp")
        try:
            f = os.open(hidden, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | os.O_CLOEXEC, 0o666)
            try:
                rest = memoryview(raw)
                while rest:
                    rest = rest[os.write(f, rest) :]
            finally:
                os.close(f)
            os.replace(hidden, local(path))
        except BaseException:
            with contextlib.suppress(OSError):
                os.remove(hidden)
            raise

    return put


def settle(folder: str) -> None:
    """Flushes what was written below a folder to disk: one flush of its file system, however many files there are. Remote stores keep a file once it is closed."""
    if not is_local(folder):
        return
    sync = getattr(ctypes.CDLL(None, use_errno=True), "syncfs", None)
    if sync is None:
        os.sync()
        return
    at = os.open(local(folder), os.O_RDONLY)
    try:
        if sync(at):
            raise OSError(ctypes.get_errno(), os.strerror(ctypes.get_errno()), folder)
    finally:
        os.close(at)


def remove(path: str) -> None:
    if is_local(path):
        p = local(path)
        shutil.rmtree(p) if os.path.isdir(p) else os.path.exists(p) and os.remove(p)
    elif exists(path):
        fs, name = _fs(path)
        (fs.delete_dir if fs.get_file_info(name).type == pafs.FileType.Directory else fs.delete_file)(name)


def walk(path: str) -> list[str]:
    """All files under a folder, in name order."""
    if is_local(path):
        return sorted(os.path.join(d, n) for d, _, names in os.walk(local(path)) for n in names if not n.startswith("."))
    fs, name = _fs(path)
    prefix = path[: len(path) - len(name)]
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True, allow_not_found=True))
    return sorted(prefix + i.path for i in found if i.type == pafs.FileType.File and not i.base_name.startswith("."))


def entries(path: str) -> tuple[list[str], list[str]]:
    """The folders and the files right in a folder."""
    if is_local(path):
        with os.scandir(local(path)) as found:
            inside = [(e.path, e.is_dir()) for e in found if not e.name.startswith(".")]
    else:
        fs, name = _fs(path)
        prefix = path[: len(path) - len(name)]
        inside = [(prefix + i.path, i.type == pafs.FileType.Directory) for i in fs.get_file_info(pafs.FileSelector(name)) if not i.base_name.startswith(".")]
    return [p for p, folder in inside if folder], [p for p, folder in inside if not folder]


def folders(path: str) -> list[str]:
    """Names of the folders in a folder, in order."""
    if is_local(path):
        return sorted(e.name for e in os.scandir(local(path)) if e.is_dir())
    fs, name = _fs(path)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(name)) if i.type == pafs.FileType.Directory)
