"""Arrays in files of the shared work folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its name; a task that runs again replaces it with the same."""
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    system.move(part, f"{path}/{name}.npy")


_copies: str | None = None


def load(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped. From a store that cannot be mapped it is copied to the worker's
    own disk first, and the copy goes when the worker ends."""
    global _copies
    system, path = _place(folder)
    path = f"{path}/{name}.npy"
    if not isinstance(system, fs.LocalFileSystem):
        if _copies is None:
            _copies = tempfile.mkdtemp(prefix="tallybrook-")
            atexit.register(shutil.rmtree, _copies, ignore_errors=True)
        own = os.path.join(_copies, f"{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}.npy")
        if not os.path.exists(own):
            fs.copy_files(path, own, source_filesystem=system)
        path = own
    return np.load(path, mmap_mode="r", allow_pickle=False)
