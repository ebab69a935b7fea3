"""Binary files in the shared folder, written by tasks and memory-mapped by readers."""

import json
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_arrays(uri: str, arrays: dict[str, np.ndarray], **facts) -> int:
    """Write named arrays as one file and return its size. A repeated attempt replaces the file whole."""
    head, at = {}, 0
    for name, values in arrays.items():
        head[name] = (str(values.dtype), len(values), at)
        at += -(-values.nbytes // 64) * 64
    text = json.dumps({"arrays": head, "facts": facts}).encode()
    start = -(-(8 + len(text)) // 64) * 64

    def put(out) -> None:
        out.write(len(text).to_bytes(8, "little") + text)
        out.write(bytes(start - 8 - len(text)))
        for values in arrays.values():
            out.write(np.ascontiguousarray(values).tobytes())
            out.write(bytes(-values.nbytes % 64))

    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        attempt = f"{path}.{uuid.uuid4().hex}"
        with open(attempt, "wb") as out:
            put(out)
        os.replace(attempt, path)
    else:
        from pyarrow.fs import FileSystem

        files, path = FileSystem.from_uri(uri)
        files.create_dir(path.rsplit("/", 1)[0])
        attempt = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(attempt) as out:
            put(out)
        files.move(attempt, path)
    return start + at


class Mapped:
    """The arrays of one file, mapped read-only: pages are read as they are touched.

    From a store that cannot be mapped the file is first copied next to the task.
    """

    def __init__(self, uri: str):
        path = _local(uri)
        if path is None:
            from pyarrow.fs import FileSystem

            files, remote = FileSystem.from_uri(uri)
            handle, path = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out, files.open_input_stream(remote) as given:
                while part := given.read(1 << 22):
                    out.write(part)
        with open(path, "rb") as given:
            size = int.from_bytes(given.read(8), "little")
            head = json.loads(given.read(size))
        self.facts = head["facts"]
        start = -(-(8 + size) // 64) * 64
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        if _local(uri) is None:
            os.unlink(path)
        self.arrays = {}
        for name, (kind, count, at) in head["arrays"].items():
            self.arrays[name] = np.frombuffer(whole, dtype=kind, count=count, offset=start + at) if count else np.zeros(0, kind)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]


@lru_cache(maxsize=4096)
def mapped(uri: str) -> Mapped:
    return Mapped(uri)
