"""Parts of files of any size, read inside tasks through the file system that their address names (local, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from pyarrow import fs

CHUNK = 8 << 20


def located(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; characters that addresses escape are taken as they are."""
    scheme, rest = (re.match(r"(?:([a-z][a-z0-9+.-]*):)?(.*)", address, re.S).groups())
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    host, _, path = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, posixpath.join(base, path) if base.strip("/") else (f"/{path}" if base.startswith("/") else path)


def size_of(address: str) -> int:
    system, path = located(address)
    info = system.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(address)
    return info.size


def chunks(address: str, start: int = 0, end: int | None = None, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes from start to end (exclusive; the whole file) in chunks; one chunk is held at a time."""
    system, path = located(address)
    with system.open_input_file(path) as f:
        end = f.size() if end is None else min(end, f.size())
        f.seek(min(start, end))
        while (left := end - f.tell()) > 0 and (got := f.read(min(size, left))):
            yield got


def listed(address: str) -> list[tuple[str, int]]:
    """Address and size of the files that an address stands for, by name: one file, all files right in a folder, or a name with * and ?.

    Names that begin with a dot or an underscore are left out in folders and by patterns.
    """
    folder, _, name = address.rpartition("/")
    is_pattern = bool(re.search(r"[*?]", name))
    system, path = located(folder if is_pattern else address)
    if not is_pattern:
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(address, info.size)]
        folder, name = address.rstrip("/"), "*"
    like = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in name), re.S)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{folder}/{i.base_name}", i.size) for i in found if i.type == fs.FileType.File and like.fullmatch(i.base_name) and i.base_name[0] not in "._")
