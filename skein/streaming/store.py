"""Files of the sources: plain paths through the operating system, URIs (hdfs://, s3://, gs://, file://) through Arrow's file
systems, which driver and executors open alike. A source's path option is a glob, or several separated by commas."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyarrow import fs

CHUNK = 1 << 20


class Seen(NamedTuple):
    size: int
    time: int  # nanoseconds


def remote(path: str) -> bool:
    return re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path) is not None


def resolved(path: str) -> tuple[fs.FileSystem, str, str, str]:
    """(file system, path on it, root, URI of that root). The root of a bucket's store is the bucket. Paths are taken as they are
    written: `?` and spaces are names' characters or wildcards, nothing is decoded."""
    base, rest = re.match(r"([^:]+:(?://[^/]*)?)/(.*)", path, re.S).groups()
    system, root = fs.FileSystem.from_uri(f"{base}/")
    root = root.rstrip("/")
    return system, f"{root}/{rest}", root, base


def pattern(glob_: str) -> re.Pattern:
    """`*` and `?` inside a name, `**` over folders."""
    out = re.escape(glob_).replace(r"\*\*/", "(?:.*/)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(out)


def listed(system: fs.FileSystem, glob_: str) -> Iterator[fs.FileInfo]:
    """The files of a glob, from a listing of the folder before its first wildcard; names with a leading dot need one said."""
    base = re.split(r"[*?]", glob_, maxsplit=1)[0]
    if base == glob_:
        found = [system.get_file_info(glob_)]
    else:
        found = system.get_file_info(fs.FileSelector(base.rpartition("/")[0] or "/", allow_not_found=True, recursive=True))
    full = pattern(glob_)
    yield from (x for x in found if x.type == fs.FileType.File and full.fullmatch(x.path))


def matching(path: str) -> list[str]:
    """The files of a path option, each once, in order."""
    out = set()
    for p in path.split(","):
        if remote(p):
            system, inner, root, base = resolved(p)
            out.update(base + x.path[len(root) :] for x in listed(system, inner))
        else:
            out.update(f for f in glob.glob(p, recursive=True) if os.path.isfile(f))
    return sorted(out)


def stat(file: str) -> Seen:
    if remote(file):
        system, inner, *_ = resolved(file)
        found = system.get_file_info(inner)
        if found.type != fs.FileType.File:
            raise FileNotFoundError(file)
        return Seen(found.size, found.mtime_ns or 0)
    found = os.stat(file)
    return Seen(found.st_size, found.st_mtime_ns)


@contextmanager
def opened(file: str) -> Iterator:
    """With read and seek, for bytes."""
    if remote(file):
        system, inner, *_ = resolved(file)
        with system.open_input_file(inner) as f:
            yield f
    else:
        with open(file, "rb") as f:
            yield f


def lines(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its newline) from a place on; the last one may have none."""
    f.seek(at)
    held: list[bytes] = []
    while chunk := f.read(CHUNK):
        begin = 0
        while (end := chunk.find(b"\n", begin)) >= 0:
            line = b"".join([*held, chunk[begin : end + 1]])
            held = []
            yield at, line
            at += len(line)
            begin = end + 1
        if begin < len(chunk):
            held.append(chunk[begin:])
    if held:
        yield at, b"".join(held)
