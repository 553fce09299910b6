"""Zip containers read with limits: encrypted entries, declared and real sizes, compression ratio."""

from __future__ import annotations

import io
import zipfile

#: Limits: fixed values of the guard.
MOST_BYTES, MOST_RATIO = 512 << 20, 100


class Broken(ValueError):
    """The source can't be read."""


class TooLarge(ValueError):
    """A limit was exceeded."""


def opened(raw: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise Broken("damaged zip container") from e
    total = 0
    for i in z.infolist():
        if i.flag_bits & 1:
            raise Broken(f"encrypted entry {i.filename}")
        total += i.file_size
        if i.file_size > MOST_RATIO * max(1, i.compress_size) and i.file_size > 1 << 20:
            raise TooLarge(f"entry {i.filename} is compressed too much")
    if total > MOST_BYTES:
        raise TooLarge("unpacked size over the limit")
    return z


def entry(z: zipfile.ZipFile, name: str) -> bytes:
    """An entry, never more of it than the limit whatever its header says."""
    try:
        with z.open(name) as f:
            out = f.read(MOST_BYTES + 1)
    except KeyError as e:
        raise Broken(f"no entry {name}") from e
    if len(out) > MOST_BYTES:
        raise TooLarge(f"entry {name} over the limit")
    return out
