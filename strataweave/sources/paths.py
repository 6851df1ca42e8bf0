"""Local documents: which paths are let in, and how a file is opened without following links."""

from __future__ import annotations

import os
import re
import stat
from pathlib import Path, PureWindowsPath

from ..errors import InputError, InputTooLargeError

#: Names that Windows keeps for devices, whatever their suffix.
_DEVICE = re.compile(r"(con|conin\$|conout\$|prn|aux|nul|(com|lpt)[1-9¹²³])(\..*)?", re.IGNORECASE)


def windows_trap(raw: str) -> bool:
    """A path that Windows reads as a device, a stream, another name, or relative to a drive."""
    path = PureWindowsPath(raw)
    if path.drive and not path.root:
        return True
    parts = path.parts[1:] if path.anchor else path.parts
    return any(":" in p or _DEVICE.fullmatch(p.rstrip(" .")) or (p not in (".", "..") and p[-1:] in (" ", ".")) for p in parts)


def local_path(path: str | os.PathLike) -> Path:
    """The absolute path of a local file that may be opened. No URLs, control characters or links, in ancestors neither; it may not exist yet."""
    raw = os.fspath(path)
    plain = raw and not re.search(r"[\x00-\x1f]", raw) and "://" not in raw and not raw.replace("\\", "/").startswith("//")
    if not plain or (os.name == "nt" and windows_trap(raw)):
        raise InputError("not a path of a local file")
    try:
        raw.encode()
        whole = Path(raw).absolute()
        at = Path(whole.anchor)
        for name in whole.parts[1:]:
            at = at / name
            try:
                found = os.lstat(at)
            except FileNotFoundError:
                break
            if stat.S_ISLNK(found.st_mode) or getattr(found, "st_file_attributes", 0) & 0x400:
                raise InputError("links are not followed")
    except (OSError, ValueError) as e:
        raise InputError("the path can't be looked up") from e
    return whole


def read_regular(path: str | os.PathLike, most: int) -> bytes:
    """The bytes of a regular file, which the open itself must find to be one; more than `most` fail."""
    where = local_path(path)
    try:
        if not stat.S_ISREG(os.stat(where, follow_symlinks=False).st_mode):
            raise InputError("not a regular file")
        mode = os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0) | getattr(os, "O_BINARY", 0)
        with open(os.open(where, mode), "rb") as f:
            if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
                raise InputError("not a regular file")
            raw = f.read(most + 1)
    except OSError as e:
        raise InputError(f"the document can't be read: {e.strerror}") from e
    if len(raw) > most:
        raise InputTooLargeError(f"more than {most} bytes")
    return raw
