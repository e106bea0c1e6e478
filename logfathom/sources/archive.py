"""Archives of bundles, unpacked without trusting their names."""

from __future__ import annotations

import os
import stat
import tarfile
import zipfile
from pathlib import Path, PurePosixPath

#: What the two short modes unpack, below the archive's first folder.
MODES = {
    "fast": ("var/log/", "sos_commands/logs/", "sos_commands/docker/", "sos_commands/systemd/", "sos_commands/kernel/", "sos_strings/logs/"),
    "journal": ("sos_commands/logs/journalctl", "sos_strings/logs/journalctl"),
    "full": ("",),
}


class ArchiveError(Exception):
    """An archive that can't be unpacked safely."""


def safe_target(root: Path, name: str) -> Path:
    parts = PurePosixPath(name.replace("\\", "/"))
    if parts.is_absolute() or ".." in parts.parts or (parts.parts and ":" in parts.parts[0]):
        raise ArchiveError(f"a member leaves the folder: {name}")
    return root.joinpath(*parts.parts)


def _wanted(name: str, mode: str) -> bool:
    rest = name.partition("/")[2]
    return mode == "full" or any(rest.startswith(p) for p in MODES[mode])


def extract(archive: str, target: str, mode: str = "full") -> list[str]:
    """The paths written. Absolute names, ``..``, links and devices are refused; the kind is told by content."""
    root = Path(target)
    written = []
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist():
                if stat.S_ISLNK(m.external_attr >> 16):
                    raise ArchiveError(f"a link: {m.filename}")
                path = safe_target(root, m.filename)
                if m.is_dir() or not _wanted(m.filename, mode):
                    continue
                path.parent.mkdir(parents=True, exist_ok=True)
                with z.open(m) as src, path.open("wb") as dst:
                    while chunk := src.read(1 << 20):
                        dst.write(chunk)
                written.append(str(path))
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            for m in t:
                path = safe_target(root, m.name)
                if not _wanted(m.name, mode) or m.isdir():
                    continue
                if not m.isreg():
                    raise ArchiveError(f"no plain file: {m.name}")
                path.parent.mkdir(parents=True, exist_ok=True)
                with t.extractfile(m) as src, path.open("wb") as dst:
                    while chunk := src.read(1 << 20):
                        dst.write(chunk)
                written.append(str(path))
    else:
        raise ArchiveError(f"neither zip nor tar: {archive}")
    return written


def find_root(folder: str) -> str:
    """The shallowest cluster bundle below a folder, else the only node bundle."""
    nodes = []
    for at, dirs, files in sorted(os.walk(folder), key=lambda x: (x[0].count(os.sep), x[0])):
        if "ucp-nodes.txt" in files:
            return at
        if "dsinfo.json" in files and "dsinfo.txt" in files and "inspect" in dirs:
            nodes.append(at)
    if len(nodes) != 1:
        raise ArchiveError(f"{len(nodes)} node bundles and no cluster bundle")
    return nodes[0]
