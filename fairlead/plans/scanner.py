"""A scan of a folder's files for what must not be published: data files, keys, home paths."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

BLOCKED = frozenset(".parquet .dat .duckdb .db .nc .pem .key .p12 .zip .tar .gz".split())
PATTERNS = {
    "private key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "access key": re.compile(r"\bAKIA[0-9A-Z]{16}\b"),
    "token": re.compile(r"\b(?:ghp|gho|ghs|github_pat)_[A-Za-z0-9_]{20,}"),
    "home path": re.compile(r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)[A-Za-z0-9._-]+"),
}
FIXTURE_BYTES = 64 << 10


def tracked(folder: Path) -> list[Path]:
    out = subprocess.run(["git", "-C", str(folder), "ls-files", "-z"], capture_output=True, check=True).stdout
    return [folder / x.decode() for x in out.split(b"\0") if x]


def scan(folder: str | Path, files: list[Path] | None = None, fixtures: str = "sample_data") -> list[tuple[str, str]]:
    """(file, finding) of the files; small data files under `fixtures` are allowed."""
    folder, out = Path(folder), []
    for p in tracked(folder) if files is None else files:
        name = str(p.relative_to(folder))
        if p.suffix.lower() in BLOCKED and not (name.startswith(f"{fixtures}/") and p.stat().st_size <= FIXTURE_BYTES):
            out.append((name, f"blocked kind {p.suffix}"))
        elif p.name.lower().startswith(".env"):
            out.append((name, "environment file"))
        else:
            text = p.read_text(encoding="utf-8", errors="replace")
            out += [(name, what) for what, pattern in PATTERNS.items() if pattern.search(text)]
    return out
