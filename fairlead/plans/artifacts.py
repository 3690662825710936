"""Hashes, signatures, manifests and atomic writes on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from contextlib import suppress
from datetime import datetime, timezone
from pathlib import Path

VERSION = "1"


class StageConflict(RuntimeError):
    """There are results that do not belong to these inputs and parameters."""


def canonical_hash(value) -> str:
    """A configuration's hash. Fixed form, so that hashes of other implementations agree: SHA-256 of JSON with
    sorted keys, no blanks and characters as they are."""
    text = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode(value)
    return hashlib.sha256(text.encode()).hexdigest()


def file_hash(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def signature(path: Path) -> dict:
    """What tells a state of a file or folder from another without reading it: the size and the time of change
    of every file, hidden ones aside, by its name below the path ("." for a file itself)."""
    own = [path] if path.is_file() else [p for p in path.rglob("[!.]*") if p.is_file()]
    if not own and not path.is_dir():
        raise FileNotFoundError(path)
    state = {str(p.relative_to(path)): p.stat() for p in own}
    return {"path": str(path), "files": {name: [state[name].st_size, state[name].st_mtime_ns] for name in sorted(state)}}


def write_json(path: Path, value) -> None:
    """Whole or not at all: a reader sees the old manifest or the new one, also after a crash."""
    os.makedirs(path.parent, exist_ok=True)
    number, part = tempfile.mkstemp(prefix=f"{path.name}.partial-", dir=path.parent)
    try:
        with open(number, "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=1)
            out.write("\n")
            out.flush()
            os.fsync(number)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def read_json(path: Path):
    """The manifest, or None where there is none that can be read: whoever asks must then take the results as unknown."""
    with suppress(OSError, ValueError), open(path, encoding="utf-8") as f:
        return json.load(f)


def same(a, b) -> bool:
    """Equal as JSON, where true, 1 and 1.0 differ."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def up_to_date(targets: list[Path], manifest: Path, inputs: list, parameters: dict, force: bool) -> bool:
    """Whether the stage can be skipped: all targets are there as the manifest tells, made of these inputs
    with these parameters by this version. Anything else that is there is a conflict unless forced."""
    known = read_json(manifest)
    there = all(t.exists() for t in targets)
    if there and known and known.get("status") == "complete" and known.get("version") == VERSION:
        plain = json.loads(json.dumps([inputs, parameters, [signature(t) for t in targets]]))
        if same([known.get("inputs"), known.get("parameters"), known.get("outputs")], plain):
            return True
    if (any(t.exists() for t in targets) or manifest.exists()) and not force:
        raise StageConflict(f"{targets[0]} belongs to other inputs or parameters; force rebuilds it")
    return False


def complete(stage: str, config_path: str, config_hash: str, inputs: list, parameters: dict, targets: list[Path], counts: dict, started: float, warnings: list[str] = ()) -> dict:
    return {
        "status": "complete", "stage": stage, "version": VERSION, "config_path": config_path, "config_hash": config_hash, "inputs": inputs, "parameters": parameters,
        "outputs": [signature(t) for t in targets], "counts": counts, "warnings": list(warnings), "completed_utc": datetime.now(timezone.utc).isoformat(), "elapsed_seconds": round(time.perf_counter() - started, 3),
    }
