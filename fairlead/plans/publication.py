"""Two-file publication of a dataset and its manifest that a crash cannot leave half done.

State on disk: target and manifest; a staging copy while a result is made; a backup of both while they are
replaced. `recover` brings any state that a crash can leave back to a whole one, or refuses.
"""

from __future__ import annotations

import os
import shutil
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import density as ops
from ..operators.quality import validate_density
from ..sources.tables import netcdf_grid, read_events, read_grid
from . import sources_gate as gate
from .artifacts import StageConflict, VERSION, canonical_hash, read_json, same, signature, write_json

NETCDF = (".nc", ".nc4")  # ends of the names of NetCDF files


def _remove(p: Path) -> None:
    shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)


class Publication:
    def __init__(self, target: Path):
        self.target, self.manifest = target, target.with_name(f"{target.name}.manifest.json")
        self.staging = target.with_name(f"{target.name}.staging")
        self.backup, self.old_manifest = target.with_name(f"{target.name}.backup"), target.with_name(f"{target.name}.manifest.backup")

    def remnants(self) -> list[Path]:
        known = {self.target, self.manifest, self.staging, self.backup, self.old_manifest}
        others = [p for p in self.target.parent.glob(f"{self.target.name}.*") if p not in known] if self.target.parent.exists() else []
        if [p for p in others if ".partial-" not in p.name]:
            raise StageConflict(f"unknown files beside the target: {others}")
        return others + [p for p in (self.staging, self.backup, self.old_manifest) if p.exists()]

    def verified(self, target: Path, manifest: Path) -> bool:
        """Whether the manifest tells of these very files."""
        m = read_json(manifest)
        return bool(m and target.exists() and m.get("status") == "complete" and same(m.get("files"), _files(target)))

    def recover(self, force: bool = False) -> None:
        left = self.remnants()
        if not left:
            return
        if self.verified(self.target, self.manifest):
            for p in left:
                _remove(p)
        elif self.backup.exists() or self.old_manifest.exists():
            # a crash may have come before both files were moved
            target = self.backup if self.backup.exists() else self.target
            manifest = self.old_manifest if self.old_manifest.exists() else self.manifest
            if not self.verified(target, manifest):
                raise StageConflict("the backup is not what its manifest tells")
            if target is self.backup:
                _remove(self.target)
                os.replace(self.backup, self.target)
            if manifest is self.old_manifest:
                os.replace(self.old_manifest, self.manifest)
            for p in self.remnants():
                _remove(p)
        elif force:
            for p in [*left, self.target, self.manifest]:
                _remove(p)
        else:
            raise StageConflict(f"an interrupted run left {[p.name for p in left]}; force cleans up")

    def publish(self, make, manifest) -> None:
        """`make(path)` writes the staging copy; `manifest(path)` checks it and returns the manifest."""
        self.target.parent.mkdir(parents=True, exist_ok=True)
        had = self.target.exists(), self.manifest.exists()
        try:
            make(str(self.staging))
            told = manifest(str(self.staging)) | {"status": "complete", "files": _files(self.staging)}
        except BaseException:
            _remove(self.staging)
            raise
        try:
            if had[0]:
                os.replace(self.target, self.backup)
            if had[1]:
                os.replace(self.manifest, self.old_manifest)
            os.replace(self.staging, self.target)
            write_json(self.manifest, told)
        except BaseException:
            for new, old, there in ((self.target, self.backup, had[0]), (self.manifest, self.old_manifest, had[1])):
                if old.exists():
                    _remove(new)
                    os.replace(old, new)
                elif not there:
                    _remove(new)
            _remove(self.staging)
            raise
        _remove(self.backup)
        _remove(self.old_manifest)


def _files(path: Path) -> list:
    """Names and sizes with content hashes, which moving keeps."""
    from .artifacts import file_hash

    return [[str(p.relative_to(path)), p.stat().st_size, file_hash(p)] for p in sorted(path.rglob("*")) if p.is_file() and not p.name.startswith(".")]


def reject_overlap(target: Path, inputs: list[Path], event_folder: Path) -> None:
    for p in inputs:
        if target == p or target in p.parents or p in target.parents:
            raise ValueError(f"the output {target} overlaps the input {p}")
    if event_folder == target or event_folder in target.parents:
        raise ValueError("the output lies inside the folder of events")


def run_density(spark: SparkSession, config: dict, force: bool = False, dry_run: bool = False, kernel=ops.teos10, method: str = "teos10") -> dict:
    """Densities of all accepted events, published with their manifest; skipped when nothing has changed.

    Grids are long-form Parquet (month, lat, lon, value) or NetCDF, by the files' names: `era5_files` by calendar
    month, `woa23_monthly_files` one file for each natural month. NetCDF files must all be what they are meant to be.
    """
    target = Path(config["output_root"]) / "event_seawater_density.parquet"
    events = Path(config["events_path"])
    inputs = [events, *map(Path, config["era5_files"]), *map(Path, config["woa23_monthly_files"].values())]
    if dry_run:
        return {"status": "planned", "target": str(target)}
    reject_overlap(target, inputs, events)
    p = Publication(target)
    p.recover(force)
    known = {"version": VERSION, "config_hash": canonical_hash(config), "inputs": [signature(x) for x in inputs], "method": method}
    old = read_json(p.manifest)
    if old and p.verified(p.target, p.manifest) and all(same(old.get(k), _plain(v)) for k, v in known.items()):
        return {"status": "skipped", "target": str(target), "counts": old["counts"]}
    if (p.target.exists() or p.manifest.exists()) and not force:
        raise StageConflict(f"{target} belongs to other inputs; force rebuilds it")
    started = time.perf_counter()
    accepted = ops.accepted_events(read_events(spark, str(events)))
    expected = accepted.count()
    woa, era = config["woa23_monthly_files"], config["era5_files"]
    if any(f.endswith(NETCDF) for f in (*woa.values(), *era)):
        gate.check_temperature_files({f: gate.described(f) for f in era})
        gate.check_salinity_files({m: gate.described(f) for m, f in woa.items()})
    united = lambda files, variable: reduce(DataFrame.unionByName, (netcdf_grid(spark, f, variable) if f.endswith(NETCDF) else read_grid(spark, f) for f in files))
    salinity, sst = united(woa.values(), "s_an"), united(era, "sst")
    gate.check_grids(salinity, sst, accepted)
    out = ops.event_density(accepted, salinity, sst, kernel, method)
    ordered = out.repartitionByRange("event_id").sortWithinPartitions("event_id")
    own = {method} - {"teos10"}

    def manifest(path: str) -> dict:
        return _plain(known | {"counts": _validated(spark, path, expected, own), "elapsed_seconds": round(time.perf_counter() - started, 3)})

    p.publish(lambda path: ordered.write.option("compression", "zstd").parquet(path), manifest)
    return {"status": "complete", "target": str(target), "counts": read_json(p.manifest)["counts"]}


def _plain(x):
    import json

    return json.loads(json.dumps(x))


def _validated(spark, path: str, expected: int, other_methods: set) -> dict:
    df = spark.read.parquet(path)
    if other_methods:  # an approximate kernel keeps its own label; it is checked as the exact one is
        from pyspark.sql import functions as F

        df = df.withColumn("density_method", F.when(F.col("density_method").isin(list(other_methods)), "teos10").otherwise(F.col("density_method")))
    return validate_density(df, expected)
