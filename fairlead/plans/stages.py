"""Batch stages: static shards, registry, tanker positions, samples, CSV, heat map. Each is skipped when up to date."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import file_date
from ..operators import sampling, spatial, vessels
from ..operators.decode import decode_positions, decode_static
from ..operators.quality import decode_summary, flag_histogram
from ..sources.dat import file_kind, read_dat
from ..sources.tables import read_union
from .artifacts import VERSION, complete, signature, up_to_date, write_json
from .config import Config

POSITION_WARNING = "records of other communication types than 1 have no mmsi and are left out"


def day_path(root: Path, what: str, day: date, name: str) -> Path:
    return root / what / f"year={day:%Y}" / f"month={day:%m}" / f"date={day.isoformat()}" / name


def shard_path(c: Config, day: date) -> Path:
    return day_path(c.output_root, "registry/static_shards", day, "static_ship_types.parquet")


def registry_path(c: Config, year: int, tankers: bool = True) -> Path:
    return c.output_root / "registry" / ("tanker_registry" if tankers else "vessel_registry") / f"year={year:04d}" / "registry.parquet"


def positions_path(c: Config, day: date) -> Path:
    return day_path(c.output_root, "positions/tanker", day, "tanker_positions.parquet")


def samples_path(c: Config, day: date) -> Path:
    zone = c.data["sampling"]["timezone"].replace("/", "_").replace("\\", "_")
    return day_path(c.output_root, f"samples_3h/timezone={zone}", day, "tanker_samples_3h.parquet")


def publish(write, target: Path) -> None:
    """Let `write` make the result beside its place, then move it there; what was there goes only then."""
    target.parent.mkdir(parents=True, exist_ok=True)
    part, old = (target.with_name(f"{target.name}.{k}-{uuid.uuid4().hex}") for k in ("partial", "old"))
    try:
        write(str(part))
        if target.exists():
            os.replace(target, old)
        os.replace(part, target)
    finally:
        for p in (part, old):
            shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)


def parquet(df: DataFrame):
    return lambda path: df.write.option("compression", "zstd").parquet(path)


def stage(c: Config, name: str, targets: list[Path], inputs: list[Path], parameters: dict, force: bool, dry_run: bool, build, warnings=()) -> dict:
    """Run a stage unless it is up to date. `build` publishes the targets and returns counts."""
    manifest = targets[-1].parent / f"{targets[-1].name}.manifest.json"
    if dry_run:
        return {"stage": name, "status": "planned", "targets": [str(t) for t in targets]}
    known = [signature(p) for p in inputs]
    if up_to_date(targets, manifest, known, parameters, force):
        return {"stage": name, "status": "skipped", "targets": [str(t) for t in targets]}
    started = time.perf_counter()
    counts = build()
    write_json(manifest, complete(name, str(c.path), c.hash, known, parameters, targets, counts, started, warnings))
    return {"stage": name, "status": "complete", "targets": [str(t) for t in targets], "counts": counts, "warnings": list(warnings)}


def _decoded(spark: SparkSession, path: Path, decode, rows: int | None) -> DataFrame:
    out = decode(read_dat(spark, f"file://{path}"), file_date(path.name))
    return out.limit(rows) if rows else out


def static_shard(spark, c: Config, day: date, force=False, dry_run=False, rows=None) -> dict:
    source, target = c.input_path("sta", day), shard_path(c, day)
    if not source.exists():
        raise FileNotFoundError(f"no static file {source}")

    def build():
        publish(parquet(vessels.static_shard(_decoded(spark, source, decode_static, rows))), target)
        counts = vessels.position_counts(spark.read.parquet(str(target)).withColumnRenamed("receive_time_s", "pos_time_s")).first()
        return {"records": counts["records"], "distinct_mmsi": counts["distinct_mmsi"]}

    return stage(c, "static_shard", [target], [source], {"date": day.isoformat(), "max_source_rows": rows}, force, dry_run, build)


def build_registry(spark, c: Config, days: list[date], force=False, dry_run=False, rows=None) -> list[dict]:
    """Shards of the days, then a registry of each year from all shards that there are of it."""
    out = [static_shard(spark, c, d, force, dry_run, rows) for d in days]
    for year in sorted({d.year for d in days}):
        targets = [registry_path(c, year, False), registry_path(c, year)]
        shards = sorted((c.output_root / "registry/static_shards" / f"year={year:04d}").rglob("*.parquet")) if not dry_run else []
        shards = [p for p in shards if p.name == "static_ship_types.parquet"]

        def build(shards=shards, targets=targets):
            registry = vessels.vessel_registry(read_union(spark, *map(str, shards)), c.tanker_types)
            publish(parquet(registry), targets[0])
            made = spark.read.parquet(str(targets[0]))
            publish(parquet(vessels.tanker_registry(made)), targets[1])
            return vessels.registry_counts(made).first().asDict()

        out.append(stage(c, "registry", targets, shards, {"year": year, "tanker_types": c.tanker_types}, force, dry_run, build))
    return out


def filter_positions(spark, c: Config, days: list[date], force=False, dry_run=False, rows=None) -> list[dict]:
    out, zero = [], bool(c.data["quality"].get("exclude_zero_zero", True))
    for day in days:
        source, registry, target = c.input_path("pos", day), registry_path(c, day.year), positions_path(c, day)
        if not source.exists():
            raise FileNotFoundError(f"no position file {source}")
        if not registry.exists() and not dry_run:
            raise FileNotFoundError(f"no registry {registry}")

        def build(source=source, registry=registry, target=target):
            known = spark.read.parquet(str(registry))
            positions = vessels.tanker_positions(_decoded(spark, source, decode_positions, rows), known, zero, vessels.fits_broadcast(known))
            publish(parquet(positions), target)
            return vessels.position_counts(spark.read.parquet(str(target))).first().asDict()

        parameters = {"date": day.isoformat(), "exclude_zero_zero": zero, "max_source_rows": rows}
        out.append(stage(c, "positions", [target], [source, registry], parameters, force, dry_run, build, [POSITION_WARNING]))
    return out


def sample_positions(spark, c: Config, days: list[date], force=False, dry_run=False) -> list[dict]:
    out, s = [], c.data["sampling"]
    tolerance = int(s["tolerance_seconds"])
    for day in days:
        targets, target = c.targets(day), samples_path(c, day)
        utc = lambda t: datetime.fromtimestamp(t, timezone.utc).date()
        first, last = utc(min(t[2] for t in targets) - tolerance), utc(max(t[2] for t in targets) + tolerance)
        wanted = [positions_path(c, first + timedelta(days=i)) for i in range((last - first).days + 1)]
        there = [p for p in wanted if p.exists()]
        warnings = [f"no positions {p}" for p in wanted if p not in there]
        if not dry_run and (not there or (warnings and s.get("require_complete_window", False))):
            raise FileNotFoundError("; ".join(warnings))

        def build(day=day, there=there, target=target):
            frame = sampling.sampling_targets(spark, s["timezone"], [int(h) for h in s["hours"]], [day])
            publish(parquet(sampling.sample_nearest(read_union(spark, *map(str, there)), frame, tolerance)), target)
            return sampling.sample_counts(spark.read.parquet(str(target))).first().asDict()

        parameters = {"date": day.isoformat(), "timezone": s["timezone"], "hours": sorted(map(int, s["hours"])), "tolerance_seconds": tolerance}
        out.append(stage(c, "samples", [target], there, parameters, force, dry_run, build, warnings))
    return out


def _samples(c: Config, days: list[date]) -> list[Path]:
    there = [p for p in (samples_path(c, d) for d in days) if p.exists()]
    if not there:
        raise FileNotFoundError("no samples of these days")
    return there


def _span(days: list[date]) -> str:
    return days[0].isoformat() if len(days) == 1 else f"{days[0].isoformat()}_{days[-1].isoformat()}"


def export_csv(spark, c: Config, days: list[date], force=False, dry_run=False) -> dict:
    """One ordered CSV file with a header."""
    target = c.output_root / "csv" / f"tanker_samples_3h_{_span(days)}.csv"
    sources = [] if dry_run else _samples(c, days)

    def build():
        df = read_union(spark, *map(str, sources))

        def write(path: str) -> None:
            folder = f"{path}-parts"
            sampling.csv_projection(df).coalesce(1).write.option("header", True).csv(folder)
            os.replace(next(Path(folder).glob("part-*")), path)
            shutil.rmtree(folder)

        publish(write, target)
        return {"records": df.count()}

    return stage(c, "csv", [target], sources, {"dates": [d.isoformat() for d in days]}, force, dry_run, build)


def render_heatmap(spark, c: Config, days: list[date], force=False, dry_run=False) -> dict:
    """The grid as Parquet, and a picture of it where matplotlib is installed."""
    h = c.data.get("heatmap") or {}
    extent, size, metric = h.get("extent", [-180.0, 180.0, -90.0, 90.0]), float(h.get("bin_size_degrees", 0.5)), h.get("metric", "sample_count")
    target = c.output_root / "heatmap" / f"tanker_{metric}_{_span(days)}.parquet"
    sources = [] if dry_run else _samples(c, days)

    def build():
        df = read_union(spark, *map(str, sources))
        publish(parquet(spatial.grid_density(df, extent, size)), target)
        cells = spark.read.parquet(str(target))
        nx, ny = spatial.grid_shape(extent, size)
        try:
            spatial.render_png(spatial.dense_grid(cells, extent, size, metric), extent, str(target.with_suffix(".png")), h.get("colormap", "inferno"), h.get("dpi", 140), h.get("figure_size_inches", (8, 6)))
        except RuntimeError:
            pass  # no matplotlib; the grid is the result
        return {"input_sample_records": df.count(), "occupied_grid_cells": cells.count(), "grid_columns": nx, "grid_rows": ny}

    return stage(c, "heatmap", [target], sources, {"dates": [d.isoformat() for d in days], "extent": extent, "bin_size_degrees": size, "metric": metric}, force, dry_run, build)


def run(spark, c: Config, days: list[date], force=False, dry_run=False, rows=None) -> list[dict]:
    out = build_registry(spark, c, days, force, dry_run, rows) + filter_positions(spark, c, days, force, dry_run, rows) + sample_positions(spark, c, days, force, dry_run)
    if c.data.get("export_csv_on_run"):
        out.append(export_csv(spark, c, days, force, dry_run))
    if c.data.get("heatmap_on_run"):
        out.append(render_heatmap(spark, c, days, force, dry_run))
    return out


def plan(c: Config, days: list[date]) -> dict:
    """What a run would read, with sizes; nothing is opened."""

    def row(kind, day):
        p = c.input_path(kind, day)
        size = p.stat().st_size if p.exists() else None
        return {"date": day.isoformat(), "path": str(p), "exists": p.exists()} | ({} if size is None else {"size_bytes": size, "size_gib": round(size / 2**30, 3)})

    sta, pos = ([row(k, d) for d in days] for k in ("sta", "pos"))
    return {"version": VERSION, "config": str(c.path), "output_root": str(c.output_root), "days": len(days), "tanker_ship_types": c.tanker_types, "sampling": c.data["sampling"], "static_inputs": sta, "position_inputs": pos, "missing_inputs": [r for r in sta + pos if not r["exists"]]}


def doctor(c: Config, days: list[date]) -> dict:
    """Whether a run can start: packages, inputs, a writable place. No record is read."""
    import importlib.metadata as meta

    def version(name):
        try:
            return meta.version(name)
        except meta.PackageNotFoundError:
            return None

    packages = {n: version(n) for n in ("pyspark", "pyarrow", "numpy", "pandas")}
    inputs = [{"kind": k, "path": str(p), "exists": p.exists()} for d in days for k in ("sta", "pos") for p in [c.input_path(k, d)]]
    parent = next(p for p in [c.output_root, *c.output_root.parents] if p.exists())
    writable = os.access(parent, os.W_OK)
    return {"ready": all(packages.values()) and all(i["exists"] for i in inputs) and writable, "packages": packages, "optional": {n: version(n) for n in ("matplotlib", "gsw", "xarray")}, "inputs": inputs, "output_parent": str(parent), "writable": writable, "free_gib": round(shutil.disk_usage(parent).free / 2**30, 3)}


def decode_file(spark, source: str, root: str, overwrite: bool = False) -> dict:
    """One message file decoded whole, with a manifest of counts and flags."""
    path = Path(source).resolve()
    kind, day = file_kind(path.name), file_date(path.name)
    target = Path(root).resolve() / "parquet" / kind / f"record_date={day or 'unknown_date'}" / f"{path.stem}.parquet"
    manifest = Path(root).resolve() / "reports" / "manifests" / f"{path.stem}.json"
    if (target.exists() or manifest.exists()) and not overwrite:
        raise FileExistsError(f"{target} is there already")
    started = time.perf_counter()
    publish(parquet(_decoded(spark, path, decode_positions if kind == "position" else decode_static, None)), target)
    made = spark.read.parquet(str(target))
    out = {"input_path": str(path), "input_kind": kind, "record_date_from_filename": day, "counts": decode_summary(made).first().asDict(), "quality_flag_counts": {r["flag"]: r["records"] for r in flag_histogram(made).collect()}, "parquet_path": str(target), "elapsed_seconds": round(time.perf_counter() - started, 3)}
    write_json(manifest, out)
    return out
