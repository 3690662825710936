"""Command line: plan, doctor, build-registry, filter-positions, sample, export-csv, heatmap, run by a configuration of
the stages; density by one of density enrichment; decode for a message file; scan for a folder to be published."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import config as cfg
from .operators import density
from .plans import publication, scanner, stages
from .plans.artifacts import StageConflict

COMMANDS = {"build-registry": stages.build_registry, "filter-positions": stages.filter_positions, "sample": stages.sample_positions, "export-csv": stages.export_csv, "heatmap": stages.render_heatmap, "run": stages.run}
KERNELS = {"teos10": density.teos10, "surface": density.surface_density}
READS_RAW = {"build-registry", "filter-positions", "run"}


def _session():
    from .session import local_session

    return local_session()


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="fairlead", description=__doc__)
    parser.add_argument("command", choices=["plan", "doctor", *COMMANDS, "density", "decode", "scan"])
    parser.add_argument("--config", help="file of the stages' or of density's configuration")
    parser.add_argument("--kernel", choices=KERNELS, default="teos10", help="equation of state of density")
    parser.add_argument("--input", help="message file to decode, or folder to scan")
    parser.add_argument("--output", help="folder for what is decoded")
    for name in ("--date", "--from-date", "--to-date"):
        parser.add_argument(name)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--max-source-rows", type=int)
    a = parser.parse_args(argv)
    try:
        needed = {"decode": ["input", "output"], "scan": ["input"]}.get(a.command, ["config"])
        if missing := [f"--{x}" for x in needed if not getattr(a, x)]:
            raise ValueError(f"{a.command} needs {', '.join(missing)}")
        if a.command == "scan":
            found = scanner.scan(a.input)
            print(json.dumps([{"file": f, "finding": what} for f, what in found], indent=2))
            return 1 if found else 0
        if a.command in ("density", "decode"):
            spark = spark or _session()
            out = publication.run_density(spark, cfg.load_density(a.config), a.force, a.dry_run, KERNELS[a.kernel], a.kernel) if a.command == "density" else stages.decode_file(spark, a.input, a.output, a.force)
            print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
            return 0
        c = cfg.load(a.config)
        days = cfg.dates(c, a.date, a.from_date, a.to_date)
        if a.command in ("plan", "doctor"):
            out = getattr(stages, a.command)(c, days)
        else:
            spark = spark or _session()
            more = {"rows": a.max_source_rows} if a.command in READS_RAW else {}
            out = COMMANDS[a.command](spark, c, days, force=a.force, dry_run=a.dry_run, **more)
    except (ValueError, FileNotFoundError, FileExistsError, StageConflict, RuntimeError) as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 2
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
