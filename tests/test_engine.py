"""Fixtures with known results: decoding, registry, sampling, grids, nearest cells, densities, stages, publication."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from fairlead import cli
from fairlead.functions.scalar import date_window, file_date, number, repaired_text, target_instants, woa_month
from fairlead.operators import density, quality, spatial, vessels
from fairlead.operators.decode import decode_positions, decode_static
from fairlead.plans import config as cfg
from fairlead.plans import publication, stages
from fairlead.plans import sources_gate as gate
from fairlead.plans.artifacts import StageConflict, same
from fairlead.sources.dat import file_kind, read_dat, split_fields

DAY = "2025-11-09"
T = 1_762_646_400  # its beginning
TANKER, CARRIER = 211_000_001, 538_000_222


def position(at: int, mmsi: int = TANKER, received: int | None = None, place=(2_700_000, 31_200_000), heading: int = 45) -> str:
    """A line of a class A position report."""
    return "~".join(map(str, (1, mmsi, at + 5 if received is None else received, 2, 3, at, *place, 900, 135, heading, 0, -4, 1)))


POS = [
    position(T), position(T + 30, heading=360), position(T + 60, place=(0, 0)), position(T + 90, received=T - 310), position(T + 20, CARRIER), position(T + 40, 1_000_000_000), position(T + 5 * 86_400),
    f"3~{TANKER}~{T + 10}~7~2700000~31200000~900~135",
]
MASKS = [0, 2048, 0, 65_536, 0, 16, 131_072, 64 + 131_072]
STA = [
    f"1~{TANKER}~{T + 1}~2~5~9074729~PABC@~NORTH STAR@@~80~120~40~9~11~1~11100930~85~ROTTERDAM@~0", f"1~{TANKER}~{T + 200}~2~24B~81~MAKER@@~PABD~120~40~9~11", f"1~{TANKER}~{T + 300}~2~24A~NORTH STAR II",
    f"1~{CARRIER}~{T + 7}~2~19~BULKY~70~60~20~8~8~1~1", f"1~{CARRIER}~{T + 8}~2~7~x", f"1~0~{T + 9}~2~5~1~A~B~256~1~1~1~1~1~01010000~10~C~0",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("ais")
    (d / "POS_OK_2025-11-09.dat").write_text("\r\n".join(POS[:4]) + "\n\n" + "\n".join(POS[4:]) + "\n")
    (d / "STA_OK_2025-11-09.dat").write_text("\n".join(STA) + "\n")
    (d / "config.json").write_text(json.dumps({
        "output_root": "out", "date_range": {"from": DAY, "to": DAY}, "input_patterns": {"sta": "STA_OK_{date}.dat", "pos": "POS_OK_{year}-{month}-{day}.dat"},
        "tanker_classification": {"policy": "any_observed", "ship_types": [80, 81, 82, 83, 84, 89]}, "sampling": {"timezone": "UTC", "hours": [0, 3], "tolerance_seconds": 1800}, "quality": {"exclude_zero_zero": True},
        "export_csv_on_run": True, "heatmap_on_run": True, "heatmap": {"extent": [0.0, 10.0, 45.0, 55.0], "bin_size_degrees": 0.25},
    }))
    return d


def test_positions(spark, folder):
    df = decode_positions(read_dat(spark, f"file://{folder}/POS_OK_{DAY}.dat"), DAY).orderBy("line_number")
    rows = df.collect()
    assert [r["line_number"] for r in rows] == list(range(1, 9))
    assert [r["dq_mask"] for r in rows] == MASKS and [r["is_hard_valid"] for r in rows] == [m & 255 == 0 for m in MASKS]
    assert (rows[0]["longitude_deg"], rows[0]["latitude_deg"], rows[0]["cog_deg"], rows[0]["sog_kn"], rows[5]["mmsi"], rows[7]["mmsi"]) == (4.5, 52.0, 90.0, 13.5, None, None)
    assert {r["flag"]: r["records"] for r in quality.flag_histogram(df).collect()}["file_date_mismatch"] == 2
    assert tuple(quality.decode_summary(df).first()) == (8, 6, 2)


def test_static_and_registry(spark, folder):
    df = decode_static(read_dat(spark, f"file://{folder}/STA_OK_{DAY}.dat"), DAY)
    assert [r["dq_mask"] for r in df.orderBy("line_number").collect()] == [0, 0, 0, 0, 8, 16 + 32_768]
    shard = vessels.static_shard(df)
    assert shard.count() == 3
    got = {r["mmsi"]: r for r in vessels.vessel_registry(shard, [80]).collect()}
    a, b = got[TANKER], got[CARRIER]
    assert (a["is_tanker"], a["first_static_time_s"], a["last_static_time_s"], a["static_record_count"], a["observed_ship_types"], a["ship_type_conflict"], a["latest_ship_type"]) == (True, T + 1, T + 200, 2, [80, 81], True, 81)
    assert (a["latest_ship_name"], a["latest_callsign"], a["latest_draught_m"], a["latest_destination"]) == ("NORTH STAR", "PABD", 8.5, "ROTTERDAM")
    assert (b["is_tanker"], b["observed_ship_types"], b["latest_ship_name"], b["latest_callsign"]) == (False, [70], "BULKY", None)


def test_odd_lines(spark):
    lines = ["2~12~1~40000~5~1e2", "3~5~1~7~600000~1200000~70000~9", "1~3000000000~x~1~1~1", "~~~", "1" + "~9" * 60, "1~7~~~5~@@@~AB@ @@~@~300"]
    raw = split_fields(spark.createDataFrame([(x, "f", i) for i, x in enumerate(lines)], "value string, source_file string, line_number long")).withColumn("record_date", F.lit(None).cast("string"))
    p = {r["line_number"]: r for r in decode_positions(raw).collect()}
    assert p[0]["pos_time_s"] is None and p[0]["lat_raw"] is None and p[1]["cog_raw"] is None and p[1]["sog_raw"] == 9 and p[1]["mmsi"] is None
    assert p[2]["mmsi"] is None and p[2]["dq_mask"] & 16 == 0 and p[3]["dq_mask"] & 20 == 20
    s = {r["line_number"]: r for r in decode_static(raw).collect()}
    assert (s[5]["imo"], s[5]["callsign"], s[5]["ship_name"], s[5]["dq_mask"]) == ("", "AB@ ", "", 32768)
    lenient = raw.selectExpr(*(number(repr(x), "smallint", True) for x in ("1.5", "-2.5", "1e2", "99999", "x", "1_000", "0x1F", " 7 ", "1__0", "_1", "0xFFFF"))).first()
    assert list(lenient) == [2, -3, 100, None, None, 1000, 31, 7, None, None, None]


def test_dates_and_kinds():
    assert file_date("/x/POS_OK_2026-03-02.dat") == "2026-03-02" and file_date("POS_OK.dat") is None and file_kind("pos_ok_1.dat") == "position"
    with pytest.raises(ValueError):
        file_kind("X.dat")
    from datetime import date

    assert target_instants("Asia/Shanghai", [0], [date(2025, 7, 15)])[0][2] == 1_752_508_800
    assert date_window(DAY) == (T - 172_800, T + 259_200)
    assert woa_month("months since 1991-01-01 00:00", 167.5 + 3) == 3


def nearest_by_hand(cells, lon, lat, radius):
    """The valid cell nearest on a sphere, the southern and then the western one of equals."""
    best = None
    for y, x, value in cells:
        h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
        km = 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))
        if not math.isnan(value) and 0 <= value <= 50 and km <= radius and (best is None or (round(km, 7), y, x) < best[0]):
            best = (round(km, 7), y, x), value
    return best and best[1]


@pytest.mark.parametrize("lon,lat", [(0.0, 0.0), (179.6, -12.0), (-179.9, 33.0), (12.3, 89.4), (-77.0, -89.7), (5.5, 71.2), (100.0, 90.0)])
def test_nearest_cell_matches_brute_force(spark, lon, lat):
    rng = random.Random(int(lon * 10 + lat))
    wide = lambda: (lon + rng.uniform(-1.5, 1.5) / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180
    cells = [(max(-90.0, min(90.0, lat + rng.uniform(-1.2, 1.2))), wide(), rng.choice([math.nan, -3.0, 60.0, *(rng.uniform(0, 50) for _ in range(5))])) for _ in range(60)]
    places = [(f"e{i}", wide(), max(-90.0, min(90.0, lat + rng.uniform(-1, 1)))) for i in range(25)]
    grid, events = spark.createDataFrame(cells, "lat double, lon double, value double"), spark.createDataFrame([*places, ("n", None, 0.0)], "event_id string, longitude_deg double, latitude_deg double")
    for radius in (15.0, 75.0):
        got = {r["event_id"]: r["value"] for r in spatial.nearest_valid_cell(events, grid, radius, 0.0, 50.0).collect()}
        assert got == {e: nearest_by_hand(cells, x, y, radius) for e, x, y in places} | {"n": None}


@pytest.mark.parametrize(
    "cells,place,radius,want",
    [
        ([(0.0, -0.3, 5.0), (0.0, 0.3, 6.0)], (0.0, 0.0), 75.0, 5.0),  # as far: the western one
        ([(0.3, 10.0, 5.0), (-0.3, 10.0, 6.0)], (10.0, 0.0), 75.0, 6.0),  # as far: the southern one
        ([(10.0, 20.0, 7.0)], (20.0, 10.0), 0.0, 7.0), ([(10.0, 20.0, 7.0)], (20.01, 10.0), 0.0, None),  # no radius
        ([(0.0, math.degrees(40 / 6371.0088), 8.0)], (0.0, 0.0), 40.000001, 8.0), ([(0.0, math.degrees(40 / 6371.0088), 8.0)], (0.0, 0.0), 39.999999, None),  # on the edge
        ([(4.0, 359.8, 9.0), (4.0, 0.4, 3.0)], (-0.1, 4.0), 75.0, 9.0),  # longitudes of both conventions
    ],
)
def test_nearest_cell_at_the_edges(spark, cells, place, radius, want):
    grid, events = spark.createDataFrame(cells, "lat double, lon double, value double"), spark.createDataFrame([("e", *place)], "event_id string, longitude_deg double, latitude_deg double")
    assert spatial.nearest_valid_cell(events, grid, radius, 0.0, 50.0).first()["value"] == want


def test_nearest_cell_refuses(spark):
    grid, events = spark.createDataFrame([(3.0, 4.0, 1.0)], "lat double, lon double, value double"), spark.createDataFrame([("e", 4.0, 3.0)], "event_id string, longitude_deg double, latitude_deg double")
    for radius in (-0.5, math.nan, -math.inf, math.inf):
        assert spatial.nearest_valid_cell(events, grid, radius, 0.0, 50.0).first()["value"] is None
    for low, high in ((40.0, 10.0), (7.0, 7.0), (3.0, math.nan), (-math.inf, 4.0)):
        with pytest.raises(ValueError):
            spatial.nearest_valid_cell(events, grid, 75.0, low, high)


def test_density_decision(spark):
    rows = [("a", 0.0, 0.0, 35.0, 15.0), ("b", None, 0.0, 35.0, 15.0), ("c", 181.0, 0.0, 35.0, 15.0), ("d", 0.0, math.inf, 35.0, 15.0), ("e", 0.0, 0.0, None, 15.0), ("f", 0.0, 0.0, 500.0, 15.0)]
    df = spark.createDataFrame(rows, "event_id string, longitude_deg double, latitude_deg double, salinity double, sst double")
    out = density.decide(df, lambda s, t, x, y: density.surface_density(s, t, x, y), "surface")
    got = {r["event_id"]: (r["seawater_density_kg_m3"], r["density_method"]) for r in out.collect()}
    assert got["a"] == (pytest.approx(1025.9729, abs=1e-3), "surface") and all(got[k] == (1025.0, "fixed_1025") for k in "bcdef")
    gsw = pytest.importorskip("gsw")
    assert gsw and density.decide(df.limit(1)).first()[1] == pytest.approx(1025.976584971187, abs=1e-8)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, event_status string, event_start_s long, event_end_s long, event_longitude_deg double, event_latitude_deg double")


E0 = 1_751_328_000


@pytest.mark.parametrize("bad", [[("a", "accepted", E0, E0, 0.0, 0.0)], [("a", "accepted", E0, E0 + 1, 0.0, 0.0)] * 2, [("", "accepted", E0, E0 + 1, 0.0, 0.0)], [("a", "accepted", None, E0, 0.0, 0.0)]])
def test_bad_events_block_the_batch(spark, bad):
    with pytest.raises(ValueError):
        density.accepted_events(events(spark, bad))
    assert density.accepted_events(events(spark, [(*bad[0][:1], "rejected", *bad[0][2:])] * 2)).count() == 0


def density_config(spark, d):
    events(spark, [("valid", "accepted", E0, E0 + 3600, 0.0, 0.0), ("fallback", "accepted", E0, E0 + 3600, None, 0.0), ("rejected", "rejected", E0, E0 + 3600, 0.0, 0.0)]).write.parquet(f"file://{d}/events")
    cells = lambda month, lons, v: spark.createDataFrame([(month, a, o, v) for a in (-90.0, 0.0, 90.0) for o in lons], "month string, lat double, lon double, value double")
    cells("2025-07", (0.0, 180.0, 359.75), 15.0).write.parquet(f"file://{d}/sst")
    for m in range(1, 13):
        cells(f"{m:02d}", (-179.875, 0.0, 179.5), 35.0).write.parquet(f"file://{d}/salt-{m:02d}")
    lines = ["events_path: events", "output_root: out", "era5_files: [sst]", "woa23_monthly_files:", *(f'  "{m:02d}": salt-{m:02d}' for m in range(1, 13)), *(f"{k}: {json.dumps(v)}" for k, v in cfg.DENSITY_FIXED.items())]
    (d / "density.yaml").write_text("\n".join(lines))
    return cfg.load_density(d / "density.yaml")


def test_density_run_and_recovery(spark, tmp_path):
    c = density_config(spark, tmp_path)
    go = lambda **k: publication.run_density(spark, c, kernel=density.surface_density, method="surface", **k)
    assert go(dry_run=True)["status"] == "planned"
    first = go()
    assert first["status"] == "complete" and first["counts"]["n_rows"] == 2 and first["counts"]["fixed_1025"] == 1
    rows = [tuple(r) for r in spark.read.parquet(first["target"]).orderBy("event_id").collect()]
    assert rows[0] == ("fallback", 1025.0, "fixed_1025") and rows[1][2] == "surface"
    assert go()["status"] == "skipped"
    p = publication.Publication(tmp_path / "out" / "event_seawater_density.parquet")
    p.target.rename(p.backup)
    assert go()["status"] == "skipped" and p.target.exists() and not p.backup.exists()
    part = next(p.target.glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(StageConflict):
        go()
    assert go(force=True)["status"] == "complete"
    p.staging.mkdir()
    assert go()["status"] == "skipped" and not p.staging.exists()
    with pytest.raises(RuntimeError):
        p.publish(lambda path: (_ for _ in ()).throw(RuntimeError("no")), lambda path: {})
    assert go()["status"] == "skipped"
    (p.target.parent / f"{p.target.name}.strange").touch()
    with pytest.raises(StageConflict):
        go()
    with pytest.raises(ValueError):
        publication.reject_overlap(tmp_path / "events" / "x", [], tmp_path / "events")


def test_density_config_is_strict(tmp_path):
    for text in ("a: 1", "events_path: x\nevents_path: y", "[1]", "a: [", ""):
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(ValueError):
            cfg.load_density(tmp_path / "c.yaml")


def test_density_command(spark, tmp_path, capsys):
    density_config(spark, tmp_path)
    go = lambda *more: cli.main(["density", "--config", str(tmp_path / "density.yaml"), *more], spark)
    assert go("--kernel", "surface") == 0 and json.loads(capsys.readouterr().out)["counts"]["n_rows"] == 2
    assert go("--kernel", "surface") == 0 and json.loads(capsys.readouterr().out)["status"] == "skipped"
    assert cli.main(["density"], spark) == 2 and cli.main(["decode", "--input", "x"], spark) == 2


def temperature_file(**change):
    axis = lambda *v: {"dims": ["x"], "attributes": {}, "values": list(v)}
    return {"sst": {"dims": ["valid_time", "latitude", "longitude"], "attributes": {"units": "K"}, "values": None}, "latitude": axis(90.0, 0.0, -90.0), "longitude": axis(0.0, 120.0, 240.0, 359.5), "valid_time": {"dims": ["valid_time"], "attributes": {}, "values": [0], "months": gate.STUDY}} | change


def salinity_file(month, **change):
    axis = lambda *v, **a: {"dims": ["x"], "attributes": a, "values": list(v)}
    own = {"s_an": {"dims": ["time", "depth", "lat", "lon"], "attributes": {"units": "1", "standard_name": "sea_water_practical_salinity"}, "values": None}}
    own |= {"lat": axis(-89.5, 0.0, 89.5), "lon": axis(-180.0, 0.0, 179.5), "time": axis(372.5 + month - 1, units="months since 1955-01-01 00:00:00"), "depth": axis(1.25, bounds="depth_bnds"), "depth_bnds": {"dims": ["depth", "b"], "attributes": {}, "values": [[0.0, 2.5]]}}
    return own | change


def test_netcdf_gate():
    where = gate.check_temperature_files({"f": temperature_file()})
    assert where["2026-06"] == ("f", 11) and len(where) == 12
    halves = {k: temperature_file(valid_time={"dims": [], "attributes": {}, "values": [], "months": gate.STUDY[own]}) for k, own in (("a", slice(0, 5)), ("b", slice(5, 12)))}
    assert gate.check_temperature_files(halves)["2025-12"] == ("b", 0)
    gate.check_salinity_files({f"{m:02d}": salinity_file(m) for m in range(1, 13)})
    axis = lambda *v, **a: {"dims": ["x"], "attributes": a, "values": list(v)}
    bad = [
        {"latitude": axis(90.0, -90.0, 0.0)}, {"latitude": axis(91.0, 0.0, -90.0)}, {"latitude": axis(80.0, -90.0)}, {"longitude": axis(-180.0, 179.5)}, {"longitude": axis(0.0, 350.0)}, {"longitude": axis(0.0, math.nan, 359.5)}, {"latitude": {"dims": ["y", "x"], "attributes": {}, "values": None}},
        {"sst": {"dims": ["latitude", "longitude", "valid_time"], "attributes": {"units": "K"}, "values": None}}, {"sst": {"dims": ["valid_time", "latitude", "longitude"], "attributes": {"units": "C"}, "values": None}},
        {"valid_time": {"dims": [], "attributes": {}, "values": [], "months": gate.STUDY[1:]}}, {"valid_time": {"dims": [], "attributes": {}, "values": [], "months": [*gate.STUDY, "2025-07"]}}, {"valid_time": {"dims": [], "attributes": {}, "values": [], "months": [*gate.STUDY, "2026-07"]}},
    ]
    for change in bad:
        with pytest.raises(gate.GridError):
            gate.check_temperature_files({"f": temperature_file(**change)})
    with pytest.raises(gate.GridError, match="no variable latitude"):
        gate.check_temperature_files({"f": {k: v for k, v in temperature_file().items() if k != "latitude"}})
    bad = [
        {"time": axis(372.5 + 5, units="months since 1955-01-01")}, {"time": axis(1.0, 2.0, units="months since 1955-01-01")}, {"time": axis(math.inf, units="months since 1955-01-01")}, {"time": axis(374.5, units="days since 1955-01-01")}, {"time": axis(374.5, units="months since 1955-13-01")},
        {"depth": axis(2.5, bounds="depth_bnds")}, {"depth": axis(1.25)}, {"depth_bnds": {"dims": ["depth", "b"], "attributes": {}, "values": [[0.0, 5.0]]}}, {"lon": axis(-180.0, 359.0)}, {"lon": axis(-170.0, 100.0)}, {"s_an": {"dims": ["time", "depth", "lat", "lon"], "attributes": {"units": "1"}, "values": None}},
    ]
    for change in bad:
        with pytest.raises(gate.GridError):
            gate.check_salinity_files({"03": salinity_file(3, **change)})


def test_texts_are_repaired(spark):
    texts = [b" TANKER @@", "\u6d77\u6d0b@@".encode("gb18030"), b"\xff\xfe\xff", b"@@@", b"  ", None, "\u6d77@".encode(), b"AB@ @@"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, b binary").select("i", repaired_text(F.col("b")).alias("x"))
    got = [tuple(r["x"]) for r in df.orderBy("i").collect()]
    assert got == [("TANKER", 0), ("\u6d77\u6d0b", 1 << 18), ("\ufffd\ufffd\ufffd", 1 << 19), (None, 0), (None, 0), (None, 0), ("\u6d77", 0), ("AB@", 0)]


def test_run_skips_and_conflicts(spark, folder, capsys):
    c = cfg.load(folder / "config.json")
    days = cfg.dates(c)
    assert stages.plan(c, days)["missing_inputs"] == [] and stages.doctor(c, days)["ready"]
    out = {r["stage"]: r for r in stages.run(spark, c, days)}
    assert out["registry"]["counts"] == {"vessels": 2, "tankers": 1, "ship_type_conflicts": 1} and out["positions"]["counts"]["records"] == 4
    assert out["csv"]["counts"] == {"records": 1} and out["heatmap"]["counts"] == {"input_sample_records": 1, "occupied_grid_cells": 1, "grid_columns": 40, "grid_rows": 40}
    row = spark.read.parquet(str(stages.samples_path(c, days[0]))).first()
    assert (row["mmsi"], row["line_number"], row["candidate_count"], row["signed_offset_seconds"], row["target_time_local"]) == (TANKER, 1, 3, 0, f"{DAY}T00:00:00+00:00")
    assert {r["status"] for r in stages.run(spark, c, days)} == {"skipped"}
    csv = next((c.output_root / "csv").glob("*.csv")).read_text().splitlines()
    assert len(csv) == 2 and csv[0].startswith("sample_date,target_hour") and "[80, 81]" in csv[1]
    next(stages.positions_path(c, days[0]).glob("part-*")).unlink()
    with pytest.raises(StageConflict):
        stages.filter_positions(spark, c, days)
    assert stages.filter_positions(spark, c, days, force=True)[0]["status"] == "complete"
    assert cli.main(["plan", "--config", str(folder / "config.json")]) == 0 and json.loads(capsys.readouterr().out)["days"] == 1
    assert cli.main(["sample", "--config", str(folder / "config.json"), "--date", DAY, "--from-date", DAY], spark) == 2
    assert cli.main(["sample", "--config", str(folder / "config.json"), "--date", "2025-11-12"], spark) == 2
    made = stages.decode_file(spark, str(folder / f"POS_OK_{DAY}.dat"), str(folder / "whole"))
    assert made["counts"]["records"] == 8 and made["quality_flag_counts"]["invalid_device_id"] == 1
    with pytest.raises(FileExistsError):
        stages.decode_file(spark, str(folder / f"POS_OK_{DAY}.dat"), str(folder / "whole"))


@pytest.mark.parametrize("change", [{"sampling": {"timezone": "UTC", "hours": [1, 1], "tolerance_seconds": 1}}, {"sampling": {"timezone": "UTC", "hours": [1], "tolerance_seconds": 10800}}, {"tanker_classification": {"ship_types": []}}, {"heatmap": {"extent": [1, 0, 0, 1]}}, {"date_range": {"from": DAY, "to": "2025-11-08"}}])
def test_config_is_checked(folder, change):
    data = json.loads((folder / "config.json").read_text()) | change
    with pytest.raises(ValueError):
        cfg.check(data)


def test_json_types_differ():
    assert same({"a": [1, "x"]}, {"a": [1, "x"]}) and not same(True, 1) and not same(1, 1.0) and not same([1], [1, 2])
