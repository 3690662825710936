from fairlead.streaming.incremental import append, decoded_stream

from .test_engine import DAY, MASKS, POS


def test_new_files_are_added_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, lines in enumerate((POS[:5], POS[5:])):
        (tmp_path / "in" / f"POS_OK_{DAY}-{n}.dat").write_text("\n".join(lines) + "\n")
        for _ in range(2):
            append(decoded_stream(spark, str(tmp_path / "in"), "position"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["dq_mask"] for r in rows) == sorted(MASKS) and {r["record_date"] for r in rows} == {DAY}
