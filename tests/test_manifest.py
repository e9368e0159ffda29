"""File digests from ranges hashed in turn."""

import hashlib
import random

from tidemark.sources import manifest as Ma


def test_digests_of_ranges_equal_those_of_whole_files(spark, tmp_path):
    draw = random.Random(7)
    noise = draw.randbytes(50_000)
    files = {
        "noise.parquet": noise,
        "ends with a break.parquet": noise[:20_000] + b"\n",
        "mark.parquet": b"\xef\xbb\xbf" + noise[:15_000],
        "mark_and_break.parquet": b"\xef\xbb\xbf" + noise[:9_000] + b"\r\n\n",
        "one_line.parquet": b"\0" * 30_000,
        "breaks.parquet": b"\n" * 12_000,
        "x%20+.parquet": b"\n" + noise[:7_000],
        "small.parquet": b"abc\n",
    }
    (tmp_path / "deep").mkdir()
    for k, (name, data) in enumerate(files.items()):
        (tmp_path / ("deep" if k % 2 else ".") / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        got = Ma.file_manifest(spark, str(tmp_path), whole_bytes=5_000, round_bytes=8_192).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in got}
    assert len(got) == len(files)
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
