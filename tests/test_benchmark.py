"""The benchmark's counts, shapes and order; its JSON and its text."""

import json
import os

import pytest

from pointmill.plans import benchmark
from pointmill.plans.points import points
from pointmill.sources import onefile


def test_doublings():
    assert [benchmark.doublings(n) for n in (1, 2, 5, 8)] == [[1], [1, 2], [1, 2, 4, 5], [1, 2, 4, 8]]


def test_sweep(spark, tmp_path, capsys):
    path = f"{tmp_path}/a.laz"
    onefile.write(points(spark, "/root/testdata/sf0.001"), path, format="6", compressed="true", chunk_size="250")
    timed = benchmark.timings(spark, path, [1, 2], "both", 0, 2, 250, keep=f"{tmp_path}/b.laz").cache()
    made = json.loads(benchmark.report(spark, path, timed))
    assert [(r["tool"], r["operation"], r["threads"], r["iteration"]) for r in made["results"]] == [
        (t, o, n, k) for t, o, n in (("pointmill", "read", 1), ("pointmill", "read", 2), ("roofline", "read", 0), ("pointmill", "write", 1), ("pointmill", "write", 2)) for k in (0, 1)
    ]
    assert (made["num_points"], made["point_format"], made["is_compressed"], made["file_size_bytes"]) == (1000, 6, True, os.path.getsize(path))
    assert all(r["time_s"] > 0 for r in made["results"])
    rows = benchmark.summary(timed, 1000, 2_000_000).collect()
    for r in rows:
        own = [t["time_s"] for t in made["results"] if (t["tool"], t["operation"], t["threads"]) == (r.tool, r.operation, r.threads)]
        assert (r.n, r.min_s, r.max_s) == (2, min(own), max(own)) and r.mean_s == pytest.approx(sum(own) / 2)
        assert (r.mpts_s, r.mb_s) == pytest.approx((0.001 / r.mean_s, 2 / r.mean_s))
    text = benchmark.table(benchmark.summary(timed, 1000, 2_000_000)).splitlines()
    assert [line.split()[:2] for line in text] == [["read"], ["tool", "tasks"], ["pointmill", "1"], ["pointmill", "2"], ["roofline", "default"], ["write"], ["tool", "tasks"], ["pointmill", "1"], ["pointmill", "2"]]
    assert benchmark.summary(spark.createDataFrame([("a", "read", 1, 0, 0.0)], benchmark.TIMINGS), 5, 5).first().mpts_s == 0.0
    for bad in ({"operation": "none"}, {"iterations": 0}, {"tasks": [0]}):
        with pytest.raises(ValueError, match="read, write or both"):
            benchmark.timings(spark, path, **bad)
    benchmark.main(["--file", path, "--tasks", "1", "--iterations", "1", "--warmup", "0", "--json"])
    assert len(json.loads(capsys.readouterr().out)["results"]) == 2 and sorted(os.listdir(tmp_path)) == ["a.laz", "b.laz"]
