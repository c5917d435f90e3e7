"""Array shards: round trip, pruning by id, commit and abort."""

import glob
import json
import os

import numpy as np
import pytest

from peakloom.sources import arrays


def table(spark, n=50, width=3):
    return spark.createDataFrame([(i, [i + 0.25 * j for j in range(width)], "x") for i in range(n)], "key long, v array<double>, other string")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_round_trip_and_pruning(spark, tmp_path, kind):
    path = str(tmp_path / "a")
    arrays.write_arrays(table(spark), path, "key", "v", kind, shard_rows=8)
    back = arrays.read_arrays(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "vector": f"array<{kind}>"}
    assert [(r.id, list(r.vector)) for r in back.orderBy("id").collect()] == [(i, [i, i + 0.25, i + 0.5]) for i in range(50)]
    shards = arrays.read_manifest(path)["shards"]
    assert all(s["rows"] <= 8 for s in shards) and sum(s["rows"] for s in shards) == 50
    assert sorted(r.id for r in arrays.read_arrays(spark, path, 10, 12).collect()) == [10, 11, 12]
    assert {s.name for s in arrays.ArrayReader(path, 10, 12).partitions()} == {s["name"] for s in shards if s["largest"] >= 10 and s["least"] <= 12} != {s["name"] for s in shards}
    assert back.where("id = 700").count() == 0 and arrays.read_arrays(spark, path, 700).count() == 0 and arrays.read_arrays(spark, path, high=3).count() == 4
    both = arrays.read_arrays(spark, path, 45)
    assert both.unionByName(back).count() == 55
    first = np.load(f"{path}/{shards[0]['name']}.npy")
    for s in shards:  # the shards of a range are the only ones that are opened
        if not s["least"] <= 7 <= s["largest"]:
            os.remove(f"{path}/{s['name']}.npy")
    assert arrays.read_arrays(spark, path, 7, 7).count() == 1
    assert first.dtype == arrays.KINDS[kind] and first.shape[1] == 3


def test_append_overwrite_and_faults(spark, tmp_path):
    path = str(tmp_path / "a")
    arrays.write_arrays(table(spark, 5), path, "key", "v")
    arrays.write_arrays(table(spark, 7), path, "key", "v", mode="append")
    assert arrays.read_arrays(spark, path).count() == 12
    arrays.write_arrays(table(spark, 2), path, "key", "v")
    assert arrays.read_arrays(spark, path).count() == 2
    assert len(glob.glob(f"{path}/*.npy")) == 2 * len(json.load(open(f"{path}/manifest.json"))["shards"])
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [None])], [(None, [1.0])]):
        rows = spark.createDataFrame(bad, "key long, v array<double>").coalesce(1)
        with pytest.raises(Exception, match="of one length|must not be null"):
            arrays.write_arrays(rows, str(tmp_path / "b"), "key", "v")
        assert not glob.glob(str(tmp_path / "b" / "manifest.json"))
    with pytest.raises(Exception, match="kind and length"):
        arrays.write_arrays(table(spark, 3, 5), path, "key", "v", mode="append")
    assert arrays.read_arrays(spark, path).count() == 2
    arrays.write_arrays(table(spark).limit(0), str(tmp_path / "c"), "key", "v")
    assert arrays.read_arrays(spark, str(tmp_path / "c")).count() == 0
