"""The folder in which driver and executors share slide files."""

import os

import numpy as np
import pytest
from pyspark import SparkConf

from tesserae.operators import disk_cache
from tesserae.plans import queries_slides


@pytest.fixture
def conf(spark, monkeypatch):
    """Sets what the context seems to be configured with."""

    def use(master: str, folder: str | None) -> None:
        found = SparkConf(loadDefaults=False)
        if folder is not None:
            found.set("spark.checkpoint.dir", folder)
        monkeypatch.setattr(spark.sparkContext, "getConf", lambda: found)
        monkeypatch.setattr(spark.sparkContext, "master", master)

    return use


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_a_shared_folder_may_be_named_in_any_way(spark, conf, tmp_path, form):
    conf("spark://there:7077", form.format(f"{tmp_path}/not yet"))
    path = queries_slides.workspace(spark)
    assert os.path.isdir(path) and os.path.dirname(path) == f"{tmp_path}/not yet"


@pytest.mark.parametrize("folder", [None, "nosuch://store/folder", "hdfs://no.such.host.invalid:1/folder"])
def test_the_warehouse_is_shared_too(spark, conf, tmp_path, monkeypatch, folder):
    conf("local-cluster[3,4,10240]", folder)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: f"{tmp_path}/warehouse" if key == "spark.sql.warehouse.dir" else None)
    path = queries_slides.workspace(spark)
    assert os.path.dirname(path) == f"{tmp_path}/warehouse" and "driver" in os.listdir(path)
    monkeypatch.setattr(queries_slides, "is_shared", lambda *a: False)
    with pytest.raises(RuntimeError):
        queries_slides.workspace(spark)


@pytest.mark.parametrize("master", ["local", "local[*]", "local[2,3]"])
def test_local_mode_needs_no_shared_folder(spark, conf, master):
    conf(master, None)
    assert os.path.isdir(queries_slides.workspace(spark))


def test_large_images_are_handed_on_in_bands():
    a = np.arange(900 * 700 * 4, dtype=np.uint32).astype(np.uint8).reshape(900, 700, 4)
    got = list(queries_slides.samples(a, 5, 7))
    assert len(got) > 5 and max(len(c[0]) for c in got) <= queries_slides.SAMPLES
    x, y, c, v = (np.concatenate([k.to_numpy() for k in column]) for column in zip(*got))
    assert len(v) == 900 * 700 * 3 and (v == a[y - 7, x - 5, c]).all() and y.max() == 906


def test_the_cache_keeps_count_of_its_bytes(tmp_path):
    cache, rnd = disk_cache.DiskTileCache(str(tmp_path), 1000), np.random.default_rng(1)
    for i in rnd.integers(0, 40, 300):
        if i % 3:
            cache.put(0, int(i), 0, np.zeros((1 + int(i) % 5, 8, 4), np.uint8))
        else:
            cache.get(0, int(i) + 1, 0)
        on_disk = {e.name: e.stat().st_size for e in os.scandir(tmp_path)}
        assert on_disk == dict(cache.files) and cache.bytes == sum(on_disk.values()) <= 1000
    cache.put(0, 99, 0, np.zeros((20, 20, 4), np.uint8))
    assert list(cache.files) == ["L0_X99_Y0.tile"]  # one beyond the budget stays alone
