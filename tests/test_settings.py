import pytest

from cytoplan.functions import settings
from cytoplan.sources import artifacts


def test_memory_sizes():
    assert settings.memory_size("2048") == 2048 and settings.memory_size("256MiB") == 256 * 2**20
    assert settings.memory_size("1.5 GiB") == 3 * 2**29 and settings.memory_size("4GB") == 4 * 10**9
    for bad in ("", "0", "-1GiB", "1XB", "NaN"):
        with pytest.raises(ValueError):
            settings.memory_size(bad)


def test_versions():
    assert settings.compatible("0.18.0", "0.18.3") and not settings.compatible("0.18.0", "0.17.0")
    with pytest.raises(ValueError):
        settings.compatible("x", "1.0")


def test_options():
    assert settings.PermitOptions(knee=True).spec(16).neighbourhood == "substitution-or-shift-1"
    assert settings.PermitOptions(unfiltered_list="w").spec(16).neighbourhood == "hamming-1"
    assert settings.PermitOptions(force_cells=3).spec(16, multi=True).neighbourhood == "hamming-1"
    for bad in ({}, {"knee": True, "force_cells": 1}, {"knee": True, "orientation": "up"}, {"knee": True, "min_reads": 0}):
        with pytest.raises(ValueError):
            settings.PermitOptions(**bad)


def test_artifacts(spark, tmp_path):
    plan = spark.createDataFrame([(3, 1), (1, 1), (2, None)], "observed long, corrected long")
    artifacts.write(plan.filter("corrected is not null"), "plan", str(tmp_path), orientation="fw")
    assert sorted(map(tuple, artifacts.read(spark, "plan", str(tmp_path)).collect())) == [(1, 1), (3, 1)]
    assert artifacts.metadata(spark, "plan", str(tmp_path))["orientation"] == "fw"
    artifacts.write(plan, "plan", str(tmp_path))
    with pytest.raises(ValueError, match="nulls"):
        artifacts.read(spark, "plan", str(tmp_path))
    artifacts.write(plan.filter("observed = 1").unionByName(plan.filter("observed = 1")), "plan", str(tmp_path), version=9)
    with pytest.raises(ValueError, match="later"):
        artifacts.read(spark, "plan", str(tmp_path))
