from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sieveworks import tables
from sieveworks.functions import redact


def session(master, folder=None):
    """What ``shared_dir`` asks of a session."""
    settings = {"spark.checkpoint.dir": folder}
    conf = SimpleNamespace(get=lambda name, default=None: settings.get(name) or default, set=settings.__setitem__)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda name: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder():
    assert tables.shared_dir(session("yarn", "s3a://x/y/")) == "s3a://x/y"
    one = session("local[4]")
    assert tables.shared_dir(one).startswith("file:///") and tables.shared_dir(one) == tables.shared_dir(one)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session(master))


def test_numbered(spark):
    rows = spark.range(1000).repartitionByRange(7, F.desc("id")).sortWithinPartitions(F.desc("id"))
    out = tables.numbered(rows).collect()
    assert sorted((r["rank"], r["id"]) for r in out) == [(k, 999 - k) for k in range(1000)] and {r["total"] for r in out} == {1000}
    assert tables.numbered(spark.range(0)).count() == 0


def test_emptied(spark):
    table = tables.written(spark.range(100), "t")
    path = table.inputFiles()[0].rpartition("/")[0]
    tables.emptied(table)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]


def test_only_pattern_errors_are_passed_over(spark, monkeypatch):
    assert redact.compiles("a+") and not redact.compiles("(")

    def broken(*_):
        raise RuntimeError("no session")

    monkeypatch.setattr(redact.F, "regexp_replace", broken)
    with pytest.raises(RuntimeError, match="no session"):
        redact.compiles("a+")
