from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketlens.operators import rfm
from basketlens.sources import scratch


def test_written_tables_lie_in_the_checkpoint_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(tmp_path))
    monkeypatch.setattr(scratch, "_used", set())
    df = spark.range(10)
    table, seen = scratch.written_with_facts(df, "ten", F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    assert table.count() == 10 and table.schema == spark.read.schema(df.schema).parquet(
        table.inputFiles()[0]
    ).schema
    assert seen == {"n": 10, "top": 9}
    assert all(str(tmp_path) in f for f in table.inputFiles())
    scratch.release(spark)
    assert not list(Path(tmp_path).rglob("*.parquet"))


class Fake:
    """Only what ``scratch_root`` asks a session for."""

    def __init__(self, folder, master):
        self.settings, self.master, self.sparkContext, self.conf = {}, master, self, self
        if folder:
            self.settings[scratch.CHECKPOINT_DIR] = folder

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getConf(self):
        return self


def test_shared_folder_is_read_from_the_session():
    assert scratch.scratch_root(Fake("hdfs:/tmp/x/", "yarn")) == "hdfs:/tmp/x"
    plain = Fake(None, "local[2]")
    plain.settings["spark.sql.warehouse.dir"] = "hdfs:/warehouse"
    assert scratch.scratch_root(plain) == "hdfs:/warehouse/scratch"


def test_a_scope_removes_its_tables(spark):
    facts = spark.createDataFrame([("a", "2020-01-01", 1.0), ("b", "2020-01-02", 2.0)], "c string, d string, x double")
    sizes = []
    for _ in range(10):
        with scratch.scope(spark):
            folder = Path(scratch.written(spark.range(1), "probe").inputFiles()[0].removeprefix("file:")).parents[1]
            rfm.rfm(facts, "c", "d", "x").collect()
        sizes.append(len(list(folder.iterdir())))
    assert len(set(sizes)) == 1


def test_local_warehouses_are_refused_on_a_cluster():
    assert scratch._shared_warehouse("file:/w/", "local[4]") == "file:/w/scratch"
    assert scratch._shared_warehouse("s3a://b/w", "spark://h:7077") == "s3a://b/w/scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch._shared_warehouse("file:/w", "yarn")
