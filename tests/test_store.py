import pytest

from basketlens.contracts import PRODUCT_FEATURES, TableContract
from basketlens.sources.store import TableStore, export

PROBE = TableContract("probe", ("value",), ("old",), {"value": "int"})


def value(spark, v):
    return spark.createDataFrame([(v,)], "value int")


def test_own_copy_wins_over_precomputed(spark, tmp_path):
    own, other = str(tmp_path / "own"), str(tmp_path / "pre")
    TableStore(spark, other).put(PROBE, value(spark, 2))
    store = TableStore(spark, own, other)
    assert store.find(PROBE).first()["value"] == 2
    store.put(PROBE, value(spark, 1))
    assert store.find(PROBE).first()["value"] == 1
    assert store.status["probe"] == "REUSED" and store.paths["probe"].startswith(own)


def test_result_is_keyed_by_its_parameters(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.put(PROBE, value(spark, 1), {"k": 1.5})
    assert store.find(PROBE, {"k": 3.0}) is None
    assert store.find(PROBE, {"k": 1.5}).first()["value"] == 1


def test_obsolete_and_empty_copies_are_rebuilt(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.put(PROBE, value(spark, 1).selectExpr("value", "'x' as old"))
    assert store.load_or_compute(PROBE, lambda: value(spark, 7)).first()["value"] == 7
    assert store.status["probe"] == "COMPUTED"
    assert any("removed columns: ['old']" in m for m in store.messages)
    empty = TableStore(spark, str(tmp_path / "empty"))
    empty.put(PROBE, value(spark, 1).where("value > 1"))
    assert empty.find(PROBE) is None


def test_failed_write_is_never_reused(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    bad = spark.range(5).selectExpr("cast(raise_error('boom') as int) as value")
    with pytest.raises(Exception, match="boom"):
        store.put(PROBE, bad)
    assert store.find(PROBE) is None


def test_rejected_write_is_removed(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))

    def check(df):
        raise ValueError(f"{df.count()} bad rows")

    with pytest.raises(ValueError, match="1 bad rows"):
        store.put(PROBE, value(spark, 1), check=check)
    assert store.find(PROBE) is None and "probe" not in store.status
    assert not list(tmp_path.rglob("*.parquet"))


def test_newest_version_is_read_and_old_readers_survive(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    first = store.put(PROBE, value(spark, 1))
    store.put(PROBE, first.selectExpr("value + 1 as value"))
    assert store.find(PROBE).first()["value"] == 2
    assert first.first()["value"] == 1


def test_precomputed_text_files(spark, tmp_path):
    folder = tmp_path / "pre" / "features"
    folder.mkdir(parents=True)
    (folder / "product_features.csv").write_text(
        "product_id,image_path,product_name_length,image_mean,image_std\n"
        "0010000001,images/001/0010000001.jpg,8,0.2,0.0\n"
    )
    store = TableStore(spark, str(tmp_path / "own"), str(tmp_path / "pre"))
    row = store.find(PRODUCT_FEATURES).first()
    assert row["product_id"] == "0010000001" and row["image_mean"] == 0.2
    assert store.find(PRODUCT_FEATURES, plain=False) is None


def test_unreadable_json_is_rejected(spark, tmp_path):
    (tmp_path / "pre").mkdir()
    (tmp_path / "pre" / "probe.json").write_text("{ not json")
    store = TableStore(spark, str(tmp_path / "own"), str(tmp_path / "pre"))
    assert store.find(PROBE) is None
    assert any("REJECTED" in m for m in store.messages)


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_export(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    export(value(spark, 5), path, kind)
    back = spark.read.option("header", True).format(kind).load(path)
    assert int(back.first()["value"]) == 5


def test_export_kind(spark, tmp_path):
    with pytest.raises(ValueError, match="kind must be"):
        export(value(spark, 5), str(tmp_path), "xml")


def test_precomputed_files_are_found_at_any_depth(spark, tmp_path):
    deep = tmp_path / "pre" / "/".join("abcdefgh")
    deep.mkdir(parents=True)
    (deep / "probe.csv").write_text("value\n7\n")
    export(value(spark, 8), str(tmp_path / "folders" / "x" / "probe.csv"))
    for top, want in (("pre", 7), ("folders", 8)):
        store = TableStore(spark, str(tmp_path / "own"), str(tmp_path / top))
        assert store.find(PROBE).first()["value"] == want
    assert TableStore(spark, str(tmp_path / "own"), str(tmp_path / "none")).find(PROBE) is None
