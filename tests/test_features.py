import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.functions.columns import array_mean, array_std, name_length
from basketlens.operators import features
from basketlens.sources.raw import read_images
from tests.conftest import write_picture


def test_name_length_counts_code_points(spark):
    df = spark.createDataFrame([("Item one",), ("é😀",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(name_length("n")).collect()] == [8, 2, 0, None]


def test_pixels_of_image_files(spark, tmp_path):
    write_picture(spark, tmp_path / "images/001/0010000001.jpg", 8, 10, 0x333333)
    write_picture(spark, tmp_path / "images/001/0010000002.jpg", 7, 6, 0xFF8000, kind="png")
    (tmp_path / "images/001/0010000003.jpg").write_bytes(b"no picture at all")
    stats = features.image_stats(read_images(spark, str(tmp_path)), "image_path")
    got = {r["image_path"][-14:-4]: (r["image_mean"], r["image_std"]) for r in stats.collect()}
    assert got["0010000001"] == pytest.approx((51.0, 0.0), abs=1)
    values = np.tile([255, 128, 0], 42)
    assert got["0010000002"] == pytest.approx((values.mean(), values.std()))
    assert got["0010000003"] == (None, None)


def test_image_paths_keep_their_characters(spark, tmp_path):
    for name in ("0 1.jpg", "0+1.jpg", "0%411.jpg"):
        write_picture(spark, tmp_path / "images/001" / name, 2, 2, 0x333333)
    got = {r["image_path"] for r in read_images(spark, str(tmp_path)).select("image_path").collect()}
    assert got == {"images/001/0 1.jpg", "images/001/0+1.jpg", "images/001/0%411.jpg"}


def test_channel_rule(spark):
    """Gray has one channel; a fourth channel is dropped."""
    rows = [
        ("gray", 2, 2, 1, bytes([0, 10, 20, 30])),
        ("alpha", 1, 2, 4, bytes([1, 2, 3, 255, 4, 5, 6, 255])),
        ("broken", -1, -1, -1, b""),
        ("short", 2, 2, 3, b"123"),
    ]
    df = spark.createDataFrame(rows, "k string, height int, width int, nChannels int, data binary")
    images = df.select("k", F.struct("height", "width", "nChannels", "data").alias("image"))
    got = {r["k"]: (r["image_mean"], r["image_std"]) for r in features.image_stats(images, "k").collect()}
    assert got["gray"] == pytest.approx((15.0, np.std([0, 10, 20, 30])))
    assert got["alpha"] == pytest.approx((3.5, np.std([1, 2, 3, 4, 5, 6])))
    assert got["broken"] == (None, None) and got["short"] == (None, None)


def test_articles_without_picture_are_kept(spark):
    articles = spark.createDataFrame(
        [("1", "One", "p1"), ("2", None, "p2")], "product_id string, product_name string, image_path string"
    )
    stats = spark.createDataFrame([("p1", 1.0, 0.5)], "image_path string, image_mean double, image_std double")
    rows = features.product_features(articles, stats).orderBy("product_id").collect()
    assert tuple(rows[0]) == ("1", "p1", 3, 1.0, 0.5)
    assert tuple(rows[1]) == ("2", "p2", None, None, None)


def test_array_statistics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([],)], "a array<double>")
    out = df.select(array_mean("a").alias("m"), "a").select("m", array_std("a", F.col("m")).alias("s"))
    rows = out.collect()
    assert tuple(rows[0]) == pytest.approx((3.0, np.std([1, 2, 6])))
    assert tuple(rows[1]) == (None, None)
