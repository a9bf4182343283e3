import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("BENCH_DRIVER_MEMORY", "4g")
os.environ.setdefault(
    "PYSPARK_SUBMIT_ARGS", f"--conf spark.checkpoint.dir={tempfile.mkdtemp(prefix='basketlens-tests-')} pyspark-shell"
)

from basketlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_picture(spark, path: Path, width: int, height: int, rgb: int, kind: str = "jpg") -> None:
    """A one-coloured picture in a real image format."""
    path.parent.mkdir(parents=True, exist_ok=True)
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(width, height, 1)
    for x in range(width):
        for y in range(height):
            picture.setRGB(x, y, rgb)
    jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(path)))


@pytest.fixture()
def raw(spark, tmp_path):
    """The miniature retail dataset: 4 facts, 3 customers, 3 articles, 2 pictures."""
    root = tmp_path / "raw"
    root.mkdir()
    (root / "transactions_train.csv").write_text(
        "t_dat,customer_id,article_id,price,sales_channel_id\n"
        "2020-01-01,customer-a,0010000001,0.1,1\n"
        "2020-01-02,customer-a,0010000002,0.2,1\n"
        "2020-01-03,customer-b,0010000001,0.3,2\n"
        "2020-01-04,customer-c,0010000003,0.5,2\n"
    )
    (root / "articles.csv").write_text(
        "article_id,prod_name,product_group_name\n"
        "0010000001,Item one,Group A\n"
        "0010000002,Item two,Group B\n"
        "0010000003,No image,Group C\n"
    )
    (root / "customers.csv").write_text(
        "customer_id,age,club_member_status,fashion_news_frequency\n"
        "customer-a,25.0,ACTIVE,Regularly\n"
        "customer-b,,ACTIVE,None\n"
        "customer-c,45.0,PRE-CREATE,Monthly\n"
    )
    write_picture(spark, root / "images/001/0010000001.jpg", 8, 10, 0x333333)
    write_picture(spark, root / "images/001/0010000002.jpg", 7, 6, 0xB3B3B3)
    return root
