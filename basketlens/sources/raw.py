"""Raw CSV files and image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.contracts import IMAGE_FOLDER


def raw_files(spark: SparkSession, path: str) -> list[list]:
    """[path, length, time of the last change] of a raw file, or of every file of a raw folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, files = [], fs.listFiles(top, True)
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return sorted(found)


def read_csv(spark: SparkSession, path: str | list[str], *, multi_line: bool = True) -> DataFrame:
    """All columns as text, taken by header name.

    A user schema would be applied by position and would silently swap columns of a
    reordered file, so types are given later, by name; in a folder of files every header
    is checked. A row with too few fields has nulls at its end, surplus fields are ignored.
    ``multi_line`` reads line ends inside quotes, but then a file cannot be split among
    tasks: right for tables of customers and articles. Facts are read without it, after
    ``require_closed_quotes``.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def require_closed_quotes(spark: SparkSession, path: str | list[str]) -> None:
    """Raise if a line leaves a quote open: read line by line, its record would be torn apart."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    torn = spark.read.text(path).where(quotes % 2 == 1).select(F.left("value", F.lit(80)).alias("v")).first()
    if torn is not None:
        raise ValueError(f"a quoted line end in {path}: {torn['v']}")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(image_path, image): decoded on the executors; image_path is relative to ``root``."""
    loaded = (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jpg")
        .load(f"{root.rstrip('/')}/{IMAGE_FOLDER}")
    )
    # The origin is a percent-encoded path, in which a plus sign is a plus sign.
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    relative = F.regexp_extract(origin, f"({IMAGE_FOLDER}/[^/]+/[^/]+)$", 1)
    return loaded.select(relative.alias("image_path"), "image")
