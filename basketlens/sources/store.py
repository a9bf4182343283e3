"""Stored results: reuse a valid copy, or compute, write once, and read back.

A version is a folder of Parquet files and a marker that says what it is: the parts it is made of (its own
and those of the version it continues), the source files it was read from, and its buckets.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.contracts import TRANSACTIONS, TableContract
from basketlens.operators.load import normalize_nulls
from basketlens.operators.quality import contract_violation
from basketlens.sources.buckets import read_bucketed, write_bucketed
from basketlens.sources.raw import read_csv, require_closed_quotes

# Marks a version that was written completely and passed its checks.
ACCEPTED = "_ACCEPTED"


def _typed(c: Column, wanted: str) -> Column:
    """A text of a CSV file as its contract's type; whole numbers may be written as 8.0."""
    return c.cast("double").cast(wanted) if wanted == "int" else c.cast(wanted)


def _digest(params: Mapping[str, object]) -> str:
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


class TableStore:
    """Parquet tables under ``root``, keyed by name and by every parameter they depend on.

    Each computation writes a new version and never touches a version somebody may be
    reading. A version counts once it is written and checked, so a failed one is never
    reused. ``precomputed`` is a second, read-only place: the own copy wins over it.
    """

    def __init__(self, spark: SparkSession, root: str, precomputed: str | None = None) -> None:
        self.spark = spark
        self.root = str(root).rstrip("/")
        self.precomputed = None if precomputed is None else str(precomputed).rstrip("/")
        self.status: dict[str, str] = {}
        self.paths: dict[str, str] = {}
        self.messages: list[str] = []

    # Files ----------------------------------------------------------------------------

    def _dimension(self, contract: TableContract, path: str) -> bool:
        """Is the file read as a whole? Facts are not: there a quoted line end is an error."""
        if contract.name != TRANSACTIONS.name:
            return True
        require_closed_quotes(self.spark, path)
        return False

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return jvm_path.getFileSystem(conf), jvm_path

    def exists(self, path: str) -> bool:
        fs, jvm_path = self._fs(path)
        return fs.exists(jvm_path)

    def _versions(self, folder: str) -> list[str]:
        """Accepted versions, newest first."""
        fs, jvm_path = self._fs(folder)
        if not fs.exists(jvm_path):
            return []
        names = sorted((s.getPath().getName() for s in fs.listStatus(jvm_path)), reverse=True)
        return [f"{folder}/{n}" for n in names if self.exists(f"{folder}/{n}/{ACCEPTED}")]

    def _candidates(self, contract: TableContract, key: str, plain: bool) -> list[str]:
        found = self._versions(f"{self.root}/{contract.name}/{key}")
        if self.precomputed is not None:
            found += self._versions(f"{self.precomputed}/{contract.name}/{key}")
            if plain:
                found += self._plain_files(contract.name)
        return found

    def _plain_files(self, name: str) -> list[str]:
        """``name``.csv and ``name``.json in the precomputed folder or below it, sorted by path."""
        fs, root = self._fs(self.precomputed)
        if not fs.exists(root):
            return []
        found, wanted = set(), {f"{name}.csv", f"{name}.json"}
        top = fs.makeQualified(root).toString().rstrip("/")
        files = fs.listFiles(root, True)
        while files.hasNext():
            below = files.next().getPath().toString()[len(top) + 1 :].split("/")
            at = next((i for i, part in enumerate(below) if part in wanted), None)  # a file, or a folder of part files
            if at is not None:
                found.add("/".join([top, *below[: at + 1]]))
        return sorted(found)

    def prune(self, keep: int = 1) -> None:
        """Remove all but the ``keep`` newest accepted versions of every table, and what these continue; nobody may be reading them."""
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return
        for table in fs.listStatus(root):
            for key in fs.listStatus(table.getPath()):
                versions = self._versions(key.getPath().toString())
                needed = {part.rsplit("/", 1)[-1] for v in versions[:keep] for part in self.facts(v).get("parts", [])}
                for old in versions[keep:]:
                    if old.rsplit("/", 1)[-1] not in needed:
                        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)

    def facts(self, path: str) -> dict:
        """What the marker of a version says."""
        fs, marker = self._fs(f"{path}/{ACCEPTED}")
        stream = fs.open(marker)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else {}

    def owns(self, path: str) -> bool:
        """Is it a version written here, and not a file from elsewhere?"""
        return path.startswith(f"{self.root}/")

    def sources(self, name: str) -> list | None:
        """The source files that the table in use was read from, if its version tells."""
        path = self.paths.get(name)
        return self.facts(path).get("sources") if path and self.owns(path) else None

    def _accept(self, path: str, facts: Mapping[str, object]) -> None:
        fs, marker = self._fs(f"{path}/{ACCEPTED}")
        stream = fs.create(marker)
        try:
            stream.write(bytearray(json.dumps(facts).encode()))
        finally:
            stream.close()

    def version(self, name: str) -> str | None:
        """The version of a table in use; results computed from it carry it in their key."""
        path = self.paths.get(name)
        return None if path is None else path.rsplit("/", 1)[-1]

    def _open(self, path: str, contract: TableContract) -> DataFrame:
        if path.endswith(".json"):
            df = self.spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
            if "_corrupt_record" in df.columns:
                raise ValueError("not a JSON object")
            return df
        if path.endswith(".csv"):
            df = normalize_nulls(read_csv(self.spark, path, multi_line=self._dimension(contract, path)))
            return df.select(
                *[
                    _typed(F.col(c), contract.types.get(c, "string")).alias(c)
                    for c in df.columns
                ]
            )
        facts = self.facts(path)
        if facts.get("buckets"):
            return read_bucketed(self.spark, path, *facts["buckets"])
        return self.spark.read.parquet(*self._parts(path, facts))

    def _parts(self, path: str, facts: Mapping[str, list[str]]) -> list[str]:
        """Folders of a version; those it continues are named by their version and lie beside it."""
        beside = path.rsplit("/", 1)[0]
        return [*[f"{beside}/{name}" for name in facts.get("parts", [])], path]

    # Tables ---------------------------------------------------------------------------

    def find(
        self,
        contract: TableContract,
        params: Mapping[str, object] | None = None,
        *,
        plain: bool = True,
        accept: Callable[[DataFrame], bool] | None = None,
    ) -> DataFrame | None:
        """The first valid copy. ``plain`` allows precomputed files that carry no parameters."""
        for path in self._candidates(contract, _digest(params or {}), plain):
            try:
                df = self._open(path, contract)
                reason = contract_violation(df, contract)
                if not reason and accept is not None and not accept(df):
                    reason = "parameters do not match"
            except (AnalysisException, PySparkException, Py4JJavaError, ValueError) as error:
                reason = f"unreadable ({str(error).splitlines()[0][:200]})"
            if not reason:
                self._record(contract.name, "REUSED", path)
                return df.select(*contract.required)
            self.messages.append(f"{contract.name}: REJECTED {path} ({reason})")
        return None

    def put(
        self,
        contract: TableContract,
        df: DataFrame,
        params: Mapping[str, object] | None = None,
        check: Callable[[DataFrame], None] | None = None,
        *,
        continues: str | None = None,
        sources: list | None = None,
        buckets: tuple[str, int] | None = None,
    ) -> DataFrame:
        """Write a new version and return a scan of it.

        ``check`` sees the rows written before they count, and rejects them by raising. ``continues`` is the path of
        a version whose rows the new one has as well, without writing them again; ``sources`` is kept
        with it. ``buckets`` (column, number) deals the rows by a hash of the column, so that groupings by it need no shuffle.
        """
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{contract.name}/{_digest(params or {})}/{version}"
        try:
            if buckets is None:
                df.write.mode("errorifexists").parquet(path)
                table = self.spark.read.schema(df.schema).parquet(path)
            else:
                table = write_bucketed(df, path, *buckets)
            if check is not None:
                check(table)
        except Exception:
            fs, jvm_path = self._fs(path)
            fs.delete(jvm_path, True)
            raise
        facts: dict[str, object] = {}
        if continues is not None:
            facts["parts"] = [*self.facts(continues).get("parts", []), continues.rsplit("/", 1)[-1]]
            table = self.spark.read.schema(df.schema).parquet(*self._parts(path, facts))
        if sources is not None:
            facts["sources"] = sources
        if buckets is not None:
            facts["buckets"] = list(buckets)
        self._accept(path, facts)
        self._record(contract.name, "COMPUTED" if continues is None else "CONTINUED", path)
        return table

    def load_or_compute(
        self,
        contract: TableContract,
        build: Callable[[], DataFrame],
        params: Mapping[str, object] | None = None,
        *,
        force: bool = False,
        plain: bool = True,
        accept: Callable[[DataFrame], bool] | None = None,
        check: Callable[[DataFrame], None] | None = None,
        sources: list | None = None,
        buckets: tuple[str, int] | None = None,
    ) -> DataFrame:
        """A stored copy that passes ``accept``, or else the result of ``build``, stored."""
        if not force:
            found = self.find(contract, params, plain=plain, accept=accept)
            if found is not None:
                return found
        return self.put(contract, build(), params, check, sources=sources, buckets=buckets)

    def _record(self, name: str, status: str, path: str) -> None:
        self.status[name] = status
        self.paths[name] = path
        self.messages.append(f"{name}: {status} ({path})")


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a result for other tools. Every task writes its own part file."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("kind must be 'csv', 'json' or 'parquet'")
