"""Versioned parquet tables for vocabularies, merges and tokenizers.

A table lives below a folder: every save writes its rows to a folder of their own and then publishes them by the
rename of one manifest file, which is atomic on file systems with an atomic rename. A save that dies leaves
rows that no manifest names. A reader takes the newest manifest, or the version it asks for, and reads the
folder that the manifest names, whatever is saved meanwhile. Two writers never publish one number: the second
takes the next.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 2
SCHEMAS = {
    "vocab": "word string, freq bigint",
    "merges": "rank int, a string, b string, freq bigint",
    "model": "bi int, bj int, h int, w binary, v binary",
    "history": "epoch int, mean_loss double, std_loss double, n bigint",
    "tokenizer": "id int, token string, is_special boolean, rank int, score float",
}


class _Folder:
    """The few file operations that a manifest takes, on whatever file system the path is of."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = path.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, into: str) -> bool:
        """Rename a file; False when another has the name already."""
        hadoop = self.jvm.org.apache.hadoop.fs
        options = self.gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        where = hadoop.FileContext.getFileContext(self._path("").toUri(), self.conf)
        try:
            where.rename(self._path(name), self._path(into), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _versions(folder: _Folder) -> list[int]:
    return sorted(int(name.removesuffix(".json")) for name in folder.names("manifests") if name.endswith(".json"))


def save_table(table: DataFrame, path: str, kind: str) -> int:
    """Store a table as a new version and return its number; readers see all of it or nothing."""
    spark = table.sparkSession
    columns = spark.createDataFrame([], SCHEMAS[kind]).columns
    folder, own = _Folder(spark, path), uuid.uuid4().hex
    table.select(*columns).write.parquet(f"{folder.path}/rows/{own}")
    written = spark.read.schema(SCHEMAS[kind]).parquet(f"{folder.path}/rows/{own}")
    manifest = {"kind": kind, "format": FORMAT, "rows": own, "row_count": written.agg(F.count(F.lit(1))).first()[0]}
    folder.write(f"manifests/{own}.new", json.dumps(manifest))
    version = max(_versions(folder), default=0) + 1
    while not folder.publish(f"manifests/{own}.new", f"manifests/{version}.json"):
        version += 1
    return version


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions below a path, the oldest first."""
    return _versions(_Folder(spark, path))


def load_table(spark: SparkSession, path: str, kind: str, version: int | None = None) -> DataFrame:
    """Read the newest or the given version; a wrong kind, format or row count is refused."""
    folder = _Folder(spark, path)
    known = _versions(folder)
    if not known or version is not None and version not in known:
        raise ValueError(f"{path} holds no table" + ("" if version is None else f" of version {version}"))
    manifest = json.loads(folder.read(f"manifests/{version or known[-1]}.json"))
    if manifest["kind"] != kind or manifest["format"] != FORMAT:
        raise ValueError(f"{path} does not hold a {kind} table of format {FORMAT}")
    rows = spark.read.schema(SCHEMAS[kind]).parquet(f"{folder.path}/rows/{manifest['rows']}")
    if (found := rows.count()) != manifest["row_count"]:
        raise ValueError(f"{path} holds {found} rows, its manifest says {manifest['row_count']}")
    return rows


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all but the newest ``keep`` versions, their manifests first; returns the deleted ones.

    A reader of a deleted version fails. Rows that no manifest names are not touched: a save may be under way.
    """
    folder = _Folder(spark, path)
    gone = _versions(folder)[: -keep or None]
    for version in gone:
        rows = json.loads(folder.read(f"manifests/{version}.json"))["rows"]
        folder.drop(f"manifests/{version}.json")
        folder.drop(f"rows/{rows}")
    return gone
