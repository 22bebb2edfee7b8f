"""Tables of one folder that change together, by a single switch.

Every change writes new files beside the old ones and ends with one small file, a manifest
that names the files of all tables:

    <folder>/<table>/batch=<id>/[<part column>=<value>/]part-*.parquet
    <folder>/_versions/<number>.json

Readers take the manifest with the highest number, so they see all tables of one version or
all of another. A change that fails half-way leaves files that no manifest names. Manifests are
created by a rename that fails where the name is taken: of two changes begun on one version
the second to end is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"
WHOLE = ""  # the only part of a table without part column


class Conflict(RuntimeError):
    """Another change was finished in between."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _listed(self, *names: str) -> list[str]:
        """Last names of what matches a pattern."""
        return [s.getPath().getName() for s in self._files.globStatus(self._path(*names)) or ()]

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._listed("_versions", "[0-9]*.json"))

    def manifest(self, number: int | None = None) -> dict:
        """The manifest of a version, the latest by default; without any, an empty one."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return {"number": 0, "tables": {}, "about": {}}
        stream = self._files.open(self._path("_versions", _file(number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(
        self, table: str, parts: Iterable[str] | None = None, manifest: dict | None = None
    ) -> DataFrame:
        """A table of a version, or the named parts of it. Other parts are not even listed."""
        manifest = self.manifest() if manifest is None else manifest
        if table not in manifest["tables"]:
            raise ValueError(f"no table {table} in {self.folder}")
        entry = manifest["tables"][table]
        schema = T.StructType.fromJson(entry["schema"])
        by, kept = entry["by"], entry["parts"]
        wanted = sorted(kept) if parts is None else [p for p in parts if p in kept]
        root = f"{self.folder}/{table}"
        paths = [f"{root}/{BATCH}={kept[p]}" + (f"/{by}={p}" if by else "") for p in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema, T.StructField(BATCH, T.StringType())])
        found = self.spark.read.schema(full).option("basePath", root).parquet(*paths)
        return found.select(*schema.fieldNames())

    def change(self) -> Change:
        return Change(self)

    def tidy(self, keep: int = 2) -> None:
        """Delete all but the last versions, and files that no kept version names.

        Not while a change is going on: its files are not named yet.
        """
        numbers = self.numbers()
        used = {
            (name, batch)
            for number in numbers[-keep:]
            for name, entry in self.manifest(number)["tables"].items()
            for batch in entry["parts"].values()
        }
        for number in numbers[:-keep]:
            self._files.delete(self._path("_versions", _file(number)), False)
        for name in self._listed("[!_]*"):
            for batch in self._listed(name, f"{BATCH}=*"):
                if (name, batch.partition("=")[2]) not in used:
                    self._files.delete(self._path(name, batch), True)


class Change:
    """New contents of some tables; nothing is seen before ``commit``.

    As a context manager it commits at the end of the block, unless that fails.
    """

    def __init__(self, versions: Versions):
        self.versions = versions
        self.manifest = versions.manifest()

    @property
    def about(self) -> dict:
        return self.manifest["about"]

    def parts(self, table: str) -> list[str]:
        return sorted(self.manifest["tables"].get(table, {"parts": {}})["parts"])

    def read(self, table: str, parts: Iterable[str] | None = None) -> DataFrame:
        """A table as it is within the change."""
        return self.versions.read(table, parts, self.manifest)

    def write(self, table: str, df: DataFrame, by: str | None = None) -> list[str]:
        """Replace a table, or with ``by`` the parts of it that occur in ``df``; their names."""
        batch = uuid.uuid4().hex
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.versions.folder}/{table}/{BATCH}={batch}")
        found = [WHOLE]
        if by:
            listed = self.versions._listed(table, f"{BATCH}={batch}", f"{by}=*")
            found = sorted(name.partition("=")[2] for name in listed)
        old = self.manifest["tables"].get(table, {"parts": {}})
        schema = df.schema
        if by:  # part columns come last when read
            last = T.StructField(by, T.StringType())
            schema = T.StructType([*(f for f in schema if f.name != by), last])
        self.manifest["tables"][table] = {
            "schema": json.loads(schema.json()),
            "by": by,
            "parts": (old["parts"] if by else {}) | dict.fromkeys(found, batch),
        }
        return found

    def commit(self) -> int:
        number = self.manifest["number"] + 1
        self.manifest["number"] = number
        versions, jvm = self.versions, self.versions._jvm
        hidden = versions._path("_versions", f"_{uuid.uuid4().hex}")
        out = versions._files.create(hidden)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        fs = jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(
            versions._files.getUri(), versions.spark.sparkContext._jsc.hadoopConfiguration()
        )
        options = versions.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            context.rename(hidden, versions._path("_versions", _file(number)), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
            versions._files.delete(hidden, False)
            raise Conflict(f"version {number} of {versions.folder} exists already") from error
        return number

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()


def _file(number: int) -> str:
    return f"{number:012d}.json"
