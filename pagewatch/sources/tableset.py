"""Several keyed tables that change together: buckets, one commit for all tables, retention.

A table is dealt into a fixed number of buckets by a hash of its key. A change
reads and rewrites the buckets that its keys fall into and no others; a version
is a manifest that names a folder for every bucket of every table, so buckets
that did not change are shared by versions. A version begins to exist when its
commit file is created, which fails if there is one of that number: of two
writers at once one is told, and neither has touched the other's rows.

Folders that no kept version names are deleted when older versions are dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagewatch.operators.outbox import DurableStateError
from pagewatch.sources.config import empty

BUCKETS = 64
KEPT_VERSIONS = 3
_BUCKET = "_bucket"


class Files:
    """Small files of the driver in the store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        found = self._fs.listStatus(self._at(folder)) if self.exists(folder) else []
        return sorted(f.getPath().getName() for f in found)

    def read(self, name: str) -> dict | None:
        """The file's object; none if there is no such file, an error if it is not sound."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as error:
            raise DurableStateError(f"not sound: {self.path}/{name}") from error

    def create(self, name: str, value: dict) -> bool:
        """Write a file that must not exist yet; false if it does. Its content is whole before it has its name."""
        if self.exists(name):
            return False
        scratch = self._at(f"scratch/{uuid.uuid4().hex}")
        stream = self._fs.create(scratch, False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        try:
            # the name itself is taken exclusively, then the content put in its place
            self._fs.create(self._at(f"{name}.taken"), False).close()
        except Py4JJavaError:
            self._fs.delete(scratch, False)
            return False
        return bool(self._fs.rename(scratch, self._at(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Keyed:
    """A table's layout and the column that deals its rows."""

    schema: T.StructType
    key: str


@dataclass
class Version:
    """A manifest: per table the folder of every bucket that has rows."""

    number: int = 0
    batch_id: int = -1
    tables: dict[str, dict[str, str]] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {folder for buckets in self.tables.values() for folder in buckets.values()}


class TableSet:
    """Tables by name under one path. ``buckets`` belongs to the path and must stay as it was."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Keyed], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self.files = Files(spark, self.path)

    def _commit(self, name: str) -> Version:
        return Version(**(self.files.read(f"commits/{name}") or {}))

    def _commits(self) -> list[str]:
        return [n for n in self.files.names("commits") if n.endswith(".json")]

    def current(self) -> Version:
        names = self._commits()
        return self._commit(names[-1]) if names else Version()

    def has_batch(self, batch_id: int) -> bool:
        """Whether the batch is committed; looks at the kept versions, of which a stream's last batch is one."""
        return any(self._commit(n).batch_id >= batch_id for n in reversed(self._commits()))

    def read(self, name: str, version: Version | None = None, only: list[int] | None = None) -> DataFrame:
        """A table's rows at a version (the current one by default), of all buckets or some."""
        schema = self.tables[name].schema
        held = (version or self.current()).tables.get(name, {})
        paths = [f"{self.path}/{folder}/{self.part(b)}" for b, folder in held.items() if only is None or int(b) in only]
        if not paths:
            return empty(self.spark, schema)
        found = self.spark.read.parquet(*paths)
        kinds = {f.name: f.dataType for f in found.schema}
        if any(kinds.get(f.name) != f.dataType for f in schema):
            raise DurableStateError(f"table {name} has an unexpected layout: {self.path}")
        return found.select(*schema.names)

    @staticmethod
    def part(bucket: str) -> str:
        """The folder of a bucket within that of a change."""
        return f"{_BUCKET}={bucket}"

    def _dealt(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.tables[name].key), F.lit(self.buckets)).cast("int"))

    def changed(
        self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: Version
    ) -> dict[str, str]:
        """Merge ``rows`` into a table at ``version``: writes the buckets they fall into, returns the table's new folders.

        ``merge`` gets the old rows of those buckets and the new ones. ``rows`` is
        read three times and should be stored. Nothing is visible before a commit.
        """
        # at most as many rows as there are buckets
        touched = sorted(r[0] for r in self._dealt(name, rows).select(_BUCKET).distinct().collect())
        folders = dict(version.tables.get(name, {}))
        if not touched:
            return folders
        folder = f"tables/{name}/{uuid.uuid4().hex}"
        merged = merge(self.read(name, version, touched), rows).select(*self.tables[name].schema.names)
        self._dealt(name, merged).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        written = {n.partition("=")[2] for n in self.files.names(folder) if n.startswith(f"{_BUCKET}=")}
        for bucket in map(str, touched):
            folders.pop(bucket, None)
            if bucket in written:
                folders[bucket] = folder
        return folders

    def commit(self, before: Version, batch_id: int, **tables: dict[str, str]) -> Version:
        """Make new folders of some tables current, all at once; an error if another writer has made this version."""
        new = Version(before.number + 1, batch_id, {**before.tables, **tables})
        if not self.files.create(f"commits/{new.number:012d}.json", vars(new)):
            raise DurableStateError(f"another writer has committed version {new.number}: {self.path}")
        return new

    def retain(self, keep: int = KEPT_VERSIONS) -> int:
        """Drop all versions but the last ``keep`` and the folders that no kept one names; how many folders went.

        A version that is being written has folders no commit names: call this
        between runs, or from the run that has just committed.
        """
        names = self._commits()
        if not names:
            return 0
        kept = set().union(*(self._commit(n).folders() for n in names[-keep:]))
        gone = 0
        for name in self.tables:
            for folder in self.files.names(f"tables/{name}"):
                if f"tables/{name}/{folder}" not in kept:
                    self.files.delete(f"tables/{name}/{folder}")
                    gone += 1
        for name in names[:-keep]:
            self.files.delete(f"commits/{name}")
            self.files.delete(f"commits/{name}.taken")
        return gone
