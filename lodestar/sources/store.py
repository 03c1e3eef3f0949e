"""A store of scopes: each owner and namespace has immutable snapshots and a pointer to one.

A load writes all tables of a scope into a new folder and then swaps the
pointer by a rename. Until then readers see the old snapshot; if a load fails
they keep seeing it. A snapshot that was replaced stays until its retention
time is over, for the readers that began with it. Overwriting partitions in place would not do: a partition
that gets no rows would keep its old ones.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.operators.search import SCOPE

TABLES = ("columns", "values", "rules", "chunks", "index")


class View:
    """The tables of some snapshots by name.

    A snapshot has a folder for each table, or (after a change by rows) parts,
    which may lie in the folders of snapshots before it.
    """

    def __init__(self, spark: SparkSession, snapshots: list[tuple[str, dict]]):
        self.spark, self.snapshots = spark, snapshots

    @property
    def folders(self) -> list[str]:
        return [f for f, _ in self.snapshots]

    def __call__(self, name: str) -> DataFrame:
        paths, schema = [], None
        for folder, parts in self.snapshots:
            if name in parts:
                schema = StructType.fromJson(json.loads(parts[name]["schema"]))
                paths += [f"{folder.rsplit('/', 1)[0]}/{snapshot}/{name}/part={part}" for part, snapshot in parts[name]["parts"].items()]
            else:
                paths.append(f"{folder}/{name}")
        if not paths:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(*paths)

    def has(self, name: str) -> bool:
        where = [self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{f}/{name}") for f in self.folders]
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return all(w.getFileSystem(conf).exists(w) for w in where)

    def each(self) -> list[View]:
        return [View(self.spark, [s]) for s in self.snapshots]


class Store:
    """``root`` is any Hadoop path that driver and executors share; replaced snapshots are kept for ``retention`` seconds."""

    def __init__(self, spark: SparkSession, root: str, retention: float = 24 * 3600):
        self.spark, self.root, self.retention = spark, root.rstrip("/"), retention

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _scope(self, owner: str, namespace: str) -> str:
        return f"{self.root}/owner={quote(owner, safe='')}/namespace={quote(namespace, safe='')}"

    def _read_text(self, path: str) -> str | None:
        fs, where = self._fs(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        fs, temporary = self._fs(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        _, where = self._fs(path)
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = options.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(options.Options.Rename, 1)
        rename[0] = options.Options.Rename.OVERWRITE
        context.rename(temporary, where, rename)

    def _pointer(self, owner: str, namespace: str) -> dict | None:
        text = self._read_text(f"{self._scope(owner, namespace)}/current.json")
        return None if text is None else json.loads(text)

    def current(self, owner: str, namespace: str) -> str | None:
        """The folder of the visible snapshot, or None."""
        pointer = self._pointer(owner, namespace)
        return None if pointer is None else f"{self._scope(owner, namespace)}/{pointer['snapshot']}"

    def stage(self, owner: str, namespace: str) -> str:
        """A folder for a new snapshot that nobody sees yet."""
        return f"{self._scope(owner, namespace)}/snapshot-{uuid.uuid4().hex}"

    def parts(self, owner: str, namespace: str) -> dict:
        """Where the parts of the visible snapshot's tables lie: table to its schema and (part to snapshot); {} for whole tables."""
        return (self._pointer(owner, namespace) or {}).get("parts", {})

    def publish(self, owner: str, namespace: str, folder: str, parts: dict | None = None) -> None:
        """Make a staged snapshot the visible one; those replaced longer ago than the retention time are deleted, unless it has parts of theirs."""
        scope, name, now = self._scope(owner, namespace), folder.rsplit("/", 1)[1], time.time()
        before = self._pointer(owner, namespace)
        replaced = [] if before is None else [*before.get("replaced", []), [before["snapshot"], now]]
        replaced = [r for r in replaced if r[0] != name]
        held = {s for t in (parts or {}).values() for s in t["parts"].values()}
        kept = [r for r in replaced if now - r[1] < self.retention or r[0] in held]
        self._write_text(f"{scope}/current.json", json.dumps({"snapshot": name, "replaced": kept, "parts": parts or {}}))
        for old in [r[0] for r in replaced if r not in kept]:
            self.discard(f"{scope}/{old}")

    def discard(self, folder: str) -> None:
        fs, where = self._fs(folder)
        fs.delete(where, True)

    def scopes(self) -> list[tuple[str, str]]:
        """Every (owner, namespace) with a visible snapshot."""
        fs, where = self._fs(f"{self.root}/owner=*/namespace=*/current.json")
        found = fs.globStatus(where) or []
        out = []
        for status in found:
            parts = status.getPath().toString().split("/")
            out.append((unquote(parts[-3].removeprefix("owner=")), unquote(parts[-2].removeprefix("namespace="))))
        return sorted(out)

    def view(self, *scopes: tuple[str, str]) -> View:
        """A reader of tables by name: one scan over the files of the scopes' snapshots that are visible now, whatever is loaded later."""
        found = []
        for o, n in scopes:
            if pointer := self._pointer(o, n):
                found.append((f"{self._scope(o, n)}/{pointer['snapshot']}", pointer.get("parts", {})))
        if not found:
            raise LookupError(f"nothing is stored for {', '.join(f'{o!r}/{n!r}' for o, n in scopes)}")
        return View(self.spark, found)

    def table(self, name: str, owner: str, namespace: str) -> DataFrame:
        """A table of one scope: only its own files are listed and read."""
        return self.view((owner, namespace))(name)

    def count(self, name: str, owner: str, namespace: str) -> int:
        mine = (F.col(SCOPE[0]) == owner) & (F.col(SCOPE[1]) == namespace)
        return self.table(name, owner, namespace).where(mine).count()
