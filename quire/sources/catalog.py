"""A catalog of Parquet tables with generations.

Tables that grow with the documents lie in buckets, by a hash of model and name. A
change writes new files for the buckets that it touches, and whole new
generations of small tables, beside the old ones, then swaps one pointer file by a
rename; readers see all of it or none. The pointer names the files of each bucket.
What it no longer names is deleted KEEP_S after that, so that readers that began
before can end.

Files are reached through Hadoop's file systems, so a catalog can be in any store
that Spark writes to. A lock file, made exclusively, keeps writers apart; it names its
owner, so that the lock of a writer that died can be taken over.
"""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError

SCHEMAS = {
    "stores": "store string, name string, path string, linked boolean, hash_a string",
    "models": "store string, model string, version int, family string, field_count int, semantics array<string>, template string, hash_b string",
    "documents": "store string, model string, doc string, path string, text string, payload_json string, semantic_tags array<string>, hash_c string, hash_d string",
    "sections": "store string, model string, doc string, position int, title string, level int, line_start int, line_end int, body_end int, slug string, path string, breadcrumbs array<string>, parent string, about array<string>",
    "folds": "store string, model string, prefix string, fold string",
    "equivalences": "store string, tag string, equal string",
    "drafts": "model string, spec string",
    "records": "root string, record long, kind string, store string, model string, doc string, name string, path string, physical array<string>, semantic array<string>, about array<string>, title string, field_path string, section_path string, breadcrumbs array<string>, value string, payload_json string, owning_section string, ord int",
    "postings": "root string, gram string, record long",
}
#: Tables in buckets; within one they are stored by model, so that a scope reads its models' files only.
BUCKETED = ("documents", "sections", "folds")
#: Seconds that files stay after the pointer has let go of them.
KEEP_S = 3600
#: A lock of another host that is older than this was left behind.
STALE_S = 24 * 3600


def _columns(name: str) -> list[str]:
    return [c.strip().split()[0] for c in SCHEMAS[name].split(", ")]


def bucket_of(digits: int) -> Column:
    """The bucket of a row (model, doc): hexadecimal digits of its hash. More digits split a bucket in sixteen."""
    return F.substring(F.sha2(F.concat_ws("\0", "model", "doc"), 256), 1, digits)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs().exists(self._path("CURRENT"))

    def _pointer(self) -> dict:
        if not self.exists():
            raise CatalogError(f"no catalog in {self.root}")
        return json.loads(self._text(self._path("CURRENT")))

    def _swap(self, pointer: dict) -> None:
        fs, new = self._fs(), self._path(f"CURRENT.{time.time_ns()}")
        stream = fs.create(new, False)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        # FileContext renames over a file that is there, in one step
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if ":" in self.root.split("/")[0] else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(self._path("CURRENT")), options)

    def _text(self, path) -> str:
        stream = self._fs().open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _left_behind(self, path) -> bool:
        """Whether a lock's owner is gone: a dead process of this host, or any that is older than STALE_S."""
        try:
            age = time.time() - self._fs().getFileStatus(path).getModificationTime() / 1000
            owner = json.loads(self._text(path) or "{}")
        except Exception:  # it was released meanwhile, or is being written
            return False
        if owner.get("host") == socket.gethostname():
            try:
                os.kill(int(owner["pid"]), 0)
            except ProcessLookupError:
                return True
            except PermissionError:
                pass
        return age > STALE_S

    @contextmanager
    def lock(self, wait_s: float = 0) -> Iterator[None]:
        """Hold the catalog's lock; without waiting, a held lock is an error at once. A lock left behind is taken over."""
        fs, path, until = self._fs(), self._path("LOCK"), time.monotonic() + wait_s
        while True:
            try:
                stream = fs.create(path, False)
                stream.write(bytearray(json.dumps({"host": socket.gethostname(), "pid": os.getpid()}).encode()))
                stream.close()
                break
            except Exception as e:
                if not fs.exists(path):
                    raise CatalogError(f"can't lock {self.root}: {e}") from e
                if self._left_behind(path):
                    # of several that see it, one renames it away
                    if fs.rename(path, self._path(f"LOCK.{os.getpid()}.{time.time_ns()}")):
                        continue
                if time.monotonic() >= until:
                    raise CatalogError(f"{self.root} is locked") from e
                time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(path, False)

    def init(self, force: bool = False, digits: int = 1) -> None:
        """An empty catalog with 16 ** ``digits`` buckets: as many as leave each one small enough to be written anew by a change."""
        if self.exists() and not force:
            raise CatalogError(f"{self.root} has a catalog")
        local = self.spark.createDataFrame([("local", "local", self.root, False, "")], SCHEMAS["stores"])
        empty = {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in BUCKETED}
        gone = self._let_go(self._pointer(), {}) if self.exists() else {}
        self._write(empty | {"stores": local}, {"digits": digits, "gone": gone} | {n: {} for n in BUCKETED})

    @property
    def digits(self) -> int:
        return self._pointer()["digits"]

    def read(self, name: str, buckets: list[str] | None = None) -> DataFrame:
        """A table, or ``buckets`` of it."""
        return self._at(self._pointer(), name, buckets)

    def _at(self, pointer: dict, name: str, buckets: list[str] | None = None) -> DataFrame:
        """A table of a generation; one that older catalogs lack is empty."""
        if not pointer.get(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name not in BUCKETED:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{pointer[name]}").select(*_columns(name))
        slots = [f"{self.root}/{name}/slot={x}" for b, x in sorted(pointer[name].items()) if buckets is None or b in buckets]
        if not slots:
            return self.spark.createDataFrame([], SCHEMAS[name])
        table = self.spark.read.schema(SCHEMAS[name] + ", slot string").option("basePath", f"{self.root}/{name}").parquet(*slots)
        return table.select(*_columns(name))  # partition columns come last otherwise

    def _bucketed(self, name: str, df: DataFrame, pointer: dict, buckets: list[str] | None) -> dict[str, str]:
        """Write ``buckets`` of a table, all if None, from ``df``, which has their rows and their ``bucket``; returns the files of each bucket."""
        mark = f"g{time.time_ns()}"
        rows = df.select(*_columns(name), F.concat("bucket", F.lit(mark)).alias("slot")).hint("rebalance", "slot", "model")
        root = self._path(name)
        rows.write.mode("append").partitionBy("slot", "model").parquet(f"{self.root}/{name}")
        fs = self._fs()
        new = [x.getPath().getName().removeprefix("slot=") for x in fs.listStatus(root)] if fs.exists(root) else []
        left = {b: x for b, x in pointer[name].items() if buckets is not None and b not in buckets}
        return left | {x.removesuffix(mark): x for x in new if x.endswith(mark)}  # a bucket that is empty now has no files

    def _let_go(self, old: dict, new: dict) -> dict[str, float]:
        """Places that ``new`` no longer names, with the time; those of before whose time is over are deleted."""
        gone, now, fs = dict(old.get("gone", {})), time.time(), self._fs()
        for place in _places(old) - _places(new):
            gone.setdefault(place, now)
        for place in [p for p, since in gone.items() if now - since > KEEP_S]:
            fs.delete(self._path(place), True)
            del gone[place]
        return gone

    def _write(self, tables: dict[str, DataFrame | Callable], pointer: dict, buckets: list[str] | None = None, mark: tuple[str, int] | None = None) -> None:
        old = pointer
        for name, df in tables.items():
            if callable(df):
                df = df(lambda n, some=None, pointer=pointer: self._at(pointer, n, some))
            if name in BUCKETED:
                pointer = pointer | {name: self._bucketed(name, df, pointer, buckets)}
            else:
                place = f"{name}/{time.time_ns()}"
                df.select(*_columns(name)).write.parquet(f"{self.root}/{place}")
                pointer = pointer | {name: place}
        marks = pointer.get("marks", {}) | ({mark[0]: mark[1]} if mark else {})
        self._swap(pointer | {"gone": self._let_go(old, pointer), "marks": marks})

    def mark(self, stream: str) -> int:
        """The number of a stream's last batch in the catalog, -1 if there is none."""
        return self._pointer().get("marks", {}).get(stream, -1)

    def write(self, buckets: list[str] | None = None, mark: tuple[str, int] | None = None, **tables: DataFrame | Callable) -> None:
        """New generations of the named tables, visible together. Hold the lock.

        A table in buckets has the rows of ``buckets``, whose old rows they replace, with
        a column bucket. A table can be a function of a reader, which sees the tables
        written before it. ``mark`` is a stream and the batch that is written.
        """
        self._write(tables, self._pointer(), buckets, mark)

    def root_hash(self) -> str:
        """What follows from all documents and models: the store's hash_a, and versions and tags of its models."""
        models = F.array_sort(F.collect_list(F.struct("model", "version", "semantics", "hash_b")))  # one row per model
        own = self.read("models").agg(F.sha2(F.to_json(models), 256)).first()[0]
        return f"{self.read('stores').where('not linked').select('hash_a').first()[0] or ''}:{own}"

    def indexed(self) -> tuple[DataFrame, DataFrame] | None:
        """Search records and their trigrams, if they are of the documents as they are now."""
        root, records = self.root_hash(), self.read("records")
        if records.isEmpty() or not records.where(F.col("root") != root).isEmpty():
            return None
        return records.drop("root"), self.read("postings").drop("root")

    def drop(self) -> None:
        """Delete the catalog and all its files."""
        self._fs().delete(self._path(""), True)

    def vacuum(self, keep_s: float = 0) -> int:
        """Delete files that the pointer doesn't name, those of writers that failed too, and that are older than ``keep_s``; returns how many places."""
        fs, pointer, places = self._fs(), self._pointer(), 0
        for name in [n for n in SCHEMAS if fs.exists(self._path(n))]:
            for x in fs.listStatus(self._path(name)):
                place, age = f"{name}/{x.getPath().getName()}", time.time() - x.getModificationTime() / 1000
                if place not in _places(pointer) and x.isDirectory() and age >= keep_s:
                    fs.delete(x.getPath(), True)
                    places += 1
        return places


def _places(pointer: dict) -> set[str]:
    """The folders that a pointer names."""
    found = set()
    for name in SCHEMAS:
        x = pointer.get(name)
        found |= {f"{name}/slot={slot}" for slot in x.values()} if isinstance(x, dict) else {x} if x else set()
    return found
