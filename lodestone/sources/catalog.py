"""Collections in immutable Parquet parts under a folder, and numbered manifests that say which parts count.

An insert adds a part; an update or delete writes the rows of just those files anew that have hits. Each change is a manifest of the next
number, put in place by a rename that fails if another session took the number first; readers take the highest. Readers never see half a
statement, a crash leaves the manifest before, and a rollback only turns back. A registered DataFrame is a part that is read where it is.
"""

from __future__ import annotations

import copy
import json
import re
import tempfile
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources import schema as sch

RID = "_rid"
#: Beside the columns of a collection while rows are changed: the part and the file that a row stands in.
PART, FILE = "__part", "__file"


class Conflict(RuntimeError):
    """Another session changed the database since this one read it."""


@dataclass(frozen=True)
class Part:
    """A folder of Parquet files without those that are `gone`, or a registered frame. rows: how many it has, where known; last: its greatest id when it was written."""

    schema: T.StructType
    path: str = ""
    gone: tuple[str, ...] = ()
    rows: int | None = None
    frame: DataFrame | None = None
    last: int | None = None


@dataclass
class Collection:
    schema: T.StructType
    parts: list[Part] = field(default_factory=list)
    next_id: int = 1
    deleted: int = 0

    @property
    def registered(self) -> bool:
        return any(p.frame is not None for p in self.parts)


@dataclass
class Counter:
    start: int = 1
    increment: int = 1
    minvalue: int = 1
    maxvalue: int = 9999999999
    cycle: bool = False
    now: int | None = None


@dataclass
class State:
    collections: dict[str, Collection] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    sequences: dict[str, Counter] = field(default_factory=dict)
    indexes: list[tuple[str, str]] = field(default_factory=list)

    def snapshot(self) -> State:
        kept = {k: Collection(c.schema, list(c.parts), c.next_id, c.deleted) for k, c in self.collections.items()}
        return State(kept, dict(self.views), copy.deepcopy(self.sequences), list(self.indexes))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of its own where the driver is the only machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None, read_only: bool = False):
        self.spark, self.kept, self.read_only = spark, root is not None, read_only
        self.root = root.rstrip("/") if root else f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
        self.tag, self.made, self.version, self.state = f"lodestone_{uuid.uuid4().hex[:12]}", 0, 0, State()
        self._views: dict[str, str] = {}
        self._passing: list[str] = []
        if root:
            self.load()

    # Files

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifests(self) -> list[int]:
        return sorted(int(m[1]) for x in self._names(self.root) if (m := re.fullmatch(r"manifest-(\d{12})\.json", x)))

    def load(self) -> None:
        """The state that the highest manifest has."""
        numbers = self._manifests()
        self.version = numbers[-1] if numbers else 0
        own = {k: c for k, c in self.state.collections.items() if c.registered}
        self.state = State(own, sequences=self.state.sequences)
        self.forget()
        if not numbers:
            return
        said = json.loads(self.spark.read.text(f"{self.root}/manifest-{self.version:012d}.json", wholetext=True).first()[0])
        struct = lambda s: T.StructType.fromJson(s)
        for name, c in said["collections"].items():
            parts = [Part(struct(p["schema"]), p["path"], tuple(p["gone"]), p["rows"]) for p in c["parts"]]
            self.state.collections[name] = Collection(struct(c["schema"]), parts, c["next_id"], c["deleted"])
        self.state.views = said["views"]
        self.state.indexes = [tuple(x) for x in said["indexes"]]

    def writable(self) -> None:
        if self.read_only:
            raise PermissionError("the database is open for reading only")

    def save(self) -> None:
        """The next manifest, written aside and renamed into place, which no two sessions can do under one number. Sequences and registered frames live with the session only."""
        self.writable()
        if not self.kept:
            return
        said = {
            "collections": {
                k: {"schema": c.schema.jsonValue(), "parts": [{"path": p.path, "schema": p.schema.jsonValue(), "gone": p.gone, "rows": p.rows} for p in c.parts], "next_id": c.next_id, "deleted": c.deleted}
                for k, c in self.state.collections.items() if not c.registered
            },
            "views": self.state.views,
            "indexes": self.state.indexes,
        }
        new, fs = self._path(f"{self.root}/.{uuid.uuid4().hex}.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        to, _ = self._path(f"{self.root}/manifest-{self.version + 1:012d}.json")
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            if [k for k in self._manifests() if k > self.version]:
                raise Conflict("another session has changed the database; it was read anew, run the statement again")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, to, never)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise Conflict("another session has changed the database; it was read anew, run the statement again") from error
        finally:
            fs.delete(new, False)
        self.version += 1

    def write(self, name: str, df: DataFrame) -> Part:
        """A new part, its tasks sorted by the paths that are indexed, which get Bloom filters. Columns of nulls only aren't stored; they read as null all the same. What it holds is counted as it is written."""
        stored = [f for f in df.schema if not isinstance(f.dataType, T.NullType)]
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df = df.select(*[F.col(quoted(f.name)) for f in stored])
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in stored])
        paths = [p for t, p in self.state.indexes if t == name and leaf(schema, p)]
        if paths:
            df = df.sortWithinPartitions(*[F.col(".".join(map(quoted, p.split(".")))) for p in paths])
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(RID).alias("last")).write
        for p in paths:
            writer = writer.option(f"parquet.bloom.filter.enabled#{p}", "true")
        writer.parquet(path)
        return Part(schema, path, (), seen.get["rows"], last=seen.get["last"])

    # Collections

    def scan(self, part: Part) -> DataFrame:
        if part.frame is not None:
            return part.frame
        paths = [part.path]
        if part.gone:
            paths = [f"{part.path}/{x}" for x in self._names(part.path) if x.endswith(".parquet") and x not in part.gone]
            if not paths:
                return self.spark.createDataFrame([], part.schema)
        return self.spark.read.schema(part.schema).parquet(*paths)

    def frame(self, name: str, at: bool = False) -> DataFrame | None:
        """The rows of a collection; at: with the part and the file that each stands in."""
        c = self.state.collections.get(name)
        if c is None:
            return None
        if len(c.parts) == 1 and c.registered and not at:
            return c.parts[0].frame
        schema = T.StructType([*c.schema, *([T.StructField(PART, T.IntegerType()), T.StructField(FILE, T.StringType())] if at else [])])
        if not c.parts:
            return self.spark.createDataFrame([], schema)
        scans: dict[str, list[tuple[int, Part]]] = {}
        for k, p in enumerate(c.parts):  # whole parts of one schema are one scan
            alone = at or p.gone or p.frame is not None
            scans.setdefault(str(k) if alone else p.schema.json(), []).append((k, p))
        out = []
        for each in scans.values():
            k, p = each[0]
            df = self.scan(p) if len(each) == 1 else self.spark.read.schema(p.schema).parquet(*[x.path for _, x in each])
            if at:
                file = F.lit("") if p.frame is not None else F.element_at(F.split("_metadata.file_path", "/"), -1)
                df = df.select("*", F.lit(k).alias(PART), file.alias(FILE))
            out.append(sch.aligned(df, schema))
        return reduce(DataFrame.unionByName, out)

    def table(self, name: str) -> tuple[str, T.StructType] | None:
        """A temporary view of the collection as it is now."""
        df = self.frame(name)
        if df is None:
            return None
        if name not in self._views:
            self._views[name] = self.view(df, False)
        return self._views[name], df.schema

    def view(self, df: DataFrame, passing: bool = True) -> str:
        """passing: for one statement, see `passed`."""
        self.made += 1
        name = f"{self.tag}_{self.made}"
        df.createOrReplaceTempView(name)
        if passing:
            self._passing.append(name)
        return f"`{name}`"

    def passed(self) -> None:
        """A statement is compiled: its DataFrame holds the plans of the views that were made for it."""
        for name in self._passing:
            self.spark.catalog.dropTempView(name)
        self._passing.clear()

    def forget(self, name: str | None = None) -> None:
        for k in [name] if name else list(self._views):
            if (v := self._views.pop(k, None)) is not None:
                self.spark.catalog.dropTempView(v.strip("`"))

    def rows(self, name: str) -> int:
        """From the manifest; what a registered frame has is counted."""
        c = self.state.collections.get(name)
        return 0 if c is None else sum(self.scan(p).count() if p.rows is None or p.gone else p.rows for p in c.parts)

    def register(self, name: str, df: DataFrame) -> None:
        self.state.collections[name] = Collection(df.schema, [Part(df.schema, frame=df)])
        self.forget(name)

    def first_free(self, name: str) -> int:
        """The id of the next document. Rows of a registered frame count as the first ones."""
        c = self.state.collections.get(name)
        if c is None:
            return 1
        if c.next_id == 1 and c.registered:
            c.next_id = 1 + self.rows(name)
        return c.next_id

    def append(self, name: str, df: DataFrame) -> tuple[int, int | None]:
        """df as new documents, a part of their own. Rows without an id get growing ones. Returns how many, and the last id."""
        first = self.first_free(name)
        c = self.state.collections.get(name) or Collection(T.StructType([T.StructField(RID, T.LongType())]))
        number = F.col(RID) if RID in df.columns else F.monotonically_increasing_id() + first
        part = self.write(name, df.withColumn(RID, number.cast("bigint")))
        nulls = [f for f in df.schema if isinstance(f.dataType, T.NullType)]
        known = c.schema if any(f.name == RID for f in c.schema) else T.StructType([T.StructField(RID, T.LongType()), *c.schema])
        c.schema = sch.settled(sch.merged_fields(known, T.StructType([*part.schema, *nulls])))
        c.parts = [*c.parts, part]
        c.next_id = (part.last or first - 1) + 1
        self.state.collections[name] = c
        self.forget(name)
        return part.rows, part.last

    def own(self, name: str) -> Collection:
        """The collection with registered frames written as parts of their own, each row with an id below those of rows that were inserted."""
        c = self.state.collections[name]
        for k, p in enumerate(c.parts):
            if p.frame is not None:
                df = p.frame if RID in p.frame.columns else p.frame.withColumn(RID, F.monotonically_increasing_id() - (1 << 62))
                c.next_id = self.first_free(name)
                c.parts[k] = self.write(name, df)
                c.schema = sch.merged_fields(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), c.schema)
                self.forget(name)
        return c

    def replace(self, name: str, hit: dict[int, set[str]], df: DataFrame, deleted: int = 0) -> None:
        """df in place of the files that are hit: part -> names of files. Other files stay as they are."""
        c = self.state.collections[name]
        new = self.write(name, df)
        parts = []
        for k, p in enumerate(c.parts):
            if k not in hit:
                parts.append(p)
            elif p.frame is None:
                left = replace(p, gone=tuple(sorted({*p.gone, *hit[k]})), rows=None)
                if rows := self.scan(left).count():  # from the footers
                    parts.append(replace(left, rows=rows))
        kinds = sch.merged_fields(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), T.StructType([]))
        c.schema = sch.settled(sch.merged_fields(kinds, c.schema) if parts else kinds)
        c.parts = [*parts, new] if new.rows else parts
        c.deleted += deleted
        self.forget(name)

    def sort(self, name: str, path: str) -> None:
        """An index: the parts written again in ranges of the path, so that statistics and Bloom filters leave a lookup few row groups to read. Registered frames stay as they are."""
        c = self.state.collections.get(name)
        if c is None or c.registered or not c.parts or not leaf(c.schema, path):
            return
        df = self.frame(name)
        tasks = max(len(df.inputFiles()), 1)
        c.parts = [self.write(name, df.repartitionByRange(tasks, F.col(".".join(map(quoted, path.split("."))))))]
        self.forget(name)

    def vacuum(self) -> int:
        """Merges each collection's parts, deletes what nothing points at any more, returns how many deleted rows that gave back. Older manifests go too: a session that still reads one must read anew."""
        self.writable()
        back = 0
        for name, c in self.state.collections.items():
            back += c.deleted
            c.deleted = 0
            if not c.registered and (len(c.parts) > 1 or any(p.gone for p in c.parts)):
                c.parts = [self.write(name, self.frame(name))]
                self.forget(name)
        self.save()
        for name, c in self.state.collections.items():
            live = {p.path.rsplit("/", 1)[-1] for p in c.parts}
            for x in self._names(f"{self.root}/{name}"):
                if x not in live:
                    path, fs = self._path(f"{self.root}/{name}/{x}")
                    fs.delete(path, True)
        for k in self._manifests()[:-1]:
            path, fs = self._path(f"{self.root}/manifest-{k:012d}.json")
            fs.delete(path, False)
        return back


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def leaf(schema: T.StructType, path: str) -> bool:
    """Whether the path is a plain value that can be sorted by."""
    t: T.DataType = schema
    for p in path.split("."):
        t = next((f.dataType for f in t if f.name == p), T.NullType()) if isinstance(t, T.StructType) else T.NullType()
    return isinstance(t, T.AtomicType) and not isinstance(t, T.VariantType | T.NullType)
