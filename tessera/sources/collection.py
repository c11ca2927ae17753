"""Collections: change logs in Parquet behind a document API.

A collection is a folder with a log of Parquet folders, one for each write, under the current generation. A row has `_id`, `_seq` (the number of its
write), `_at` (its place within the write), `_op`, `_ts` and the document's columns; the newest row of a key is the one with the greatest (`_seq`, `_at`). A write takes
its number by creating a file of that name, which only one of several writers can, and counts once its job has
committed, so readers see whole writes only. What replaces the log (compaction, `$out`) is written as a new generation, and a small file that names
the current one is replaced last.
Reads are lazy frames; DML appends after-images or tombstones of the rows that match.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.updates import apply_update, upsert_document
from tessera.operators import search, versioned
from tessera.plans import pipeline
from tessera.plans.builder import Hooks, Stop
from tessera.plans.validation import InvalidQuery, check_filter
from tessera.sources.cursor import Cursor
from tessera.sources.folders import Folder

META = ("_seq", "_at", "_op", "_ts")
_TIES = ("_at",)


class Collection:
    def __init__(self, database: Database, name: str, folder: Folder | None = None) -> None:
        self.database, self.spark, self.name = database, database.spark, name
        self.folder = folder or Folder(self.spark, f"{database.root}/{name}")
        self.path = self.folder.path

    # The log

    def create(self) -> Collection:
        """Makes the collection's folder; it has no columns before the first write."""
        (self.folder / "_current").create({"generation": "g0"})
        return self

    def _generation(self) -> Folder:
        return self.folder / (((self.folder / "_current").read() or {}).get("generation") or "g0")

    def writes(self) -> list[tuple[int, str]]:
        """(number, folder) of the committed writes of the current generation."""
        found = [p.rsplit("/", 1)[0] for p in self._generation().matching("write-*/_SUCCESS")]
        return [(int(p.rsplit("-", 1)[1]), p) for p in found]

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def log(self, upto: int | None = None) -> DataFrame | None:
        """All changes (to a number), or None before the first write. Files of older schemas are read with the newest columns."""
        return self._read([p for n, p in self.writes() if upto is None or n <= upto])

    def _reserve(self) -> int:
        """The next write's number."""
        numbers = self.folder / "_numbers"
        taken = [int(p.rsplit("/", 1)[1]) for p in numbers.matching("[0-9]*")]
        n = max(taken, default=0) + 1
        while not (numbers / f"{n:020d}").create({}):
            n += 1
        for old in taken:
            if old < n - 100:
                (numbers / f"{old:020d}").delete()
        return n

    def _numbered(self, rows: DataFrame, number: int, kinds: dict[str, T.DataType]) -> DataFrame:
        # A field keeps the type of its first write; a value that doesn't fit it raises.
        rows = rows.select(*[F.col(f"`{c}`").cast(kinds[c]) if c in kinds else F.col(f"`{c}`") for c in rows.columns if c not in ("_seq", "_at", "_ts")])
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return rows.withColumns({"_seq": F.lit(number).cast("long"), "_at": F.monotonically_increasing_id(), "_ts": F.lit(now).cast("timestamp")})

    def _append(self, rows: DataFrame, op: str | None) -> None:
        """One write; rows of a later place in it are newer. Without `op` the rows have their own `_op`."""
        log, number = self.log(), self._reserve()
        kinds = {f.name: f.dataType for f in log.schema.fields} if log is not None else {}
        rows = rows.withColumn("_op", F.lit(op)) if op else rows
        self._numbered(rows, number, kinds).write.parquet(f"{self._generation().path}/write-{number:020d}")

    def _switch(self, rows: DataFrame, number: int) -> None:
        """Replaces the log by rows that have its columns already: a new generation, then the file that names it. The generation
        before stays until the next switch, for frames that still read it."""
        now = self._generation().path.rsplit("/", 1)[1]
        name = f"g{number}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{name}/write-{number:020d}")
        (self.folder / "_current").replace({"generation": name})
        for old in self.folder.names(folders=True):
            if old.startswith("g") and old not in (now, name):
                (self.folder / old).delete()

    # Reading

    def scan(self, as_of_seq: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """The newest row of each key, now or at a write's number or a time."""
        log = self.log(as_of_seq)
        if log is None:
            return self.spark.createDataFrame([], "_id string")
        return versioned.as_of(log, as_of_seq, as_of, tiebreak=_TIES).drop(*META)

    def _text(self) -> list[str]:
        return next((list(i["key"]) for i in self.list_indexes() if "text" in i["key"].values()), [])

    def _hooked(self, event: str, spec):
        return self.database.hooks.apply(event, spec, self)

    def find(self, query: dict | None = None, **options) -> DataFrame:
        return pipeline.find(self.scan(), self._hooked("find", query or {}), text=self._text() or None, **options)

    def find_one(self, query: dict | None = None, **options) -> dict | None:
        rows = self.find(query, **options).limit(1).collect()
        return rows[0].asDict(recursive=True) if rows else None

    def find_by_id(self, key: object) -> dict | None:
        return self.find_one({"_id": key})

    def exists(self, query: dict | None = None) -> bool:
        return not self.find(query).isEmpty()

    def cursor(self, query: dict | None = None, batch_size: int = 1000, **options) -> Cursor:
        return Cursor(lambda: self.find(query, **options), batch_size)

    def aggregate(self, stages: list[dict], **options) -> DataFrame:
        stages = self._hooked("aggregate", stages)
        return pipeline.Pipeline(lambda n: self.database[n].scan(), self._sink, text=self._text() or None, **options).run(self.scan(), stages)

    def count_documents(self, query: dict | None = None) -> int:
        return self.find(query).count()

    def estimated_document_count(self) -> int:
        """Rows of the log, superseded ones included: footers only."""
        log = self.log()
        return 0 if log is None else log.count()

    def distinct(self, field: str, query: dict | None = None) -> DataFrame:
        from tessera.operators.group import distinct

        return distinct(self.find(query), field)

    def iterate(self, query: dict | None = None, **options):
        """Documents one by one; only a partition at a time is on the driver."""
        for row in self.find(query, **options).toLocalIterator(prefetchPartitions=True):
            yield row.asDict(recursive=True)

    def search(self, query: str, **options) -> DataFrame:
        """(_id, score) of the documents that match, by the text index's fields and its stored postings, if they are of the newest write."""
        index = next((i for i in self.list_indexes() if "text" in i["key"].values()), None)
        if index is None:
            raise InvalidQuery("$text needs a text index: create_index({field: 'text'})")
        weights = {f: float(index.get("weights", {}).get(f, 1.0)) for f in index["key"]}
        postings = None
        if not options and index.get("written") == max((n for n, _ in self.writes()), default=0):
            postings = self.spark.read.parquet(index["postings"])
        return search.search(self.scan(), "_id", weights, query, index=postings, **options)

    # Writing

    def insert(self, rows: DataFrame) -> None:
        """Appends documents; those without `_id` get one. An `_id` that is there already is superseded."""
        made = F.expr("uuid()")
        rows = rows.withColumn("_id", F.coalesce(F.col("_id"), made.cast(rows.schema["_id"].dataType)) if "_id" in rows.columns else made)
        self._append(rows, "i")

    def insert_many(self, docs: list[dict], schema: T.StructType | str | None = None) -> int:
        docs = self._hooked("insert", docs)
        docs = [{"_id": str(uuid.uuid4())} | d for d in docs]
        self.insert(self.spark.createDataFrame(docs, schema) if schema else self.spark.createDataFrame(docs))
        self._hooked("inserted", docs)
        return len(docs)

    def insert_one(self, doc: dict, schema: T.StructType | str | None = None) -> object:
        doc = {"_id": str(uuid.uuid4())} | doc
        self.insert_many([doc], schema)
        return doc["_id"]

    def _matched(self, query: dict, one: bool) -> DataFrame:
        """The rows that match, written once, as they are counted and then changed."""
        from tessera.sources.scratch import materialize

        check_filter(query)
        rows = self.find(query)
        return materialize(rows.orderBy("_id").limit(1) if one else rows)

    def update(self, query: dict, update: dict, one: bool = False, upsert: bool = False) -> int:
        """Appends after-images of the rows that match; with `upsert`, inserts one if none do."""
        update = self._hooked("update", update)
        rows = self._matched(query, one)
        n = rows.count()
        if n:
            self._append(apply_update(rows, {k: v for k, v in update.items() if k != "$setOnInsert"}), "u")
        elif upsert:
            self.insert_many([upsert_document(query, update)])
        self._hooked("updated", update)
        return n

    def replace_one(self, query: dict, doc: dict, upsert: bool = False) -> int:
        found = self._matched(query, True).select("_id").collect()
        if not found:
            if upsert:
                self.insert_many([({"_id": query["_id"]} if "_id" in query else {}) | doc])
            return 0
        self._append(self.spark.createDataFrame([{**doc, "_id": found[0]["_id"]}]), "r")
        return 1

    def delete(self, query: dict, one: bool = False) -> int:
        try:
            query = self._hooked("delete", query)
        except Stop as e:
            return e.value
        rows = self._matched(query, one).select("_id")
        n = rows.count()
        if n:
            self._append(rows, "d")
        self._hooked("deleted", query)
        return n

    def find_one_and_update(self, query: dict, update: dict, return_new: bool = False) -> dict | None:
        before = self._matched(query, True).collect()
        if not before:
            return None
        self.update({"_id": before[0]["_id"]}, update, one=True)
        return self.find_one({"_id": before[0]["_id"]}) if return_new else before[0].asDict(recursive=True)

    def find_one_and_delete(self, query: dict) -> dict | None:
        before = self._matched(query, True).collect()
        if before:
            self.delete({"_id": before[0]["_id"]}, one=True)
        return before[0].asDict(recursive=True) if before else None

    def _sink(self, op: str, df: DataFrame, spec) -> DataFrame:
        """`$out` replaces a collection by a new generation; `$merge` joins its rows by key and appends what changes as one write."""
        from tessera.sources.scratch import materialize

        df = materialize(df)
        if op == "$out":
            target = self.database[spec if isinstance(spec, str) else spec["coll"]]
            rows = df if "_id" in df.columns else df.withColumn("_id", F.expr("uuid()"))
            number = target.create()._reserve()
            target._switch(target._numbered(rows.withColumn("_op", F.lit("i")), number, {}), number)
            return df
        spec = {"into": spec} if isinstance(spec, str) else spec
        target, on = self.database[spec["into"]], spec.get("on", "_id")
        matched, missing = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
        have = materialize(target.scan()) if target.log() is not None else None
        if have is None:
            if missing == "fail" and not df.isEmpty():
                raise InvalidQuery("$merge: a row is not in the target")
            if missing == "insert":
                target.insert(df)
            return df
        on = [on] if isinstance(on, str) else on
        new, old = df.join(have.select(*on), on, "left_anti"), df.join(have.select(*on), on, "left_semi")
        if missing == "fail" and not new.isEmpty() or matched == "fail" and not old.isEmpty():
            raise InvalidQuery("$merge: a row must not (or must) be in the target")
        made = []
        if matched in ("merge", "replace"):
            rest = [c for c in have.columns if c not in df.columns and (matched == "merge" or c == "_id")]
            made.append(old.join(have.select(*on, *rest), on).withColumn("_op", F.lit("u" if matched == "merge" else "r")))
        if missing == "insert":
            new = new if "_id" in new.columns else new.withColumn("_id", F.expr("uuid()").cast(have.schema["_id"].dataType))
            made.append(new.withColumn("_op", F.lit("i")))
        if made:
            rows = made[0] if len(made) == 1 else made[0].unionByName(made[1], allowMissingColumns=True)
            rows = materialize(rows)
            if not rows.isEmpty():
                target._append(rows, None)
        return df

    def compact(self) -> None:
        """Rewrites the log without superseded rows and deletions, as a new generation."""
        log = self.log()
        if log is not None:
            self._switch(versioned.compact(log, tiebreak=_TIES), max(n for n, _ in self.writes()))

    def drop(self) -> None:
        self.folder.delete()

    def watch(self, query: dict | None = None, after_seq: int | None = None) -> DataFrame:
        """A streaming frame of the current generation's writes. After a compaction, watch again from the last token."""
        from tessera.streaming.changes import watch

        return watch(self.spark, f"{self._generation().path}/write-*", self.log().schema, query, after_seq)

    def changes(self, after_seq: int | None = None, **options) -> DataFrame:
        """Change events of the log in batch form; see `versioned.changes`."""
        return versioned.changes(self.log().drop("_ts"), tiebreak=_TIES, after_seq=after_seq, **options)

    # Snapshots: each write's number is one

    def snapshots(self) -> DataFrame:
        """(snapshot_id, parent_id, folder) of the writes of the current generation."""
        found = self.writes()
        return self.spark.createDataFrame([(n, found[i - 1][0] if i else None, p) for i, (n, p) in enumerate(found)], "snapshot_id long, parent_id long, folder string")

    def changes_since(self, snapshot_id: int) -> DataFrame | None:
        """Log rows of the writes after a snapshot: only their folders are read."""
        return self._read([p for n, p in self.writes() if n > snapshot_id])

    def rollback(self, snapshot_id: int) -> int:
        """Appends what makes the rows those of a snapshot again: after-images and tombstones, as one write. Gives the number of rows."""
        from tessera.sources.scratch import materialize

        d = versioned.diff(self.scan(), self.scan(as_of_seq=snapshot_id))
        rows = materialize(d.select("_id", F.when(F.col("change") == "delete", "d").otherwise("r").alias("_op"), "after.*"))
        n = rows.count()
        if n:
            self._append(rows, None)
        return n

    def cherry_pick(self, snapshot_id: int) -> None:
        """Applies one write again, on top of the newest rows."""
        picked = self._read([p for n, p in self.writes() if n == snapshot_id])
        if picked is None:
            raise InvalidQuery(f"no write {snapshot_id} in this generation")
        self._append(versioned.latest(picked, op=None, tiebreak=_TIES).drop("_seq", "_at", "_ts"), None)

    # Indexes: a text index is a stored postings table; for others Parquet statistics and layout serve, and only their description is kept

    def _indexes(self) -> Folder:
        return self.folder / "_indexes"

    def create_index(self, key: dict | str, name: str | None = None, **options) -> str:
        key = {key: 1} if isinstance(key, str) else dict(key)
        bad = [k for k in key.values() if k not in (1, -1, "text", "2d", "2dsphere", "hashed")]
        if bad:
            raise InvalidQuery(f"unknown kind of index {bad[0]!r}")
        name = name or "_".join(f"{k}_{v}" for k, v in key.items())
        meta = {"name": name, "key": key} | options
        if options.get("unique") and self.log() is not None:
            fields = list(key)
            twice = self.scan().groupBy(*fields).count().where("count > 1")
            if not twice.isEmpty():
                raise InvalidQuery(f"values of {fields} repeat")
        if "text" in key.values() and self.log() is not None:
            written = max(n for n, _ in self.writes())
            path = f"{self._indexes().path}/postings-{name}-{written}"
            weights = {f: float(options.get("weights", {}).get(f, 1.0)) for f in key}
            search.postings(self.scan(), "_id", weights).write.mode("overwrite").parquet(path)
            meta |= {"written": written, "postings": path}
        (self._indexes() / f"{name}.json").replace(meta)
        return name

    def list_indexes(self) -> list[dict]:
        """Descriptions, that of the key first."""
        return [{"name": "_id_", "key": {"_id": 1}}, *[Folder(self.spark, p).read() for p in self._indexes().matching("*.json")]]

    def sync_indexes(self, wanted: list[dict | str]) -> tuple[list[str], list[str]]:
        """Makes the indexes listed and drops all others but the key's; gives the names made and dropped."""
        names = {"_".join(f"{k}_{v}" for k, v in ({w: 1} if isinstance(w, str) else w).items()): w for w in wanted}
        have = [i["name"] for i in self.list_indexes() if i["name"] != "_id_"]
        gone = [n for n in have if n not in names]
        for n in gone:
            self.drop_index(n)
        return [self.create_index(w) for n, w in names.items() if n not in have], gone

    def drop_index(self, name: str) -> None:
        file = self._indexes() / f"{name}.json"
        meta = file.read()
        if meta is None:
            raise InvalidQuery(f"no index {name}")
        file.delete()
        if "postings" in meta:
            Folder(self.spark, meta["postings"]).delete()


class Database:
    """Collections under a root folder on any file system that Spark reads. `hooks` see and rewrite what collections are asked."""

    def __init__(self, spark: SparkSession, root: str, hooks: Hooks | None = None) -> None:
        self.spark, self.root, self.hooks = spark, root.rstrip("/"), hooks or Hooks()
        self.folder = Folder(spark, self.root)

    def __getitem__(self, name: str) -> Collection:
        return Collection(self, name)

    def list_collections(self) -> list[str]:
        return self.folder.names(folders=True)

    def create_collection(self, name: str) -> Collection:
        return self[name].create()

    def drop_collection(self, name: str) -> None:
        self[name].drop()

    def drop(self) -> None:
        self.folder.delete()


class Lake:
    """Databases under one folder."""

    def __init__(self, spark: SparkSession, root: str, hooks: Callable[[str], Hooks] | None = None) -> None:
        self.spark, self.folder, self.hooks = spark, Folder(spark, root), hooks

    def __getitem__(self, name: str) -> Database:
        return Database(self.spark, f"{self.folder.path}/{name}", self.hooks(name) if self.hooks else None)

    def list_databases(self) -> list[str]:
        return self.folder.names(folders=True)

    def drop_database(self, name: str) -> None:
        self[name].drop()
