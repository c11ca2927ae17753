"""Branches of a database: metadata as small JSON files, data as each branch's own change logs over the rows at its fork.

A branch sees its parent's rows as they were when it was made (the number of each collection's newest write is part of its metadata) and its own
writes over them. Merging writes what the three-way merge gives that the target doesn't have, as one write a collection.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import versioned
from tessera.plans.validation import InvalidQuery
from tessera.sources.collection import META, Collection, Database

MAIN = "main"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")


class BranchCollection(Collection):
    """A collection as a branch sees it; writes go to the branch's own log."""

    def __init__(self, branch: BranchDatabase, name: str) -> None:
        super().__init__(branch, name, branch.data / name)
        self.forked = branch.meta["forks"].get(name)

    def base(self) -> DataFrame | None:
        """The parent's rows at the fork."""
        if self.forked is None:
            return None
        return self.database.parent[self.name].scan(as_of_seq=self.forked)

    def scan(self, as_of_seq: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        base, log = self.base(), self.log(as_of_seq)
        if log is None or base is None:
            return base if base is not None else super().scan(as_of_seq, as_of)
        log = log.where(F.col("_ts") <= F.lit(as_of)) if as_of is not None else log
        own = versioned.dedup(log, keep_deletes=True, tiebreak=("_at",)).drop(*[c for c in META if c != "_op"])
        return versioned.overlay(base, own)


class BranchDatabase(Database):
    """What `checkout` gives: the database as one branch sees it."""

    def __init__(self, branches: Branches, meta: dict) -> None:
        db = branches.database
        super().__init__(db.spark, db.root, db.hooks)
        self.meta, self.data, self.parent = meta, branches.folder / f"data-{meta['id']}", branches.checkout(meta["parent"])

    def __getitem__(self, name: str) -> Collection:
        return BranchCollection(self, name)

    def list_collections(self) -> list[str]:
        return sorted({*self.meta["forks"], *self.data.names(folders=True)})

    def drop(self) -> None:
        raise InvalidQuery("delete the branch instead")


class Branches:
    """The branches of a database."""

    def __init__(self, database: Database) -> None:
        self.database, self.folder = database, database.folder / "_branches"

    # Metadata

    def _file(self, name: str):
        return self.folder / f"{name}.json"

    def get(self, name: str) -> dict | None:
        return {"name": MAIN, "parent": None} if name == MAIN else self._file(name).read()

    def _known(self, name: str) -> dict:
        meta = self.get(name)
        if meta is None:
            raise InvalidQuery(f"no branch {name}")
        return meta

    def create(self, name: str, parent: str = MAIN, description: str | None = None) -> dict:
        if name == MAIN or not _NAME.fullmatch(name):
            raise InvalidQuery(f"{name!r} can't name a branch")
        source = self.checkout(parent)
        forks = {}
        for c in source.list_collections():
            forks[c] = max((n for n, _ in source[c].writes()), default=0)
        now = dt.datetime.now(dt.timezone.utc).isoformat()
        meta = {"name": name, "id": f"{name}-{now.replace(':', '')[:26]}", "parent": parent, "forks": forks, "created": now, "updated": now, "description": description, "status": "active"}
        if not self._file(name).create(meta):
            raise InvalidQuery(f"branch {name} exists")
        return meta

    def list(self, status: str | None = None) -> list[dict]:
        found = [type(self.folder)(self.folder.spark, p).read() for p in self.folder.matching("*.json")]
        return [m for m in found if status in (None, m["status"])]

    def update(self, name: str, **fields) -> dict:
        meta = self._known(name)
        if bad := set(fields) - {"description", "status", "merged", "forks", "parent", "name"}:
            raise InvalidQuery(f"can't change {sorted(bad)} of a branch")
        meta |= fields | {"updated": dt.datetime.now(dt.timezone.utc).isoformat()}
        self._file(name).replace(meta)
        return meta

    def rename(self, name: str, to: str) -> dict:
        meta = self._known(name)
        if not _NAME.fullmatch(to) or to == MAIN or not self._file(to).create(meta | {"name": to}):
            raise InvalidQuery(f"{to!r} exists or can't name a branch")
        for child in self.children(name):
            self.update(child["name"], parent=to)
        self._file(name).delete()
        return self._known(to)

    def children(self, name: str) -> list[dict]:
        return [m for m in self.list() if m["parent"] == name]

    def ancestry(self, name: str) -> list[str]:
        """The branch's parents up to main, nearest first."""
        out, meta = [], self._known(name)
        while meta["parent"] is not None:
            out.append(meta["parent"])
            meta = self._known(meta["parent"])
        return out

    def delete(self, name: str, force: bool = False) -> None:
        meta = self._known(name)
        if name == MAIN:
            raise InvalidQuery("main can't be deleted")
        if not force and self.children(name):
            raise InvalidQuery(f"branch {name} has children")
        self._file(name).delete()
        (self.folder / f"data-{meta['id']}").delete()

    def stats(self) -> dict:
        found = self.list()
        return {"branches": len(found), **{s: sum(m["status"] == s for m in found) for s in ("active", "merged", "closed")}}

    # Data

    def checkout(self, name: str) -> Database:
        return self.database if name == MAIN else BranchDatabase(self, self._known(name))

    def _sides(self, name: str, collection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows at the fork, of the parent now, and of the branch."""
        branch = self.checkout(name)
        rows = branch[collection]
        mine, theirs = branch.parent[collection].scan(), rows.scan()
        base = rows.base()
        return (mine.limit(0) if base is None else base), mine, theirs

    def diff(self, name: str, collection: str, **options) -> DataFrame:
        """What a branch changed since its fork; options are those of `versioned.diff`."""
        base, _, branch = self._sides(name, collection)
        return versioned.diff(base, branch, **options)

    def conflicts(self, name: str, collection: str) -> DataFrame:
        base, main, branch = self._sides(name, collection)
        return versioned.conflicts(versioned.diff(base, main), versioned.diff(base, branch))

    def preview(self, name: str) -> dict[str, tuple[DataFrame, DataFrame]]:
        """For each collection that the branch wrote, its changes and its conflicts with the parent; nothing is written."""
        own = self.checkout(name).data.names(folders=True)
        return {c: (self.diff(name, c), self.conflicts(name, c)) for c in own}

    def merge(self, name: str, strategy: str = "ours", resolutions: Callable[[str], DataFrame | None] | None = None) -> dict[str, int]:
        """Merges a branch into its parent; `resolutions` gives the (key, take) rows of a collection for a manual merge. Gives the rows written."""
        from tessera.sources.scratch import materialize

        branch, written = self.checkout(name), {}
        for c in branch.data.names(folders=True):
            base, main, theirs = self._sides(name, c)
            merged = versioned.three_way_merge(base, main, theirs, strategy=strategy, resolutions=resolutions(c) if resolutions else None)
            d = versioned.diff(main, merged)
            rows = materialize(d.select("_id", F.when(F.col("change") == "insert", "i").when(F.col("change") == "delete", "d").otherwise("u").alias("_op"), "after.*"))
            written[c] = rows.count()
            if written[c]:
                branch.parent[c]._append(rows, None)
        self.update(name, status="merged", merged=written)
        return written

    def merge_many(self, names: list[str], strategy: str = "ours") -> dict[str, dict[str, int]]:
        """One after the other; each sees what those before wrote."""
        return {n: self.merge(n, strategy) for n in names}
