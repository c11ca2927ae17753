"""Cursors: documents of a query in batches, with only one partition of the result on the driver at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class Cursor:
    """Iterates over a query's documents. The query is planned when the first document is asked for, and again after `rewind`."""

    def __init__(self, make: Callable[[], DataFrame], batch_size: int = 1000) -> None:
        self._make, self._size, self._steps, self._maps = make, batch_size, [], []
        self._rows: Iterator | None = None
        self._peeked: list = []
        self.closed = False

    # Before the first document

    def _add(self, step: Callable[[DataFrame], DataFrame]) -> Cursor:
        if self._rows is not None or self.closed:
            raise RuntimeError("the cursor has begun")
        self._steps.append(step)
        return self

    def sort(self, spec: dict) -> Cursor:
        from tessera.plans.pipeline import sort_columns

        return self._add(lambda df: df.orderBy(*sort_columns(df, spec)))

    def skip(self, n: int) -> Cursor:
        return self._add(lambda df: df.offset(n))

    def limit(self, n: int) -> Cursor:
        return self._add(lambda df: df.limit(n))

    def project(self, spec: dict) -> Cursor:
        from tessera.operators.shape import project

        return self._add(lambda df: project(df, spec))

    def map(self, f: Callable[[dict], object]) -> Cursor:
        """Documents pass through `f`, after those added before."""
        self._maps.append(f)
        return self

    def frame(self) -> DataFrame:
        df = self._make()
        for step in self._steps:
            df = step(df)
        return df

    # Reading

    def _begin(self) -> Iterator:
        if self.closed:
            return iter(())
        if self._rows is None:
            self._rows = self.frame().toLocalIterator(prefetchPartitions=True)
        return self._rows

    def __iter__(self) -> Cursor:
        return self

    def __next__(self) -> object:
        if self._peeked:
            return self._peeked.pop()
        doc = next(self._begin()).asDict(recursive=True)
        for f in self._maps:
            doc = f(doc)
        return doc

    def has_next(self) -> bool:
        if not self._peeked:
            try:
                self._peeked.append(next(self))
            except StopIteration:
                return False
        return True

    def next(self) -> object | None:
        """The next document, or None at the end."""
        return next(self, None)

    def next_batch(self) -> list:
        return list(itertools.islice(self, self._size))

    def batches(self) -> Iterator[list]:
        while batch := self.next_batch():
            yield batch

    def for_each(self, f: Callable[[object], object]) -> None:
        """Calls `f` for each document until it gives False."""
        for doc in self:
            if f(doc) is False:
                break

    def to_list(self) -> list:
        return list(self)

    def count(self) -> int:
        return self.frame().count()

    def rewind(self) -> Cursor:
        self._rows, self._peeked, self.closed = None, [], False
        return self

    def close(self) -> None:
        self._rows, self._peeked, self.closed = None, [], True
