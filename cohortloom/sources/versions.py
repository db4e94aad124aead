"""Tables in numbered versions, rebuilt together with what depends on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[["VersionedTables"], DataFrame]


@dataclass(frozen=True)
class Definition:
    """How a table is built and which tables it is built from."""

    build: Build
    uses: tuple[str, ...]


class VersionedTables:
    """Tables below one folder of a shared store, each in numbered versions.

    A version is written as a whole and published last, by an empty file with its number, so readers see the old one
    until the new one is complete, and still after a rebuild that failed. A table may be rebuilt from itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.definitions: dict[str, Definition] = {}

    # --- files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """The published versions, the newest last."""
        folder, files = self._path(name, "published"), self._files()
        return sorted(int(one.getPath().getName()) for one in files.listStatus(folder)) if files.exists(folder) else []

    def _publish(self, name: str, version: int) -> None:
        if not self._files().createNewFile(self._path(name, "published", f"{version:08d}")):
            raise RuntimeError(f"version {version} of {name} has been published by another writer")

    # --- reading and writing

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The newest published version, or one that is named."""
        known = self.versions(name)
        if not known or (version is not None and version not in known):
            raise KeyError(f"no table {name}" if version is None else f"no version {version} of {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{(known[-1] if version is None else version):08d}")

    def write(self, name: str, df: DataFrame) -> int:
        """Write and publish the next version; the ones before stay."""
        version = max([0, *self.versions(name)]) + 1
        # What an unfinished attempt has left at this number is written over.
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version:08d}")
        self._publish(name, version)
        return version

    def keep(self, name: str, newest: int = 1) -> None:
        """Remove all versions but the newest ones, the record of a version before its rows."""
        for version in self.versions(name)[: -max(1, newest)]:
            self._files().delete(self._path(name, "published", f"{version:08d}"), False)
            self._files().delete(self._path(name, f"v{version:08d}"), True)

    # --- definitions

    def define(self, name: str, build: Build, uses: Sequence[str] = ()) -> None:
        """Say how a table is built. The tables it uses must be defined or written; itself is among them if it likes."""
        for other in uses:
            if other != name and other not in self.definitions and not self.versions(other):
                raise KeyError(f"{name} uses {other}, which is not known")
        self.definitions[name] = Definition(build, tuple(other for other in uses if other != name))
        self.dependants(name)  # finds circles

    def dependants(self, name: str) -> list[str]:
        """The tables built from this one, directly or not, each after all that it is built from."""
        order: list[str] = []
        open_: set[str] = set()

        def visit(one: str) -> None:
            if one in open_:
                raise ValueError(f"{one} is built from itself by way of other tables")
            if one in order:
                return
            open_.add(one)
            for other in sorted(other for other, definition in self.definitions.items() if one in definition.uses):
                visit(other)
            open_.discard(one)
            order.append(one)

        visit(name)
        return order[::-1][1:]

    def rebuild(self, name: str) -> list[str]:
        """Build a table anew, and then its dependants in order; returns what was published.

        If one fails, it and the tables behind it keep their old versions and the error goes on to the caller.
        """
        done = []
        for one in [name, *self.dependants(name)]:
            if one in self.definitions:
                self.write(one, self.definitions[one].build(self))
                done.append(one)
        return done

    def drop(self, name: str, cascade: bool = False) -> list[str]:
        """Remove a table; one that others are built from goes only together with them. Returns what has gone."""
        others = self.dependants(name)
        if others and not cascade:
            raise ValueError(f"{name} is used by {', '.join(others)}")
        gone = [*others[::-1], name]
        for one in gone:
            self._files().delete(self._path(one, "published"), True)
            self._files().delete(self._path(one), True)
            self.definitions.pop(one, None)
        return gone
