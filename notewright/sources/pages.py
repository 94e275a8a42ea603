"""Document files as page blocks through named adapters: a Python data source, a partition a group of files.

Files are listed and opened by their URI, so any store that Arrow's file systems know will do. The driver lists the
top folder alone: each folder in it is listed by the task that reads it, so the driver holds no name of their files.
Every adapter reads every file and all their blocks are united; what an adapter could not do is a row with its status,
never a failure.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from notewright.operators.hooks import BrokenParser, LineParser, Parser

SCHEMA = "path string, backend string, status string, page_num int, reading_order int, role string, text string, bbox array<double>, error string"
#: Adapters by name; a cluster's own are registered with ``register_pages``.
ADAPTERS: dict[str, Callable[[], Parser]] = {"lines": LineParser, "broken": BrokenParser}
#: Bytes of files that one task reads, a file of any size at least.
GROUP_BYTES = 64 << 20
#: Folders that a task writes its files into.
FOLDERS = 16


@dataclass
class FileGroup(InputPartition):
    """Paths that one task reads, or a folder with all below it."""

    paths: tuple[str, ...]
    folder: str | None = None


def blocks_of(path: str, content: bytes, names: list[str], parsers: dict[str, Parser | None]) -> Iterator[tuple]:
    """Rows of one file: each adapter's blocks, pages cut at form feeds where blocks have no page, and a status row."""
    for name in names:
        if name not in parsers:
            yield path, name, "unknown_parser", None, None, None, None, None, None
            continue
        parser = parsers[name]
        if parser is None:
            yield path, name, "not_available", None, None, None, None, None, None
            continue
        try:
            order, rows = 0, []
            for page, part in enumerate(content.split(b"\f"), 1):
                for block in parser.parse(part):
                    order += 1
                    box = block.get("bbox")
                    rows.append((path, name, "block", block.get("page_num") or page, order, block.get("role"), block.get("text"), None if box is None else [float(x) for x in box], None))
        except Exception as e:  # an adapter may raise anything; the row carries it
            yield path, name, "failed", None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]
            continue
        yield from rows
        yield path, name, "ok", None, None, None, None, None, None


def pages_source(adapters: dict[str, Callable[[], Parser]]) -> type[DataSource]:
    """The data source class of a set of adapters."""

    class PageReader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.path = options["path"]
            self.names = [x.strip() for x in options.get("adapters", "lines").split(",") if x.strip()]
            self.group_bytes = int(options.get("groupbytes", GROUP_BYTES))

        def _store(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.path)

        def _files(self, store, folder: str, recursive: bool) -> list:
            from pyarrow import fs

            found = store.get_file_info(fs.FileSelector(folder, recursive=recursive))
            return sorted((f for f in found if not f.base_name.startswith(("_", "."))), key=lambda f: f.path)

        def partitions(self) -> list[FileGroup]:
            store, root = self._store()
            files = self._files(store, root, recursive=False)
            groups, held, size = [FileGroup((), f.path) for f in files if not f.is_file], [], 0
            for f in (f for f in files if f.is_file):
                if held and size + f.size > self.group_bytes:
                    groups.append(FileGroup(tuple(held)))
                    held, size = [], 0
                held.append(f.path)
                size += f.size
            return [*groups, FileGroup(tuple(held))] if held or not groups else groups

        def read(self, partition: FileGroup) -> Iterator[tuple]:
            store, _ = self._store()
            made = {n: adapters[n]() for n in self.names if n in adapters}
            parsers = {n: p if p.is_available() else None for n, p in made.items()}
            below = (f.path for f in self._files(store, partition.folder, recursive=True) if f.is_file) if partition.folder else ()
            for path in (*partition.paths, *below):
                with store.open_input_stream(path) as stream:
                    content = stream.read()
                yield from blocks_of(path, content, self.names, parsers)

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> PageReader:
            return PageReader(self.options)

    return PageSource


def register_pages(spark: SparkSession, adapters: dict[str, Callable[[], Parser]] | None = None) -> None:
    """Makes ``spark.read.format("pages")`` known, with the library's adapters and more."""
    spark.dataSource.register(pages_source({**ADAPTERS, **(adapters or {})}))


def read_pages(spark: SparkSession, path: str, adapters: list[str], group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(blocks, status) of all files below ``path``: blocks of all adapters, and a row for each file and adapter."""
    rows = spark.read.format("pages").option("path", path).option("adapters", ",".join(adapters)).option("groupBytes", str(group_bytes)).load()
    return rows.where("status = 'block'").drop("status", "error"), rows.where("status <> 'block'").select("path", "backend", "status", "error")


def write_files(df: DataFrame, name: str, text: str, folder: str) -> int:
    """Writes each row's text and a line feed as a file ``name=<value>-<n>.txt`` below ``folder``; how many there are.

    A task writes its rows into folders of its own, equal names numbered, so a task that runs again replaces its files.
    The driver receives a number a task, no name.
    """

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        part, seen, made = TaskContext.get().partitionId(), Counter(), set()
        for batch in batches:
            for value, content in zip(batch.column(0), batch.column(1)):
                key = "" if not value.is_valid else str(value)
                below = f"{root}/part-{part:05d}-{zlib.crc32(key.encode()) % FOLDERS:02d}"
                if below not in made:
                    store.create_dir(below, recursive=True)
                    made.add(below)
                with store.open_output_stream(f"{below}/{name}={key}-{seen[key]}.txt") as out:
                    out.write((content.as_py() or "").encode() + b"\n")
                seen[key] += 1
        yield pa.record_batch({"n": pa.array([seen.total()], pa.int64())})

    return df.select(F.col(name).cast("string"), F.col(text)).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
