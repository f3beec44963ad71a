"""Folders of score files as a Spark data source: ``segno_scores``.

    register(spark)
    spark.read.format("segno_scores").option("kind", "midi").load(folder)
    encoded_scores(notes, ["piece"]).select("path", "content").write.format("segno_scores").mode("append").save(folder)

Reading plans its partitions by the files' sizes; a task parses one file at a time, and a file that cannot
be parsed is a row with an error. Writing is all or nothing: tasks write below a staging folder of the
write, under names of their own, so an attempt that failed or ran twice leaves nothing that counts; the
commit moves the told files to their places and, if one cannot be moved, takes back those that were;
what is left of the staging folder goes either way. An existing file is an error in mode ``append`` and
is replaced in mode ``overwrite``, which keeps files that the write does not name.

With option ``packs`` a task's files lie in packs, gzipped tar archives of some PACK_BYTES before compression: small
files that are alike take less disk so, and no block each. A pack is written all or nothing like a file; names in it are
not compared with those in other packs. Read with that option, the folder gives the files in its packs, each under the
path that it would have beside its pack; a pack that cannot be read to its end is a row with an error behind those
of its files that could.

``folder`` may be any address that pyarrow opens (a path, file://, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from segno.shipping import ship_package

from . import scores

#: What each kind of file gives: its rows, its parser and the names that it has.
KINDS = {"midi": (scores.MIDI_NOTES, scores.parse_midi, "*.mid"), "musicxml": (scores.EVENTS, scores.parse_musicxml, "*.musicxml"), "files": ("path string, content binary", None, "*")}
#: Bytes of the files of one partition, beside single larger ones, and what a file counts for at least.
PARTITION_BYTES, FILE_BYTES = 32 << 20, 64 << 10
#: What packs end with, and bytes of the files of one, beside single larger ones.
PACK, PACK_BYTES = ".pack.tar.gz", 32 << 20


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ScoreSource)


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    """(staged, place) below the folder, of the files of one task."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class ScoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segno_scores"

    def _kind(self) -> tuple:
        kind = self.options.get("kind", "files")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind}")
        return KINDS[kind]

    def _packs(self) -> bool:
        return self.options.get("packs", "false").lower() == "true"

    def schema(self) -> str:
        return self._kind()[0]

    def reader(self, schema: StructType) -> DataSourceReader:
        _, parse, pattern = self._kind()
        return ScoreReader(self.options["path"], self.options.get("pattern", pattern), parse, schema, int(self.options.get("partition_bytes", PARTITION_BYTES)), self._packs())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if missing := {"path", "content"} - set(schema.fieldNames()):
            raise ValueError(f"rows to write need {' and '.join(sorted(missing))}")
        return ScoreWriter(self.options["path"], overwrite, self._packs())


class ScoreReader(DataSourceReader):
    def __init__(self, folder: str, pattern: str, parse, schema: StructType, partition_bytes: int, packs: bool = False):
        self.folder, self.pattern, self.parse, self.schema, self.partition_bytes, self.packs = folder, pattern, parse, schema, partition_bytes, packs

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        held = [f for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, f"*{PACK}" if self.packs else self.pattern) and not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/"))]
        out, size = [Files()], 0
        for f in sorted(held, key=lambda f: f.path):
            cost = self.partition_bytes if self.packs else max(f.size, FILE_BYTES)
            if out[-1].paths and size + cost > self.partition_bytes:
                out.append(Files())
                size = 0
            out[-1].paths.append(f.path)
            size += cost
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = fs.FileSystem.from_uri(self.folder)
        kind = to_arrow_schema(self.schema)
        for held in partition.paths:
            for path, content in self._in_pack(store, held) if self.packs else self._file(store, held):
                rows = [{"content": content}]
                if self.parse is not None:
                    try:
                        if isinstance(content, Exception):
                            raise content
                        rows = list(self.parse(content))
                    except Exception as e:  # noqa: BLE001  a bad file is a row
                        rows = [{"error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{"path": path} | r for r in rows], schema=kind)

    def _file(self, store: fs.FileSystem, path: str) -> Iterator[tuple[str, bytes]]:
        with store.open_input_file(path) as f:
            yield path, f.read()

    def _in_pack(self, store: fs.FileSystem, path: str) -> Iterator[tuple[str, bytes | Exception]]:
        """The files of a pack, one at a time; what ends the pack early, if kinds have errors, is told under its own path."""
        try:
            with store.open_input_stream(path, compression=None) as f, gzip.GzipFile(fileobj=f, mode="rb") as z, tarfile.open(fileobj=z, mode="r|") as pack:
                for member in pack:
                    content = pack.extractfile(member).read()
                    if len(content) < member.size:
                        raise EOFError(f"{member.name} ends early")
                    if fnmatch(posixpath.basename(member.name), self.pattern):
                        yield f"{posixpath.dirname(path)}/{member.name}", content
                while z.read(1 << 16):  # to the end: gzip tells its checksum there
                    pass
        except Exception as e:
            if self.parse is None:
                raise
            yield path, e


class ScoreWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, packs: bool = False):
        self.folder, self.overwrite, self.packs, self.staging = folder, overwrite, packs, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, root = fs.FileSystem.from_uri(self.folder)
        own, moves = f"{self.staging}/{uuid.uuid4().hex}", []
        if self.packs:
            return Written(self._write_packs(store, root, own, iterator))
        for k, row in enumerate(iterator):
            place = self._place(row["path"])
            store.create_dir(f"{root}/{own}", recursive=True)
            with store.open_output_stream(f"{root}/{own}/{k}", compression=None) as out:
                out.write(bytes(row["content"]))
            moves.append((f"{own}/{k}", place))
        return Written(moves)

    def _place(self, path: str) -> str:
        place = posixpath.normpath(path)
        if place.startswith(("/", "..")):
            raise ValueError(f"{path} is not below the folder")
        return place

    def _write_packs(self, store: fs.FileSystem, root: str, own: str, rows: Iterator) -> list[tuple[str, str]]:
        moves, row = [], next(rows, None)
        while row is not None:
            name, size = f"{uuid.uuid4().hex}{PACK}", 0
            store.create_dir(f"{root}/{own}", recursive=True)
            with store.open_output_stream(f"{root}/{own}/{name}", compression=None) as out, gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w|") as pack:
                while row is not None and size < PACK_BYTES:
                    content, member = bytes(row["content"]), tarfile.TarInfo(self._place(row["path"]))
                    member.size = len(content)
                    pack.addfile(member, io.BytesIO(content))
                    size += len(content)
                    row = next(rows, None)
            moves.append((f"{own}/{name}", name))
        return moves

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        moves = [m for told in messages if told is not None for m in told.moves]
        places = [place for _, place in moves]
        done: list[str] = []
        aside: list[str] = []
        try:
            if len(set(places)) < len(places):
                raise FileExistsError("two rows name one file")
            for place in places:
                if store.get_file_info(f"{root}/{place}").type == fs.FileType.NotFound:
                    continue
                if not self.overwrite:
                    raise FileExistsError(f"{place} exists")
                store.create_dir(posixpath.dirname(f"{root}/{self.staging}/old/{place}"), recursive=True)
                store.move(f"{root}/{place}", f"{root}/{self.staging}/old/{place}")
                aside.append(place)
            for staged, place in moves:
                store.create_dir(posixpath.dirname(f"{root}/{place}"), recursive=True)
                store.move(f"{root}/{staged}", f"{root}/{place}")
                done.append(place)
        except Exception:
            for place in done:
                store.delete_file(f"{root}/{place}")
            for place in aside:
                store.move(f"{root}/{self.staging}/old/{place}", f"{root}/{place}")
            raise
        finally:
            self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        self._clear(store, root)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")
