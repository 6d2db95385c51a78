"""Captions as a data source: ``spark.read.format("captions")`` and ``df.write.format("captions")``.

Reading lists a folder, deals its files to partitions by size and gives one row a file: path, kind, text and,
where a file is refused, reason. Nothing is refused by an error, and a refused file's text is null.
Writing takes cues (name, seq, start_ms, end_ms, text), one SubRip file a name: ``write_srt`` brings a
name's cues together and in order. Tasks write below ``_temporary``; files are put in their places when all
tasks are done, and a job that fails leaves none of them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

READ = "path string, kind string, text string, reason string"
WRITTEN = ["name", "seq", "start_ms", "end_ms", "text"]
KINDS = ("srt", "vtt", "json3")
#: Bytes of files that one partition reads; a larger file is a partition of its own.
PARTITION_BYTES = 32 << 20


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Files of one partition: path and kind."""

    files: list

    def __init__(self, files: list):
        super().__init__(None)
        self.files = files


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote: where they are, and the names they are to have."""

    moves: list


class CaptionReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = re.compile(r"(^|/)[._]")
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and not hidden.search(f.path[len(root):].lstrip("/")))
        parts, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.most:
                parts, held, size = [*parts, Files(held)], [], 0
            held.append((path, path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""))
            size += n
        return [*parts, Files(held)] if held else [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path, kind in partition.files:
            if kind not in KINDS:
                yield path, kind, None, "unknown kind of file"
                continue
            with system.open_input_stream(path, compression=None) as stream:
                raw = stream.read()
            try:
                yield path, kind, raw.decode("utf-8-sig"), None
            except UnicodeDecodeError as bad:
                yield path, kind, None, f"not UTF-8 at byte {bad.start}"


def timecode(ms: int) -> str:
    return f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02},{ms % 1000:03}"


class SubtitleWriter(DataSourceWriter):
    """One task writes a name's file, cue after cue; a name that comes back, or in two tasks, is refused."""

    def __init__(self, path: str, overwrite: bool, columns: list):
        missing = [c for c in WRITTEN if c not in columns]
        if missing:
            raise ValueError(f"captions need columns {', '.join(missing)}")
        self.path, self.overwrite = path, overwrite
        self.staging = f"_temporary/{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        moves, seen, name, out, number = [], set(), None, None, 0
        try:
            for row in rows:
                if out is None or row["name"] != name:
                    if out is not None:
                        out.close()
                    name, number = row["name"], 0
                    if not name or not re.fullmatch(r"[^/\\\x00]+", name) or name[0] in "._":
                        raise ValueError(f"{name!r} is no name of a file")
                    if name in seen:
                        raise ValueError(f"cues of {name!r} are not together")
                    seen.add(name)
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}.srt", compression=None)
                    moves.append((f"{folder}/{name}.srt", f"{name}.srt"))
                line = re.sub(r"\s*\n\s*", "\n", (row["text"] or "").strip())
                if line:
                    number += 1
                    out.write(f"{number}\n{timecode(row['start_ms'])} --> {timecode(row['end_ms'])}\n{line}\n\n".encode())
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = opened(self.path)
        moves = [m for message in messages if message is not None for m in message.moves]
        names = [n for _, n in moves]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if twice:
            self.abort(messages)
            raise ValueError(f"cues of {twice[0]} lie in several tasks")
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File}
        if self.overwrite:
            for old in there - set(names):
                if old.endswith(".srt"):
                    system.delete_file(f"{root}/{old}")
        elif there & set(names):
            self.abort(messages)
            raise ValueError(f"{sorted(there & set(names))[0]} exists")
        for source, target in moves:
            system.move(source, f"{root}/{target}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Deletes what tasks wrote."""
        from pyarrow import fs

        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")
        rest = system.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True))
        if not rest and system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


class Captions(DataSource):
    """Options: ``path``; ``partitionBytes`` for reading."""

    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return CaptionReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SubtitleWriter(self.options["path"], overwrite, schema.names)


def read_captions(spark: SparkSession, folder: str) -> DataFrame:
    """The files below ``folder``: path, kind, text, reason."""
    spark.dataSource.register(Captions)
    return spark.read.format("captions").load(folder)


def write_srt(cues: DataFrame, folder: str, mode: str = "append") -> None:
    """One ``.srt`` a name, cues by seq; a name's cues, a few thousand, are one task's.

    Blank lines inside a text, which would end a cue, go, and so do cues without text, as numbers run over
    the rest. ``append`` refuses names that exist, ``overwrite`` replaces all ``.srt`` of the folder.
    """
    cues.sparkSession.dataSource.register(Captions)
    cues.select(*WRITTEN).repartition("name").sortWithinPartitions("name", "seq").write.format("captions").mode(mode).save(folder)
