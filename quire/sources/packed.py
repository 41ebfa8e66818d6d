"""What the data sources of zipped XML files share: files in groups for reading, a folder that appears whole for writing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

#: Bytes of files that one task reads, about.
GROUP = 32 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


def listed(path: str, extension: str) -> list[tuple[str, int]]:
    """Files below a path with an extension, and their sizes, in order; trial files of writers are none."""
    store, root = fs.FileSystem.from_uri(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(f".{extension}"))


def groups(path: str, extension: str, most: int = GROUP) -> list[Files]:
    """Files on end, some ``most`` bytes in each group, so that small files share a task."""
    out: list[Files] = []
    held = most
    for name, size in listed(path, extension):
        if held + size > most:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(name)
        held += size
    return out


@dataclass
class Done(WriterCommitMessage):
    n: int


class FolderWriter:
    """Tasks write files into a trial folder, each under its name only when whole; the commit gives the folder its own name."""

    def __init__(self, path: str):
        self.path, self.trial = path.rstrip("/"), f"{path.rstrip('/')}.trial-{uuid.uuid4().hex}"

    def put(self, name: str, write: Callable[[BinaryIO], None]) -> None:
        store, root = fs.FileSystem.from_uri(self.trial)
        full = f"{root}/{name}"
        store.create_dir(full.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(own := f"{full}.{uuid.uuid4().hex}") as f:
            write(f)
        store.move(own, full)

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        _, trial = fs.FileSystem.from_uri(self.trial)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.path} is there already")
        store.create_dir(trial, recursive=True)  # of no rows
        store.move(trial, root)

    def abort(self, messages: list) -> None:
        store, trial = fs.FileSystem.from_uri(self.trial)
        if store.get_file_info(trial).type != fs.FileType.NotFound:
            store.delete_dir(trial)


def opened(paths: list[str], path: str) -> Iterator[tuple[str, BinaryIO]]:
    store, _ = fs.FileSystem.from_uri(path)
    for name in paths:
        with store.open_input_file(name) as f:
            yield name, f
