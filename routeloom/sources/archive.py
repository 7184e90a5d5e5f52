"""Rule archives (``.npz`` files of one array for each field) as a Spark data source: tasks read ranges of rows."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = {
    "rules": "rule_idx int, template string, native string, nb_prod int, score float, reaction_id string",
    "need": "rule_idx int, coord int, need int",
    "delta": "rule_idx int, coord int, delta int",
}
#: The archive's arrays of each table.
TEXTS = {"template": "template_reaction", "native": "smi_sub", "nb_prod": "nb_prod", "score": "score", "reaction_id": "reaction_id"}
MATRICES = {"need": ("ecfp_reaction_center", -1), "delta": ("ecfp_reaction", 1)}
ROWS = 5000
BLOCK = 500


class Archive:
    """An open archive: reads ranges of rows of a member, and no member whole but one of pickled objects."""

    def __init__(self, path: str, trusted: bool):
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.zip, self.trusted = zipfile.ZipFile(files.open_input_file(place)), trusted
        self.names = {n.removesuffix(".npy") for n in self.zip.namelist()}

    def header(self, name: str) -> tuple[tuple[int, ...], np.dtype]:
        with self.zip.open(f"{name}.npy") as source:
            return self._header(source)

    @staticmethod
    def _header(source) -> tuple[tuple[int, ...], np.dtype]:
        version = np.lib.format.read_magic(source)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = read(source)
        if by_column and len(shape) > 1:
            raise ValueError("arrays must be stored by rows")
        return shape, kind

    def blocks(self, name: str, begin: int, end: int, rows: int = BLOCK) -> Iterator[np.ndarray]:
        """The rows of a range, some at a time.  What lies before them is skipped: at once if the member is stored plainly."""
        with self.zip.open(f"{name}.npy") as source:
            shape, kind = self._header(source)
            if kind.hasobject:
                if not self.trusted:
                    raise ValueError(f"{name} holds pickled objects: reading them runs code from the archive")
                source.seek(0)
                yield np.lib.format.read_array(source, allow_pickle=True)[begin:end]
                return
            size = int(kind.itemsize * np.prod(shape[1:], dtype=np.int64))
            source.seek(source.tell() + begin * size)
            for at in range(begin, end, rows):
                n = min(rows, end - at)
                yield np.frombuffer(source.read(n * size), kind).reshape(n, *shape[1:])

    def column(self, name: str, begin: int, end: int) -> np.ndarray:
        return np.concatenate([*self.blocks(name, begin, end, end - begin)])


@dataclass
class Rows(InputPartition):
    begin: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "rules")
        self.trusted, self.rows = options.get("trusted", "false").lower() == "true", int(options.get("rows", ROWS))
        if self.table not in TABLES:
            raise ValueError(f"table must be one of {sorted(TABLES)}, got {self.table!r}")

    def partitions(self) -> list[InputPartition]:
        name = TEXTS["template"] if self.table == "rules" else MATRICES[self.table][0]
        n = Archive(self.path, self.trusted).header(name)[0][0]
        return [Rows(at, min(n, at + self.rows)) for at in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        archive = Archive(self.path, self.trusted)
        if self.table == "rules":
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float32(), pa.string())
            columns = [pa.array(np.arange(part.begin, part.end, dtype=np.int32))]
            for (name, member), kind in zip(TEXTS.items(), kinds, strict=True):
                if member not in archive.names and name == "reaction_id":
                    columns.append(pa.nulls(part.end - part.begin, kind))
                    continue
                values = archive.column(member, part.begin, part.end)
                columns.append(pa.array([None if v is None else str(v) for v in values], kind) if pa.types.is_string(kind) else pa.array(values.astype(kind.to_pandas_dtype()), kind))
            yield pa.RecordBatch.from_arrays(columns, ["rule_idx", *TEXTS])
            return
        member, sign = MATRICES[self.table]
        at = part.begin
        for block in archive.blocks(member, part.begin, part.end):
            r, c = np.nonzero(block)
            values = (sign * block[r, c].astype(np.int64)).astype(np.int32)
            if sign < 0 and (values < 0).any():
                raise ValueError("requirements must not be positive in the archive")
            yield pa.RecordBatch.from_arrays([pa.array((r + at).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(values)], ["rule_idx", "coord", self.table])
            at += len(block)


class RuleArchive(DataSource):
    """``spark.read.format("rule_archive")`` with options path, table (rules, need or delta), rows a task, and trusted.

    Text that is stored as Python objects is only read from a ``trusted`` archive, as that runs code from it.
    """

    @classmethod
    def name(cls) -> str:
        return "rule_archive"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "rules")]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
