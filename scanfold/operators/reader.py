"""What a user's inspection function may do with one object: read, search, remember, unpack, look into scripts, PDF and JSON."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import normalize_script


class Reader:
    """One object's bytes with a place in them, and sets and maps that live as long as it is inspected."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.sets: dict[str, set[int]] = {}
        self.maps: dict[str, dict[bytes, bytes]] = {}

    def read(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        self.at += len(out := self.data[self.at : self.at + max(0, n)])
        return out

    def seek(self, to: int, whence: int = 0) -> int:
        """Go to a place from the start, from here (1) or from the end (2); -1 where there is none."""
        place = to + (0, self.at, len(self.data))[whence]
        if not 0 <= place <= len(self.data):
            return -1
        self.at = place
        return place

    def find(self, needle: bytes, limit: int | None = None) -> int:
        """Where the bytes next stand from here on, -1 if nowhere."""
        return self.data.find(needle, self.at, limit)

    def add(self, name: str, key: int) -> None:
        self.sets.setdefault(name, set()).add(key)

    def contains(self, name: str, key: int) -> bool:
        return key in self.sets.get(name, ())

    def put(self, name: str, key: bytes, value: bytes) -> None:
        self.maps.setdefault(name, {})[key] = value

    def value(self, name: str, key: bytes) -> bytes | None:
        return self.maps.get(name, {}).get(key)

    def inflated(self, n: int, limit: int = 1 << 24, raw: bool = False) -> bytes:
        """The next ``n`` bytes, inflated as far as they go."""
        try:
            return zlib.decompressobj(-15 if raw else 15).decompress(self.read(n), limit)
        except zlib.error:
            return b""

    def script(self, n: int) -> str:
        """The next ``n`` bytes as a normalised script."""
        return normalize_script(self.read(n).decode("utf-8", "replace"))

    def pdf_object(self, number: int, generation: int = 0) -> bytes | None:
        """The body of a PDF object by its number; the last definition counts."""
        found = re.findall(rb"(?s)(?<!\d)%d\s+%d\s+obj\b(.*?)endobj" % (number, generation), self.data)
        return found[-1] if found else None

    def json_value(self, path: str) -> object:
        """The value at a dotted path of the object as JSON, None where there is none."""
        try:
            now = json.loads(self.data)
        except (ValueError, RecursionError):
            return None
        for key in path.split("."):
            if isinstance(now, list) and key.isdigit() and int(key) < len(now):
                now = now[int(key)]
            elif isinstance(now, dict) and key in now:
                now = now[key]
            else:
                return None
        return now


def inspected(objects: DataFrame, look: Callable[[Reader], str | None], *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, name) of what ``look`` says of each object; None says nothing. A function that raises ends the query."""
    rows = objects.select(F.col(id_col).alias("id"), F.col(content).cast("binary").alias("content")).where("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [look(Reader(batch.column("content")[k].as_py())) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(said, pa.string())], names=["id", "name"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, name string")
    return out.where("name is not null").withColumnRenamed("id", id_col)
