"""Records of FASTA files by identifier: a data source that stops reading a file once all it was asked for is found.

    spark.dataSource.register(FastaLookup)
    spark.read.format("fasta_lookup").option("wanted", table).load()

``wanted`` is a JSON array of [path, [id, …]] (``lookup`` makes it from a table).  A file is a partition, read
line by line from the start.  With the option ``pushdown`` (and ``spark.sql.python.filterPushdown.enabled``, which
Spark then asks for) a filter on ``seq_id`` or ``path`` narrows what is asked of each file before it is opened, and files
of which nothing is left are not read at all.  Files are opened by pyarrow's file systems (local, HDFS, object
stores), gzip by suffix.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.joins import CheckFailed

SCHEMA = "path string, seq_id string, header string, seq string, records_read long"
WANTED_BYTES = 64 << 20


class FilePart(InputPartition):
    def __init__(self, path: str, ids: list[str]):
        self.path, self.ids = path, ids


def opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = unquote(urlparse(path).path)
    at, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    raw = at.open_input_stream(name, compression=None)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw), encoding="utf-8")


def found(lines, ids: set[str]) -> Iterator[tuple[str, str, str, int]]:
    """(id, header, sequence, records begun so far) of the first record of each of ``ids``, until all are found."""
    left, header, parts, n = set(ids), None, [], 0
    if not left:
        return
    for line in lines:
        if not line.startswith(">"):
            if header is not None:
                parts.append("".join(line.split()))
            continue
        if header is not None:
            yield header.split()[0], header, "".join(parts), n
            header = None
            if not left:
                return
        n += 1
        name = line[1:].strip()
        key = name.split()[0] if name else ""
        if key in left:
            left.discard(key)
            header, parts = name, []
    if header is not None:
        yield header.split()[0], header, "".join(parts), n


class LookupReader(DataSourceReader):
    def __init__(self, wanted: list):
        self.wanted = {path: set(ids) for path, ids in wanted}

    def partitions(self):
        return [FilePart(path, sorted(ids)) for path, ids in sorted(self.wanted.items()) if ids] or [FilePart("", [])]

    def read(self, partition: FilePart):
        if not partition.ids:
            return
        with opened(partition.path) as lines:
            for seq_id, header, seq, n in found(lines, set(partition.ids)):
                yield partition.path, seq_id, header, seq, n


class PushingReader(LookupReader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("seq_id",):
                only = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = {path: ids & only for path, ids in self.wanted.items()}
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                only = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = {path: ids for path, ids in self.wanted.items() if path in only}
            else:
                yield f


class FastaLookup(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_lookup"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LookupReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else LookupReader
        return kind(json.loads(self.options["wanted"]))


def lookup(wanted: DataFrame, path: str = "path", seq_id: str = "seq_id") -> DataFrame:
    """(path, seq_id, header, seq, records_read) of each wanted (path, id) that its file has, the first of
    repeats; ``records_read`` tells how far the file was read for it.  The list goes through the plan of the read,
    so its bytes are counted first and at most WANTED_BYTES; beyond that ``fasta`` and a join serve."""
    spark = wanted.sparkSession
    asked = wanted.where(F.col(path).isNotNull() & F.col(seq_id).isNotNull()).select(F.col(path).alias("path"), F.col(seq_id).alias("seq_id")).distinct()
    size = asked.agg(F.sum(F.octet_length("path") + F.octet_length("seq_id"))).first()[0] or 0
    if size > WANTED_BYTES:
        raise CheckFailed(f"{size} bytes of wanted ids; the limit is {WANTED_BYTES}: read the files and join")
    rows = asked.groupBy("path").agg(F.sort_array(F.collect_list("seq_id")).alias("ids")).collect()
    spark.dataSource.register(FastaLookup)
    return spark.read.format("fasta_lookup").option("wanted", json.dumps([[r["path"], r["ids"]] for r in rows])).load()


def missing(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(path, n_missing): files that did not have all that was asked of them."""
    asked = wanted.select("path", "seq_id").distinct()
    return asked.join(got.select("path", "seq_id"), ["path", "seq_id"], "left_anti").groupBy("path").agg(F.count("*").alias("n_missing"))
