"""Writers.  Spark's own commit protocol makes each write whole or absent."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MARKER = "_done"


def _marker(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark, path: str) -> str | None:
    """The mode in which the table at ``path`` was made, or nothing where no marker says that it is whole."""
    at, files = _marker(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def once(df: DataFrame, path: str, mode: str, write: Callable[[DataFrame, str], None]) -> bool:
    """``write(df, path)`` unless it was done before in the same ``mode``; tells whether it wrote.  The marker, which
    carries the mode, is written last, so a write that broke off or was made in another mode is made again."""
    spark = df.sparkSession
    if finished(spark, path) == mode:
        return False
    at, files = _marker(spark, path)
    files.delete(at.getParent(), True)
    write(df, path)
    stream = files.create(at, True)
    stream.write(bytearray(mode.encode()))
    stream.close()
    return True


def tsv(df: DataFrame, path: str, compress: bool = True) -> None:
    """Tab-separated with a header; an empty table still writes its header."""
    df.write.csv(path, sep="\t", header=True, compression="gzip" if compress else "none", emptyValue="")


def fasta_record(name: Column, seq: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def fasta(df: DataFrame, name: str, seq: str, path: str, width: int = 60) -> None:
    df.select(fasta_record(F.col(name), F.col(seq), width)).write.text(path)


def batched(df: DataFrame, batch: str, path: str) -> None:
    """One folder per batch; rows of a batch meet in one task, which is its file."""
    df.repartition(batch).write.partitionBy(batch).csv(path, sep="\t", header=True)


def json_document(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns))).coalesce(1).write.text(path)


def matrix(long: DataFrame, row: str, column: str, value: str, columns: list, path: str) -> None:
    """Dense matrix with two decimals from a long form and a stated column list; empty where a
    cell has no value."""
    wide = long.groupBy(row).pivot(column, columns).agg(F.first(value))
    wide.select(row, *[F.when(F.col(f"`{c}`").isNotNull(), F.format_string("%.2f", F.col(f"`{c}`"))).alias(str(c)) for c in columns]).orderBy(row).coalesce(1).write.csv(path, sep="\t", header=True)


def graphml(nodes: DataFrame, edges: DataFrame, attributes: list[str], weight: str) -> Iterable[str]:
    """Lines of a GraphML document, streamed partition by partition."""
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    for a in attributes:
        yield f'<key id="{escape(a)}" for="node" attr.name="{escape(a)}" attr.type="string"/>'
    yield f'<key id="{escape(weight)}" for="edge" attr.name="{escape(weight)}" attr.type="double"/>'
    yield '<graph edgedefault="undirected">'
    for r in nodes.toLocalIterator():
        data = "".join(f'<data key="{escape(a)}">{escape(str(r[a]))}</data>' for a in attributes if r[a] is not None)
        yield f'<node id="{escape(str(r[0]))}">{data}</node>'
    for r in edges.toLocalIterator():
        yield f'<edge source="{escape(str(r["u"]))}" target="{escape(str(r["v"]))}"><data key="{escape(weight)}">{r[weight]}</data></edge>'
    yield "</graph></graphml>"


def markdown(df: DataFrame, columns: list[str] | None = None, floats: str = "%.3f", limit: int = 1000) -> str:
    """A report table; what is longer than ``limit`` rows belongs in a file, and raises."""
    columns = columns or df.columns
    rows = df.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows for a report table")
    show = lambda v: "" if v is None else floats % v if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]])
