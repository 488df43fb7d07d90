"""Code-intelligence indexes in the SCIP wire format as rows, and as a graph.

An index is one message that holds a message for each document. Files are read as binary rows; a pass over the top level, which looks at
lengths alone, cuts each into its documents, these are dealt anew and decoded by themselves, so a large index is
decoded by many tasks. What symbols are, who contains whom and what refers to what is decided by joins over the decoded rows.

Damaged files and documents give a row with the reason in `error` instead of ending the run. Null and empty files have no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.joins import innermost, overlapping

# Field numbers of the format's messages, and bits of an occurrence's roles.
DOCUMENTS = 2
PATH, OCCURRENCES, SYMBOLS = 1, 2, 3
RANGE, SYMBOL, ROLES, ENCLOSING = 1, 2, 3, 7
RELATED = 4
DEFINITION, IMPORT, WRITE, READ, TEST = 1, 2, 4, 8, 32

OCCURRENCE = "path string, symbol string, roles int, line int, column int, end_line int, body_start int, body_end int, error string"
RELATION = "path string, symbol string, other string, reference boolean, implementation boolean, error string"


def varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Field numbers with their values: numbers, or the bytes of texts and messages."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 2, 5):
            size, at = varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            if at + size > len(data):
                raise ValueError("a field beyond the end")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _numbers(value: int | memoryview) -> list[int]:
    """A repeated number, packed or by itself."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = varint(value, at)
        out.append(n)
    return out


def _text(value: int | memoryview) -> str:
    return bytes(value).decode("utf-8", "replace") if isinstance(value, memoryview) else ""


def documents(files: DataFrame) -> DataFrame:
    """index, document (bytes), error of the files (path, content)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                found, error = [], None
                try:
                    found = [bytes(v) for n, v in fields(memoryview(content or b"")) if n == DOCUMENTS and isinstance(v, memoryview)]
                except (ValueError, IndexError) as e:
                    error = str(e)
                rows = [(path, d, None) for d in found] + ([(path, None, error)] if error else [])
                yield pd.DataFrame(rows, columns=["index", "document", "error"])

    return files.select("path", "content").mapInPandas(cut, "index string, document binary, error string")


def _decoded(docs: DataFrame, schema: str, take) -> DataFrame:
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for document, error in zip(b["document"], b["error"], strict=True):
                if document is None:
                    rows.append((*([None] * (len(names) - 1)), error))
                    continue
                try:
                    parts = [*fields(memoryview(document))]
                    path = next((_text(v) for n, v in parts if n == PATH), "")
                    rows += [(path, *r, None) for n, v in parts for r in take(n, v)]
                except (ValueError, IndexError) as e:
                    rows.append((*([None] * (len(names) - 1)), str(e)))
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="object") for k, n in enumerate(names)})

    return docs.select("document", "error").mapInPandas(decode, schema)


def occurrences(docs: DataFrame) -> DataFrame:
    """path, symbol, roles, line, column, end_line, body_start, body_end (lines from 1), error: a row for each place of a symbol."""

    def take(number: int, value: int | memoryview) -> list[tuple]:
        if number != OCCURRENCES or isinstance(value, int):
            return []
        at, body, symbol, roles = [], [], "", 0
        for n, v in fields(value):
            if n == RANGE:
                at += _numbers(v)
            elif n == ENCLOSING:
                body += _numbers(v)
            elif n == SYMBOL:
                symbol = _text(v)
            elif n == ROLES and isinstance(v, int):
                roles = v
        lines = lambda r: (r[0] + 1, (r[2] if len(r) > 3 else r[0]) + 1) if len(r) >= 3 else (None, None)
        (line, end), (first, last) = lines(at), lines(body)
        return [(symbol, roles, line, at[1] if len(at) > 1 else None, end, first, last)]

    return _decoded(docs, OCCURRENCE, take)


def relations(docs: DataFrame) -> DataFrame:
    """path, symbol, other, reference, implementation, error: what a document's symbols say of others."""

    def take(number: int, value: int | memoryview) -> list[tuple]:
        if number != SYMBOLS or isinstance(value, int):
            return []
        parts = [*fields(value)]
        symbol, out = next((_text(v) for n, v in parts if n == 1), ""), []
        for n, v in parts:
            if n == RELATED and isinstance(v, memoryview):
                said = dict(fields(v))
                out.append((symbol, _text(said.get(1, 0)), bool(said.get(2)), bool(said.get(3))))
        return out

    return _decoded(docs, RELATION, take)


def read(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The documents of all index files below a path, dealt over `partitions` tasks (the session's number)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return documents(files).repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def kind_of(symbol):
    """A symbol's kind by its last descriptor."""
    return F.when(symbol.endswith("()."), "function").when(symbol.endswith("#"), "class").when(symbol.endswith("/"), "module").when(symbol.endswith("."), "field").otherwise("symbol")


def graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name, file, line, end_line) and edges (src, dst, kind, file, line, confidence, conf_rank, gate) of documents.

    A reference belongs to the narrowest definition whose body holds its line, else to the file; local symbols are of their file alone.
    """
    own = F.when(F.col("symbol").startswith("local "), F.concat("path", F.lit("#"), "symbol")).otherwise(F.col("symbol"))
    every = occurrences(docs).where("error is null and symbol <> '' and line is not null").withColumn("id", own)
    is_definition = F.col("roles").bitwiseAND(F.lit(DEFINITION)) > 0
    defs = every.where(is_definition).select("id", kind_of(F.col("id")).alias("kind"), F.regexp_extract("id", r"([^/#.`()\s]+)[`().#/]*$", 1).alias("name"), F.col("path").alias("file"), F.coalesce("body_start", "line").alias("line"), F.coalesce("body_end", "end_line").alias("end_line"))
    nodes = defs.groupBy("id").agg(*(F.min_by(c, F.struct("file", "line")).alias(c) for c in ("kind", "name", "file", "line", "end_line")))
    uses = every.where(~is_definition).select("id", "path", "line", "column", "roles").distinct()
    bodies = nodes.where("kind in ('function', 'class')").select(F.col("id").alias("holder"), F.col("file").alias("path"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    asked = uses.withColumn("lo", F.col("line")).withColumn("hi", F.col("line"))
    held = innermost(overlapping(asked, bodies, ["path"]), ["id", "path", "line", "column", "roles"], tie="holder")
    met = uses.join(held.select("id", "path", "line", "column", "roles", "holder"), ["id", "path", "line", "column", "roles"], "left").join(nodes.select("id", F.col("kind").alias("to_kind")), "id", "left")
    bit = lambda b: F.col("roles").bitwiseAND(F.lit(b)) > 0
    what = F.coalesce("to_kind", kind_of(F.col("id")))
    kind = F.when(bit(IMPORT), "IMPORTS").when(what == "function", "CALLS").when(what == "class", "USES_TYPE").when(bit(WRITE), "WRITES_PROP").when(what == "field", "READS_PROP").otherwise("REFERS_TO")
    rows = met.select(F.coalesce("holder", F.concat(F.lit("file:"), "path")).alias("src"), F.col("id").alias("dst"), kind.alias("kind"), F.col("path").alias("file"), "line")
    related = relations(docs).where("error is null and implementation").select(F.col("symbol").alias("src"), F.col("other").alias("dst"), F.lit("IMPLEMENTS").alias("kind"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"))
    exact = rows.unionByName(related).where("src <> dst").distinct()
    return nodes, exact.withColumn("confidence", F.lit("exact")).withColumn("conf_rank", F.lit(3)).withColumn("gate", F.lit(None).cast("string"))
