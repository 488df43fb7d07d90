"""Code-intelligence indexes written from the tables, a file for each nation, and read back as a graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lattica.plans.registry import query
from lattica.sources import scip
from lattica.sources.fixture import read


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | str | bytes | list[int]) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    data = value.encode() if isinstance(value, str) else b"".join(map(_number, value)) if isinstance(value, list) else value
    return _number(number << 3 | 2) + _number(len(data)) + data


def written(spark, sf_dir):
    """path, content: a document for each supplier, whose function calls the next supplier's, reads a field and writes another, and whose class implements its nation's."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, n in zip(b["s_suppkey"], b["s_nationkey"], strict=True):
                place = lambda symbol, roles, line, body=None: _field(2, _field(1, [line, 4, 9]) + _field(2, symbol) + _field(3, roles) + (_field(7, body) if body else b""))
                document = _field(1, f"src/s{s}.py") + place(f"py pkg s/S{s}#", 1, 0, [0, 0, 30, 0]) + place(f"py pkg s/S{s}#run().", 1, 10, [10, 0, 20, 0])
                document += place(f"py pkg s/S{s + 1}#run().", 8, 12) + place(f"py pkg s/S{s}#kept.", 1, 3) + place(f"py pkg s/S{s}#kept.", 8, 14) + place(f"py pkg s/S{s}#kept.", 4, 15) + place("py lib x/", 2, 40)
                document += _field(3, _field(1, f"py pkg s/S{s}#") + _field(4, _field(1, f"py lib N{n}#") + _field(3, 1)))
                rows.append((int(n), int(s), _field(2, document)))
            yield pd.DataFrame(rows, columns=["n", "s", "document"])

    documents = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").mapInPandas(encode, "n long, s long, document binary")
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", F.hex("document").alias("h")))), lambda x: x["h"]), ""))
    return documents.groupBy("n").agg(joined.alias("content")).select(F.concat(F.lit("n"), F.col("n").cast("string"), F.lit(".scip")).alias("path"), "content")


@query("""WITH s AS (SELECT s_suppkey AS s, s_nationkey AS n, 'py pkg s/S' || s_suppkey || '#' AS c FROM supplier)
SELECT c || 'run().' AS src, 'CALLS' AS kind, 'py pkg s/S' || (s + 1) || '#run().' AS dst, 13 AS line FROM s UNION ALL SELECT c || 'run().', 'READS_PROP', c || 'kept.', 15 FROM s UNION ALL SELECT c || 'run().', 'WRITES_PROP', c || 'kept.', 16 FROM s
UNION ALL SELECT 'file:src/s' || s || '.py', 'IMPORTS', 'py lib x/', 41 FROM s UNION ALL SELECT c, 'IMPLEMENTS', 'py lib N' || n || '#', NULL FROM s""")
def indexed_graph(spark, sf_dir):
    """SC16: edges of indexes in the wire format, each from the narrowest definition around it."""
    return scip.graph(scip.documents(written(spark, sf_dir)))[1].select("src", "kind", "dst", "line")
