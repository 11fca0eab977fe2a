"""Small tables as a folder of Parquet files, and SQL twins over them."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tests.oracle import rows_of


def folder(path, **tables) -> str:
    """Writes {name: (schema, rows)}."""
    for name, (schema, rows) in tables.items():
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema), os.path.join(path, f"{name}.parquet"))
    return str(path)


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
CONVERSATIONS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def documents(path, texts, langs=None, **more) -> str:
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in enumerate(texts)]
    return folder(path, documents=(DOCUMENTS, rows), **more)


def result(df) -> list[tuple]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def twin(sql: str, path: str, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    rel = con.execute(sql)
    return rows_of([d[0] for d in rel.description], rel.fetchall())
