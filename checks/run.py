"""Compare registered queries with their SQL: ``python -m checks.run [sf_dir] [name-part ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pyarrow as pa

from checks import REGISTRY, frames_for


def tables(con: duckdb.DuckDBPyConnection, sf_dir: str) -> None:
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}'")


def _kind(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return "timestamp" if pa.types.is_timestamp(t) else str(t)


def normal(table: pa.Table) -> tuple[list[tuple[str, str]], list[str]]:
    names = sorted(table.column_names)
    schema = [(n, _kind(table.schema.field(n).type)) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted("|".join("~" if v is None else str(v) for v in row) for row in zip(*columns))
    return schema, rows


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """``None`` if the query and its SQL agree, else what differs."""
    entry = REGISTRY[name]
    got_schema, got = normal(entry.run(frames_for(spark, sf_dir)).toArrow())
    if entry.sql is None:
        return None
    want_schema, want = normal(con.sql(entry.sql).to_arrow_table())
    if got_schema != want_schema:
        return f"schema {sorted(set(got_schema) ^ set(want_schema))}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}; extra {extra} missing {missing}"
    return "both empty" if not got else None


def main() -> int:
    from fieldtally.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    tables(con, sf_dir)
    bad = 0
    for name in REGISTRY:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001  (the report goes on with the next query)
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
