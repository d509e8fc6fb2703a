"""Compare registered queries with their SQL: ``python -m checks.compare [sf_dir] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path
from typing import Any

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.oracles import ORACLES  # noqa: E402
from checks.registry import QUERIES  # noqa: E402


def tables(path: str) -> duckdb.DuckDBPyConnection:
    """A connection with one view per table of the folder."""
    db = duckdb.connect()
    for file in sorted(Path(path).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def _cell(v: Any) -> Any:
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    return v


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])


def differences(spark, db, name: str, path: str) -> str | None:
    """What differs between a query and its SQL; None if nothing does."""
    df = QUERIES[name](spark, path)
    got = [tuple(row) for row in df.collect()]
    if name not in ORACLES:
        return None if got else "no rows"
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    pairs = zip(_sorted(df.columns, got), _sorted(columns, want))
    odd = [(a, b) for a, b in pairs if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(odd)} of {len(got)} rows, first {odd[0]}" if odd else None


def main() -> int:
    from kerbstat.session import local_session

    path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, db, failed = local_session(8), tables(path), 0
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, db, name, path)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "oracle" if name in ORACLES else "rows only"
        print(f"{'FAIL' if problem else 'ok':4} {name:24} {kind:9} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
