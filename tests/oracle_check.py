"""Compare catalogue queries with their SQL twins: names, types, rows.

    python -m tests.oracle_check SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else float(f"{value:.9g}") if not math.isnan(value) else "nan"
    return value


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in words; empty when both sides agree."""
    found = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in found.description}
    theirs = found.fetchall()
    names = sorted(spark_df.columns)
    if names != sorted(kinds):
        return [f"columns {names} != {sorted(kinds)}"]
    problems = [
        f"type of {n}: {t} != {kinds[n]}" for n, t in spark_df.dtypes if SAME_TYPE.get(t, t) != kinds[n]
    ]
    place = {n: i for i, n in enumerate(kinds)}
    ours = Counter(tuple(_cell(r[n]) for n in names) for r in spark_df.collect())
    expected = Counter(tuple(_cell(r[place[n]]) for n in names) for r in theirs)
    if ours != expected:
        extra, missing = ours - expected, expected - ours
        problems.append(
            f"rows {sum(ours.values())} vs {sum(expected.values())}; only Spark {list(extra)[:2]}; only SQL {list(missing)[:2]}"
        )
    return problems


def main(sf_dir: str, names: list[str]) -> int:
    from tracewell.plans.catalog import QUERIES
    from tracewell.plans.oracles import ORACLES
    from tracewell.session import build_session

    spark, con, bad = build_session(), connect(sf_dir), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name not in ORACLES:
                problems = [] if QUERIES[name](spark, sf_dir).count() >= 0 else []
            else:
                problems = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
        except Exception as error:
            problems = [str(error)[:600].replace("\n", " | ")]
        bad += bool(problems)
        print("FAIL" if problems else "ok", name, f"{time.time() - start:.2f}s", *problems, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
