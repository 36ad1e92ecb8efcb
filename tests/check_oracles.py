"""Compare registered queries with their SQL: ``python tests/check_oracles.py SF_DIR [name ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tokenweave.session import build_session  # noqa: E402

#: Queries that SQL cannot state; their rows are held against brute force in tests/.
NO_SQL = {"bpe_encode", "bpe_pack_sequences", "pipeline"} | {
    "op1_near_dedup", "op2_quality_rules", "op3_secret_scan", "op4_packing", "op5_quality_classifier", "op6_line_dedup",
    "op7_passage_dedup", "op8_personal_data", "op10_license_scan", "op11_repeated_bytes", "op13_token_alignment",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def normalized(rows, columns):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in place) for r in rows), key=repr), [columns[i] for i in place]


def compare(spark, con, name, sf):
    """None when rows, column names and values agree, else what differs."""
    df = entry.queries()[name](spark, sf)
    mine, my_columns = normalized([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        if name not in NO_SQL:
            return "no SQL"
        return None if mine else "no rows"
    result = con.execute(sql)
    theirs, their_columns = normalized(result.fetchall(), [d[0] for d in result.description])
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = {c: (t, kinds.get(c)) for c, t in df.dtypes if expected.get(t, t) != kinds.get(c)}
    if my_columns != their_columns or wrong:
        return f"columns {my_columns} / {their_columns}, types {wrong}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows, expected {len(theirs)}"
    off = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(off)} of {len(mine)} rows differ, e.g. {str(off[0])[:400]}" if off else None


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    session = build_session(
        master="local[8]",
        **{"spark.driver.memory": "20g", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    failed = 0
    for query in names or entry.queries():
        began = time.time()
        try:
            problem = compare(session, database, query, folder)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {query} {time.time() - began:.1f}s {problem or ''}", flush=True)
    sys.exit(bool(failed))
