"""Side-by-side comparison of a Spark query with its SQL on the same files."""

from __future__ import annotations

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return repr(v)  # exact: both sides round what they report
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def canonical(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(columns) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} vs {sorted(columns)}"
    a, b = canonical(spark_df.columns, rows), canonical(columns, other)
    if a == b:
        types = {type(v).__name__ for r in b for v in r}
        return True, f"{len(a)} rows {sorted(types)}"
    only_a = [x for x in a if x not in set(b)][:3] if len(a) < 20000 else []
    only_b = [x for x in b if x not in set(a)][:3] if len(b) < 20000 else []
    return False, f"{len(a)} vs {len(b)} rows; spark only {only_a}; sql only {only_b}"
