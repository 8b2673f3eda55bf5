"""Run registered queries and their SQL on the same tables and compare the rows."""

import glob
import os
import sys
import time


def connection(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        at = f if os.path.isfile(f) else f"{f}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{at}'")
    return c


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def difference(df, c, sql):
    """None, or what differs."""
    got_columns = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in got_columns) for r in df.collect()), key=repr)
    rel = c.sql(sql)
    columns = list(rel.columns)
    if sorted(columns) != got_columns:
        return f"columns {got_columns} and {sorted(columns)}"
    order = [columns.index(k) for k in got_columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows, {got[:2]} and {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} of {len(got)} rows, {got_columns}: {a} and {b}"
    return None


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    import tempfile

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', 4)}]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tmp).config("spark.local.dir", tmp).config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    d = f"/root/testdata/{sys.argv[1]}"
    c = connection(d)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        t = time.time()
        try:
            out = difference(queries[name](spark, d), c, sql[name]) if name in sql else f"(no SQL) {queries[name](spark, d).count()} rows"
        except Exception as e:
            out = f"FAILED {type(e).__name__} {str(e)[:700]}"
        print(name, round(time.time() - t, 1), out, flush=True)
