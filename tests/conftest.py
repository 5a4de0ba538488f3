import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Whether a query's rows are those of its SQL, columns by name, rows in any order."""

    def check(query, sql):
        df = query(spark, DATA)
        made = duck.execute(sql)
        names = [c[0] for c in made.description]
        assert sorted(df.columns) == sorted(names)
        rows = made.fetchall()
        order = [names.index(c) for c in sorted(names)]
        got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        assert got == sorted(tuple(plain(r[k]) for k in order) for r in rows)
        return len(got)

    return check
