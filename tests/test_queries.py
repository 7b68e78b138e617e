"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).take(1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(params=["files", "row groups"])
def split_tables(spark, request, tmp_path):
    """A part whose last bits depend on the order of its lines: its first line lies apart from the other two."""
    pq.write_table(pa.table({"p_partkey": [1, 2], "p_name": ["a", "b"], "p_brand": ["x", "x"], "p_type": ["t", "t"], "p_size": pa.array([1, 1], pa.int32()), "p_retailprice": [900.0, 901.0]}), tmp_path / "part.parquet")
    lines = pa.table({"l_partkey": [1, 1, 1], "l_extendedprice": [0.1, 0.2, 0.7], "l_quantity": [1.0, 2.0, 3.0], "l_discount": [0.1, 0.2, 0.3], "l_tax": [0.3, 0.2, 0.1]})
    path = tmp_path / "lineitem.parquet"
    if request.param == "files":
        path.mkdir()
        for i, piece in enumerate((lines[:1], lines[1:])):
            pq.write_table(piece, path / f"{i}.parquet")
    else:
        with pq.ParquetWriter(path, lines.schema) as out:
            for piece in (lines[:1], lines[1:]):
                out.write_table(piece)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["screen_criteria", "screen_formatted", "screen_formatted_all"])
def test_sums_do_not_depend_on_splits(spark, split_tables, name):
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{split_tables}/part.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{split_tables}/lineitem.parquet{'/*.parquet' * Path(split_tables, 'lineitem.parquet').is_dir()}'")
    want = con.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, split_tables).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_rounding_is_that_of_the_sql(spark):
    values = [941.8 / 640, -941.8 / 640, 0.49999999999999994e-6, -1e-9, 1e303, math.inf, None]
    got = [r[0] for r in catalogue.rounded(spark.createDataFrame([(x,) for x in values], "x double")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [x]).fetchone()[0] for x in values]
    assert got == want and got[:2] == [1.471563, -1.471563]
