"""Every registered query with an SQL twin against DuckDB, and parity of the stream."""

import glob
import os

import duckdb
import pytest

from wavemill.plans import registry
from wavemill.streaming import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(found, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    twin = duck.execute(registry.SQL[name])
    columns = [c[0] for c in twin.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(map(tuple, df.collect()), df.columns, sorted(columns)), rows(twin.fetchall(), columns, sorted(columns))
    assert got == want and (got or name == "backlog_warnings")


def test_stream_equals_table(spark):
    from wavemill.plans import stream

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    table = session.transcribe_table(stream.session_commands(read("embeddings"), read("nation")), stream.SHORT_GATE, stream.mean_score, vanish=True)
    got = sorted(map(str, registry.QUERIES["stream_parity"](spark, SF).collect()))
    assert got == sorted(map(str, table.collect())) and len(got) > 40


def test_max_split_equals_rules(spark):
    from wavemill.operators.gate import walk
    from wavemill.plans.inputs import frames

    want = []
    pdf = frames(spark, SF).toPandas()
    for source, f in pdf.sort_values("i").groupby("source_id"):
        scored = list(zip(f["i"] * 512, f["prob"]))
        want += [(source, n, a, b) for n, (a, b) in enumerate(walk(scored, 0.5, 0.35, 1600, 4000, 9600 - 512 - 960, len(f) * 512))]
    assert sorted(map(tuple, registry.QUERIES["vad_max_split"](spark, SF).collect())) == sorted(want)
