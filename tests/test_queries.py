import glob
import os

import pytest

from cadenza import queries
from cadenza.plans import adapters
from cadenza.streaming import filter_stream, trim_stream

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    same = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(same, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_notes_moved(spark, tmp_path):
    """Events at the same time, 256 notes on both sides together, and shares a digit from halfway, against the SQL."""
    import random
    from datetime import datetime, timedelta

    import duckdb

    rng, start, out = random.Random(1), datetime(2024, 1, 1), []
    for user in range(100):
        out += [(rng.randrange(10**6), user, start + timedelta(microseconds=rng.randrange(30 * 86400 * 10**6))) for _ in range(60)]
    out += [(k, 100, start + timedelta(seconds=k // 6)) for k in range(300)]
    # 140 notes, 116 of them not gone
    out += [(11 * k, 101, start + timedelta(hours=k)) for k in range(24)] + [(11 * k + 1 + k % 9, 101, start + timedelta(hours=24 + k)) for k in range(116)]
    spark.createDataFrame(out, "event_id long, user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = queries.queries()["eval_notes_moved"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(queries.oracle_sql()["eval_notes_moved"]).df()) and len(got) == 102 * 14


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stream(spark, tmp_path):
    corpus = adapters.points(spark, SF)
    corpus.observations.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(corpus.observations.schema).parquet(str(tmp_path / "in"))
    for name, out, want in (
        ("trimmed", trim_stream(corpus, stream, start=queries.LO, end=queries.HI), queries.trim_point(spark, SF)),
        ("filtered", filter_stream(corpus, stream, lambda v: v == "purchase"), queries.filter_payload(spark, SF)),
    ):
        q = out.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want.count()

