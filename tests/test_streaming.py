from verdigris.sources.versioned import VersionedTable
from verdigris.streaming.ingest import upsert_stream


def test_upserts_arrive_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = spark.readStream.schema("k int, at int, v string").json(f"file://{landing}")

    def drain():
        run = upsert_stream(rows, table, ["k"], ["at"]).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        run.awaitTermination()

    (landing / "1.json").write_text('{"k":1,"at":1,"v":"a"}\n{"k":1,"at":2,"v":"b"}\n{"k":2,"at":1,"v":"c"}\n')
    drain()
    (landing / "2.json").write_text('{"k":2,"at":5,"v":"d"}\n')
    drain()
    drain()
    assert {r.k: r.v for r in table.read().collect()} == {1: "b", 2: "d"}
    assert table.version() == 1
