import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.sources.versioned import ConcurrentCommit, ConstraintViolation, RepeatedKeys, VersionedTable

SCHEMA = "k int, l string, v int"


@pytest.fixture
def made(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_history_and_time_travel(spark, made):
    df = lambda *r: spark.createDataFrame(r, SCHEMA)
    assert made.merge(df((1, "a", 1), (None, "a", 2)), ["k", "l"], {"p": 1}) == 0
    assert made.merge(df((None, "a", 3), (2, None, 4)), ["k", "l"]) == 1
    assert rows(made.read()) == rows(df((1, "a", 1), (None, "a", 3), (2, None, 4)))
    assert rows(made.as_of(0)) == rows(df((1, "a", 1), (None, "a", 2)))
    assert made.merge(df((2, None, 4)), ["k", "l"], skip_unchanged=True) is None
    kinds = {(r.v, r._change_type) for r in made.changes(1).collect()}
    assert kinds == {(2, "update_preimage"), (3, "update_postimage"), (4, "insert")}
    assert [r.operation for r in made.history().collect()] == ["MERGE", "CREATE"]
    assert '"p": 1' in made.history().first().properties
    assert made.merge(df((1, "a", 1)), ["k", "l"], delete_unmatched=True) == 2
    assert rows(made.read()) == rows(df((1, "a", 1)))
    assert {r._change_type for r in made.changes(2).collect()} == {"delete"}


def test_incidental_columns_change_nothing_alone(spark, made):
    df = lambda *r: spark.createDataFrame(r, "k int, v string, m map<string,int>, at int")
    again = lambda *r: made.merge(df(*r), ["k"], skip_unchanged=True, incidental=["at"])
    made.merge(df((1, "a", {"x": 1, "y": 2}, 1), (2, None, None, 1), (3, "c", {}, None)), ["k"])
    assert again((1, "a", {"y": 2, "x": 1}, 2), (2, None, None, None), (3, "c", {}, 2)) is None
    assert again((1, "a", {"x": 1, "y": 3}, 2), (2, "b", None, 2), (3, "c", {}, 2), (4, "d", None, 2)) == 1
    assert {r.k: (r.v, r.at) for r in made.read().collect()} == {1: ("a", 2), 2: ("b", 2), 3: ("c", None), 4: ("d", 2)}
    assert sorted((r.k, r._change_type) for r in made.changes(1).collect()) == [(1, "update_postimage"), (1, "update_preimage"), (2, "update_postimage"), (2, "update_preimage"), (4, "insert")]
    assert made.merge(df((1, "a", {"x": 1, "y": 3}, 3)), ["k"], delete_unmatched=True, incidental=["at"]) == 2
    assert [(r.k, r.at) for r in made.read().collect()] == [(1, 2)]
    for wrong in (["k"], ["none"]):
        with pytest.raises(ValueError):
            made.merge(df((1, "a", None, 1)), ["k"], incidental=wrong)


def test_repeated_source_keys_raise(spark, made):
    with pytest.raises(RepeatedKeys):
        made.merge(spark.createDataFrame([(1, "a", 1), (1, "a", 2)], SCHEMA), ["k", "l"])
    assert not made.exists()


def numbers(spark, n, v=0):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit("b").alias("l"), F.lit(v).alias("v"))


def written(made, segment):
    return len(made._scan([segment["name"]], made.read().schema).inputFiles())


def test_scattered_upserts_write_and_read_in_proportion(spark, made, monkeypatch):
    monkeypatch.setattr("verdigris.sources.versioned.ROWS_PER_FILE", 50)
    made.merge(numbers(spark, 20_000), ["k"])
    (base,) = made.entry()["segments"]
    assert written(made, base) == base["files"] == 400
    small = len(json.dumps(made.entry()))
    # A hundred keys from all over the table: a delta of their rows, before and after, in 4 files.
    made.merge(numbers(spark, 20_000, 7).where("k % 200 = 3"), ["k"])
    told = json.loads(made.history().first().metrics)
    assert (told["inserted"], told["updated"], told["deleted"]) == (0, 100, 0) and 80 < told["files_read"] <= 101 and told["files"] == 400
    entry = made.entry()
    assert entry["segments"][0] == base and written(made, entry["segments"][1]) == 4 and len(json.dumps(entry)) < small + 500
    # One known key and many new ones: ranges and filters leave nearly all files out.
    made.merge(spark.createDataFrame([(5, "x", 9), *((k, "new", 1) for k in range(10**6, 10**6 + 9))], SCHEMA), ["k"])
    told = json.loads(made.history().first().metrics)
    assert (told["inserted"], told["updated"]) == (9, 1) and told["files_read"] <= 8
    got = {r.k: r.v for r in made.read().collect()}
    assert got == {k: 9 if k == 5 else 7 if k % 200 == 3 else 0 for k in range(20_000)} | {k: 1 for k in range(10**6, 10**6 + 9)}
    assert made.as_of(1).where("v = 7").count() == 100 and made.as_of(0).where("v <> 0").count() == 0


def test_the_log_entry_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("verdigris.sources.versioned.ROWS_PER_FILE", 2)
    sizes = []
    for n in (10, 4000):
        made = VersionedTable(spark, f"file://{tmp_path}/{n}")
        made.merge(numbers(spark, n), ["k"])
        sizes.append(len(json.dumps(made.entry())))
    assert written(made, made.entry()["segments"][0]) > 1500 and sizes[1] - sizes[0] < 20


def test_filters_never_miss_a_key(spark, made):
    from verdigris.sources import versioned

    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**63), 2**63 - 1, 5000)
    stats = versioned._file_stats(pa.table({"file": ["f"] * 4000, "h": hashes[:4000]}))
    files = stats.select(["file", "bloom"])
    held = [versioned._may_hold(pa.table({"h": hashes[k : k + 1]}), files).num_rows for k in range(5000)]
    assert all(held[:4000]) and sum(held[4000:]) < 50


def test_segments_are_merged_and_old_versions_stay(spark, made, monkeypatch):
    monkeypatch.setattr("verdigris.sources.versioned.MAX_SEGMENTS", 3)
    made.merge(numbers(spark, 2000), ["k"])
    state, versions = {k: 0 for k in range(2000)}, []
    for v in range(1, 9):
        batch = {v: v, 10 + v: v, 3000 + v: v} | ({1: 100} if v == 8 else {})
        made.merge(spark.createDataFrame([(k, "b", x) for k, x in batch.items()], SCHEMA), ["k"])
        state |= batch
        versions.append(dict(state))
        entry = made.entry()
        assert len(entry["segments"]) <= 3 and entry["rows"] == len(state)
        assert entry["rows"] == sum(s["rows"] for s in entry["segments"]) - entry["n_gone"]
    assert any(s["rows"] == 2000 for s in entry["segments"])  # the large one is left alone
    for v, told in enumerate(versions, 1):
        assert {r.k: r.v for r in made.as_of(v).collect()} == told
        assert {r.k: r.v for r in made.changes(v, v).where("_change_type IN ('insert', 'update_postimage')").collect()}.items() <= told.items()
    made.register("versioned_test", "merged")
    assert {r.k: r.v for r in spark.table("versioned_test.merged").collect()} == state
    assert made.compact() == 9 and [s["delta"] for s in made.entry()["segments"]] == [False] and made.entry()["n_gone"] == 0
    assert {r.k: r.v for r in made.read().collect()} == state == {r.k: r.v for r in spark.table("versioned_test.merged").collect()}
    assert made.changes(9).count() == 0


def test_much_that_is_gone_is_not_kept(spark, made):
    made.merge(numbers(spark, 100), ["k"])
    made.merge(numbers(spark, 100, 1).where("k < 60"), ["k"])
    assert made.entry()["n_gone"] == 0 and len(made.entry()["segments"]) == 1
    assert {r[0]: r[1] for r in made.changes(1).groupBy("_change_type").count().collect()} == {"update_preimage": 60, "update_postimage": 60}


def test_changes_of_many_versions_are_one_scan(spark, made):
    made.merge(numbers(spark, 50), ["k"])
    for v in range(1, 12):
        made.merge(spark.createDataFrame([(v, "b", v)], SCHEMA), ["k"])
    found = made.changes(1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
    assert {(r.k, r._commit_version) for r in found.collect()} == {(v, v) for v in range(1, 12)}
    made.overwrite(numbers(spark, 3, 5))
    assert {r[0]: r[1] for r in made.changes(12).groupBy("_change_type").count().collect()} == {"delete": 50, "insert": 3}


def test_replace_by_key(spark, made):
    df = lambda *r: spark.createDataFrame(r, "id int, source_file string")
    made.replace_by_key(df((1, "a'.csv"), (2, "a'.csv"), (3, "b.csv")))
    made.replace_by_key(df((9, "a'.csv"), (4, "c.csv")))
    assert rows(made.read()) == [(3, "b.csv"), (4, "c.csv"), (9, "a'.csv")]
    assert made.version() == 1
    assert rows(made.changes(1).select("id", "_change_type")) == [(1, "delete"), (2, "delete"), (4, "insert"), (9, "insert")]


def test_a_second_writer_fails(spark, made):
    made.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["k"])
    with pytest.raises(ConcurrentCommit):
        made._commit(0, made.entry(0))


def test_empty_table_and_view(spark, made):
    made.merge(spark.createDataFrame([], SCHEMA), ["k"])
    made.register("versioned_test", "t")
    assert spark.table("versioned_test.t").count() == 0
    made.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["k"])
    made.register("versioned_test", "t")
    assert rows(spark.table("versioned_test.t")) == [(1, "a", 1)]


upserts = st.lists(st.dictionaries(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.integers(0, 3)), min_size=1), min_size=1, max_size=3)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(upserts)
def test_merges_are_dictionary_updates(spark, tmp_path_factory, batches):
    made = VersionedTable(spark, f"file://{tmp_path_factory.mktemp('t')}/t")
    state = {}
    for batch in batches:
        before = dict(state)
        version = made.merge(spark.createDataFrame(list(batch.items()), "k int, v int"), ["k"])
        state.update(batch)
        assert {r.k: r.v for r in made.read().collect()} == state
        for r in made.changes(version, version).collect():
            if r._change_type in ("insert", "update_postimage"):
                before[r.k] = r.v
        assert before == state


@pytest.mark.parametrize("write", ["merge", "replace"])
def test_keys_of_another_type_fall_into_the_same_buckets(spark, made, write):
    made.merge(spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v")), ["k"])
    five = spark.createDataFrame([(x, 1) for x in (3, 14, 15, 92, 65)], "k int, v long")
    assert made.merge(five, ["k"]) == 1 if write == "merge" else made.replace_by_key(five) == 1
    found = {r.k: r.v for r in made.read().collect()}
    assert found == {k: int(k in (3, 14, 15, 92, 65)) for k in range(100)}
    assert made.read().schema == made.as_of(0).schema


def test_rows_that_do_not_fit_are_refused(spark, made):
    made.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["k"])
    with pytest.raises(ValueError, match="lack"):
        made.merge(spark.createDataFrame([(1,)], "k int"), ["k"])
    with pytest.raises(Exception, match="CAST|OVERFLOW"):
        made.merge(spark.createDataFrame([(1 << 40, "a", 1)], "k long, l string, v int"), ["k"])
    with pytest.raises(ValueError, match="keys"):
        made.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["l"])
    assert made.version() == 0 and made.read().count() == 1


def test_a_writer_lost_before_its_commit_leaves_no_version(spark, made, monkeypatch):
    made.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["k"])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(made, "_move", lost)
        with pytest.raises(RuntimeError):
            made.merge(spark.createDataFrame([(2, "a", 1)], SCHEMA), ["k"])
    assert made.version() == 0 and made.read().count() == 1
    assert made.merge(spark.createDataFrame([(2, "a", 1)], SCHEMA), ["k"]) == 1 and made.read().count() == 2


def test_two_writers_do_not_touch_each_other(spark, made, monkeypatch):
    """A second writer commits while the first is about to: the first fails as such, and can do it again."""
    made.merge(numbers(spark, 20), ["k"])
    other, apply = VersionedTable(spark, made.path), VersionedTable._apply

    def slow(self, folders, *args, **more):
        if self is made:
            assert other.merge(numbers(spark, 5, 2), ["k"]) == 1
        return apply(self, folders, *args, **more)

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_apply", slow)
        with pytest.raises(ConcurrentCommit):
            made.merge(numbers(spark, 10, 3), ["k"])
    assert made.version() == 1 and made.read().where("v = 2").count() == 5
    assert made.merge(numbers(spark, 10, 3), ["k"]) == 2 and made.read().where("v = 3").count() == 10
    fs, at = made._fs, made._at("_staged")
    assert not fs.exists(at) or len(fs.listStatus(at)) == 0
    live = {s["name"] for v in range(3) for s in made.entry(v)["segments"]} | {made.entry(v)["delta"] for v in range(3)}
    assert {f.getPath().getName() for f in fs.listStatus(made._at("data"))} <= live


def test_names_that_the_table_needs_are_refused_and_others_are_kept(spark, made):
    with pytest.raises(ValueError, match="_change_type"):
        made.merge(spark.createDataFrame([(1, "x")], "k int, _change_type string"), ["k"])
    odd = spark.createDataFrame([(1, 7, "d", 2)], "k int, _bucket int, `a.b` string, t int")
    made.merge(odd, ["k"])
    made.merge(odd.withColumn("_bucket", F.lit(8)), ["k"])
    assert rows(made.read()) == [(1, 8, "d", 2)]
    assert {r["_bucket"]: r["_change_type"] for r in made.changes(1).collect()} == {7: "update_preimage", 8: "update_postimage"}


def test_maps_are_compared_by_their_entries(spark, made):
    told = "k int, m map<string, int>, n array<struct<x: map<int, string>>>"
    row = lambda k, m, n: (k, m, [(n,)])
    made.merge(spark.createDataFrame([row(1, {"a": 1, "b": 2}, {1: "x", 2: "y"}), row(2, None, None)], told), ["k"])
    assert made.merge(spark.createDataFrame([row(1, {"b": 2, "a": 1}, {2: "y", 1: "x"}), row(2, None, None)], told), ["k"], skip_unchanged=True) is None
    assert made.merge(spark.createDataFrame([row(1, {"b": 2, "a": 1}, {2: "z", 1: "x"})], told), ["k"], skip_unchanged=True) == 1
    assert {r.k: r.n[0].x for r in made.read().collect()} == {1: {1: "x", 2: "z"}, 2: None}


def test_new_columns_are_added_or_refused(spark, made):
    made.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA), ["k"])
    made.register("versioned_test", "evolved")
    wider = spark.createDataFrame([(2, "b", 2, 2.5), (3, "c", 3, None)], SCHEMA + ", w double")
    for write in (lambda **m: made.merge(wider, ["k"], **m), lambda **m: made.replace_by_key(wider, **m), lambda **m: made.overwrite(wider, **m)):
        with pytest.raises(ValueError, match="no columns"):
            write()
    assert made.merge(wider, ["k"], add_columns=True) == 1
    assert rows(made.read()) == rows(spark.createDataFrame([(1, "a", 1, None), (2, "b", 2, 2.5), (3, "c", 3, None)], SCHEMA + ", w double"))
    assert rows(spark.table("versioned_test.evolved")) == rows(made.read())
    assert made.as_of(0).columns == ["k", "l", "v"] and made.as_of(0).count() == 2
    kinds = [(r.k, r._change_type, r.w) for r in made.changes(0).collect()]
    assert sorted(kinds, key=repr) == sorted([(1, "insert", None), (2, "insert", None), (2, "update_preimage", None), (2, "update_postimage", 2.5), (3, "insert", None)], key=repr)
    with pytest.raises(ValueError, match="lack"):
        made.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["k"])
    assert made.compact() == 2 and rows(made.read()) == rows(spark.table("versioned_test.evolved"))


def test_constraints_leave_no_version(spark, made):
    made.create(spark.createDataFrame([(1, "a", 1), (2, None, None)], SCHEMA), ["k"], unique=True, not_null=["k"], checks={"positive": "v > 0"})
    df = lambda *r: spark.createDataFrame(r, SCHEMA)
    for bad in (df((3, "c", 0)), df((None, "c", 1)), df((3, "c", -1), (4, "d", 1))):
        for write in (lambda bad=bad: made.merge(bad, ["k"]), lambda bad=bad: made.replace_by_key(bad), lambda bad=bad: made.overwrite(bad)):
            with pytest.raises(ConstraintViolation):
                write()
    assert made.version() == 0 and made.merge(df((3, None, None)), ["k"]) == 1  # an unknown condition is not false
    with pytest.raises(ConstraintViolation, match="named"):
        made.add_constraint("named", "l is not null")
    assert made.add_constraint("short", "length(l) < 3") == 2
    with pytest.raises(ConstraintViolation, match="short"):
        made.merge(df((9, "long one", 1)), ["k"])
    with pytest.raises(ConstraintViolation):
        VersionedTable(spark, made.path + "2").create(df((None, "a", 1)), ["k"], not_null=["k"])
    assert made.version() == 2 and not VersionedTable(spark, made.path + "2").exists()


def test_a_replaced_key_that_most_rows_share(spark, made, monkeypatch):
    monkeypatch.setattr("verdigris.sources.versioned.ROWS_PER_FILE", 100)
    df = lambda n, at: spark.range(n).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 3 == 0, "hot.csv").otherwise(F.concat(F.lit("f"), F.col("id") % 9)).alias("source_file"), F.lit(at).alias("at"))
    made.replace_by_key(df(3000, 1))
    assert written(made, made.entry()["segments"][0]) > 20
    made.replace_by_key(df(30, 2).where("source_file = 'hot.csv'"))
    assert {(r.source_file == "hot.csv", r["at"]): r["count"] for r in made.read().groupBy("source_file", "at").count().collect()}[(True, 2)] == 10
    assert made.read().count() == 2010 and made.changes(1).where("_change_type = 'delete'").count() == 1000


def test_views_follow_and_sql_sees_versions(spark, made):
    from verdigris.plans.sqlrun import run_sql

    made.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["k"])
    made.register("versioned_test", "followed")
    made.merge(spark.createDataFrame([(1, "a", 2), (2, "b", 3)], SCHEMA), ["k"])
    assert spark.table("versioned_test.followed").count() == 2
    assert [r.operation for r in run_sql(spark, "DESCRIBE HISTORY versioned_test.followed").collect()] == ["MERGE", "CREATE"]
    assert run_sql(spark, "SELECT v, 'x VERSION AS OF 1' AS t FROM versioned_test.followed VERSION AS OF 0").first().v == 1
    sql = lambda q: [tuple(r) for r in run_sql(spark, q).collect()]
    assert sql("SELECT followed.k, followed.v FROM versioned_test.followed VERSION AS OF 0 WHERE followed.k > 0") == [(1, 1)]
    assert sql("SELECT a.v, b.v FROM versioned_test.followed VERSION AS OF 0 AS a JOIN versioned_test.followed VERSION AS OF 1 b ON a.k = b.k") == [(1, 2)]
    assert sql("SELECT followed.v, n.v FROM versioned_test.followed VERSION AS OF 1 LEFT JOIN versioned_test.followed VERSION AS OF 0 n ON followed.k = n.k ORDER BY 1") == [(2, 1), (3, None)]
    assert sql("SELECT count(followed._change_type) FROM table_changes('versioned_test.followed', 1, 1) WHERE followed.k = 1") == [(2,)]
    kinds = run_sql(spark, "SELECT _change_type AS t FROM table_changes('versioned_test.followed', 1) ORDER BY 1").collect()
    assert [r.t for r in kinds] == ["insert", "update_postimage", "update_preimage"]


def test_vacuum_keeps_the_latest_versions(spark, made):
    for v in range(3):
        made.merge(spark.createDataFrame([(k, "a", v) for k in range(40)], SCHEMA), ["k"])
    assert made.vacuum(keep=1) > 1 and made.vacuum(keep=1) == 0
    assert made.changes(2).count() == 80
    assert rows(made.read().select("v").distinct()) == [(2,)]
