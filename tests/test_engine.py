import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe import Filter, cli, connect
from vecframe import engine as engine_module
from vecframe.config import Config, GraphParams
from vecframe.engine import Engine
from vecframe.errors import ConfigError, LockConflict, StorageError
from vecframe.functions.ids import id_column, id_of
from vecframe.streaming import mutations


@pytest.fixture
def engine(spark, tmp_path):
    e = connect(str(tmp_path / "db"), spark=spark, dimension=2, metric="euclidean")
    yield e
    e.abandon()


ROWS = [((0.0, 0.0), {"topic": "tech", "year": 2024}), ((0.1, 0.1), {"topic": "finance", "year": 2024}), ((0.2, 0.2), {"topic": "tech", "year": 2019})]


def test_filtered_nearest_and_reopening(spark, tmp_path):
    path = str(tmp_path / "kept")
    with connect(path, spark=spark, dimension=2, metric="euclidean") as e:
        keys = [e.collection("docs").write(vector=v, meta=m) for v, m in ROWS]
    e = connect(path, spark=spark, dimension=2, metric="euclidean")
    c = e.collection("docs")
    where = Filter().field("topic").equals("tech") & Filter().field("year").ge(2020)
    assert [r.id for r in c.probe([0.2, 0.2], 10, where).collect()] == [keys[0]]
    assert [r.id for r in c.probe([0.19, 0.19], 2).collect()] == [keys[2], keys[1]]
    assert c.probe([0.0, 0.0], threshold=0.15).count() == 2 and c.count() == 3 and e.verify() == "OK"
    assert c.discard([keys[1]]) == 1 and c.count() == 2
    e.close()


def test_transactions_are_all_or_nothing(engine):
    c = engine.collection("docs")
    with engine.transaction() as t:
        t.place("docs", [1.0, 2.0], {"n": 1})
    assert c.count() == 1
    with pytest.raises(RuntimeError), engine.transaction() as t:
        t.place("docs", [1.0, 2.0], {"n": 2})
        raise RuntimeError
    assert c.count() == 1


def test_missing_keys_and_types_of_filters(engine):
    c = engine.collection("docs")
    c.write_many([{"vector": [0.0, 0.0], "meta": m} for m in ({"n": 1}, {"n": "1"}, {}, {"n": True}, {"n": 1.0})])
    has = lambda f: c.sweep(f).count()
    assert has(~Filter().field("n").equals("1")) == 4 and has(Filter().field("n").equals("1")) == 1 and has(Filter().field("n").one_of([])) == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("key", ["n", "u", None])
def test_ingest_of_a_dataframe(spark, metric, key):
    u = "0190aaaa-bbbb-7ccc-8ddd-eeeeffff0001"
    df = spark.createDataFrame([(1, u.upper(), [3.0, 4.0], "a", None), (2, "named", [0.0, 2.0], None, True), (2, None, [0.0, 2.0], None, True)], "n int, u string, vector array<double>, s string, b boolean")
    c = connect(":memory:", spark=spark, dimension=2, metric=metric).collection("c")
    c.ingest_df(df, meta=["n", "s", "b"], id=key)
    assert c.count() == {"n": 2, "u": 3, None: 3}[key]
    got = {r.id: r for r in c.sweep(include_vectors=True).collect()}
    if key == "u":
        assert {u, id_of("named")} < set(got)
        assert [r.id for r in c.pull(["named", u.upper(), "none"]).collect()] == [id_of("named"), u]
        assert c.discard([u]) == 1 and c.discard(["named"]) == 1 and c.count() == 1
    lengths = sorted(round(float(np.linalg.norm(r.vector)), 5) for r in got.values())
    assert lengths[-1] == (1.0 if metric == "cosine" else 5.0)
    assert {k for r in got.values() for k in r.meta} == {"n", "s", "b"}


def test_ingest_refuses_what_is_no_vector(spark):
    c = connect(":memory:", spark=spark, dimension=2).collection("c")
    for v in ([1.0], [float("nan"), 1.0], [None, 1.0], None):
        with pytest.raises(Exception, match="DimensionMismatch|InvalidVector"):
            c.ingest_df(spark.createDataFrame([(v,)], "vector array<double>"))
    assert c.count() == 0


def test_ids_of_keys_are_the_same_as_columns(spark):
    keys = ["0190aaaabbbb7ccc8dddeeeeffff0001", "0190AAAA-BBBB-7CCC-8DDD-EEEEFFFF0001", "7", "", "é"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", id_column(F.col("k")).alias("i")).collect()
    assert {r.k: r.i for r in rows} == {k: id_of(k) for k in keys} and id_of(keys[0]) == id_of(keys[1])


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_json_lines_come_back(spark, tmp_path, metric):
    a = connect(":memory:", spark=spark, dimension=2, metric=metric).collection("a")
    keys = a.write_many([{"vector": [0.6, 0.8], "meta": {"n": 1, "x": 0.1, "b": True, "s": "é"}, "document": {"text": "t"}}, {"vector": [1.0, 0.0]}])
    a.export_jsonl(str(tmp_path / "out"))
    (tmp_path / "out" / "more.txt").write_text('{"vector": [0, 1]}\n\n{"id": "", "vector": [0, 1], "data": {"n": 2}}\n{"id": "mine", "vector": [1, 1]}\n')
    b = connect(":memory:", spark=spark, dimension=2, metric=metric).collection("b")
    b.import_jsonl(str(tmp_path / "out"))
    assert b.count() == 5
    had, got = ({r.id: (r.vector, r.meta, r.document) for r in c.pull(keys, include_vectors=True).collect()} for c in (a, b))
    assert had == got and b.pull(["mine"]).count() == 1


def test_command_line_imports_and_exports(spark, tmp_path, capsys):
    db = str(tmp_path / "db")
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"id": str(i), "vector": [i, 1], "data": {"n": i}}) for i in range(5)))
    run = lambda *a: cli.main([*a, "--path", db, "--dimension", "2"], spark)
    assert run("import", "--vault", "v", "--input", str(tmp_path / "in.jsonl")) == 0
    assert run("stats") == 0 and json.loads(capsys.readouterr().out) == {"vault": "v", "records": 5}
    assert run("export", "--vault", "v", "--output", str(tmp_path / "out")) == 0
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert sorted(x["data"]["n"] for x in lines) == list(range(5)) and run("verify") == 0


def records(c):
    return {r.id: (r.meta["n"]["i"], r.codec) for r in c.records().collect()}


def test_records_are_placed_as_they_are(spark):
    a = connect(":memory:", spark=spark, dimension=2).collection("a")
    a.write_many([{"vector": [3.0, 4.0], "meta": {"n": 1}}, {"vector": [0.0, 1.0], "meta": {"n": 2}}])
    b = connect(":memory:", spark=spark, dimension=2).collection("b")
    b.place_records(a.records().withColumn("vector", F.transform("vector", lambda x: x * 2)))
    assert records(a) == records(b) and {round(float(np.linalg.norm(r.vector)), 4) for r in b.records().collect()} == {2.0}


def test_writers_exclude_each_other_across_processes(spark, tmp_path):
    path = str(tmp_path / "db")
    e = connect(path, spark=spark, dimension=2)
    code = f"import fcntl; f = open({path + '/.lock'!r}, 'a'); fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode != 0
    with pytest.raises(LockConflict):
        connect(path, spark=spark)
    connect(path, spark=spark, access_mode="read_only").abandon()
    e.close()
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
    connect(path, spark=spark).close()


def test_deletes_and_commits_fold_the_log_by_themselves(spark, tmp_path, monkeypatch):
    e = connect(str(tmp_path / "db"), spark=spark, dimension=2, metric="euclidean")
    c = e.collection("c")
    c.ingest_df(spark.range(20).selectExpr("id", "array(id, 1.0D) AS vector"), meta=["id"], id="id")
    c.discard(["1"])
    assert e.pending_writes().count() == 21
    c.discard(where=Filter.compare("id", "<", 6))
    assert e.pending_writes().count() == 0 and c.count() == 14 and c.health().tombstones == 0
    monkeypatch.setattr(engine_module, "PENDING_COMMITS", 3)
    for i in range(3):
        c.write(vector=[i, 2.0])
    assert e.pending_writes().count() == 0 and c.count() == 17
    e.close()


def test_lists_are_trained_again_after_growth_and_kept_by_codes(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "n int, vector array<double>")
    e = Engine(spark, str(tmp_path / "db"), Config(8, "euclidean", graph=GraphParams(ef_search=1000)))
    c = e.collection("c")
    c.ingest_df(df.filter("n < 200"), meta=["n"], id="n")
    c.rebuild()
    first = len(e.manifest.collections["c"]["lists"])
    c.ingest_df(df.filter("n >= 200 AND n < 300"), meta=["n"], id="n")
    e.checkpoint()
    assert len(e.manifest.collections["c"]["lists"]) == first and c.records().filter("list_id IS NULL").count() == 0
    c.ingest_df(df.filter("n >= 300"), meta=["n"], id="n")
    e.checkpoint()
    assert len(e.manifest.collections["c"]["lists"]) == 30 and e.manifest.collections["c"]["trained_rows"] == 900
    want = np.argsort(((x - x[7]) ** 2).sum(1), kind="stable")[:10].tolist()
    assert [r.meta["n"]["i"] for r in c.probe(x[7].tolist(), 10).collect()] == want
    c.compress("sq8")
    assert c.records().filter("list_id IS NULL OR vector IS NOT NULL").count() == 0
    c.write(vector=x[7].tolist(), meta={"n": 5000})
    got = [r.meta["n"]["i"] for r in c.probe(x[7].tolist(), 11).collect()]
    assert 5000 in got and len(set(got) & set(want)) >= 9
    e.checkpoint()
    assert c.records().filter("list_id IS NULL").count() == 0 and c.count() == 901
    e.close()


def test_only_published_commits_are_streamed(spark, tmp_path):
    path = str(tmp_path / "db")
    e = connect(path, spark=spark, dimension=2)
    seen = []
    run = lambda: mutations.apply_log(spark, path, lambda rows, n: seen.extend(rows.collect()), str(tmp_path / "state"), "c", 1).awaitTermination()
    run()
    assert not seen
    c = e.collection("c")
    c.write_many([{"vector": [1.0, 0.0], "key": "1"}, {"vector": [0.0, 1.0], "key": "1"}])
    e.collection("other").write(vector=[1.0, 0.0])
    e.pending_writes().drop("seq").limit(1).write.parquet(f"{path}/log/{9:012d}-lost")
    run()
    assert [(r.id, r.op, r.seq) for r in seen] == [(id_of("1"), "place", 0)] and list(seen[0].vector) == [0.0, 1.0]
    c.discard(["1"])
    run()
    assert [r.op for r in seen] == ["place", "erase"]
    e.abandon()


def test_many_commits_are_one_scan(spark, tmp_path):
    e = connect(str(tmp_path / "db"), spark=spark, dimension=2)
    c = e.collection("c")
    for i in range(6):
        c.write(vector=[1.0, i], key=str(i % 4), meta={"n": i})
    plan = c.records()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2
    assert sorted(r.meta["n"]["i"] for r in c.records().collect()) == [2, 3, 4, 5]
    e.abandon()


def test_embedder_file_is_checked(spark, tmp_path):
    path = tmp_path / "db"
    with connect(str(path), spark=spark, dimension=16) as e:
        e.collection("c").write(text="some words")
    file = path / "embedder.json"
    good = json.loads(file.read_text())
    assert good["model"] == "default" and good["dimension"] == 16
    file.write_text(json.dumps({**good, "projections": 9}))
    with pytest.raises(StorageError), connect(str(path), spark=spark) as e:
        e.collection("c").probe_text("words").collect()
    (path / ".embedder.json.crc").unlink()
    with pytest.raises(ConfigError), connect(str(path), spark=spark) as e:
        e.collection("c").probe_text("words").collect()


def test_snapshots_are_checked(spark, tmp_path):
    e = connect(str(tmp_path / "db"), spark=spark, dimension=2, metric="euclidean")
    e.collection("a").write_many([{"vector": [float(i), 1.0], "meta": {"n": i}} for i in range(5)])
    e.collection("b").write(text="some words")
    e.save_snapshot(str(tmp_path / "s"))
    e.close()
    made = Engine.load_snapshot(spark, str(tmp_path / "s"), str(tmp_path / "again"))
    assert made.totals() == {"a": 5, "b": 1} and made.verify() == "OK" and made.config.metric == "euclidean"
    assert made.collection("b").probe_text("some words").count() == 1
    assert made.embedder_loaded()
    made.unload_embedder()
    assert not made.embedder_loaded() and made.embedder().dimension == 2
    with pytest.raises(StorageError):
        made.close()
        Engine.load_snapshot(spark, str(tmp_path / "s"), str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "s" / "records")).limit(1).write.mode("append").parquet(str(tmp_path / "s" / "records"))
    with pytest.raises(StorageError, match="damaged"):
        Engine.load_snapshot(spark, str(tmp_path / "s"), str(tmp_path / "other"))
    about = json.loads((tmp_path / "s" / "snapshot.json").read_text())
    (tmp_path / "s" / ".snapshot.json.crc").unlink()
    (tmp_path / "s" / "snapshot.json").write_text(json.dumps({**about, "version": 2}))
    with pytest.raises(StorageError, match="version"):
        Engine.load_snapshot(spark, str(tmp_path / "s"), str(tmp_path / "other"))
    with pytest.raises(StorageError):
        Engine.load_snapshot(spark, str(tmp_path / "nothing"), str(tmp_path / "other"))
