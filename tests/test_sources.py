"""Round trips of sources, sinks, the registry and the loop of rounds."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tamizal.plans.pipeline import Capabilities, rounds
from tamizal.plans.registry import Migrations, Registry
from tamizal.session import Scratch
from tamizal.sources import corpus as S


def test_pages_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 1, "uno"), ("a.pdf", 2, "dos\nlineas"), ("b.pdf", 1, "solo")], "filename string, page int, text string")
    S.write_extracted(pages, f"{tmp_path}/out")
    back = S.pages_of(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in pages.collect())


def test_binary_pages_keep_failures_as_rows(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one\fTwo\f ")
    (tmp_path / "b.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = S.read_binary_pages(spark, str(tmp_path), lambda b: b.decode("utf-8").split("\f")).collect()
    assert sorted((r["page"], r["text"]) for r in rows if r["error"] is None) == [(1, "one"), (2, "Two")]
    assert sum(r["error"] is not None for r in rows) == 1
    assert S.list_files(spark, str(tmp_path)).count() == 2


def test_corpus_with_exclusions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hola\nadiós")
    (tmp_path / "b.txt").write_text("x")
    gone = spark.createDataFrame([("b.txt",)], "name string")
    assert [(r["name"], r["text"]) for r in S.read_corpus(spark, str(tmp_path), gone).collect()] == [("a.txt", "hola\nadiós")]


def test_event_log_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event":"q","ts":"2024-01-01T00:00:00Z","latency_s":1.5}\nbroken\n{"event":"e"}\n')
    assert [r["event"] for r in S.read_events(spark, str(tmp_path / "log.jsonl")).collect()] == ["q"]


def test_front_matter(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: One\ntags: [a, b]\nrelated:\n  - x\n  - y\nnone: null\n---\nbody")
    got = {(r["field"], r["value"]) for r in S.read_front_matter(spark, str(tmp_path)).collect()}
    assert {("title", "One"), ("tags", "a"), ("tags", "b"), ("related", "x"), ("related", "y")} <= got


def test_upsert_replaces_and_quarantines(spark, tmp_path):
    target = f"{tmp_path}/t"
    S.upsert(target, spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), "k")
    S.upsert(target, spark.createDataFrame([("b", 2), (None, 3)], "k string, v int"), "k")
    before = {str(f) for f in (tmp_path / "t").rglob("*.parquet")}
    S.upsert(target, spark.createDataFrame([("b", 2)], "k string, v int"), "k")
    assert sorted(tuple(r) for r in spark.read.parquet(target).select("k", "v").collect()) == [("a", 1), ("b", 2)]
    assert len(before & {str(f) for f in (tmp_path / "t").rglob("*.parquet")}) == 1  # the other bucket was not written again
    assert spark.read.parquet(f"{target}_quarantine").count() == 1


def test_registry_lifecycle(spark, tmp_path):
    reg = Registry(spark, f"{tmp_path}/reg")
    one, two = spark.range(3), spark.range(5)
    reg.publish("b1", {"t": one})
    with pytest.raises(ValueError):
        reg.publish("b1", {"t": one})
    reg.promote("b1")
    reg.publish("b2", {"t": two})
    reg.promote("b2")
    assert reg.resolve("t").count() == 5 and reg.active() == "b2" and reg.verify("b2") == []
    assert reg.rollback() == "b1" and reg.resolve("t").count() == 3
    two.write.mode("append").parquet(f"{tmp_path}/reg/builds/b1/t")
    assert reg.verify("b1") == ["t"]
    later = datetime.now(timezone.utc) + timedelta(days=31)
    assert reg.retain(0, 30, later) == {"archived": [], "purged": []}  # b2 is what a rollback would bring back
    for b in ("b3", "b4"):
        reg.publish(b, {"t": one})
        reg.promote(b)
    assert reg.active() == "b4" and reg.retain(1, 30) == {"archived": ["b2", "b1"], "purged": []}
    assert reg.retain(1, 30, later) == {"archived": [], "purged": ["b1", "b2"]}
    assert set(reg.builds()) == {"b3", "b4"} and reg.rollback() == "b3"
    assert Registry(spark, f"{tmp_path}/reg").active() == "b3"


def test_index_grows_in_batches(spark, tmp_path):
    read = lambda files: spark.createDataFrame([(f, f"text of {f}") for f in files], "path string, text string")
    target = f"{tmp_path}/index"
    assert S.build_index(spark, [f"f{i}" for i in range(5)], target, read, batch=2) == 5
    assert S.build_index(spark, [f"f{i}" for i in range(7)], target, read, batch=2) == 2
    assert spark.read.parquet(target).count() == 7
    assert S.build_index(spark, ["f1"], target, read, rebuild=True) == 1 and spark.read.parquet(target).count() == 1


def test_cross_references(spark):
    notes = spark.createDataFrame([("a", "related", "x"), ("b", "related", "x"), ("b", "title", "y"), ("c", "supersedes", None)], "path string, field string, value string")
    assert [(r["value"], r["notes"]) for r in S.cross_references(notes).collect()] == [("x", ["a", "b"])]


def test_migrations_take_the_shortest_way(spark):
    m = Migrations()
    for a, b in (("1", "2"), ("2", "3"), ("1", "3")):
        m.register(a, b, lambda t, s=f"{a}{b}": {k: v.withColumn("way", F.lit(s)) for k, v in t.items()})
    assert m.path("1", "3") == ["1", "3"]
    assert m.apply({"t": spark.range(1)}, "1", "3")["t"].first()["way"] == "13"
    with pytest.raises(KeyError):
        m.path("3", "1")


def test_rounds_and_capabilities(spark):
    caps = Capabilities()
    caps.register("halve", lambda df: df.withColumn("n", F.floor(F.col("n") / 2)))
    step = lambda df: caps.run(df, [("halve", {})]).withColumn("done", F.col("n") <= 1)
    out = rounds(Scratch(spark, "test"), spark.createDataFrame([(1, 100, False), (2, 1, True), (3, 3, False)], "id int, n long, done boolean"), step)
    assert sorted((r["id"], r["n"]) for r in out.collect()) == [(1, 1), (2, 1), (3, 1)]
    cut = rounds(Scratch(spark, "test"), spark.createDataFrame([(1, 1 << 40, False)], "id int, n long, done boolean"), step, 3)
    assert [tuple(r) for r in cut.collect()] == [(1, 1 << 37, True)]
