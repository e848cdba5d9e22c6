"""The model registry's transition log: stages, tags, concurrent writers, cut-off commits."""

import threading

import pytest

from stockpulse.operators import evaluation as ev
from stockpulse.operators.registry_log import RegistryLog
from stockpulse.session import run_folder


def models(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "model_name string")


def state(log):
    return {(r["model_name"], r["version"]): (r["stage"], r["run_id"]) for r in log.versions().collect()}


@pytest.fixture
def log(spark):
    return RegistryLog(spark, run_folder(spark, "test_registry"))


def test_register_promotes_and_archives(spark, log):
    assert state(log) == {}
    assert log.register(models(spark, "a", "b", "a", None), "r1", 1000) == 0
    assert log.register(models(spark, "a"), "r2", 2000) == 1
    assert log.register(models(spark, "a"), "r3", 3000) == 2
    assert state(log) == {("a", "1"): ("Archived", "r1"), ("a", "2"): ("Archived", "r2"), ("a", "3"): ("Production", "r3"),
                          ("b", "1"): ("Production", "r1")}
    best = {r["model_name"]: r["version"] for r in ev.resolve_model(log.versions(), "Production").collect()}
    assert best == {"a": "3", "b": "1"}
    # a version archived once is not archived again
    assert log.events().where("event = 'archive'").count() == 2


def test_tags_keep_the_last_value(spark, log):
    log.register(models(spark, "a"), "r1", 1000, tags={"team": "x"})
    log.tag("a", 1, "team", "y", 2000)
    log.tag("a", 1, "note", "kept", 2000)
    assert {(r["key"], r["value"]) for r in log.tags().collect()} == {("team", "y"), ("note", "kept")}
    assert state(log) == {("a", "1"): ("Production", "r1")}


def test_a_slower_writer_commits_after_the_faster_one(spark, log):
    """Both read the empty log; the faster one commits in between."""
    slow, seen = RegistryLog(spark, log.base), []
    real = slow._claim

    def claim(n, folder):
        if not seen:
            log.register(models(spark, "a"), "fast", 1000)
        seen.append(n)
        return real(n, folder)
    slow._claim = claim
    slow.register(models(spark, "a"), "slow", 2000)
    assert seen == [0, 1]
    assert state(log) == {("a", "1"): ("Archived", "fast"), ("a", "2"): ("Production", "slow")}


def test_writers_at_the_same_time(spark, log):
    log.register(models(spark, "a"), "r0", 0)
    threads = [threading.Thread(target=RegistryLog(spark, log.base).register, args=(models(spark, "a"), f"r{i}", i)) for i in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = state(log)
    assert set(got) == {("a", "1"), ("a", "2"), ("a", "3")}
    assert [s for s, _ in got.values()].count("Production") == 1 and got["a", "3"][0] == "Production"


def test_events_without_a_commit_are_not_seen(spark, log):
    log.register(models(spark, "a"), "r1", 1000)
    log.events().drop("n").write.parquet(f"{log.base}/events/lost")      # its writer ended before the commit
    assert state(log) == {("a", "1"): ("Production", "r1")}
    log.register(models(spark, "a"), "r2", 2000)
    assert state(log)["a", "2"] == ("Production", "r2")
