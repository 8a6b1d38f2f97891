"""Registry commits: two writers never take one version."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from coverwise.operators import registry as reg

EVENTS = "model_key string, config_id int, event_seq int, created_at int"


def test_interleaved_writers(spark, tmp_path):
    log = str(tmp_path / "log")
    assert reg.read_commits(spark, log) == (None, None)
    assert reg.commit(spark, log, spark.createDataFrame([("m", 1, 1, 5), ("m", 2, 1, 4), ("k", 3, 1, 1)], EVENTS)) == 1
    # both have read commit 1; the second finds number 2 taken
    assert reg.commit(spark, log, spark.createDataFrame([("m", 4, 1, 9)], EVENTS), after=1) == 2
    assert reg.commit(spark, log, spark.createDataFrame([("m", 5, 1, 1), ("k", 6, 1, 1)], EVENTS), after=1) == 3
    promos = spark.createDataFrame([("m", 2, 1, 1), ("m", 4, 2, 2), ("m", 9, 3, 3)], "model_key string, version int, event_seq int, at int")
    assert reg.commit(spark, log, promotions=promos) == 4
    regs, promoted = reg.read_commits(spark, log)
    assert {(r["model_key"], r["config_id"]): r["version"] for r in regs.collect()} == {
        ("m", 2): 1, ("m", 1): 2, ("m", 4): 3, ("m", 5): 4, ("k", 3): 1, ("k", 6): 2}
    stages = {(r["model_key"], r["version"]): r["stage"] for r in reg.registry_state(regs, promoted).collect()}
    assert stages[("m", 4)] == "Production" and stages[("m", 2)] == "Archived" and stages[("k", 1)] == "Staging"


def test_writers_at_the_same_time(spark, tmp_path):
    log = str(tmp_path / "log")

    def write(i):
        return reg.commit(spark, log, spark.createDataFrame([("m", i, 1, 1)], EVENTS), after=0)

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    regs, promoted = reg.read_commits(spark, log)
    assert promoted is None
    assert {r["config_id"]: r["version"] for r in regs.collect()} == dict(enumerate(numbers))
