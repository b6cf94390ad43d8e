"""Optimistic commits: racing writers, readers, stored-table merges, retraining in parallel."""

import datetime as dt
import os
import threading

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from demandlake.operators import contract as ct
from demandlake.operators import features as fe
from demandlake.plans import boosting as bo
from demandlake.plans import models as md
from demandlake.plans import retrain as rt
from demandlake.sources.stored import StoredTable
from demandlake.sources.versions import Conflict, VersionLog

DDL = "k bigint, name string, value bigint, at int"


def race(n, work):
    threads, errors = [], []

    def run(i):
        try:
            work(i)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    for i in range(n):
        threads.append(threading.Thread(target=run, args=(i,)))
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors, errors


def test_one_of_many_writers_wins_every_version(spark, tmp_path):
    folder, won = str(tmp_path), []
    logs = [VersionLog(spark, folder) for _ in range(6)]

    def work(i):
        for read in range(5):
            if logs[i].commit(read, {"by": i}):
                won.append((read, i))

    race(6, work)
    assert sorted(r for r, _ in won) == list(range(5))
    log = VersionLog(spark, folder)
    assert log.latest()[0] == 5 and all(log.entry(r + 1) == {"by": i} for r, i in won)
    assert not [f for f in os.listdir(tmp_path / "_log") if f.startswith("_")]


def test_updates_count_up_and_reservations_differ(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path))
    assert log.latest() == (0, None)
    race(4, lambda i: [log.update(lambda n, e: {"total": (e or {"total": 0})["total"] + 1}, tries=200) for _ in range(5)])
    assert log.latest()[1] == {"total": 20}
    numbers = []
    race(4, lambda i: numbers.extend(log.reserve() for _ in range(3)))
    assert len(set(numbers)) == 12 and min(numbers) > 20
    assert log.update(lambda n, e: None) is None
    blocked = VersionLog(spark, str(tmp_path))
    blocked.commit = lambda read, entry: False
    with pytest.raises(Conflict):
        blocked.update(lambda n, e: {}, tries=3)


def test_a_rename_elsewhere_creates_only_once(spark, tmp_path):
    """The way of file systems that are not a local disk."""
    log = VersionLog(spark, str(tmp_path))
    log.local = False
    assert log.commit(0, {"a": 1}) and not log.commit(0, {"a": 2}) and log.latest() == (1, {"a": 1})


def table(spark, tmp_path, parts=8):
    return StoredTable(spark, str(tmp_path / "t"), DDL, ["k", "name"], "at", parts)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_rewrites_touched_parts_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.merge(t.read()) == 0
    base = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("name"), F.col("id").alias("value"), F.lit(1).alias("at"))
    assert t.merge(base) == 1
    before = t.log.latest()[1]["folders"]
    one = base.where("k = 17").withColumn("value", F.lit(-1).cast("bigint")).withColumn("at", F.lit(2))
    assert t.merge(one) == 2
    entry = t.log.latest()[1]
    changed = [p for p in before if before[p] != entry["folders"][p]]
    assert len(changed) == 1 and entry["rewritten"] == changed
    assert os.listdir(tmp_path / "t" / entry["folders"][changed[0]]).count(f"_part={changed[0]}") == 1
    assert rows(t.read()) == rows(ct.upsert(base, one, ["k", "name"], "at").select("k", "name", "value", "at"))
    assert rows(t.read(version=1)) == rows(base) and t.read(version=1).where("value < 0").count() == 0


def test_merge_of_odd_rows_equals_upsert(spark, tmp_path):
    t, seen = table(spark, tmp_path, 3), spark.createDataFrame([], DDL)
    batches = [[(None, None, 1, 1), (1, "a", None, 1), (1, "a", 5, 1), (2, None, 2, 7)],
               [(None, None, 9, 0), (1, "a", 6, 1), (2, None, 3, 6)], [(3, "é", 1, None), (1, "a", 7, 2)]]
    for b in batches:
        df = spark.createDataFrame(b, DDL)
        t.merge(df.withColumn("_part", F.lit("other")))
        seen = ct.upsert(seen, df, ["k", "name"], "at").select("k", "name", "value", "at")
    assert rows(t.read()) == rows(seen)


def test_merges_at_once_lose_nothing(spark, tmp_path):
    t = table(spark, tmp_path, 2)
    race(4, lambda i: t.merge(spark.range(10).select((F.col("id") * 4 + i).alias("k"), F.lit("n").alias("name"),
                                                     F.lit(i).cast("bigint").alias("value"), F.lit(1).alias("at"))))
    assert t.log.latest()[0] == 4 and sorted(r.k for r in t.read().collect()) == list(range(40))


def sales(spark, days):
    start = dt.date(2025, 1, 1)
    rows = []
    for i in range(days):
        d = start + dt.timedelta(days=i)
        q = 40 + 10 * (d.weekday() >= 5) + i % 3
        rows.append(("Cafe", "Latte", d, 20.0, 1.0, q + 3, q, q, 3, "Clear", 0))
    return spark.createDataFrame(rows, "business_type string, item_name string, date date, price double, shelf_life_hours double, "
                                 "quantity_available bigint, quantity_sold bigint, customer_demand bigint, waste_quantity bigint, "
                                 "weather_condition string, holiday_flag int")


def test_a_retraining_that_lost_compares_itself_with_the_new_champion(spark, tmp_path, monkeypatch):
    df = sales(spark, 150)
    old, upload = df.where("date < '2025-04-01'"), df.where("date >= '2025-04-01'").withColumn(
        "date", F.date_format("date", "yyyy-MM-dd"))
    weak = md.gbt(max_iter=1, max_depth=1).fit(fe.build_features(old))
    base, once = str(tmp_path), []

    real = rt.write_history

    def slow(df, path, mode="errorifexists"):
        """Another job promotes the same good model while this one writes its history."""
        if not once:
            once.append(1)
            assert rt.retrain(spark, upload, old, weak, base, factory=md.ridge(1.0)).first().deployed
        return real(df, path, mode)

    monkeypatch.setattr(rt, "write_history", slow)
    first = rt.retrain(spark, upload, old, weak, base, factory=md.ridge(1.0)).first()
    assert not first.deployed and first.new_mape == first.old_mape  # a tie with the new champion
    log = VersionLog(spark, base)
    assert log.latest()[0] == 1 and rt.current_version(spark, base).first().version == log.latest()[1]["version"] == 2
    assert isinstance(rt.current_model(spark, base), PipelineModel)


def test_ensemble_is_a_stage_of_a_saved_pipeline(spark, tmp_path):
    feats = fe.build_features(sales(spark, 90))
    members = {"Ridge": md.ridge(1.0).fit(feats), "Boosted": bo.BoostedTrees(rounds=2, depth=2).fit(feats)}
    inner = md.EnsembleModel(members, {"Ridge": 0.25, "Boosted": 0.75})
    outer = md.EnsembleModel({"inner": inner, "Ridge": members["Ridge"]}, {"inner": 0.5, "Ridge": 0.5})
    path = str(tmp_path / "pipe")
    PipelineModel([outer]).write().save(path)
    back = md.load_model(path)
    a, b = (sorted(r.prediction for r in m.transform(feats).collect()) for m in (PipelineModel([outer]), back))
    assert a == b and back.stages[0].weights == outer.weights
    parts = [sorted(r.prediction for r in m.transform(feats.where("date = '2025-02-01'")).collect()) for m in (
        members["Ridge"], members["Boosted"], outer)]
    assert abs(parts[2][0] - (0.5 * (0.25 * parts[0][0] + 0.75 * parts[1][0]) + 0.5 * parts[0][0])) < 1e-9
    assert md.permutation_importance(outer, feats, ["business_type", "item_name", "date"]).count() == 34


def test_a_merge_computes_its_batch_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    t = StoredTable(spark, str(tmp_path / "once"), "k int, at int", ["k"], "at", 4)
    batch = spark.range(50).select(F.udf(seen, "int")(F.col("id").cast("int")).alias("k"), F.lit(1).alias("at"))
    t.merge(batch)
    assert calls.value == 50 and t.read().count() == 50
