"""An updated history equals one that is computed anew, and touches only the owners with new uploads."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgermill.operators import history

KIND = "owner string, upload string, date date, amount decimal(18,2)"


def judge(rows):
    whole = rows.groupBy("owner").agg(F.sum("amount").cast("decimal(18,2)").alias("all_of"), F.count(F.lit(1)).alias("n")).withColumnRenamed("owner", "_o")
    return rows.join(whole, F.col("owner").eqNullSafe(F.col("_o"))).drop("_o")


def row(owner, upload, day, amount):
    return owner, upload, dt.date(2026, 1, day), Decimal(amount)


def test_update_equals_a_new_computation(spark, tmp_path):
    path = str(tmp_path / "h")
    old = [row("a", "1", 1, "5.00"), row("a", "1", 2, "6.00"), row("b", "1", 3, "7.00"), row(None, "1", 3, "1.00"), row("c", "1", 4, "9.00")]
    new = [row("a", "2", 9, "50.00"), row(None, "2", 9, "2.00"), row("d", "1", 9, "3.00"), row("a", "copy", 1, "5.00"), row("a", "copy", 2, "6.00"), row("d", "twin", 9, "3.00")]
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    history.write_history(judge(frame(old)), path, ["owner"], 4)
    # A mark that only a new judgement of the owner would remove.
    marked = [(*r, Decimal("9.00"), 77) if r[0] == "c" else tuple(x) for x in judge(frame(old)).collect() for r in [x[:4]]]
    history.write_history(spark.createDataFrame(marked, judge(frame(old)).schema), path, ["owner"], 4)
    errors = history.update_history(spark, path, frame(new), ["owner"], "upload", judge, 4)
    assert sorted(map(tuple, errors.collect())) == [("copy", "repeated statement"), ("twin", "repeated statement")]
    want = {tuple(r) for r in judge(frame([*old, *new[:3]])).collect()}
    got = {tuple(r) for r in history.read_history(spark, path).drop("bucket").collect()}
    assert {r for r in got if r[0] != "c"} == {r for r in want if r[0] != "c"}
    assert [r[-1] for r in got if r[0] == "c"] == [77]
    again = history.update_history(spark, path, frame(new), ["owner"], "upload", judge, 4)
    assert sorted(r.error for r in again.collect()) == ["known statement"] * 2 + ["repeated statement"] * 2
    assert {tuple(r) for r in history.read_history(spark, path).drop("bucket").collect()} == got
    assert history.update_history(spark, path, frame([]), ["owner"], "upload", judge, 4).count() == 0


def test_recomputation_judges_written_rows(spark, monkeypatch):
    """Rows of an update come from joins; judging reads them more than once and must not run those again."""
    from ledgermill.plans import transactions

    judge, plans = transactions.anomaly.detect_anomalies, []

    def seen(rows, *args, **kwargs):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return judge(rows, *args, **kwargs)

    monkeypatch.setattr(transactions.anomaly, "detect_anomalies", seen)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select("statement", "anomaly_type", "n", "top_score").collect())
    got = rows(transactions.rel_recomputed(spark, "/root/testdata/sf0.001"))
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    assert got == rows(transactions.win_detect_anomalies(spark, "/root/testdata/sf0.001"))
