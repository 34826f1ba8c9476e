from datetime import datetime, timedelta

from quillmesh.functions import skew
from quillmesh.operators import audit as A
from quillmesh.streaming import quotas as Q

T0 = datetime(2030, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def test_upsert_active_prune(spark):
    rows = [("1", at(5), at(6), "verified", "p"), ("1", at(1), at(9), "provider_asserted", "q"), ("2", at(1), at(1), "provider_asserted", "p")]
    df = spark.createDataFrame([(*r, "cites", "e") for r in rows], "assertion_id string, first_seen_at timestamp, last_seen_at timestamp, verification_status string, provider string, relation string, evidence_type string")
    got = {r.assertion_id: (r.first_seen_at, r.last_seen_at, r.status, r.provider) for r in A.upserted(df).collect()}
    assert got["1"] == (at(1), at(9), "verified", "q") and got["2"][2] == "provider_asserted"
    ev = spark.createDataFrame([("1", "merge", None), ("2", "revert", "1"), ("3", "split", None)], "event_id string, action string, reverts_event_id string")
    assert [r.event_id for r in A.active_events(ev).collect()] == ["3"]
    d = spark.createDataFrame([(k, at(k)) for k in range(6)], "k int, t timestamp")
    assert sorted((r.k, r.reason) for r in A.prune_preview(d, "k", "t", at(2), 3).collect()) == [(0, "age"), (1, "age"), (2, "capacity")]


def test_streaks_gaps_quotas(spark):
    rows = [(k, "u", at(k * 10), k in (1, 2, 3, 5)) for k in range(7)]
    df = spark.createDataFrame(rows, "event_id long, u string, t timestamp, bad boolean")
    (s,) = A.streaks(df, "u", "t", "bad", 3).collect()
    assert (s.started, s.ended, s.failures) == (at(10), at(30), 3)
    assert len(A.pacing_gaps(df, "u", "t", 10.5).collect()) == 6 and not A.pacing_gaps(df, "u", "t", 10).collect()
    assert sorted(r.event_id for r in Q.minute_quota(df, "u", "t", 4).collect()) == [4, 5]
    assert sorted(r.event_id for r in Q.first_hit_quota(df, "u", "t", 2, 35).collect()) == [2, 3, 6]
    assert Q.first_hit_quota(df.limit(0), "u", "t", 2, 35).collect() == []


def test_lookup_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = spark.createDataFrame([("h", k) for k in range(40)] + [("x", 1), (None, 2), ("none", 3)], "k string, v int")
    table = spark.createDataFrame([("h", "H"), ("x", "X")], "k string, w string")
    got = skew.lookup_join(rows, table, "k", 43)
    assert sorted((r.k or "", r.v, r.w or "") for r in got.collect()) == sorted([("h", k, "H") for k in range(40)] + [("x", 1, "X"), ("", 2, ""), ("none", 3, "")])
    assert got.columns == ["k", "v", "w"] and skew.lookup_join(rows, table, "k", 43, "inner").count() == 41
