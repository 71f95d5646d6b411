"""Durable state: streams equal their batch form over several batches and a restart; repeats, leases and time to live."""

import time

import pytest

from changelens.streaming import processors as P
from changelens.streaming import roles, state

SCANS = "url string, seq int, scan_id long, snapshot_id long, outcome string, base long"


def feed(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def run(spark, machine, schema, folder):
    """Starts the query anew on its checkpoint and gives all it has said so far."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    P.drain(P.stream(source, machine), str(folder / "out"), str(folder / "cp"), timeout=120)
    return sorted(map(tuple, spark.read.parquet(str(folder / "out")).collect()), key=str)


def test_watermark_goes_on_after_a_restart(spark, tmp_path):
    rows = [("u", 1, 1, 11, "ok", None), ("u", 2, 2, 12, None, None), ("u", 3, 3, 13, "ok", 11), ("u", 4, 4, 10, "ok", 11), ("u", 5, 3, 99, "ok", None), ("v", 1, 5, 21, None, None), ("v", 2, 6, 22, "ok", 7)]
    machine = P.Watermark(["url"], ["seq"])
    for part in (rows[:2] + rows[5:6], rows[2:4], rows[4:5] + rows[6:]):
        feed(spark, part, SCANS, tmp_path)
        got = run(spark, machine, SCANS, tmp_path)
    out = "url string, scan_id long, previous long, observed long, processed long, advanced boolean"
    want = state.in_batch(spark.createDataFrame(rows, SCANS), ["url"], ["seq"], state.comparison_watermark, out).collect()
    assert sorted(str(r[2:]) for r in got) == sorted(str(tuple(r)[2:]) for r in want)
    said = {(r[0], r[1]): r[2:] for r in got}
    assert said["u", 5] == (13, 99, 13, False)  # a scan that has been processed before moves nothing, however long ago
    assert said["v", 2] == (None, 22, 22, True)


def test_keys_of_a_shard_share_a_call(spark, tmp_path, monkeypatch):
    """Over five batches, with null keys, and with more of the state out of date than not."""
    monkeypatch.setattr(P, "SHARDS", 8, raising=False)
    calls = str(tmp_path / "calls")

    def told(machine):
        class Told(machine):
            def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
                with open(calls, "a") as f:
                    f.write(".")
                yield from super().handleInputRows(key, rows, timerValues)

        return Told

    kinds = {
        P.Seen: ("url string, site long, seq long, baseline boolean", lambda k, n: (n == 0,)),
        P.Steps: ("url string, site long, seq long, outcome string, category string", lambda k, n: (("failed", None, "failed", "complete", "failed")[n], f"c{k}")),
        P.FollowUps: ("url string, site long, seq long, request_id long, action string", lambda k, n: (n % 2, ("ask", "fail", "complete", "ask", "ask")[n])),
        P.Watermark: ("url string, site long, seq long, scan_id long, snapshot_id long, outcome string, base long", lambda k, n: (n % 4, n, None if n == 1 else "ok", None)),
    }
    want = {
        P.Seen: [(False, False, 0), *[(True, False, 0)] * 4],
        P.Steps: [("failed", 1, False, 1), ("running", 2, False, 1), ("failed", 3, False, 2), ("complete", 4, False, 2), ("complete", 4, True, 2)],
        P.FollowUps: [("running", False, 1), ("unknown", False, 1), ("completed", False, 1), ("running", False, 2), ("completed", True, 2)],
        P.Watermark: [(None, 0, 0, True), (0, 1, 0, False), (0, 2, 2, True), (2, 3, 3, True), (3, 4, 3, False)],
    }
    for machine, (schema, rest) in kinds.items():
        folder, before = tmp_path / machine.__name__, len((tmp_path / "calls").read_text()) if (tmp_path / "calls").exists() else 0
        folder.mkdir()
        for n in range(5):
            keys = [(None if k == 0 else f"u{k % 50}", k % 7 or None) for k in range(200)]
            feed(spark, [(*k, n, *rest(j, n)) for j, k in enumerate(dict.fromkeys(keys))], schema, folder)
        got = run(spark, told(machine)(["url", "site"], ["seq"]), schema, folder)
        assert len((tmp_path / "calls").read_text()) - before <= 5 * 8
        by_key = {}
        for r in sorted(got, key=lambda r: r[2]):
            by_key.setdefault(r[:2], []).append(r[3:])
        assert len(by_key) == len(set(keys)) and all(x == want[machine] for x in by_key.values())


def test_state_that_has_expired_is_gone(spark, tmp_path):
    schema = "url string, seq long, baseline boolean"
    for ttl, again in ((None, True), (1000, False)):
        folder = tmp_path / str(ttl)
        folder.mkdir()
        for seq in (1, 2):
            feed(spark, [("u", seq, False)], schema, folder)
            got = run(spark, P.Seen(["url"], ["seq"], ttl_ms=ttl), schema, folder)
            time.sleep(1.5)
        assert [r[2] for r in got] == [False, again]


def test_a_lease_fails_a_task_that_never_ends(spark, tmp_path):
    schema = "task string, seq long, action string, token string"
    machine = P.Claims(["task"], ["seq"], lease_ms=500)
    feed(spark, [("a", 1, "claim", "p"), ("b", 1, "claim", "p"), ("b", 2, "complete", "p")], schema, tmp_path)
    run(spark, machine, schema, tmp_path)
    time.sleep(1)
    feed(spark, [("c", 1, "claim", "q")], schema, tmp_path)
    got = run(spark, machine, schema, tmp_path)
    assert ("a", None, "failed", 1, False) in got and ("b", 2, "completed", 1, True) in got
    assert [r for r in got if r[1] is None] == [("a", None, "failed", 1, False)]


@pytest.mark.parametrize("cut", [1, 4])
def test_follow_ups_and_steps_over_batches(spark, tmp_path, cut):
    schema = "chat string, seq long, request_id long, action string"
    rows = [("c", k, r, a) for k, (r, a) in enumerate([(1, "ask"), (1, "ask"), (2, "complete"), (1, "complete"), (1, "ask"), (2, "ask"), (2, "fail"), (2, "complete")])]
    for part in (rows[:cut], rows[cut:]):
        feed(spark, part, schema, tmp_path)
        got = run(spark, P.FollowUps(["chat"], ["seq"]), schema, tmp_path)
    states = ["running", "running", "unknown", "completed", "completed", "running", "failed", "failed"]
    assert [r[2:] for r in got] == [(s, k in (1, 4), 1 if k < 5 else 2) for k, s in enumerate(states)]
    steps, folder = "run string, seq long, outcome string, category string", tmp_path / "steps"
    folder.mkdir()
    rows = [("r", 1, "failed", "x"), ("r", 2, None, None), ("r", 3, "failed", None), ("r", 4, "complete", None), ("r", 5, "failed", "y")]
    for part in (rows[:cut], rows[cut:]):
        feed(spark, part, steps, folder)
        got = run(spark, P.Steps(["run"], ["seq"]), steps, folder)
    assert [r[2:] for r in got] == [("failed", 1, False, 1), ("running", 2, False, 1), ("failed", 3, False, 2), ("complete", 4, False, 2), ("complete", 4, True, 2)]


def test_roles_keep_their_budget_and_name_what_fails(spark):
    def role(texts):
        if "boom" in texts:
            raise RuntimeError("down")
        return [[] if x == "" else [x.upper(), x] for x in texts][: 1 if "short" in texts else None]

    rows = [("a", k, x) for k, x in enumerate(["one", None, "two", "three", "four"])] + [("b", 0, "boom"), ("b", 1, "x"), ("b", 2, "short"), ("b", 3, "y")]
    df = spark.createDataFrame(rows, "chat string, seq int, text string").repartition(3)
    check = lambda text, proposal: None if proposal in text else "not_said"
    got = sorted(map(tuple, roles.ask(df, role, check, ["chat", "seq"], "text", "chat", "seq", batch=2, budget=2).collect()), key=str)
    said = lambda seq, call, x: [("a", seq, call, x.upper(), "not_said"), ("a", seq, call, x, "accepted")]
    want = [*said(0, 1, "one"), ("a", 1, 1, None, "empty"), *said(2, 2, "two"), *said(3, 2, "three"), ("a", 4, None, None, "budget"), *(("b", k, 1 + k // 2, None, "failed") for k in range(4))]
    assert got == sorted(want, key=str)
    assert {r.outcome: r.n for r in roles.tally(spark.createDataFrame(got, "chat string, seq int, call int, proposal string, status string"), []).collect()} == {"accepted": 3, "not_said": 3}
    assert roles.ask(df.limit(0), role, check, ["chat"], "text", "chat", "seq").count() == 0
    with pytest.raises(Exception, match="has no other"):
        roles.role_function(role, check, ["other"], "text")(df.asTable().partitionBy("chat")).count()
