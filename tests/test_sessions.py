import pytest
from pyspark.sql import functions as F

from docsieve.operators import sessions as ss


def msgs(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


THREAD = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "user", "u3"), (1, 5, "assistant", "a3"),
          (1, 6, "assistant", "a3b"), (2, 0, "assistant", "alone"), (3, 0, "user", "only")]


@pytest.mark.parametrize("slice_len", [1000, 2])
def test_turns(spark, slice_len):
    got = sorted(tuple(r) for r in ss.turns_from_messages(msgs(spark, THREAD), slice_len=slice_len).collect())
    assert got == [(1, 1, "u1", "a1"), (1, 2, "u2", None), (1, 3, "u3", "a3"), (3, 1, "only", None)]


def test_history(spark):
    turns = spark.createDataFrame([("s", 1, "u1", "a1"), ("s", 2, "u2", ""), ("s", 3, "u3", None), ("s", 4, "u4", "a4"), ("t", 1, "x", "y")],
                                  "session_id string, turn_number int, user_message string, assistant_response string")
    got = [(r.position, r.role, r.content) for r in ss.history(turns, 3).where("session_id = 's'").orderBy("position").collect()]
    assert got == [(1, "user", "u2"), (2, "user", "u3"), (3, "user", "u4"), (4, "assistant", "a4")]
    assert ss.history(turns.where("session_id = 'none'")).count() == 0


@pytest.mark.parametrize("piece", [1000, 2])
def test_context_and_query(spark, piece, monkeypatch):
    monkeypatch.setattr(ss, "SLICE", piece)
    rows = [tuple(r) for r in ss.conversation_context(msgs(spark, THREAD)).orderBy("conv_id", "position").collect()]
    assert rows == [(1, 4, "u3", 1, "u1"), (1, 4, "u3", 2, "u2"), (3, 0, "only", 0, None)]
    assert {r.conv_id: r.query for r in ss.retrieval_query(msgs(spark, THREAD), 2).collect()} == {1: "u2 u3", 3: "only"}


def test_whole_context_of_a_thread(spark):
    long = [(4, i, "user", None if i == 7 else f"m{i}") for i in range(30)]
    whole = ss.whole_context(ss.conversation_context(msgs(spark, THREAD + long)))
    said = " ".join(f"m{i}" for i in range(29) if i != 7)
    assert {r.conv_id: r.context for r in whole.collect()} == {1: "u1 u2", 3: "", 4: said}


@pytest.mark.parametrize("part", [1000, 1])
def test_thread_intents_across_parts(spark, part):
    rows = msgs(spark, [(1, 0, "user", "we die"), (1, 1, "user", "now"), (1, 2, "user", "and?"), (2, 0, "user", "x")])
    got = {r.conv_id: (r.blocked, r.intent) for r in ss.thread_intents(rows, {"g": ["die now"]}, ["g"], part).collect()}
    assert got == {1: (False, "g_from_context"), 2: (True, "off_topic")}


@pytest.mark.parametrize("piece", [1000, 4])
def test_threads(spark, piece, monkeypatch):
    monkeypatch.setattr(ss, "SLICE", piece)
    got = [tuple(r) for r in ss.fold_threads(msgs(spark, THREAD)).where("conv_id = 1").orderBy("position").collect()]
    assert got == [(1, i, r, t, 3, 6) for i, (_, _, r, t) in enumerate(THREAD[:7], 1)]
    assert ss.fold_threads(msgs(spark, THREAD)).count() == len(THREAD)
    assert [r.text for r in ss.recent_messages(msgs(spark, THREAD), 1).where("conv_id = 1").orderBy("turn").collect()] == ["a3", "a3b"]


def test_long_thread_has_one_shape(spark):
    rows = [(1, t, "ua"[t % 2] + "x", f"m{t}") for t in range(5000)] + [(2, 0, "ux", "short")]
    got = ss.fold_threads(msgs(spark, rows)).where("conv_id = 1").orderBy("position").collect()
    assert [(r.position, r.content) for r in got] == [(t + 1, f"m{t}") for t in range(5000)]
    assert {r.updated_at for r in got} == {4999}


def test_memory(spark):
    w = spark.createDataFrame([("u", "k", "old", 1), ("u", "k", "new", 2), ("v", "k", "x", 1)], "user_id string, key string, value string, saved_at int")
    later = spark.createDataFrame([("v", "k", "y", 5)], w.schema)
    assert {(r.user_id, r.value) for r in ss.upsert_memory(later, ss.upsert_memory(w)).collect()} == {("u", "new"), ("v", "y")}
    mem = spark.createDataFrame([("u", f"k{i}", "a" * (i % 4), 0) for i in range(30)] + [("v", "k", "aaaaaaa", 0)], w.schema)
    asked = spark.createDataFrame([(1, "u", "q"), (2, "none", "q")], "query_id int, user_id string, query string")
    for block in (1000, 4):
        got = [(r.query_id, r.rank, r.key) for r in ss.recall(mem, asked, lambda q, v: F.length(v), 3, block).orderBy("rank").collect()]
        assert got == [(1, 1, "k11"), (1, 2, "k15"), (1, 3, "k19")]


def test_recall_of_a_hot_user(spark):
    """A third of all memories and most queries are one user's; the plan has no row a pair."""
    mem = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("user_id"),
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") * 7919 % 1009).cast("string").alias("value"),
    )
    asked = spark.range(60).select(F.col("id").alias("query_id"), F.when(F.col("id") < 40, "hot").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("user_id"), (F.col("id") * 17).cast("string").alias("query"))
    near = lambda q, v: -F.abs(q.cast("int") - v.cast("int"))
    got = {(r.query_id, r.rank): (r.key, r.score) for r in ss.recall(mem, asked, near, 3, 100).collect()}
    held = {}
    for r in mem.collect():
        held.setdefault(r.user_id, []).append((r.key, int(r.value)))
    want = {}
    for q in asked.collect():
        best = sorted((abs(int(q.query) - v), k) for k, v in held.get(q.user_id, []))[:3]
        want |= {(q.query_id, i): (k, -d) for i, (d, k) in enumerate(best, 1)}
    assert got == want


def test_stored_turns(spark):
    from docsieve.schemas import SESSION_SCHEMA

    turns = ss.turns_from_messages(msgs(spark, THREAD))
    out = ss.stored_turns(turns, F.lit("2024-01-01T00:00:00"), F.lit(12), F.lit("m"), F.lit(None), F.lit("{}"))
    want = spark.createDataFrame([], SESSION_SCHEMA).schema
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in want]
    rows = out.collect()
    assert len({r.turn_id for r in rows}) == len(rows) == 4 and all(r.response_time_ms == 12.0 for r in rows)


def test_fallback_ids_triggers(spark):
    a = spark.createDataFrame([("s1", 1)], "session_id string, n int")
    b = spark.createDataFrame([("s1", 9), ("s2", 9)], "session_id string, n int")
    assert {tuple(r) for r in ss.history_with_fallback(a, b).collect()} == {("s1", 1), ("s2", 9)}
    df = spark.createDataFrame([("jo.doe@x.org",), (None,)], "u string")
    assert [r.y for r in df.select(ss.safe_user_id(F.col("u")).alias("y")).collect()] == ["jo_doe_at_x_org", None]
    got = ss.match_triggers(spark.createDataFrame([("What COST now",), ("hi",)], "t string"), "t", {"calc": ["cost", "sum"], "time": ["NOW"], "none": []})
    assert {(r.t, r.tool) for r in got.collect()} == {("What COST now", "calc"), ("What COST now", "time")}
