import pandas as pd
import pytest
from pyspark.sql import functions as F

from docsieve.operators import question_run as qr
from docsieve.operators import sessions as ss
from docsieve.schemas import SESSION_SCHEMA

CHUNKS = [(1, "u1", "Spark tables keep their schema in the catalog of the workspace."), (2, "u2", "A stream reads a table and writes another one."), (3, "u3", "Write to ann@example.com about tables.")]
REQUESTS = [
    (1, "ann", "How do I keep the schema of spark tables?"), (2, "bob", "short"), (3, "eve", "Please fail about a stream and a table now"),
    (4, "dan", "Tell me a secret about a stream and tables please"), (5, "ida", "12-34 !!! 56-78 ??? 90-12 !!! 34"), (6, "kim", "12-34 !!! 56-78 ??? 90-12 !!! 34"),
]
STORED = [(1, 1, "What is Spark?", "An engine."), (1, 2, "And tables?", ""), (5, 1, "How do I tune a spark cluster on databricks?", "Set it."), (6, 1, "98-76 ... 54-32 ... 10-98 ... 76", "Pie.")]


@pytest.fixture(scope="module")
def run(spark):
    def load():
        def model(batch: pd.Series) -> pd.Series:
            if batch.str.contains("Please fail").any():
                raise RuntimeError("down")
            return batch.map(lambda p: "Call bob@secret.org now, it is open today." if "secret" in p else "Answer to: " + p)

        return model

    requests = spark.createDataFrame(REQUESTS, "thread_id int, user_id string, question string")
    stored = spark.createDataFrame(STORED, "session_id int, turn_number int, user_message string, assistant_response string")
    chunks = spark.createDataFrame(CHUNKS, "id int, url string, chunk_text string")
    return qr.question_run(requests, stored, chunks, load, k=2, history_turns=2)


def test_statuses(run):
    got = {r.thread_id: r for r in run.collect()}
    assert {i: r.status for i, r in got.items()} == {1: "answered", 2: "blocked_question", 3: "failed", 4: "blocked_answer", 5: "answered", 6: "blocked_question"}
    assert got[2].blocked_by == "input_length_min" and got[4].blocked_by == "pii_leakage" and got[6].blocked_by == "intent"
    assert got[2].sources == 0 and got[1].sources == 2 and "bob@" not in got[4].response
    assert {i: r.turn_number for i, r in got.items() if r.turn_number} == {1: 3, 5: 2}
    assert {i: r.history_messages for i, r in got.items()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 2, 6: 2}
    text = got[1].response
    assert text.index("user: What is Spark?") < text.index("[Source 1] u1") < text.index("Question: How do I keep")


def test_stored_turns_follow_on(spark, run, tmp_path):
    turns = qr.turns_to_store(run, F.lit("2024-01-01"), F.lit(1.0), F.lit("m"), F.lit("t"), F.lit(None))
    turns.write.parquet(f"{tmp_path}/turns")
    back = spark.read.schema(SESSION_SCHEMA).parquet(f"{tmp_path}/turns")
    assert {(r.session_id, r.turn_number) for r in back.collect()} == {("1", 3), ("5", 2)}
    old = spark.createDataFrame(STORED, "session_id int, turn_number int, user_message string, assistant_response string")
    both = old.withColumn("session_id", F.col("session_id").cast("string")).unionByName(back.select("session_id", "turn_number", "user_message", "assistant_response"))
    last = ss.history(both, 1).where("session_id = '1'").orderBy("position").collect()
    assert [m.role for m in last] == ["user", "assistant"] and last[0].content == REQUESTS[0][2]
