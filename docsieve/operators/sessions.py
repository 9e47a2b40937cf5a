"""Conversation turns, thread state and long-term memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.scale import running
from docsieve.operators.screening import group_index, intent_from

TEXT_LIMIT = 4000  # fixed value: stored message length


SLICE = 1000  # turns of a thread that are counted, or searched for a keyword, as one piece
MEMORIES = 1000  # memories of a user that lie in one block, about


def _joined() -> Column:
    """Texts in turn order, joined by a space."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return F.array_join(F.transform(rows, lambda r: r["text"]), " ")


def numbered(msgs: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Add ``position`` from 1 in the order of turns; counted in slices, so an endless thread is spread over tasks."""
    return running(msgs, [conv], [turn], {"position": F.lit(1)}, F.floor(F.col(turn) / SLICE))


def conversation_context(turns: DataFrame) -> DataFrame:
    """Per thread the current (last) user message, and what was said before it.

    ``conv_id, turn, message, position, text``: one row for each earlier user
    message, numbered from 1 in time order, at every length of a thread; a
    thread without earlier ones has one row with position 0 and no text. A
    reader that wants one value joins the texts of a thread by a space.
    """
    users = turns.where(F.col("role") == "user").select("conv_id", "turn", "text")
    last = users.groupBy("conv_id").agg(F.max("turn").alias("_last"), F.max_by("text", "turn").alias("message"), F.count("*").alias("_n"))
    rows = numbered(users).join(last, "conv_id").where((F.col("turn") < F.col("_last")) | (F.col("_n") == 1))
    alone = F.col("_n") == 1
    return rows.select(
        "conv_id", F.col("_last").alias("turn"), "message", F.when(alone, 0).otherwise(F.col("position")).alias("position"),
        F.when(~alone, F.col("text")).alias("text"),
    )


def whole_context(rows: DataFrame) -> DataFrame:
    """Of rows of :func:`conversation_context`, one per thread: ``conv_id, context``, its texts in time order, joined by a space."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda r: r["text"])
    return rows.groupBy("conv_id").agg(F.array_join(texts, " ").alias("context"))


def _context_parts(turns: DataFrame, part: int) -> DataFrame:
    """``conv_id, message, part, context``: the earlier user messages, ``part`` turns at a time."""
    users = turns.where(F.col("role") == "user").select("conv_id", "turn", "text")
    last = users.groupBy("conv_id").agg(F.max("turn").alias("_last"), F.max_by("text", "turn").alias("message"))
    parts = users.groupBy("conv_id", F.floor(F.col("turn") / part).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_rows")
    )
    earlier = F.filter("_rows", lambda r: r["turn"] < F.col("_last"))
    return parts.join(last, "conv_id").select(
        "conv_id", "message", "part", F.array_join(F.transform(earlier, lambda r: r["text"]), " ").alias("context")
    )


def thread_intents(
    turns: DataFrame, groups: dict[str, list[str]], allowed: list[str] | None = None, part: int = SLICE
) -> DataFrame:
    """Keyword intent of each thread's current message: ``conv_id, blocked, intent``.

    Falls back to the earlier user messages. A part of a long thread also
    sees the end of the part before it, so a keyword across the cut is found.
    """
    rows = _context_parts(turns, part)
    longest = max((len(w) for words in groups.values() for w in words), default=1)
    before = Window.partitionBy("conv_id").orderBy("part")
    tail = F.lag(F.right(F.concat("context", F.lit(" ")), F.lit(longest + 1))).over(before)
    carried = rows.withColumn("_text", F.concat(F.coalesce(tail, F.lit("")), "context"))
    hit = carried.withColumn("_g", group_index(F.col("_text"), groups))
    found = hit.groupBy("conv_id").agg(F.max("message").alias("message"), F.min("_g").alias("_before"))
    return found.select("conv_id", intent_from(group_index(F.col("message"), groups), F.col("_before"), groups, allowed).alias("_c")).select(
        "conv_id", "_c.blocked", "_c.intent"
    )


def retrieval_query(turns: DataFrame, n: int = 3) -> DataFrame:
    """Per thread: the last ``n`` user messages in time order, joined by a space."""
    recent = _last_rows(turns.where(F.col("role") == "user"), n)
    return recent.groupBy("conv_id").agg(_joined().alias("query"))


def _last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows per thread; the rank limit also prunes before the shuffle."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def turns_from_messages(msgs: DataFrame, slice_len: int = SLICE) -> DataFrame:
    """One stored turn per user message: its number, text and the reply before the next user message.

    Turn numbers are running counts in slices of ``slice_len`` turns, so an
    endless thread is spread over tasks. Texts are cut to what is stored first.
    """
    said = msgs.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", F.left(F.col("text"), F.lit(TEXT_LIMIT)).alias("text"))
    is_user = F.when(F.col("role") == "user", 1).otherwise(0)
    counted = running(said, ["conv_id"], ["turn"], {"turn_number": is_user}, F.floor(F.col("turn") / slice_len))
    part = F.struct("turn", "text")
    by_turn = counted.where(F.col("turn_number") > 0).groupBy("conv_id", "turn_number").agg(
        F.min(F.when(F.col("role") == "user", part)).alias("u"),
        F.min(F.when(F.col("role") == "assistant", part)).alias("a"),
    )
    return by_turn.select(
        F.col("conv_id").alias("session_id"), F.col("turn_number").cast("int").alias("turn_number"),
        F.col("u.text").alias("user_message"), F.col("a.text").alias("assistant_response"),
    )


def stored_turns(
    turns: DataFrame, request_time: Column, response_time_ms: Column, model_endpoint: Column, trace_id: Column, metadata: Column
) -> DataFrame:
    """Turns in the ten columns of ``SESSION_SCHEMA``: an id from session and number, and what the serving layer knows of the request."""
    return turns.select(
        F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn_number").cast("string")), 256).alias("turn_id"),
        F.col("session_id").cast("string").alias("session_id"), F.col("turn_number").cast("int").alias("turn_number"),
        F.left(F.col("user_message"), F.lit(TEXT_LIMIT)).alias("user_message"), F.left(F.col("assistant_response"), F.lit(TEXT_LIMIT)).alias("assistant_response"),
        request_time.cast("string").alias("request_time"), response_time_ms.cast("double").alias("response_time_ms"),
        model_endpoint.cast("string").alias("model_endpoint"), trace_id.cast("string").alias("trace_id"), metadata.cast("string").alias("metadata"),
    )


def history(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of each session as messages ``position, role, content``, oldest first.

    Empty messages are dropped; positions count what is left.
    """
    w = Window.partitionBy("session_id").orderBy(F.col("turn_number").desc())
    recent = turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    pair = F.array(
        F.struct(F.lit(0).alias("half"), F.lit("user").alias("role"), F.col("user_message").alias("content")),
        F.struct(F.lit(1).alias("half"), F.lit("assistant").alias("role"), F.col("assistant_response").alias("content")),
    )
    kept = F.filter(pair, lambda m: F.coalesce(m["content"] != "", F.lit(False)))
    rows = recent.select("session_id", "turn_number", F.explode(kept).alias("m"))
    # At most 2n rows per session are left here.
    order = Window.partitionBy("session_id").orderBy("turn_number", "m.half")
    return rows.select("session_id", F.row_number().over(order).alias("position"), "m.role", "m.content")


def recent_messages(msgs: DataFrame, n: int) -> DataFrame:
    """The last ``2n`` messages of each thread."""
    return _last_rows(msgs, 2 * n)


def fold_threads(msgs: DataFrame) -> DataFrame:
    """Stored state per thread: ordered messages, user turns, latest turn.

    ``conv_id, position, role, content, turn_count, updated_at``: one row for
    each stored message, numbered from 1, at every length of a thread; the
    counts are those of the whole thread.
    """
    said = msgs.where((F.col("role") != "") & (F.col("text") != ""))
    totals = said.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).cast("int").alias("turn_count"), F.max("turn").alias("updated_at")
    )
    return numbered(said.select("conv_id", "turn", "role", "text")).join(totals, "conv_id").select(
        "conv_id", "position", "role", F.col("text").alias("content"), "turn_count", "updated_at"
    )


def upsert_memory(writes: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Latest value per ``(user_id, key)``; combines on the map side, so a hot key costs one row per task."""
    rows = writes if current is None else current.unionByName(writes)
    return rows.groupBy("user_id", "key").agg(
        F.max_by("value", F.struct("saved_at", "value")).alias("value"), F.max("saved_at").alias("saved_at")
    )


def recall(memories: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], k: int = 5, block: int = MEMORIES) -> DataFrame:
    """Top ``k`` memories for each query within its own user: ``query_id, user_id, key, value, score, rank``.

    ``score`` makes a number of a query and a value. Ties go to the smaller
    key. The memories of a user lie in blocks of about ``block``, as many as
    their count asks for; a query meets each block as one row, and the block's
    best ``k`` are all that leaves it.
    """
    held = memories.select("user_id", "key", "value")
    counts = held.groupBy("user_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    placed = held.join(counts, "user_id").withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    blocks = placed.groupBy("user_id", "_block").agg(F.collect_list(F.struct("key", "value")).alias("_held"))
    asked = queries.select("query_id", "user_id", "query").join(counts, "user_id")
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    scored = F.transform("_held", lambda m: F.struct((-score(F.col("query"), m["value"])).alias("_low"), m["key"].alias("key"), m["value"].alias("value")))
    best = asked.join(blocks, ["user_id", "_block"]).select("query_id", "user_id", F.explode(F.slice(F.array_sort(scored), 1, k)).alias("_m"))
    found = best.select("query_id", "user_id", "_m.key", "_m.value", (-F.col("_m._low")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def history_with_fallback(primary: DataFrame, secondary: DataFrame, key: str = "session_id") -> DataFrame:
    """The primary store's rows, and the secondary's for sessions the primary does not hold."""
    rest = secondary.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def safe_user_id(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("."), F.lit("_")), F.lit("@"), F.lit("_at_"))


def match_triggers(msgs: DataFrame, text: str, tools: dict[str, list[str]]) -> DataFrame:
    """One row per message and tool whose trigger occurs in it, in any case.

    The tool list is configuration, so it is part of the expression: one scan,
    no join.
    """
    low = F.lower(F.col(text))
    listed = [
        F.when(F.exists(F.array(*[F.lit(t.lower()) for t in words]), lambda t: F.contains(low, t)), F.lit(name))
        for name, words in tools.items() if words
    ]
    hits = F.filter(F.array(*listed), lambda x: x.isNotNull()) if listed else F.array().cast("array<string>")
    return msgs.select("*", F.explode(hits).alias("tool"))
