"""Cheapest repair of conversations: an auction finds shortest paths in a lattice of rows and role states.

A node is a place between two rows and what was last put out (nothing, system,
user, assistant); arcs keep, rerole or delete a row or insert an empty message.
The auction grows one path from the origin: where no arc at its end is tight,
the end's price rises and the path contracts, else it extends along the best
arc. Prices at the end are shortest distances on every cheapest path, so the
arcs that are tight are traced in the order of their letters.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.operators.scale import join_null_safe

# Prices of the edits; an undeleted truncated row adds TRUNCATED.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
# Rows of one lattice. A longer conversation is a row of lattices; prices at the start of one end the one before.
BLOCK = 64
# What was last put out: nothing, system, user, assistant. The next inserted or reroled message, and what it leads to.
_NEXT_ROLE = ["user", "user", "assistant", "user"]
_NEXT = [2, 2, 3, 2]
# Distances to the end behind the last row, and the inserts that lead there.
_END, _TAIL = (0, 6, 3, 0), ["", "II", "I", ""]
# States of a row: fine, truncated, blank, duplicate; a code is four times the class of the role plus the state.
_FAULTS = "-tbd"
_CLASS = {"s": 0, "u": 1, "a": 2}
# Rows that a worker hands on at a time.
_HAND_ON = 2_000


def _kept_state(role_class: int, q: int) -> int | None:
    """Where keeping a role leads from ``q``; None where its initial may not follow."""
    if role_class == 0:
        return 1 if q == 0 else None
    if role_class == 1:
        return None if q == 2 else 2
    return 3 if role_class == 2 and q == 2 else None


def _arcs(code: int, count: int, q: int) -> list[tuple[str, int, int, int]]:
    """``letter, cost, rows taken, state`` of the arcs at a row, in the order of their letters."""
    role_class, state = divmod(code, 4)
    arcs = [("D", COST["D"] * count, 1, q), ("I", COST["I"], 0, _NEXT[q])]
    if state < 2:
        extra = TRUNCATED * state
        kept = _kept_state(role_class, q)
        if kept is not None:
            arcs.append(("K", COST["K"] + extra, 1, kept))
        arcs.append(("R", COST["R"] + extra, 1, _NEXT[q]))
    return arcs


def _auction(adjacent: list[list[tuple[int, int]]], price: list[int], origin: int, target: int) -> None:
    """Raise prices until a path of tight arcs leads from origin to target. Arcs cost whole numbers of at least 0, circles more."""
    path = [origin]
    while path[-1] != target:
        i = path[-1]
        least, to = min((cost + price[j], j) for cost, j in adjacent[i])
        if price[i] < least:
            price[i] = least
            if i != origin:
                path.pop()
        else:
            path.append(to)


@lru_cache(maxsize=50_000)
def solve(codes: bytes, counts: tuple[int, ...], ends: tuple[int, ...], entries: int) -> tuple[list[int], list[tuple[str, int]]]:
    """Distances from the first ``entries`` states before the rows, and each one's edits and last state.

    ``ends`` are the distances from the four states behind the rows to the end.
    """
    n = len(codes)
    target = 4 * (n + 1)
    arcs = [_arcs(codes[i], counts[i], q) for i in range(n) for q in range(4)]
    adjacent = [[(cost, 4 * (v // 4 + rows) + q) for _, cost, rows, q in node] for v, node in enumerate(arcs)]
    adjacent += [[(ends[q], target)] for q in range(4)]
    price = [0] * (target + 1)
    for q in range(entries):
        _auction(adjacent, price, q, target)
    leads = [False] * target + [True]  # to the target along tight arcs
    for v in range(target - 1, -1, -4):
        row = range(v - 3, v + 1)
        for _ in range(3):  # inserts link the states of one place; no more than two follow each other
            for u in row:
                leads[u] = leads[u] or any(leads[j] and price[u] == cost + price[j] for cost, j in adjacent[u])
    traces = []
    for q in range(entries):
        v, letters = q, []
        while v < 4 * n:
            for letter, cost, rows, to in arcs[v]:
                j = 4 * (v // 4 + rows) + to
                if leads[j] and price[v] == cost + price[j]:
                    letters.append(letter if rows == 0 else letter * counts[v // 4])
                    v = j
                    break
        traces.append(("".join(letters), v % 4))
    return price[:entries], traces


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks of at most ``BLOCK`` rows of one conversation."""
    kinds = None
    held, out = [], []

    def block() -> tuple:
        codes, counts = [], []
        for _, _, role, _, m, state, first in held:
            role_class = _CLASS.get(role[:1], 3)
            if state == 2 or not first:
                codes.append(4 * role_class + (2 if state == 2 else 3))
                counts.append(m)
            else:
                codes.append(4 * role_class + state)
                counts.append(1)
                if m > 1:  # the other copies
                    codes.append(4 * role_class + 3)
                    counts.append(m - 1)
        return (*held[0][:4], bytes(codes), counts)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        arrays = [pa.array(c, t) for c, t in zip(cols, [*kinds, pa.binary(), pa.list_(pa.int64())], strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["c", "t", "r", "h", "codes", "counts"])

    for b in batches:
        kinds = [b.schema.field(i).type for i in range(4)]
        for row in zip(*[col.to_pylist() for col in b.columns], strict=True):
            if held and (held[0][0] != row[0] or len(held) == BLOCK):
                out.append(block())
                held = []
                if len(out) == _HAND_ON:
                    yield batch()
                    out = []
            held.append(row)
    if held:
        out.append(block())
    if out:
        yield batch()


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from its last to its first: prices move from block to block."""
    kinds, before, ends, out = None, None, None, []

    def one(row: tuple, entries: int) -> None:
        nonlocal ends
        c, t, r, h, codes, counts = row
        base = min(ends)
        prices, traces = solve(codes, tuple(counts), tuple(e - base for e in ends), entries)
        # A row's fault rides beside its letter; an insert has none.
        states = [_FAULTS[code % 4] for code, m in zip(codes, counts, strict=True) for _ in range(m)]
        faults = []
        for letters, _ in traces:
            at = iter(states)
            faults.append("".join("-" if x == "I" else next(at) for x in letters))
        out.append((c, t, r, h, [x for x, _ in traces], faults, [q for _, q in traces]))
        ends = tuple(p + base for p in prices)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        more = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*kinds, *more], strict=True)], ["c", "t", "r", "h", "edits", "faults", "states"])

    for b in batches:
        kinds = [b.schema.field(i).type for i in range(4)]
        for row in zip(*[col.to_pylist() for col in b.columns], strict=True):
            if before is not None:
                if before[0] == row[0]:
                    one(before, 4)
                else:
                    one(before, 1)  # nothing comes before its first block
                    ends = _END
            else:
                ends = _END
            before = row
            if len(out) >= _HAND_ON:
                yield batch()
                out = []
    if before is not None:
        one(before, 1)
    if out:
        yield batch()


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and rows of each conversation in order to its edited rows. Holds one conversation's letters, never its texts."""
    kinds, key, state, entry, out, size = None, (), 0, 0, [], 0
    edits: deque[tuple[str, str]] = deque()

    def put(turn, letter: str, fault: str, given: str | None, text: str) -> None:
        nonlocal state, size
        role = given
        if letter in "IR":
            role, state = _NEXT_ROLE[state], _NEXT[state]
        elif letter == "K":
            state = _kept_state(_CLASS.get(given[:1], 3), state)
        out.append((key[0], turn, letter, None if fault == "-" else fault, given, None if letter == "D" else role, text))
        size += 50 + len(text)

    def inserts() -> None:
        while edits and edits[0][0] == "I":
            edits.popleft()
            put(None, "I", "-", None, "")

    def finish() -> None:
        for _ in _TAIL[state]:
            put(None, "I", "-", None, "")

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        names = ["conv", "turn", "edit", "fault", "given_role", "role", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*kinds, *[pa.string()] * 5], strict=True)], names)

    for b in batches:
        kinds = [b.schema.field(i).type for i in range(2)]
        cols = [b.column(name).to_pylist() for name in ("c", "t", "r", "kind", "text", "edits", "faults", "states")]
        for c, t, role, kind, text, letters, faults, states in zip(*cols, strict=True):
            if not key or key[0] != c:
                if key:
                    finish()
                key, state, entry = (c,), 0, 0
                edits.clear()
            if kind == 0:
                edits.extend(zip(letters[entry], faults[entry], strict=True))
                entry = states[entry]
                continue
            inserts()
            letter, fault = edits.popleft()
            put(t, letter, fault, role, text)
            if len(out) >= _HAND_ON or size > 4 << 20:
                yield batch()
                out, size = [], 0
    if key:
        finish()
    if out:
        yield batch()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of every conversation with the cheapest edits that make its roles read ``(s?(ua)+)?`` by their initials.

    Columns: ``conv, turn, edit`` (K keep, R rerole, D delete, I insert),
    ``fault`` (b blank, d duplicate, t truncated or null), ``given_role``,
    ``role`` (null if deleted), ``text``. Rows lie in the order of the
    conversation inside a partition, a conversation in one partition. Of the
    cheapest edits those come whose letters are least.

    Order: turn, null turns first; ties by role, then by the SHA-256 of the
    text. Null roles and texts count as one space, a null conversation is one
    of its own; an empty role has no initial and is never kept. Rows that are
    equal in all are duplicates of each other. Other columns are left out, so
    their names cannot clash.

    Equal rows meet in counts, first occurrences are looked up by distinct row,
    and the order is made by ranges of rows, so a hot conversation is spread
    until its blocks of 64 rows (a byte a row) pass through one task, last block
    first. Its texts then pass through one task in order, without being held.
    """
    blank = F.lit(" ")
    given = rows.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), blank).alias("r"), F.coalesce(F.col(text), blank).alias("text")
    ).withColumn("h", F.sha2("text", 256))
    state = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)
    order = ["c", "t", "r", "h"]
    distinct = given.withColumn("state", state).groupBy(*order).agg(F.count("*").alias("m"), F.first("state").alias("state"))
    # The struct keeps null turns, and puts them first.
    firsts = distinct.groupBy("c", "r", "h").agg(F.min(F.struct("t")).alias("least")).select(
        "c", F.col("least.t").alias("t"), "r", "h", F.lit(0).cast("bigint").alias("m"), F.lit(0).alias("state"), F.lit(True).alias("first")
    )
    flagged = distinct.withColumn("first", F.lit(False)).unionByName(firsts).groupBy(*order).agg(F.max("m").alias("m"), F.max("state").alias("state"), F.max("first").alias("first"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = flagged.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    fields = [T.StructField(n, given.schema[n].dataType) for n in order]
    blocks = sorted_rows.select(*order, "m", "state", "first").mapInArrow(
        _cut, T.StructType([*fields, T.StructField("codes", T.BinaryType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    )
    solved = blocks.repartition("c").sortWithinPartitions("c", *[F.col(n).desc() for n in order[1:]]).mapInArrow(
        _solve_blocks, T.StructType([
            *fields, T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("faults", T.ArrayType(T.StringType())),
            T.StructField("states", T.ArrayType(T.IntegerType())),
        ])
    ).withColumn("kind", F.lit(0))
    both = given.withColumn("kind", F.lit(1)).unionByName(solved, allowMissingColumns=True)
    in_order = both.repartition("c").sortWithinPartitions(*order, "kind")
    out = [T.StructField(conv, fields[0].dataType), T.StructField("turn", fields[1].dataType)]
    out += [T.StructField(n, T.StringType()) for n in ("edit", "fault", "given_role", "role", "text")]
    return in_order.mapInArrow(_edit, T.StructType(out))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, kind, sums = [], None, None

    def close() -> None:
        span = sums["max"] - sums["min"] + 1 - sums["turns"] if sums["turns"] else 0
        out.append((sums["conv"], span, sums["b"], sums["d"], sums["t"], sums["illegal"], sums["cost"], "".join(sums["audit"]), sums["sha"].hexdigest()))

    def batch() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
        ])

    for b in batches:
        kind = b.schema.field(0).type
        for conv, turn, edit, fault, given, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if sums is None or sums["conv"] != conv:
                if sums is not None:
                    close()
                    if len(out) >= _HAND_ON:
                        yield batch()
                        out = []
                sums = {
                    "conv": conv, "min": None, "max": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "cost": 0, "audit": [],
                    "sha": hashlib.sha256(), "some": False, "last": None,
                }
            sums["audit"].append(edit)
            sums["cost"] += COST[edit] + (TRUNCATED if fault == "t" and edit in "KR" else 0)
            if edit != "I":
                if fault:
                    sums[fault] += 1
                if sums["last"] is not None and sums["last"] + given[:1] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                sums["last"] = given[:1]
                if turn is not None and turn != sums["max"]:
                    sums["min"] = turn if sums["min"] is None else sums["min"]
                    sums["max"], sums["turns"] = turn, sums["turns"] + 1
            if edit != "D":
                sums["sha"].update((("\n" if sums["some"] else "") + f"{role}:{text}").encode())
                sums["some"] = True
    if sums is not None:
        close()
    if out:
        yield batch()


def report(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row a conversation from ``repair``: gaps, faults, illegal pairs, cost, letters and the hash of what is left.

    Reads the rows as ``repair`` puts them out, in the same task: give it that frame as it is.
    """
    kind = repaired.schema[conv].dataType.simpleString()
    longs = ", ".join(f"{n} bigint" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return repaired.mapInArrow(_digest, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by the CRC-32 of ``conv_id:turn`` (null: one space) modulo 20."""
    blank = F.lit(" ")
    number = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), number.alias("d")).where(F.col("d") != 0)
    damaged = marked.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return damaged.drop("copy")


def repair_report(rows: DataFrame) -> DataFrame:
    """The report of damaged ``rows`` with every ``conv_id`` they had before the damage."""
    found = report(repair(damage(rows)))
    every = rows.select("conv_id").distinct()
    joined = join_null_safe(every, found, ["conv_id"], "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in found.columns[1:7]]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: The same by dynamic programming: per place and state the least of cost, letters and messages, from the last row to the first.
SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END), CAST(4294967295 AS BIGINT)) % 20 AS d FROM src
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM rows_
), flags AS (
  SELECT conv_id, turn, role, text, i, n, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault FROM placed
), dp AS (
  SELECT conv_id, max(n) + 1 AS i, [{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']},
                                    {'c': 3, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}] AS f
  FROM flags GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda q: list_sort([
           g[q],
           {'c': 3 + g[[3, 3, 4, 3][q]].c, 'a': 'I' || g[[3, 3, 4, 3][q]].a, 't': list_prepend(['user:', 'user:', 'assistant:', 'user:'][q], g[[3, 3, 4, 3][q]].t)},
           {'c': 6 + g[[4, 4, 3, 4][q]].c, 'a': 'II' || g[[4, 4, 3, 4][q]].a,
            't': list_concat([['user:', 'user:', 'assistant:', 'user:'][q], ['assistant:', 'assistant:', 'user:', 'assistant:'][q]], g[[4, 4, 3, 4][q]].t)}])[1]) AS f
  FROM (
    SELECT b.conv_id, b.i, list_transform([1, 2, 3, 4], lambda q: list_sort(list_filter([
      {'c': 4 + f[q].c, 'a': 'D' || f[q].a, 't': f[q].t},
      CASE WHEN fault IN ('-', 't') AND (x = 's' AND q = 1 OR x = 'u' AND q <> 3 OR x = 'a' AND q = 3)
           THEN {'c': CASE fault WHEN 't' THEN 3 ELSE 0 END + f[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c,
                 'a': 'K' || f[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
                 't': list_prepend(role || ':' || text, f[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].t)} END,
      CASE WHEN fault IN ('-', 't')
           THEN {'c': 3 + CASE fault WHEN 't' THEN 3 ELSE 0 END + f[[3, 3, 4, 3][q]].c, 'a': 'R' || f[[3, 3, 4, 3][q]].a,
                 't': list_prepend(['user:', 'user:', 'assistant:', 'user:'][q] || text, f[[3, 3, 4, 3][q]].t)} END
    ], lambda s: s IS NOT NULL))[1]) AS g
    FROM dp JOIN flags b ON b.conv_id IS NOT DISTINCT FROM dp.conv_id AND b.i = dp.i - 1
  )
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (y IS NOT NULL AND y || x NOT IN ('su', 'ua', 'au')) AS illegal FROM flags GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(f[1].c, 0) AS BIGINT) AS cost, coalesce(f[1].a, '') AS audit,
       sha256(coalesce(array_to_string(f[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM e.conv_id AND dp.i = 1
"""
