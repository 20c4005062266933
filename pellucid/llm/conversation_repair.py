"""Repair of the turn order of conversations: the cheapest edits by minimum costs from both ends.

A conversation is a row of symbols: what role each message has, and whether it must go
or ends without a stop.  Its graph has a node for each place between messages and
each state of the wanted order `(s?(ua)+)?`, and an arc for each edit: Keep, Rerole and Delete
pass a message, Insert stays at its place.  Minimum costs from the start and to the end
tell which arcs lie on a cheapest path; these tight arcs make a graph without circles, and a
walk over them that follows the least letter from all nodes it has reached gives the
least of all cheapest edit strings.

Rows are sorted over ranges of (conversation, turn), so a long conversation lies in several
partitions.  Conversations within one partition are repaired where they lie.  Of one that goes
across, each partition's share is a block: its costs from every state to every state
are sixteen numbers, from which the driver (two blocks for each partition at most) gets the costs at
the blocks' ends; then each block walks from every state by itself, and the walks that
meet are put together.  Earlier equal messages are found by an aggregation of digests.  Only the
digest of a repaired text, which can't be had in parts, is made by one task, message by message.

Nulls are one space, but a null turn sorts first and counts in no gap.  Messages of one turn are in the order of
their roles, then of their texts (of the first 64 characters, then of a hash).  Repeated
rows are repeated messages.  A table without rows gives none.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, ship, table

#: Costs of the edits, and of a message without a stop that stays.
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
STOPS = "[.!?]"
#: Of a place in a conversation: nothing yet, behind system, behind user, behind assistant.
STATES = 4
#: The state behind a user or assistant message, whichever comes next in a state.
NEXT = (2, 2, 3, 2)
#: The role that comes next in a state.
ROLE = ("user", "user", "assistant", "user")
#: The state behind a message that's kept, by its role's initial.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None, None, None, None)}
FAR = 1 << 60
START, ENDS = (0, FAR, FAR, FAR), (0, FAR, FAR, 0)
LEGAL = {"su", "ua", "au"}
#: Symbol of a message that must be deleted.
GONE = "x"
#: Letters of texts that are compared to put messages of one turn in order.
SHOWN = 64
#: Symbol strings whose repairs a worker keeps, and the longest that it keeps.
KEPT_REPAIRS, KEPT_MESSAGES = 100_000, 64


def _passing(symbol: str) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of the edits that pass a message; a capital is one without a stop."""
    out = [("D", q, q, DELETE) for q in range(STATES)]
    if symbol != GONE:
        more = UNFINISHED * symbol.isupper()
        out += [("K", q, to, more) for q, to in enumerate(KEPT[symbol.lower()]) if to is not None]
        out += [("R", q, to, REROLE + more) for q, to in enumerate(NEXT)]
    return out


PASSING = {s: _passing(s) for s in "suaoSUAO" + GONE}
INSERTING = [("I", q, to, INSERT) for q, to in enumerate(NEXT)]


def _inserted(cost: list[int]) -> list[int]:
    """Costs at a place, from those at its states, with messages inserted there."""
    while True:
        better = list(cost)
        for _, q, to, c in INSERTING:
            better[to] = min(better[to], better[q] + c)
        if better == cost:
            return better
        cost = better


def _before_inserted(cost: list[int]) -> list[int]:
    """The same for costs to the end."""
    while True:
        better = list(cost)
        for _, q, to, c in INSERTING:
            better[q] = min(better[q], better[to] + c)
        if better == cost:
            return better
        cost = better


def forward(symbols: str, start) -> list[list[int]]:
    """Minimum costs from the start to each place and state; nothing is inserted at the last place."""
    out = [list(start)]
    for s in symbols:
        out[-1] = cost = _inserted(out[-1])
        new = [FAR] * STATES
        for _, q, to, c in PASSING[s]:
            new[to] = min(new[to], cost[q] + c)
        out.append(new)
    return out


def backward(symbols: str, end) -> list[list[int]]:
    """Minimum costs from each place and state to the end, what is inserted there included."""
    out = [_before_inserted(list(end))]
    for s in reversed(symbols):
        cost = [FAR] * STATES
        for _, q, to, c in PASSING[s]:
            cost[q] = min(cost[q], out[-1][to] + c)
        out.append(_before_inserted(cost))
    return out[::-1]


def walk(symbols: str, ahead: list[list[int]], back: list[list[int]], state: int, last: bool = True) -> tuple[str, int]:
    """The least string of tight edits from a state at the first place, and the state where it ends.

    last: does the conversation end here?  If not, the walk stops at the last place.
    """
    n, i, reached, letters = len(symbols), 0, {state}, []
    total = min(ahead[0][q] + back[0][q] for q in reached)
    while i < n or last:
        arcs = [x for x in ([*PASSING[symbols[i]], *INSERTING] if i < n else INSERTING) if x[1] in reached]
        tight = [x for x in arcs if ahead[i][x[1]] + x[3] + back[i + (x[0] != "I")][x[2]] == total]
        if not tight:
            break
        least = min(x[0] for x in tight)
        reached = {x[2] for x in tight if x[0] == least}
        letters.append(least)
        i += least != "I"
    return "".join(letters), min(reached)


def _repair(symbols: str) -> tuple[int, str]:
    ahead, back = forward(symbols, START), backward(symbols, ENDS)
    ahead[-1] = _inserted(ahead[-1])
    return back[0][0], walk(symbols, ahead, back, 0)[0]


_repair_kept = lru_cache(KEPT_REPAIRS)(_repair)


def repair(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return (_repair_kept if len(symbols) <= KEPT_MESSAGES else _repair)(symbols)


def lines(audit: str, roles: list[str], texts: list[str], state: int = 0) -> Iterator[tuple[int, str]]:
    """(message, `role:text`) of what the edits leave, from a state on; an inserted message has the number of the next one."""
    i = 0
    for letter in audit:
        if letter == "K":
            state = KEPT[(roles[i][:1] if roles[i][:1] in KEPT else "o")][state]
            yield i, f"{roles[i]}:{texts[i]}"
        elif letter != "D":
            yield i, f"{ROLE[state]}:{texts[i] if letter == 'R' else ''}"
            state = NEXT[state]
        i += letter != "I"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of (conv_id, turn, role, text) after the damage; conv is a text, different for each conv_id, null too."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, STOPS, "")).otherwise(text)
    role = F.when(fate == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    times = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    kept = rows.where(fate != 0).select(conversation(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
    return kept.drop("times")


def conversation(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _in_order(rows: DataFrame) -> DataFrame:
    """(conv, part, k, turn, role, text, kind, blank): rows in ranges of conversations and turns, k by k in order within a part.

    kind is s, u, a or o (another role), a capital if the text has no stop at its end.
    """
    ends = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    kind = F.when(F.substring(ends, -1, 1).rlike(STOPS), kind).otherwise(F.upper(kind))
    facts = rows.withColumns({"kind": kind, "blank": ends == "", "copy": F.monotonically_increasing_id()})
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, SHOWN), F.substring("text", 1, SHOWN), F.xxhash64("role", "text"), F.col("copy")]
    ranges = facts.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut(ranges.select("conv", F.spark_partition_id().alias("part"), place.alias("k"), "turn", "role", "text", "kind", "blank"))


def _across(rows: DataFrame) -> list[str]:
    """Conversations that lie in more than one part: two for each part at most."""
    ends = rows.groupBy("part").agg(F.min_by("conv", "k").alias("a"), F.max_by("conv", "k").alias("b")).collect()
    seen: dict[str, int] = {}
    for r in ends:
        for conv in {r["a"], r["b"]}:
            seen[conv] = seen.get(conv, 0) + 1
    return sorted(c for c, n in seen.items() if n > 1)


def _faults(kinds: list[str], blanks: list[bool], seen: list[bool]) -> tuple[str, dict[str, int]]:
    """The symbols of messages, and how many have each fault; the first fault of a message counts."""
    symbols = "".join(GONE if b or d else k for k, b, d in zip(kinds, blanks, seen, strict=True))
    n_blank = sum(blanks)
    n_double = sum(d and not b for b, d in zip(blanks, seen, strict=True))
    low = "".join(kinds).lower()
    return symbols, {"blank": n_blank, "duplicate": n_double, "truncated": sum(map(str.isupper, symbols)), "illegal": sum(low[i : i + 2] not in LEGAL for i in range(len(low) - 1))}


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each conversation of a part; its rows follow one another."""
    out: list[dict] = []

    def done(conv: str, rows: list[tuple]) -> None:
        turns = {r[0] for r in rows if r[0] is not None}
        met: set[tuple[str, str]] = set()
        seen = []
        for r in rows:
            seen.append((r[1], r[2]) in met)
            met.add((r[1], r[2]))
        symbols, counts = _faults([r[3] for r in rows], [r[4] for r in rows], seen)
        cost, audit = repair(symbols)
        digest = hashlib.sha256("\n".join(x for _, x in lines(audit, [r[1] for r in rows], [r[2] for r in rows])).encode())
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append({"conv": conv, "gaps": gaps, **counts, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()})

    def batch() -> pa.RecordBatch:
        names = ["conv", *_NUMBERS, "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64() if c in _NUMBERS else pa.string()) for c in names], names)

    held, rows = None, []
    for b in batches:
        for conv, *r in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "kind", "blank")), strict=True):
            if conv != held and rows:
                done(held, rows)
                rows = []
            held = conv
            rows.append(r)
        yield batch()
        out.clear()
    if rows:
        done(held, rows)
    yield batch()


def _block(rows: pa.Table) -> pa.Table:
    """A block's symbols, faults, first and last role, and the costs from every state to every state."""
    rows = rows.sort_by("k")
    kinds = rows["kind"].to_pylist()
    symbols, counts = _faults(kinds, rows["blank"].to_pylist(), rows["seen"].to_pylist())
    costs = [x for q in range(STATES) for x in forward(symbols, [FAR * (p != q) for p in range(STATES)])[-1]]
    return pa.table({"conv": rows["conv"][:1], "part": rows["part"][:1], "symbols": [symbols], "first": [kinds[0].lower()], "last": [kinds[-1].lower()], **{k: [v] for k, v in counts.items()}, "costs": pa.array([[min(x, FAR) for x in costs]], pa.list_(pa.int64()))})


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block its walks from each state, and where they end; a state that no cheapest path meets has none."""
    for b in batches:
        for r in b.to_pylist():
            ahead, back = forward(r["symbols"], r["start"]), backward(r["symbols"], r["end"])
            if r["is_last"]:
                ahead[-1] = _inserted(ahead[-1])
            total = min(x + y for x, y in zip(r["start"], back[0], strict=True))
            found = [walk(r["symbols"], ahead, back, q, r["is_last"]) if r["start"][q] + back[0][q] == total else (None, None) for q in range(STATES)]
            yield pa.RecordBatch.from_pydict({"conv": [r["conv"]], "part": pa.array([r["part"]], pa.int32()), "audits": pa.array([[x[0] for x in found]], pa.list_(pa.string())), "ends": pa.array([[x[1] for x in found]], pa.list_(pa.int32()))})


def _left(key: tuple, rows: pa.Table, edits: pa.Table) -> pa.Table:
    """(conv, part, k, line): what a block's edits leave of it."""
    rows = rows.sort_by("k")
    audit, state = edits["audit"][0].as_py(), edits["state"][0].as_py()
    found = list(lines(audit, rows["role"].to_pylist(), rows["text"].to_pylist(), state))
    return pa.table({"conv": pa.array([key[0].as_py()] * len(found), pa.string()), "part": pa.array([key[1].as_py()] * len(found), pa.int32()), "k": pa.array(range(len(found)), pa.int64()), "line": pa.array([x for _, x in found], pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) of lines in order; no more than a line is held."""
    held, digest = None, None

    def out():
        return pa.RecordBatch.from_pydict({"conv": [held], "repaired_sha256": [digest.hexdigest()]})

    for b in batches:
        for conv, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist(), strict=True):
            if conv != held:
                if digest is not None:
                    yield out()
                held, digest = conv, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
    if digest is not None:
        yield out()


def _spread(rows: DataFrame) -> DataFrame:
    """The results of conversations whose rows lie in several parts."""
    spark = rows.sparkSession
    light = rows.select("conv", "part", "k", "kind", "blank", F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256).alias("h"))
    first = light.groupBy("conv", "h").agg(F.min(F.struct("part", "k")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    light = light.join(first, ["conv", "h"], "left").withColumn("seen", F.coalesce(F.struct("part", "k") != F.col("first"), F.lit(False))).drop("first", "h")
    blocks = cut(light.groupBy("conv", "part").applyInArrow(_block, "conv string, part int, symbols string, first string, last string, blank long, duplicate long, truncated long, illegal long, costs array<long>"))

    # two blocks for each part of the table at most
    by: dict[str, list] = {}
    for r in sorted(blocks.drop("symbols").collect(), key=lambda r: (r["conv"], r["part"])):
        by.setdefault(r["conv"], []).append(r)
    sides, totals = [], []
    for conv, own in by.items():
        costs = [[r["costs"][STATES * q : STATES * q + STATES] for q in range(STATES)] for r in own]
        starts = [list(START)]
        for m in costs[:-1]:
            starts.append([min(FAR, *(starts[-1][q] + m[q][to] for q in range(STATES))) for to in range(STATES)])
        ends = [list(ENDS)]
        after = _before_inserted(list(ENDS))
        for m in costs[:0:-1]:
            after = [min(FAR, *(m[q][to] + after[to] for to in range(STATES))) for q in range(STATES)]
            ends.append(after)
        for r, start, end in zip(own, starts, ends[::-1], strict=True):
            sides.append((conv, r["part"], start, end, r is own[-1]))
        cost = min(costs[0][0][to] + after[to] for to in range(STATES))
        joints = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(own, own[1:]))  # noqa: B905
        totals.append((conv, *(sum(r[c] for r in own) for c in ("blank", "duplicate", "truncated")), sum(r["illegal"] for r in own) + joints, cost))
    side = spark.createDataFrame(sides, "conv string, part int, start array<long>, end array<long>, is_last boolean")
    walks = cut(blocks.select("conv", "part", "symbols").join(F.broadcast(side), ["conv", "part"]).mapInArrow(_walks, "conv string, part int, audits array<string>, ends array<int>"))
    chosen, held, state = [], None, 0
    for r in sorted(walks.select("conv", "part", "ends").collect(), key=lambda r: (r["conv"], r["part"])):
        state = 0 if r["conv"] != held else state
        held = r["conv"]
        chosen.append((held, r["part"], state))
        state = r["ends"][state]
    chosen = spark.createDataFrame(chosen, "conv string, part int, state int")
    edits = cut(walks.join(F.broadcast(chosen), ["conv", "part"]).select("conv", "part", "state", F.element_at("audits", F.col("state") + 1).alias("audit")))

    left = rows.select("conv", "part", "k", "role", "text").groupBy("conv", "part").cogroup(edits.groupBy("conv", "part")).applyInArrow(_left, "conv string, part int, k long, line string")
    digests = left.repartition(parts(spark), "conv").sortWithinPartitions("conv", "part", "k").select("conv", "line").mapInArrow(_digests, "conv string, repaired_sha256 string")
    audits = edits.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    counts = spark.createDataFrame(totals, "conv string, blank long, duplicate long, truncated long, illegal long, cost long")
    out = F.broadcast(counts).join(gaps, "conv").join(audits, "conv").join(digests, "conv", "left")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))).select("conv", *_NUMBERS, "audit", "repaired_sha256")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, ...) of RESULT for each conversation of messages (conv, turn, role, text)."""
    spark = rows.sparkSession
    ship(spark)
    held = _in_order(rows)
    across = _across(held)
    names = F.broadcast(spark.createDataFrame([(c,) for c in across], "conv string"))
    out = held.join(names, "conv", "left_anti").select("conv", "turn", "role", "text", "kind", "blank").mapInArrow(_whole, RESULT)
    if across:
        out = out.unionByName(_spread(held.join(names, "conv", "left_semi")))
    return out


def repairs(conversations: DataFrame) -> DataFrame:
    """A row for every conv_id of (conv_id, turn, role, text), damaged and repaired; one of which the damage leaves nothing has zeros and empty texts."""
    found = repaired(damaged(conversations))
    every = conversations.select("conv_id").distinct().withColumn("conv", conversation(F.col("conv_id")))
    joined = every.join(found, "conv", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _NUMBERS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "conversations"))


def _state(source: str, cost: str, letter: str, line: str) -> str:
    return f"CASE WHEN {source} IS NOT NULL THEN {{'c': {source}.c + {cost}, 'a': {source}.a || '{letter}', 't': list_append({source}.t, {line})}} END"


def _with_inserted(source: str) -> str:
    """SQL: the states of a place with what may be inserted there."""
    user, assistant = "'user:'", "'assistant:'"
    return f"""(SELECT *, least(y2, {_state("y3", "2", "I", user)}) AS x2, y3 AS x3 FROM
  (SELECT *, least(s3, {_state("y2", "2", "I", assistant)}) AS y3 FROM
   (SELECT *, least(s2, {_state("s0", "2", "I", user)}, {_state("s1", "2", "I", user)}, {_state("s3", "2", "I", user)}) AS y2 FROM {source})))"""


def _passed(state: int) -> str:
    """SQL: the best ways to a state behind a message, from those at the place before it."""
    own, ways = ("s0", "s1", "x2", "x3"), []
    for q in range(STATES):
        if q == state:
            ways.append(f"CASE WHEN {own[q]} IS NOT NULL THEN {{'c': {own[q]}.c + 3, 'a': {own[q]}.a || 'D', 't': {own[q]}.t}} END")
        for initial, to in KEPT.items():
            if to[q] == state:
                ways.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_state(own[q], 'cut', 'K', "role || ':' || text")} END")
        if NEXT[q] == state:
            ways.append(f"CASE WHEN NOT gone THEN {_state(own[q], '2 + cut', 'R', f"'{ROLE[q]}:' || text")} END")
    return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]


_KIND = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
ORACLE = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
fates AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))),
  lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 20 AS fate FROM conversations, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fates WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending, role[1:1] AS initial FROM hurt),
judged AS (SELECT *, ending = '' AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
marked AS MATERIALIZED (SELECT *, is_blank OR again AS gone, CASE WHEN NOT is_blank AND NOT again AND ending[-1:] NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM judged),
counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (again AND NOT is_blank) AS duplicate, count(*) FILTER (cut = 1) AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
ways AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, n AS n_all, CAST({{'c': 0, 'a': '', 't': []}} AS {_KIND}) AS s0, CAST(NULL AS {_KIND}) AS s1, CAST(NULL AS {_KIND}) AS s2, CAST(NULL AS {_KIND}) AS s3 FROM marked
  UNION ALL SELECT w.conv_id, m.i, w.n_all, {_passed(0)}, {_passed(1)}, {_passed(2)}, {_passed(3)} FROM {_with_inserted("ways")} w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.k + 1),
best AS (SELECT conv_id, least(s0, x3) AS b FROM {_with_inserted("ways")} WHERE k = n_all)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id"""
