"""Conversation structure repair: the cheapest edits that leave an optional system turn and then pairs of user and assistant.

1. Equal rows of one turn are counted, the others put in order over all conversations by ranges. A row's first fault is told.
2. A conversation is cut into blocks of rows. Within a block, equal role and fault symbols in a row are a run; the min-plus
   transition of a run is a product of binary powers of its symbol's, which are kept.
3. The cost still to come is carried from the end through a conversation's blocks, and from there through each
   block's runs; the state is carried from the start. Both go level by level where blocks are many, so no task has all of them.
4. With both known at its ends, each block unrolls its choices: of the cheapest the one whose letters are least.

States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import BLANKS, discard, joined_small, table, written
from paperloom.operators.numbering import running_before

#: Weight of a block: bytes of text, and 64 a row. Blocks whose carries one task joins.
BLOCK = 1 << 20
FAN = 4096

INF = 1 << 40
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: The state after a user's or an assistant's turn, whichever may follow; and who speaks there.
NEXT = (2, 2, 3, 2)
SPEAKER = {2: "user", 3: "assistant"}
#: The states after a turn that stays, by its role's initial; nothing else may stay.
STAY = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GONE = ("", "gone")


def _times(a, b):
    """Min-plus product of matrices as tuples of rows."""
    return tuple(tuple(min(x + y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)) for row in a)


def _applied(a, v):
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


_STAND = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
_ONE = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else INF for j in range(4)) for i in range(4))
#: Any number of insertions: more than two never help.
_INSERTED = _times(_ONE, _ONE)
#: Cost still to come after the last row; the last number tells the end.
END = (*_applied(_INSERTED, (0, INF, INF, 0)), 1)


def choices(symbol: tuple[str, str], state: int):
    """(letter, cost, next state) of what can be done with a row, by letter. ``symbol``: its role's initial and its fault."""
    initial, fault = symbol
    yield "D", DELETE, state
    if fault == "gone":
        return
    extra = TRUNCATED if fault == "truncated" else 0
    if state in STAY.get(initial, ()):
        yield "K", extra, STAY[initial][state]
    yield "R", REROLE + extra, NEXT[state]


@lru_cache(None)
def power(symbol: tuple[str, str], k: int):
    """The transition of 2**k rows with one symbol, insertions before each included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    rows = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in choices(symbol, state):
            rows[state][to] = min(rows[state][to], cost)
    return _times(_INSERTED, tuple(map(tuple, rows)))


@lru_cache(100_000)
def advanced(symbol: tuple[str, str], n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost still to come before n rows with one symbol, from that after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = _applied(power(symbol, k), v)
    return v


def symbols(rows) -> list[tuple[int, tuple[str, str], int]]:
    """(row, symbol, times) of rows (role, fault, copies): of copies the first is judged, the others are duplicates."""
    out = []
    for i, (role, fault, copies) in enumerate(rows):
        if copies:
            own = GONE if fault in ("blank", "duplicate") else (role[:1], fault)
            out += [(i, own, 1), (i, GONE, copies - 1)] if copies > 1 and own != GONE else [(i, own, copies)]
    return out


def runs(units) -> list[tuple[tuple[str, str], list[tuple[int, int]]]]:
    """Units with one symbol in a row: the symbol, and (row, times) of each."""
    return [(symbol, [(i, n) for i, _, n in group]) for symbol, group in groupby(units, key=lambda u: u[1])]


def transition(found) -> tuple[tuple[int, ...], ...]:
    """The min-plus transition of all runs of a block."""
    out = _STAND
    for symbol, members in found:
        n = sum(t for _, t in members)
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(out, power(symbol, k))
    return out


def unrolled(found, after, state: int, size: int):
    """(letters, turns, cost, state): what is done at each of ``size`` rows, and the (state, from the row) that are left of it."""
    togo = [tuple(after[:4])]
    for symbol, members in reversed(found):
        togo.append(advanced(symbol, sum(t for _, t in members), togo[-1]))
    togo.reverse()
    letters, turns, cost = [""] * size, [[] for _ in range(size)], 0

    def inserted(i):
        nonlocal state, cost
        state, cost = NEXT[state], cost + INSERT
        letters[i] += "I"
        turns[i].append((state, False))

    for (symbol, members), v in zip(found, togo[1:], strict=True):
        if symbol == GONE:  # D comes before I, so nothing is put between
            for i, n in members:
                letters[i] += "D" * n
                cost += DELETE * n
            continue
        vectors = [v]
        for _ in members:
            vectors.append(advanced(symbol, 1, vectors[-1]))
        for (i, _), here, there in zip(members, vectors[:0:-1], vectors[-2::-1], strict=True):
            while True:
                best = [(letter, c, to) for letter, c, to in choices(symbol, state) if c + there[to] == here[state]]
                if INSERT + here[NEXT[state]] == here[state]:
                    best.append(("I", INSERT, NEXT[state]))
                letter, c, to = min(best)
                if letter == "I":
                    inserted(i)
                    continue
                state, cost = to, cost + c
                letters[i] += letter
                if letter != "D":
                    turns[i].append((state if letter == "R" else 0, True))
                break
    while after[4] and state in (1, 2):
        inserted(size - 1)
    return letters, turns, cost, state


def faults(rows: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text, copies, fault``: rows that are alike once, each with the first fault that applies.

    ``rows``: conv_id, turn, role, text, and copies if a row stands for several, or with 0 for none. Faults: ``blank``, ``duplicate`` (role and text in an
    earlier turn), ``truncated`` (no full stop, exclamation or question mark at the end), else empty.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = rows.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"))
    same = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")]
    once = rows.groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).select("*", *same)
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    first = once.where("copies > 0").groupBy("key", "role", "h1", "h2").agg(F.min(turn).alias("first"))
    met = once.join(first.hint("merge"), ["key", "role", "h1", "h2"], "left")
    bare = F.trim("text", F.lit(BLANKS))
    fault = F.when(bare == "", "blank").when(turn > F.col("first"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return met.select("key", "conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def blocks(rows: DataFrame) -> DataFrame:
    """``key, block, rows``: each conversation's rows in order, by blocks. A written table.

    Order: turn, null first, then role and text.
    """
    weighed = rows.withColumn("numbered", F.col("turn").isNotNull()).withColumn("weight", F.octet_length("text") + 64)
    placed = running_before(weighed, "weight", ["numbered", "turn", "role", "text"], ["key"])
    entry = F.struct(F.col("before").alias("place"), "turn", "role", "text", "copies", "fault", "conv_id")
    dealt = placed.withColumn("block", F.expr(f"before div {BLOCK}")).groupBy("key", "block").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    return written(dealt, "blocks")


def _each(df: DataFrame, columns: list[str], over, schema: str) -> DataFrame:
    """Rows that ``over`` yields for each row's ``columns``, in small batches."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        kinds = None
        for batch in batches:
            out = [r for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in over(*row)]
            if out:
                yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(names, zip(*out, strict=True), strict=True)}, schema=kinds or (kinds := _arrow(schema)))

    return df.select(*columns).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def carried(parts: DataFrame, start: tuple[int, ...], backward: bool, joined, step) -> DataFrame:
    """``key, block, carry``: what each block meets, from (key, block, m), the blocks' own effects.

    ``step(carry, m)`` is the carry behind a block; ``joined(a, b)`` the effect of two blocks in the direction of the carry.
    Each task has ``FAN`` blocks of a conversation; more are joined level by level.
    """
    entry = F.sort_array(F.collect_list(F.struct("block", "m")), asc=not backward)
    dealt = written(parts.withColumn("outer", F.expr(f"block div {FAN}")).groupBy("key", "outer").agg(entry.alias("ms")), "carried")

    def whole(key, outer, ms):
        out = None
        for x in ms:
            out = x["m"] if out is None else joined(out, x["m"])
        yield key, outer, out

    def inner(key, carry, ms):
        for x in ms:
            yield key, x["block"], carry
            carry = step(carry, x["m"])

    if dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        above = carried(_each(dealt, ["key", "outer", "ms"], whole, "key string, block long, m array<long>"), start, backward, joined, step)
        dealt = dealt.join(above.withColumnRenamed("block", "outer").hint("merge"), ["key", "outer"])
    else:
        dealt = dealt.withColumn("carry", F.array(*map(F.lit, start)).cast("array<long>"))
    return written(_each(dealt, ["key", "carry", "ms"], inner, "key string, block long, carry array<long>"), "carries")


def _matrix(m):
    return tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4))


def _found(rows):
    return runs(symbols([(r["role"], r["fault"], r["copies"]) for r in rows]))


def _ends(dealt: DataFrame) -> DataFrame | None:
    """``key, block, after, state`` of the blocks of conversations that have several; None if there are none."""
    several = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
    if several.limit(1).count() == 0:
        return None
    part = joined_small(dealt, several, ["key"], "left_semi")
    matrices = _each(part, ["key", "block", "rows"], lambda key, block, rows: [(key, block, [x for row in transition(_found(rows)) for x in row])], "key string, block long, m array<long>")
    after = carried(
        matrices, END, True, lambda a, b: [x for row in _times(_matrix(b), _matrix(a)) for x in row], lambda v, m: [*_applied(_matrix(m), v[:4]), 0]
    ).withColumnRenamed("carry", "after")

    def exits(key, block, rows, v):
        found = _found(rows)
        yield key, block, [unrolled(found, v, s, len(rows))[3] for s in range(4)]

    met = part.join(after.hint("merge"), ["key", "block"])
    maps = _each(met, ["key", "block", "rows", "after"], exits, "key string, block long, m array<long>")
    state = carried(maps, (0,), False, lambda a, b: [b[x] for x in a], lambda s, m: [m[s[0]]])
    return after.join(state.select("key", "block", F.col("carry")[0].alias("state")).hint("merge"), ["key", "block"])


EDITS = "key string, place long, conv_id string, turn long, role string, text string, copies long, fault string, letters string, becomes array<struct<role:string,text:string>>, cost long"


def edits(rows: DataFrame) -> DataFrame:
    """A row for each different row of a conversation, in the order of ``place``: its fault, what is done, and what becomes of it.

    ``rows``: see ``faults``; other columns are ignored. ``letters``: K keep, R give it to user or assistant, D delete, I insert an empty turn; copies of a row
    follow it. ``becomes``: the turns that are there afterwards. ``cost`` is the block's at its first row, else 0. Null roles and texts are one blank, and
    nulls in conv_id are one conversation. Turns may repeat, be null or leave gaps: null is first, equal ones go by role and
    text. A role without an initial of s, u or a cannot stay as it is. Empty tables give none; rows with 0 copies give a row
    where nothing is done. ``conv_id`` comes as text.
    """
    dealt = blocks(faults(rows))
    ends = _ends(dealt)
    if ends is None:
        met = dealt.withColumn("after", F.array(*map(F.lit, END)).cast("array<long>")).withColumn("state", F.lit(0).cast("long"))
    else:
        met = dealt.join(ends.hint("merge"), ["key", "block"], "left")
        met = met.withColumn("after", F.coalesce("after", F.array(*map(F.lit, END)).cast("array<long>"))).withColumn("state", F.coalesce("state", F.lit(0)).cast("long"))

    def solve(key, entries, after, state):
        letters, turns, cost, _ = unrolled(_found(entries), after, state, len(entries))
        for r, done, left in zip(entries, letters, turns, strict=True):
            becomes = [{"role": SPEAKER[s] if s else r["role"], "text": r["text"] if own else ""} for s, own in left]
            yield key, r["place"], r["conv_id"], r["turn"], r["role"], r["text"], r["copies"], r["fault"], done, becomes, cost
            cost = 0

    met = met.withColumn("rows", F.transform("rows", lambda r: r.withField("conv_id", r["conv_id"].cast("string"))))
    return _each(met, ["key", "rows", "after", "state"], solve, EDITS)


def summaries(done: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, from ``edits``.

    A conversation's rows go through one task in order, a batch at a time: its letters and a running hash are all that is held.
    """
    ordered = done.repartition("key").sortWithinPartitions("key", "place")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")

    def close(x):
        turns = x["top"] - x["low"] + 1 - x["turns"] if x["turns"] else 0
        return (x["conv_id"], turns, *(x[c] for c in counts), "".join(x["audit"]), x["hash"].hexdigest())

    def follow(batches):
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or now["key"] != r["key"]:
                    if now is not None:
                        out.append(close(now))
                    now = {"key": r["key"], "conv_id": r["conv_id"], "turns": 0, "low": None, "top": None, "last": None, "audit": [], "hash": hashlib.sha256(), "open": False} | dict.fromkeys(counts, 0)
                now["cost"] += r["cost"]
                now["audit"].append(r["letters"])
                for t in r["becomes"]:
                    now["hash"].update(f"{chr(10) if now['open'] else ''}{t['role']}:{t['text']}".encode())
                    now["open"] = True
                n, turn, initial = r["copies"], r["turn"], r["role"][:1]
                if not n:
                    continue
                if turn is not None and turn != now["top"]:
                    now["turns"], now["low"], now["top"] = now["turns"] + 1, turn if now["low"] is None else now["low"], turn
                if r["fault"] == "blank":
                    now["blank"] += n
                else:
                    now["duplicate"] += n - (r["fault"] != "duplicate")
                    now["truncated"] += r["fault"] == "truncated"
                now["illegal"] += n - 1 + (now["last"] is not None and now["last"] + initial not in ("su", "ua", "au"))
                now["last"] = initial
            if out:
                yield _summary(out)
        if now is not None:
            yield _summary([close(now)])

    return ordered.mapInArrow(follow, SUMMARY)


SUMMARY = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summary(rows) -> pa.RecordBatch:
    kinds = _arrow(SUMMARY)
    return pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(kinds.names, zip(*rows, strict=True), strict=True)}, schema=kinds)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; ``copies`` 0 stands for a row that went, 2 for one that is there twice."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    gone = kind == 0
    null = F.lit(None)
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(kind == 4, "user").when(gone, null).otherwise(space("role")).alias("role"),
        F.when(~gone, text).alias("text"), F.when(gone, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    out = summaries(edits(damaged(table(spark, sf_dir, "conversations"))))
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


_BLANK = r"[\x20\x09-\x0D]"
_STEP = "lambda h, i: xor(h >> 1, 3988292384 * (h & 1))"


def _sql_struct(state: str, cost: str, letter: str, turn: str = "[]::varchar[]") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {turn}}}"


_KEEP = lambda state, initial: f"case when i1 = '{initial}' then {_sql_struct(state, 'extra', 'K', '[role || chr(58) || text]')} end"
_RE = lambda state, role: f"case when free then {_sql_struct(state, '1 + extra', 'R', f'[{chr(39)}{role}:{chr(39)} || text]')} end"
_IN = lambda state, role: _sql_struct(state, "5", "I", f"['{role}:']")
_GO = lambda state: _sql_struct(state, "2", "D")
OP12_SQL = rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint),
      lambda c, b: list_reduce(range(8), {_STEP}, xor(c, b)), 4294967295::bigint), 4294967295::bigint) % 20 as kind
  from conversations
), hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
  from raw where kind <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k, role[1] as i1 from hurt
), judged as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?]{_BLANK}*\z') then 'truncated' else '' end as fault,
    lag(i1) over (partition by conv_id order by k) as before from placed
), told as (
  select *, fault in ('', 'truncated') as free, case when fault = 'truncated' then 5 else 0 end as extra from judged
), dp as (
  select distinct conv_id, 0::bigint as k, {{'c': 0, 'a': '', 't': []::varchar[]}} as s0, {{'c': 1000000000, 'a': '', 't': []::varchar[]}} as s1,
    {{'c': 1000000000, 'a': '', 't': []::varchar[]}} as s2, {{'c': 1000000000, 'a': '', 't': []::varchar[]}} as s3 from conversations
  union all
  select conv_id, k, {_GO('s0')}, least({_GO('s1')}, case when free then {_KEEP('s0', 's')} end),
    least({_GO('s2')}, case when free then least({_KEEP('s0', 'u')}, {_KEEP('s1', 'u')}, {_KEEP('s3', 'u')}) end, {_RE('s0', 'user')}, {_RE('s1', 'user')}, {_RE('s3', 'user')}),
    least({_GO('s3')}, case when free then {_KEEP('s2', 'a')} end, {_RE('s2', 'assistant')})
  from (
    select t.conv_id, t.k, t.role, t.text, t.i1, t.free, t.extra, s0, s1, least(s2, {_IN('s0', 'user')}, {_IN('s1', 'user')}, {_IN('s3', 'user')}) as s2, least(s3, {_IN('s2', 'assistant')}) as s3
    from dp join told t on t.conv_id is not distinct from dp.conv_id and t.k = dp.k + 1)
), best as (
  select conv_id, least(s0, s3, {_IN('s2', 'assistant')}) as x from dp qualify row_number() over (partition by conv_id order by k desc) = 1
), counted as (
  select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before is not null and before || i1 not in ('su', 'ua', 'au')) as illegal
  from told group by conv_id
)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  x.c::bigint as cost, x.a as audit, sha256(array_to_string(x.t, chr(10))) as repaired_sha256
from best b left join counted c on c.conv_id is not distinct from b.conv_id
"""
