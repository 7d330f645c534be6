"""Conversation repair: the cheapest edits that give a conversation the order system? (user assistant)+, found by an agenda.

A repair is a derivation. Item (i, q) says that the rows from i on can be repaired when what stands before them has left the grammar in
state q. A hyperedge takes an edit of row i - 1 that leads from q to p (or an insertion, which uses no row) and the item (i, p), and
concludes the item before. Its function adds the edit's cost and puts its letter in front, so it is monotone; it is
superior in the order of (cost, rows used, audit), as an edit costs something or uses a row. The agenda pops the least value, which is
final, and stops at the goal (Knuth's generalisation of Dijkstra's algorithm). Of one item all derivations use the same rows,
so the least value is the least (cost, audit).

Conversations of any length: rows are dealt by ranges of (conversation, turn), and a task cuts a conversation into blocks of at
most BLOCK_ROWS rows. What a block can do, from each state to each state, is found where its rows are; only that is brought together.
A hot conversation so spreads over tasks; one task holds four audits and the initials of its rows, never its texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: A block ends with so many rows, or so many characters.
BLOCK_ROWS, BLOCK_CHARS = 2048, 4 << 20

#: States of the grammar by what was last put out: nothing, system, user, assistant. A conversation may end in ENDS.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
#: state -> (state before, initial) of each step that leads there
_BACK = {p: [(q, r) for (q, r), to in STEPS.items() if to == p] for p in STATES}

Value = tuple[int, int, str]  # cost, rows used, audit

_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("turn", pa.int64())])
_SPAN = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS], ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("initials", pa.string()), ("spans", pa.list_(_SPAN)), ("content", pa.list_(_TURN)),
])
PIECE = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("piece", pa.string()), ("state", pa.int32()), ("place", pa.int64()), ("report", pa.struct([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())]))])
TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    def kind(t):
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        if pa.types.is_struct(t):
            return "struct<" + ",".join(f"{f.name}:{kind(f.type)}" for f in t) + ">"
        return {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}[t]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


# ---- derivations ----


def lightest(axioms: dict, deduce: Callable[[tuple], Iterable[tuple]], goals: Iterable[tuple]) -> dict[tuple, Value]:
    """The final values of the items popped until all goals are final. deduce(item) gives (conclusion, cost, rows, letters) of each
    hyperedge that the item is the last antecedent of."""
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    final, wanted = {}, set(goals)
    while agenda and wanted:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        wanted.discard(item)
        for conclusion, cost, rows, letters in deduce(item):
            if conclusion not in final:
                heapq.heappush(agenda, ((value[0] + cost, value[1] + rows, letters + value[2]), conclusion))
    return final


def edits(rows: list[tuple[str, str]]) -> Callable[[tuple], Iterable[tuple]]:
    """The deductions over rows, each an initial and a fault ('', 'blank', 'duplicate', 'truncated')."""

    def deduce(item):
        i, p = item
        for q, r in _BACK[p]:
            if r != "s":
                yield (i, q), INSERT, 0, "I"
        if i:
            initial, fault = rows[i - 1]
            yield (i - 1, p), DELETE, 1, "D"
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault else 0
                for q, r in _BACK[p]:
                    if r == initial:
                        yield (i - 1, q), KEEP + extra, 1, "K"
                    if r != "s":
                        yield (i - 1, q), REROLE + extra, 1, "R"

    return deduce


def whole_repair(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    final = lightest({(len(rows), q): (0, 0, "") for q in ENDS}, edits(rows), [(0, 0)])
    return final[0, 0][0], final[0, 0][2]


def block_spans(rows: list[tuple[str, str]]) -> list[dict]:
    """What a block can do: the lightest way from each state before it to each state after it, where there is one."""
    out = []
    for after in STATES:
        final = lightest({(len(rows), after): (0, 0, "")}, edits(rows), [(0, q) for q in STATES])
        out += [{"before": q, "after": after, "cost": final[0, q][0], "audit": final[0, q][2]} for q in STATES if (0, q) in final]
    return out


def chain(spans: list[dict], n: int, after: dict[int, Value]) -> dict[int, Value]:
    """The values of the states before a block of n rows, from those of the states after it: hyperedges of a span and an item."""
    by_end = {p: [s for s in spans if s["after"] == p] for p in STATES}

    def deduce(item):
        return [((0, s["before"]), s["cost"], n, s["audit"]) for s in by_end[item[1]]] if item[0] else []

    final = lightest({(1, p): value for p, value in after.items()}, deduce, [(0, q) for q in STATES])
    return {q: value for (i, q), value in final.items() if not i}


def walk(audit: str, initials: Iterable[str], state: int = 0) -> Iterator[tuple[str, bool, str | None, int]]:
    """Edit, whether it uses a row, the initial it puts out (none if it deletes), and the state after it."""
    rows = iter(initials)
    for edit in audit:
        initial = None if edit == "I" else next(rows)
        if edit == "D":
            yield edit, True, None, state
            continue
        out = initial if edit == "K" else "a" if state == 2 else "u"
        state = STEPS[state, out]
        yield edit, edit != "I", out, state


def pieces(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut where blocks of so many rows end; insertions before a row go with it, those at the end with the last block."""
    out, at = [], 0
    for k, n in enumerate(sizes):
        end = at
        while n and end < len(audit):
            n -= audit[end] != "I"
            end += 1
        end = len(audit) if k == len(sizes) - 1 else end
        out.append(audit[at:end])
        at = end
    return out


# ---- faults ----


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with planted damage, chosen by crc32 of `conv_id:turn` modulo 20: 0 drops the row,
    1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. A null counts
    as one space, in role and text and in what is hashed; null turns and conv_ids themselves stay null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), equal ones as one with their number n: blank, truncated, and fresh where the conversation
    has no earlier row of that role and text. Counts meet by whole rows before anything is dealt by conversation."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("last_", last)
    rows = rows.withColumns({"blank": F.col("last_") == "", "truncated": ~F.col("last_").isin(".", "!", "?"), "said": F.sha2("text", 256)}).drop("last_")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("said").alias("s_")).agg(F.min(when).alias("first_"))
    same = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("said") == F.col("s_"))
    return rows.join(first, same).select("conv_id", "turn", "role", "text", "n", "blank", "truncated", F.col("turn").eqNullSafe(F.col("first_.turn")).alias("fresh"))


# ---- blocks ----


class _Block:
    """The rows of one block of a conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.chars, self.content, self.faults = conv_id, 0, [], []

    def add(self, role, text, turn, fault):
        self.content.append({"role": role, "text": "" if fault in ("blank", "duplicate") else text, "turn": turn})
        self.faults.append(fault)
        self.chars += len(self.content[-1]["text"])

    def row(self, part: int, number: int, whole: bool) -> dict:
        initials = "".join(x["role"][:1] or "?" for x in self.content)
        turns = [x["turn"] for x in self.content if x["turn"] is not None]
        rows = list(zip(initials, self.faults, strict=True))
        if whole:
            cost, audit = whole_repair(rows)
            spans = [{"before": 0, "after": None, "cost": cost, "audit": audit}]
        else:
            spans = block_spans(rows)
        return {
            "conv_id": self.conv_id, "part": part, "block": number, "whole": whole, "rows": len(rows), **{f: self.faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(initials[i : i + 2] not in LEGAL_PAIRS for i in range(len(initials) - 1)), "turns": len(set(turns)), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
            "initials": initials, "spans": spans, "content": self.content,
        }


def _sent(schema: pa.Schema):
    """Gathers rows (dicts) to record batches of about a thousand rows or 4 MB of text."""
    held, chars = [], 0

    def send(row=None, weight=0):
        nonlocal held, chars
        if row is not None:
            held.append(row)
            chars += weight
        if held and (row is None or len(held) >= 1000 or chars > 4 << 20):
            out, held, chars = pa.RecordBatch.from_pylist(held, schema), [], 0
            yield out

    return send


def conversation_blocks(rows: DataFrame) -> DataFrame:
    """Blocks (BLOCK) of marked rows. `whole` blocks are conversations that lie in one task and one block; of others, also of those at
    the edges of a task, spans tell what each block can do."""

    def cut(batches):
        part, send, number = TaskContext.get().partitionId(), _sent(BLOCK), 0
        current, edge = None, True

        def close(whole):
            nonlocal number
            number += 1
            yield from send(current.row(part, number, whole), current.chars)

        for batch in batches:
            for conv_id, turn, role, text, n, blank, truncated, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is not None and current.conv_id != conv_id:
                    yield from close(not edge)
                    current, edge = _Block(conv_id), False
                current = current or _Block(conv_id)
                for copy in range(n):
                    if len(current.content) >= BLOCK_ROWS or current.chars >= BLOCK_CHARS:
                        edge = True
                        yield from close(False)
                        current = _Block(conv_id)
                    current.add(role, text, turn, "blank" if blank else "duplicate" if copy or not fresh else "truncated" if truncated else "")
        if current is not None:
            yield from close(False)
        yield from send()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]  # and the text; ranges need only how it begins
    rows = rows.select("conv_id", "turn", "role", "text", "n", "blank", "truncated", "fresh")
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return materialise(rows.mapInArrow(cut, _ddl(BLOCK)), "repair-blocks")


def _gaps(first, last, turns):
    return 0 if first is None else last - first + 1 - turns


def join_blocks(blocks: DataFrame) -> DataFrame:
    """The edits of each block (PIECE), with the state and the place before it; the last of a conversation carries its report.

    Blocks come from the last to the first, without their rows, and only the four lightest values are kept; sorted by Spark.
    """

    def join(batches):
        send = _sent(PIECE)

        def done(parts, values):
            parts.reverse()
            cost, _, audit = values[0]
            state, place, counts = 0, 0, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
            last_initial, first_turn, last_turn = "", None, None
            for k, (b, piece) in enumerate(zip(parts, pieces(audit, [b["rows"] for b in parts]), strict=True)):
                for c in counts:
                    counts[c] += b[c]
                counts["illegal"] += bool(last_initial) and last_initial + b["initials"][0] not in LEGAL_PAIRS
                counts["turns"] -= last_turn is not None and last_turn == b["first_turn"]
                last_initial = b["initials"][-1]
                first_turn = b["first_turn"] if first_turn is None else first_turn
                last_turn = last_turn if b["last_turn"] is None else b["last_turn"]
                row = {"part": b["part"], "block": b["block"], "piece": piece, "state": state, "place": place, "report": None}
                steps = list(walk(piece, b["initials"], state))
                place += sum(out is not None for _, _, out, _ in steps)
                state = steps[-1][-1] if steps else state
                if k == len(parts) - 1:
                    row["report"] = {"conv_id": b["conv_id"], "gaps": _gaps(first_turn, last_turn, counts["turns"]), **{c: counts[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}
                yield from send(row, len(piece))

        parts, values = [], {}
        for batch in batches:
            for b in batch.to_pylist():
                if parts and parts[-1]["conv_id"] != b["conv_id"]:
                    yield from done(parts, values)
                    parts = []
                if not parts:
                    values = {q: (0, 0, "") for q in ENDS}
                values = chain(b.pop("spans"), b["rows"], values)
                parts.append(b)
        if parts:
            yield from done(parts, values)
        yield from send()

    slim = blocks.filter("not whole").drop("content", "whole").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    return materialise(slim.mapInArrow(join, _ddl(PIECE)), "repair-pieces")


def repaired_turns(blocks: DataFrame, joined: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn (TURNS): place counts them from 0, turn is null where one was inserted."""
    columns = ["conv_id", "piece", "state", "place", "initials", "content"]
    whole = blocks.filter("whole").select("conv_id", F.col("spans")[0]["audit"].alias("piece"), F.lit(0).alias("state"), F.lit(0).cast("long").alias("place"), "initials", "content")
    others = blocks.filter("not whole").join(joined.select("part", "block", "piece", "state", "place"), ["part", "block"]).select(columns)

    def apply(batches):
        send = _sent(TURNS)
        for batch in batches:
            for i in range(batch.num_rows):
                conv_id, piece, state, place, initials, content = (c[i].as_py() for c in batch.columns)
                rows = iter(content)
                for edit, uses, out, _ in walk(piece, initials, state):
                    row = next(rows) if uses else {"role": None, "text": "", "turn": None}
                    if out is not None:
                        yield from send({"conv_id": conv_id, "place": place, "edit": edit, "role": row["role"] if edit == "K" else ROLES[out], "text": row["text"], "turn": row["turn"]}, len(row["text"]))
                        place += 1
        yield from send()

    return whole.unionByName(others).mapInArrow(apply, _ddl(TURNS))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has rows, and
    the repaired turns (TURNS).

    Rows count in the order of turn (nulls first), role and text, so equal rows are adjacent. A row's fault is the first of: blank,
    duplicate (role and text stand earlier), truncated (doesn't end as a sentence). A null conv_id is a conversation of its own;
    a null role or text is one space; an empty role has no initial and is never legal; an empty table has no reports. Other columns are
    ignored.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    blocks = conversation_blocks(marked(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))))
    joined = join_blocks(blocks)
    span = F.col("spans")[0]
    gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
    whole = blocks.filter("whole").select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", span["cost"].alias("cost"), span["audit"].alias("audit"))
    return whole.unionByName(joined.filter("report is not null").select("report.*")), repaired_turns(blocks, joined)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of its `role:text`, joined by line breaks. A digest is sequential, so the turns of a conversation
    stream through one task, in order; nothing but the digest's state is kept."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(batches):
        send, now, sha = _sent(schema), None, None
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if sha is not None and conv_id == now:
                    sha.update(b"\n")
                else:
                    if sha is not None:
                        yield from send({"conv_id": now, "repaired_sha256": sha.hexdigest()})
                    now, sha = conv_id, hashlib.sha256()
                sha.update(f"{role}:{text}".encode())
        if sha is not None:
            yield from send({"conv_id": now, "repaired_sha256": sha.hexdigest()})
        yield from send()

    ordered = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    return ordered.mapInArrow(digest, _ddl(schema))


def op11_agenda_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    reports, turns = repair(damage(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    reports = reports.withColumnRenamed("conv_id", "c_")
    shas = digests(turns).withColumnRenamed("conv_id", "d_")
    rows = every.join(reports, F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("cost").isNotNull(), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("d_")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _plus(value: str, cost, letter: str) -> str:
    """SQL: a value (nine digits of cost, then the audit) with an edit behind it. Values compare as strings."""
    return f"lpad(cast(cast(substr({value}, 1, 9) as bigint) + {cost} as varchar), 9, '0') || substr({value}, 10) || '{letter}'"


_CLOSED = f"""(select *, least(s3, {_plus("c2", INSERT, "I")}) as c3 from (
  select *, least(s2, {_plus("s0", INSERT, "I")}, {_plus("s1", INSERT, "I")}, {_plus("s3", INSERT, "I")}) as c2 from r))"""

#: Forwards, row by row, with the least value of each state; the crc32 bit by bit; then the audits' letters are replayed.
OP11_SQL = f"""
with recursive keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)) as bytes from conversations),
kinds as (select *, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b:
  list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 as kind from keyed),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds where kind <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
placed as (select *, row_number() over (partition by conv_id, role, text order by i) as times, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from numbered),
o as (select conv_id, i, turn, role, text, left(role, 1) as x, case when body = '' then 'blank' when times > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
  lag(left(role, 1)) over (partition by conv_id order by i) as x0 from placed),
counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where i > 1 and x0 || x not in ('su', 'ua', 'au')) as illegal from o group by conv_id),
r as (select conv_id, cast(0 as bigint) as i, '000000000' as s0, cast(null as varchar) as s1, cast(null as varchar) as s2, cast(null as varchar) as s3 from counts
  union all
  select conv_id, i + 1, {_plus("s0", DELETE, "D")}, least({_plus("s1", DELETE, "D")}, case when ok and x = 's' then {_plus("s0", "extra", "K")} end),
    least({_plus("c2", DELETE, "D")}, case when ok and x = 'u' then {_plus("before_u", "extra", "K")} end, case when ok then {_plus("before_u", f"extra + {REROLE}", "R")} end),
    least({_plus("c3", DELETE, "D")}, case when ok and x = 'a' then {_plus("c2", "extra", "K")} end, case when ok then {_plus("c2", f"extra + {REROLE}", "R")} end)
  from (select c.conv_id, c.i, c.s0, c.s1, c.c2, c.c3, least(c.s0, c.s1, c.c3) as before_u, o.x, o.fault not in ('blank', 'duplicate') as ok, case when o.fault = 'truncated' then {TRUNCATED} else 0 end as extra
    from {_CLOSED} c join o on o.conv_id is not distinct from c.conv_id and o.i = c.i + 1)),
best as (select k.*, least(c.s0, c.c3) as value from {_CLOSED} c join counts k on k.conv_id is not distinct from c.conv_id and k.n = c.i),
audits as (select *, cast(substr(value, 1, 9) as bigint) as cost, substr(value, 10) as audit from best),
letters as (select conv_id, audit, unnest(range(1, length(audit) + 1)) as k from audits),
replayed as (select l.conv_id, k, substr(audit, k, 1) as letter, length(replace(substr(audit, 1, k), 'D', '')) as place, o.role, o.text, o.x
  from letters l left join o on o.conv_id is not distinct from l.conv_id and o.i = length(replace(substr(audit, 1, k), 'I', '')) and substr(audit, k, 1) <> 'I'),
led as (select *, count(*) filter (where place = 1 and letter = 'K' and x = 's') over (partition by conv_id) as lead_ from replayed where letter <> 'D'),
written as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (place - lead_) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by k)) as sha from led group by conv_id)
select e.conv_id, coalesce(a.gaps, 0) as gaps, coalesce(a.blank, 0) as blank, coalesce(a.duplicate, 0) as duplicate, coalesce(a.truncated, 0) as truncated, coalesce(a.illegal, 0) as illegal, coalesce(a.cost, 0) as cost,
  coalesce(a.audit, '') as audit, coalesce(w.sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) e left join audits a on a.conv_id is not distinct from e.conv_id left join written w on w.conv_id is not distinct from e.conv_id
"""
