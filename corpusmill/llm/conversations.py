"""Operator 12: repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a place between two rows and a state of the grammar `(s?(ua)+)?` of role initials; edges are the
edits.  A forward and a reverse heap grow until their least costs add up to more than the best meeting, so all crossings
of equal cost are finished; the least concatenated audit among them is taken.

Rows are range-sorted by conversation and turn (the one shuffle of texts) and read as a stream: a conversation that lies in
one task and has at most SEGMENT rows is repaired there.  Longer ones, and those cut by a task's edge, become segments:

1. The rows of earlier segments that a segment's rows repeat are found by grouping digests.
2. Each segment is solved for every state before and after it.  Insertions stand before a row, so audits of one start and
   different ends never are prefixes of each other, and a segment hands on costs and the order of its audits only.
3. These small matrices are multiplied (least cost, then least audit), first those of a task, then those of a conversation;
   going back down gives each segment its states.
4. Segments write out their part; the parts stream past one hash in order.  (SHA-256 of one text is serial, and the audit is one
   value; nothing else of a conversation is ever in one task or in memory as a whole.)

Defined results: null ids are one conversation, and a null id, turn, role or text counts as one space (a null turn comes first,
and `gaps` leaves it out); rows of equal turn stand in the order of role, then text; a role of no characters fits no place of
the grammar; an empty text is blank; long texts and long conversations are taken whole; repeated rows are duplicates; a
conversation without rows after damage has zeros, an empty audit and the hash of nothing; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import materialize, pieces

#: Costs of the edits and of leaving a row that is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Rows to a segment, and characters.
SEGMENT, CHARACTERS = 256, 1 << 20
BLANK = " \t\n\v\f\r"
#: States of the grammar: nothing yet, after s, after u, after a; and the steps that initials take.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a row of a free role leads to, and what its role is.
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
BEFORE = {t: [s for s in FREE if FREE[s] == t] for t in range(4)}
#: What must still be inserted at the end of a conversation.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
SOUND, DEAD, CUT = range(3)

Node = tuple[int, int]
Best = tuple[int, str]


class Lattice:
    """The edits of some rows: initials and faults (SOUND, DEAD: to be deleted, CUT: costs more if it stays)."""

    def __init__(self, initials: list[str], faults: list[int], tail: bool):
        self.initials, self.faults, self.last, self.tail = initials, faults, len(initials), tail

    def _row(self, i: int, s: int) -> Iterator[tuple[int, int, str]]:
        """Edits of row i in state s: cost, state after it, letter."""
        yield DELETE, s, "D"
        if self.faults[i] != DEAD:
            more = CUT_OFF if self.faults[i] == CUT else 0
            if (s, self.initials[i]) in STEPS:
                yield more, STEPS[s, self.initials[i]], "K"
            yield REROLE + more, FREE[s], "R"

    def onward(self, node: Node) -> Iterator[tuple[int, Node, str]]:
        i, s = node
        if i < self.last or self.tail:
            yield INSERT, (i, FREE[s]), "I"
        if i < self.last:
            for cost, t, letter in self._row(i, s):
                yield cost, (i + 1, t), letter

    def back(self, node: Node) -> Iterator[tuple[int, Node, str]]:
        i, t = node
        if i < self.last or self.tail:
            for s in BEFORE[t]:
                yield INSERT, (i, s), "I"
        if i:
            for s in range(4):
                for cost, to, letter in self._row(i - 1, s):
                    if to == t:
                        yield cost, (i - 1, s), letter

    def cheapest(self, first: int, ends: list[int]) -> Best | None:
        """Least cost, and least audit of that cost, from state first before the rows to one of the states behind them."""
        # Equal costs leave the heaps in the order of rows (edges that cost nothing lead on by a row), then of audits,
        # so a node is settled with the least audit of its least cost.
        forward, reverse = [(0, 0, "", first)], [(0, 0, "", t) for t in ends]
        settled: tuple[dict[Node, Best], dict[Node, Best]] = ({}, {})
        best = 0 if not self.last and first in ends else None
        while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
            ahead = forward[0][0] <= reverse[0][0]
            cost, k, audit, s = heappop(forward if ahead else reverse)
            node = (k, s) if ahead else (self.last - k, s)
            mine, other = settled if ahead else settled[::-1]
            if node in mine:
                continue
            mine[node] = cost, audit
            for more, to, letter in self.onward(node) if ahead else self.back(node):
                if to in other and (best is None or cost + more + other[to][0] < best):
                    best = cost + more + other[to][0]
                if to not in mine:
                    if ahead:
                        heappush(forward, (cost + more, to[0], audit + letter, to[1]))
                    else:
                        heappush(reverse, (cost + more, self.last - to[0], letter + audit, to[1]))
        if best is None:
            return None
        there, rest = settled
        crossings = [a + letter + rest[to][1] for node, (c, a) in there.items() for more, to, letter in self.onward(node) if to in rest and c + more + rest[to][0] == best]
        return best, min(crossings, default="")


def initials_of(roles: list[str]) -> list[str]:
    return [r[:1] for r in roles]


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def faults_of(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[list[int], dict[str, int]]:
    """The fault of each row and their counts; seen has the digests of rows before, and gets those of these."""
    faults, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in zip(roles, texts, strict=True):
        rest, name = text.rstrip(BLANK), digest(role, text)
        first = "blank" if not rest else "duplicate" if name in seen else "truncated" if rest[-1] not in ".!?" else None
        seen.add(name)
        faults.append(SOUND if first is None else CUT if first == "truncated" else DEAD)
        if first:
            counts[first] += 1
    return faults, counts


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> list[str]:
    """The lines `role:text` that the edits leave, from a state on."""
    out, rows = [], zip(roles, texts, strict=True)
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = STEPS[state, role[:1]] if letter == "K" else FREE[state]
        out.append(f"{role if letter == 'K' else ROLES[state]}:{text}")
    return out


def turn_span(turns: list[int | None]) -> dict[str, int | None]:
    """Least, greatest and number of different turns, nulls left out."""
    known = {t for t in turns if t is not None}
    return {"lo": min(known, default=None), "hi": max(known, default=None), "distinct": len(known)}


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def whole(roles: list[str], texts: list[str], turns: list[int | None]) -> dict:
    """The result of one conversation."""
    faults, counts = faults_of(roles, texts, set())
    initials, span = initials_of(roles), turn_span(turns)
    cost, audit = Lattice(initials, faults, True).cheapest(START, [START, ASSISTANT])
    gaps = span["hi"] - span["lo"] + 1 - span["distinct"] if span["distinct"] else 0
    text = "\n".join(repaired(roles, texts, audit, START))
    return {"gaps": gaps, **counts, "illegal": illegal_pairs(initials), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def damage(df: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text) after damage; rows that are dropped stay with a null text."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(spaced("text"), ".!?", "")).when(F.col("kind") != 0, spaced("text"))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def name_of(conv_id: Column) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


# Matrices: for each pair of states (before, after) the least cost, null if there is no way, and the place of its audit
# among those of the same state before.


def matrix(best: list[Best | None]) -> tuple[list[int | None], list[int | None]]:
    costs, ranks = [b and b[0] for b in best], []
    for s in range(4):
        order = sorted(b[1] for b in best[4 * s : 4 * s + 4] if b)
        ranks += [b and order.index(b[1]) for b in best[4 * s : 4 * s + 4]]
    return costs, ranks


def multiply(a: dict, b: dict) -> dict:
    """What two neighbouring parts of a conversation are together."""
    best: list = []
    for s, t in product(range(4), range(4)):
        ways = [(a["costs"][4 * s + m] + b["costs"][4 * m + t], a["ranks"][4 * s + m], b["ranks"][4 * m + t]) for m in range(4) if a["costs"][4 * s + m] is not None and b["costs"][4 * m + t] is not None]
        best.append(min(ways, default=None))
    ranks = []
    for s in range(4):
        order = sorted(w[1:] for w in best[4 * s : 4 * s + 4] if w)
        ranks += [w and order.index(w[1:]) for w in best[4 * s : 4 * s + 4]]
    out = {"costs": [w and w[0] for w in best], "ranks": ranks, **{c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")}}
    seam = a["last"] is not None and b["first"] is not None and a["last"] + b["first"] not in ("su", "ua", "au")
    out |= {"illegal": a["illegal"] + b["illegal"] + seam, "first": b["first"] if a["first"] is None else a["first"], "last": a["last"] if b["last"] is None else b["last"]}
    known = [x for x in (a, b) if x["distinct"]]
    out |= {"lo": min((x["lo"] for x in known), default=None), "hi": max((x["hi"] for x in known), default=None)}
    return out | {"distinct": a["distinct"] + b["distinct"] - (len(known) == 2 and a["hi"] == b["lo"])}


def states_between(parts: list[dict], first: int, last: int) -> list[int]:
    """The states between neighbouring parts on the cheapest way of least audit: one more than there are parts."""
    back = [[None] * 4 for _ in parts] + [[0 if t == last else None for t in range(4)]]
    for k in reversed(range(len(parts))):
        for s in range(4):
            back[k][s] = min((parts[k]["costs"][4 * s + t] + back[k + 1][t] for t in range(4) if parts[k]["costs"][4 * s + t] is not None and back[k + 1][t] is not None), default=None)
    out = [first]
    for k, p in enumerate(parts):
        s = out[-1]
        tight = [(p["ranks"][4 * s + t], t) for t in range(4) if p["costs"][4 * s + t] is not None and back[k + 1][t] is not None and p["costs"][4 * s + t] + back[k + 1][t] == back[k][s]]
        out.append(min(tight)[1])
    return out


_SUMMARY = "lo long, hi long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, ranks array<int>"


def _product(parts: list[dict]) -> dict:
    out = parts[0]
    for p in parts[1:]:
        out = multiply(out, p)
    return out


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conv_id: conv_id, NUMBERS, audit, repaired_sha256."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = damage(conversations)
    order = ["conv_id", "turn", "role", "head", "rest"]
    # Texts that begin alike are told apart by a hash where tasks meet, and equal rows by a number: none of them fills a task.
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "rest": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order, "at").sortWithinPartitions("conv_id", "turn", "role", "head", "text", "at").select("conv_id", "turn", "role", "text")
    fields = [rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in NUMBERS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in ("part", "seq", "lo", "hi", "distinct")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("roles", "texts")]
    schema = T.StructType([*fields, T.StructField("marks", T.ArrayType(T.BinaryType()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of conversations, and segments (those with a part) of what is longer or may go on in another task."""
        part, seq, kind = TaskContext.get().partitionId(), 0, None
        out: list[dict] = []
        roles: list[str] = []
        texts: list[str] = []
        turns: list[int | None] = []
        size, cut, edge, conv, begun = 0, False, True, None, False

        def flush() -> None:
            nonlocal seq, size
            marks = {digest(r, t) for r, t in zip(roles, texts, strict=True) if t.strip(BLANK)}
            out.append({"conv_id": conv, "part": part, "seq": seq, **turn_span(turns), "roles": list(roles), "texts": list(texts), "marks": list(marks)})
            seq, size = seq + 1, 0
            roles.clear(), texts.clear(), turns.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, pa.schema([kind, *((f.name, _arrow(f.dataType)) for f in schema.fields[1:])]))
            out.clear()
            return made

        for b in pieces(batches, 1024):
            kind = pa.field("conv_id", b.schema.field("conv_id").type)
            for c, turn, role, text in zip(*(b[k].to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                if not begun or c != conv:
                    if begun and (cut or edge):
                        flush()
                    elif begun:
                        out.append({"conv_id": conv, **whole(roles, texts, turns)})
                        size = 0
                        roles.clear(), texts.clear(), turns.clear()
                    edge, begun, conv, cut = not begun, True, c, False
                if text is not None:
                    if len(roles) >= segment or size >= CHARACTERS:
                        flush()
                        cut = True
                    roles.append(role), texts.append(text), turns.append(turn)
                    size += len(text)
            if out:
                yield batch()
        if begun:
            flush()
            yield batch()

    made = materialize(rows.mapInArrow(stream, schema), "conversations")
    results = ["conv_id", *NUMBERS, "audit", "repaired_sha256"]
    done = made.filter("part is null").select(results)
    long_ones = made.filter("part is not null").select(name_of(F.col("conv_id")).alias("name"), "conv_id", "part", "seq", "lo", "hi", "distinct", "roles", "texts", "marks")

    marks = long_ones.select("name", "part", "seq", F.explode("marks").alias("mark"))
    firsts = marks.groupBy("name", "mark").agg(F.min(F.struct("part", "seq")).alias("first"))
    later = marks.join(firsts, ["name", "mark"]).filter(F.struct("part", "seq") != F.col("first")).groupBy("part", "seq").agg(F.collect_list("mark").alias("seen"))
    ready = long_ones.join(later, ["part", "seq"], "left").select("name", "part", "seq", "lo", "hi", "distinct", "roles", "texts", "seen")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 16):
            out = []
            for r in b.to_pylist():
                faults, counts = faults_of(r["roles"], r["texts"], set(r["seen"] or ()))
                initials = initials_of(r["roles"])
                lattice = Lattice(initials, faults, False)
                best = [lattice.cheapest(s, [t]) for s, t in product(range(4), range(4))]
                costs, ranks = matrix(best)
                row = {k: r[k] for k in ("name", "part", "seq", "lo", "hi", "distinct")} | counts | {"illegal": illegal_pairs(initials), "costs": costs, "ranks": ranks, "audits": [x and x[1] for x in best]}
                out.append(row | {"first": initials[0] if initials else None, "last": initials[-1] if initials else None})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(f.name, _arrow(f.dataType)) for f in solved]))

    solved = T.StructType.fromDDL(f"name string, part long, seq long, audits array<string>, {_SUMMARY}")
    segments = materialize(ready.mapInArrow(solve, solved), "segments")

    def combine(table: pa.Table) -> pa.Table:
        """One row for the segments that a task has of a conversation."""
        found = sorted(table.to_pylist(), key=lambda r: r["seq"])
        row = {k: found[0][k] for k in ("name", "part")} | {k: v for k, v in _product(found).items() if k not in ("name", "part", "seq")}
        return pa.Table.from_pylist([row], pa.schema([(f.name, _arrow(f.dataType)) for f in of_parts]))

    of_parts = T.StructType.fromDDL(f"name string, part long, {_SUMMARY}")
    by_part = materialize(segments.drop("audits").groupBy("name", "part").applyInArrow(combine, of_parts), "parts")
    chosen = T.StructType.fromDDL("name string, part long, seq long, before int, after int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")

    def choose(table: pa.Table) -> pa.Table:
        """For a conversation: its numbers (in the row of its last part), and the states around each part."""
        found = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = _product(found)
        ends = [(total["costs"][t] + INSERT * len(TAIL[t]), total["ranks"][t], t) for t in range(4) if total["costs"][t] is not None]
        cost, _, end = min(ends)
        states = states_between(found, START, end)
        out = [{"name": r["name"], "part": r["part"], "before": s, "after": t} for r, s, t in zip(found, states, states[1:], strict=False)]
        out[-1] |= {"gaps": total["hi"] - total["lo"] + 1 - total["distinct"] if total["distinct"] else 0, "cost": cost, **{c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}}
        return pa.Table.from_pylist(out, pa.schema([(f.name, _arrow(f.dataType)) for f in chosen]))

    of_conversations = materialize(by_part.groupBy("name").applyInArrow(choose, chosen), "states")

    def descend(table: pa.Table, around: pa.Table) -> pa.Table:
        """The states around each segment of a task and a conversation."""
        found, (ends,) = sorted(table.to_pylist(), key=lambda r: r["seq"]), around.to_pylist()
        states = states_between(found, ends["before"], ends["after"])
        out = [{"name": r["name"], "part": r["part"], "seq": r["seq"], "before": s, "after": t} for r, s, t in zip(found, states, states[1:], strict=False)]
        return pa.Table.from_pylist(out, pa.schema([(f.name, _arrow(f.dataType)) for f in chosen]))

    states = segments.drop("audits").groupBy("name", "part").cogroup(of_conversations.select("name", "part", "before", "after").groupBy("name", "part")).applyInArrow(descend, chosen)
    audit = F.element_at("audits", 4 * F.col("before") + F.col("after") + 1)
    way = segments.select("part", "seq", "audits").join(states.select("part", "seq", "before", "after"), ["part", "seq"]).select("part", "seq", "before", "after", audit.alias("audit"))
    written = long_ones.join(way, ["part", "seq"]).select("name", "conv_id", "part", "seq", "before", "after", "audit", "roles", "texts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 16):
            texts = [repaired(r["roles"], r["texts"], r["audit"], r["before"]) for r in b.select(["roles", "texts", "audit", "before"]).to_pylist()]
            lines = [("\n".join(t) if t else None) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in ("name", "conv_id", "part", "seq", "after", "audit")), pa.array(lines, pa.string())], [f.name for f in lined])

    lined = T.StructType([T.StructField("name", T.StringType()), rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in ("part", "seq")), T.StructField("after", T.IntegerType()), T.StructField("audit", T.StringType()), T.StructField("lines", T.StringType())])
    in_order = written.mapInArrow(write, lined).repartition(F.col("name")).sortWithinPartitions("name", "part", "seq")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations one after another: nothing but the running hash and the audit is kept."""
        name, conv, audit, end, hasher, any_line, kind = None, None, [], START, None, False, None

        def row() -> pa.RecordBatch:
            tail = repaired([], [], TAIL[end], end)
            if tail:
                hasher.update((("\n" if any_line else "") + "\n".join(tail)).encode())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([conv], kind), pa.array(["".join(audit) + TAIL[end]]), pa.array([hasher.hexdigest()])], ["name", "conv_id", "audit", "repaired_sha256"])

        for b in pieces(batches, 64):
            kind = b.schema.field("conv_id").type
            for r in b.to_pylist():
                if r["name"] != name:
                    if name is not None:
                        yield row()
                    name, conv, audit, hasher, any_line = r["name"], r["conv_id"], [], hashlib.sha256(), False
                audit.append(r["audit"])
                end = r["after"]
                if r["lines"] is not None:
                    hasher.update((("\n" if any_line else "") + r["lines"]).encode())
                    any_line = True
        if name is not None:
            yield row()

    hashed = in_order.mapInArrow(digests, T.StructType([lined["name"], rows.schema["conv_id"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]))
    numbers = of_conversations.filter("cost is not null").select("name", *NUMBERS)
    return done.unionByName(hashed.join(numbers, "name").select(results))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind.simpleString()]


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the faults, the cheapest repair and the digest of what it leaves, of every conversation."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql_least(target: str, ways: list[tuple[str, str, str, str]]) -> str:
    """SQL: the least of some (cost, audit, lines) that come from states by a letter; condition, cost, letter, lines."""
    rows = ", ".join(f"CASE WHEN {when} THEN {{'c': {cost}, 'a': {letter}, 'l': {lines}}} END" for when, cost, letter, lines in ways)
    return f"list_sort(list_filter([{rows}], lambda x: x IS NOT NULL))[1] AS {target}"


def _oracle() -> str:
    """Dynamic programming row by row: the best of each state (cost, audit, lines), first by insertions, then by the row's edits."""
    role = {USER: "user", ASSISTANT: "assistant"}
    name = ["st", "sy", "us", "aa"]

    def way(s: str, when: str, cost: str, letter: str, line: str | None) -> tuple[str, str, str, str]:
        lines = f"{s}.l" if line is None else f"list_append({s}.l, {line})"
        return f"{s} IS NOT NULL AND {when}", f"{s}.c + {cost}", f"{s}.a || '{letter}'", lines

    stay = lambda s: way(s, "true", "0", "", None)
    insert = lambda s, t: way(s, "true", "3", "I", f"'{role[t]}:'")
    to_user = _sql_least("us", [stay("us"), *(insert(s, USER) for s in ("st", "sy", "aa"))])
    to_assistant = _sql_least("aa", [stay("aa"), insert("us", ASSISTANT)])
    more = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    alive = "(fault IS NULL OR fault = 'truncated')"

    def after(t: int) -> str:
        ways = [way(name[t], "true", "4", "D", None)]
        ways += [way(name[s], f"{alive} AND role[1:1] = '{c}'", more, "K", "role || ':' || text") for (s, c), to in STEPS.items() if to == t]
        ways += [way(name[s], alive, f"3 + {more}", "R", f"'{role[t]}:' || text") for s in FREE if FREE[s] == t]
        return _sql_least(name[t], ways)

    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
    lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM damaged),
rowz AS (SELECT conv_id, turn, role, text, p, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY p) || role[1:1] AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS again FROM placed)),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, {{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}} AS st, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, l VARCHAR[])) AS sy, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, l VARCHAR[])) AS us,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, l VARCHAR[])) AS aa FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, p, {after(START)}, {after(SYSTEM)}, {after(USER)}, {after(ASSISTANT)} FROM (
    SELECT conv_id, p, st, sy, us, {to_assistant}, role, text, fault FROM (
      SELECT dp.conv_id, r.p, st, sy, {to_user}, aa, role, text, fault FROM dp JOIN rowz r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.p = dp.p + 1))),
ended AS (SELECT conv_id, st, {_sql_least('aa', [stay('aa'), way('us', 'true', '3', 'I', "'assistant:'"), ('sy IS NOT NULL', 'sy.c + 6', "sy.a || 'II'", "list_concat(sy.l, ['user:', 'assistant:'])")])}
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS k FROM dp) WHERE k = 1),
best AS (SELECT conv_id, {_sql_least('b', [stay('st'), stay('aa')])} FROM ended),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rowz GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(array_to_string(b.l, chr(10))) AS repaired_sha256
FROM best LEFT JOIN n ON best.conv_id IS NOT DISTINCT FROM n.conv_id
"""


ORACLE_SQL = _oracle()
