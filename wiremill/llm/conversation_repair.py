"""Least-cost repair of conversations by bidirectional Dijkstra over the edit lattice.

A repaired conversation is empty or an optional system turn, then pairs of a
user and an assistant turn. A node of the lattice is a number of rows consumed
and what has been put out last (nothing, system, user, assistant); edges keep,
rerole, delete or insert a turn. One heap goes forward from the first node, one
backward from the last; they stop when their tops add up to more than the best
crossing, so that every cheapest path has a crossing edge. All crossings of that
cost are joined with the two trees into one graph, in which the letters of the
edits (D, I, K, R) are picked least first. Letters give costs, and no audit of a
cheapest path is a beginning of another, so the audit that is least is found
letter by letter, and audits of parts can be put together.

Rows of a conversation come in order of turn (nulls first), then role and text.
Conversations of up to ``piece_rows`` rows are repaired one by one from sorted
partitions. Longer ones are cut into pieces of that size: each piece gets the
cheapest edits between any two states at its borders, pieces are put together
256 at a time up to the whole, and the chosen edits are then applied to each
piece; only the hash of the whole, which has to see its bytes in order, goes
through one task, as a stream.

Cases: a null conversation key is a conversation like others; null turns sort
first and count for no gap; null roles and texts are a single space, so a null
text is blank; repeated rows are duplicates; rows equal in turn are ordered by
role and text; texts are taken whole; an empty table gives an empty table; only
the four named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiremill.llm.common import checked, small_batches, table
from wiremill.session import written

#: What was put out last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with a role's initial, by state.
_AFTER = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state after a turn whose role is chosen, and the states from which it is.
_NEXT = (USER, USER, ASSISTANT, USER)
_BEFORE = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_DELETE, _REROLE, _INSERT = 3, 2, 2
_FAR = 1 << 60

#: A row for the search: role's initial, whether it has to go, whether it ends early.
Turn = tuple[str, bool, bool]


def _forward(turns: list[Turn], node: int) -> Iterator[tuple[int, int, str]]:
    """Edges out of a node (4 times rows consumed, plus state): next node, cost, letter."""
    at, state = divmod(node, 4)
    after = _NEXT[state]
    yield 4 * at + after, _INSERT, "I"
    if at < len(turns):
        initial, gone, short = turns[at]
        yield node + 4, _DELETE, "D"
        if not gone:
            yield 4 * at + 4 + after, _REROLE + short, "R"
            kept = _AFTER[state].get(initial)
            if kept is not None:
                yield 4 * at + 4 + kept, int(short), "K"


def _backward(turns: list[Turn], node: int) -> Iterator[tuple[int, int]]:
    """Edges into a node: node before, cost."""
    at, state = divmod(node, 4)
    for before in _BEFORE.get(state, ()):
        yield 4 * at + before, _INSERT
    if at:
        initial, gone, short = turns[at - 1]
        yield node - 4, _DELETE
        if not gone:
            for before in _BEFORE.get(state, ()):
                yield 4 * at - 4 + before, _REROLE + short
            for before in range(4):
                if _AFTER[before].get(initial) == state:
                    yield 4 * at - 4 + before, int(short)


def cheapest(turns: list[Turn], start: int = NOTHING, ends: tuple[int, ...] = (NOTHING, ASSISTANT)) -> tuple[int, str] | None:
    """Cost and least audit of the edits that lead from state ``start`` to one of ``ends``; None if none do."""
    goals = [4 * len(turns) + e for e in ends]
    ahead, back = {start: 0}, dict.fromkeys(goals, 0)
    ahead_heap, back_heap = [(0, start)], [(0, g) for g in goals]
    heapq.heapify(back_heap)
    ahead_done: set[int] = set()
    back_done: set[int] = set()
    best = back.get(start, _FAR)
    while ahead_heap and back_heap and ahead_heap[0][0] + back_heap[0][0] <= best:
        if ahead_heap[0][0] <= back_heap[0][0]:
            d, node = heapq.heappop(ahead_heap)
            if node in ahead_done:
                continue
            ahead_done.add(node)
            for other, cost, _ in _forward(turns, node):
                if d + cost < ahead.get(other, _FAR):
                    ahead[other] = d + cost
                    heapq.heappush(ahead_heap, (d + cost, other))
                best = min(best, d + cost + back.get(other, _FAR))
        else:
            d, node = heapq.heappop(back_heap)
            if node in back_done:
                continue
            back_done.add(node)
            for other, cost in _backward(turns, node):
                if d + cost < back.get(other, _FAR):
                    back[other] = d + cost
                    heapq.heappush(back_heap, (d + cost, other))
                best = min(best, d + cost + ahead.get(other, _FAR))
    if best == _FAR:
        return None
    # Nodes on the forward side from which a crossing of the best cost is reached.
    leads = [n for n in ahead_done if any(ahead[n] + c + back.get(o, _FAR) == best for o, c, _ in _forward(turns, n))]
    useful = set(leads)
    while leads:
        node = leads.pop()
        for other, cost in _backward(turns, node):
            if other in ahead_done and other not in useful and ahead[other] + cost == ahead[node]:
                useful.add(other)
                leads.append(other)
    audit = []
    front = {(start, False)} | ({(start, True)} if back.get(start) == best else set())
    while not any(crossed and node in goals and not back[node] for node, crossed in front):
        least, following = "~", set()
        for node, crossed in front:
            for other, cost, letter in _forward(turns, node):
                if letter > least:
                    continue
                steps = []
                if crossed:
                    if back.get(other, _FAR) + cost == back[node]:
                        steps = [(other, True)]
                else:
                    if other in useful and ahead[node] + cost == ahead[other]:
                        steps = [(other, False)]
                    if ahead[node] + cost + back.get(other, _FAR) == best:
                        steps.append((other, True))
                if steps:
                    if letter < least:
                        least, following = letter, set()
                    following.update(steps)
        audit.append(least)
        front = following
    return best, "".join(audit)


def edited(rows: list[tuple[str, str]], audit: str, state: int = NOTHING) -> list[tuple[str, str]]:
    """The (role, text) that an audit makes of rows, from a state on."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            out.append(rows[at])
            state = _AFTER[state][rows[at][0][:1]]
        else:
            state = _NEXT[state]
            out.append((_ROLE[state], "" if letter == "I" else rows[at][1]))
        at += letter != "I"
    return out


def spelt(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def fault(role: str, text: str, seen: bool) -> str | None:
    """A row's first fault."""
    text = text.strip(" \t\n\x0b\x0c\r")
    return "blank" if not text else "duplicate" if seen else "truncated" if text[-1] not in ".!?" else None


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


#: What a repair returns beside the key.
FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def repair(rows: list[tuple[int | None, str, str]]) -> tuple[dict, list[tuple[str, str]]]:
    """Facts of one conversation's rows (turn, role, text), in order, and its repaired turns."""
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    seen: set[tuple[str, str]] = set()
    turns: list[Turn] = []
    for _, role, text in rows:
        found = fault(role, text, (role, text) in seen)
        seen.add((role, text))
        if found:
            counts[found] += 1
        turns.append((role[:1], found in ("blank", "duplicate"), found == "truncated"))
    numbers = {t for t, *_ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, audit = cheapest(turns)
    return {"gaps": gaps, **counts, "illegal": _illegal([t[0] for t in turns]), "cost": cost, "audit": audit}, edited([r[1:] for r in rows], audit)


def _conversations(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, the first ``keys`` columns of which are the group."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def _arrow(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _batched(rows: Iterator[tuple], kinds: pa.Schema, most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str))
        if size > most_chars:
            yield _arrow(held, kinds)
            held, size = [], 0
    if held:
        yield _arrow(held, kinds)


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _mapped(df: DataFrame, each, spec: str) -> DataFrame:
    """``df`` through ``each``, from record batches to tuples of ``spec``."""
    kinds = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in spec.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(each(batches), kinds)

    return df.mapInArrow(run, spec)


def _short_ones(rows: DataFrame) -> DataFrame:
    """Facts and repaired text of conversations that fit a task, from rows dealt by key and sorted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (key,), held in _conversations(batches, 1):
            facts, turns = repair([r[1:] for r in held if r[0]])
            yield (key, *facts.values(), hashlib.sha256(spelt(turns).encode("utf-8", "surrogatepass")).hexdigest())

    dealt = rows.select("conv_id", "there", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return _mapped(dealt, each, f"conv_id bigint, {FACTS}, repaired_sha256 string")


#: Pairs of states at the borders of a piece between which edits exist: system and nothing are never come back to.
PAIRS = tuple((i, j) for i in range(4) for j in range(4) if not (j == NOTHING and i != NOTHING) and not (j == SYSTEM and i > SYSTEM))
Option = tuple[int, str, list[int]]


def combined(parts: list[dict[tuple[int, int], Option]]) -> dict[tuple[int, int], Option]:
    """Cheapest, then least options over consecutive pieces: cost, audit, and the states at the inner borders."""
    out = parts[0]
    for part in parts[1:]:
        best: dict[tuple[int, int], Option] = {}
        for (i, k), (cost, audit, inner) in out.items():
            for j in range(4):
                if (k, j) in part:
                    more = part[k, j]
                    option = (cost + more[0], audit + more[1], [*inner, k, *more[2]])
                    if (i, j) not in best or option[:2] < best[i, j][:2]:
                        best[i, j] = option
        out = best
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, role, text``: each row's place in its conversation, sorted over all tasks; equal rows may be dealt apart."""
    kinds = "conv_id bigint, task int, place bigint, turn bigint, role string, text string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, key, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = place + 1 if (conv,) == key else 0
                key = (conv,)
                yield conv, task, place, turn, role, text

    salted = written(rows.select("conv_id", "turn", "role", "text", F.rand(7).alias("salt")), "long-turns")
    order = ["conv_id", "turn", "role", "text", "salt"]
    dealt = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    placed = written(_mapped(dealt, each, kinds), "placed-turns")
    sizes = placed.groupBy("conv_id", "task").agg(F.count("*").alias("size"))  # a row per long conversation and task that holds a part of it
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first")), "task-starts")
    met = placed.join(checked(starts), placed["conv_id"].eqNullSafe(F.col("c")) & (F.col("task") == F.col("k")))
    return met.select("conv_id", (F.col("first") + F.col("place")).alias("pos"), "turn", "role", "text")


def _long_ones(rows: DataFrame, piece_rows: int) -> DataFrame:
    """As :func:`_short_ones` for conversations of any length, cut into pieces."""
    turns = written(_numbered(rows.where("there")), "numbered-turns")
    piece = F.floor(F.col("pos") / piece_rows).cast("bigint")
    firsts = turns.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("pos").alias("p")).select(F.col("conv_id").alias("c"), "p", F.lit(True).alias("new"))
    marked = turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    marked = written(marked.select("conv_id", piece.alias("piece"), "pos", "turn", "role", "text", F.col("new").isNull().alias("seen")), "marked-turns")
    dealt = marked.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "pos")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A row per piece and pair of border states."""
        for key, held in _conversations(batches, 2):
            found = [fault(role, text, seen) for _, _, role, text, seen in held]
            lattice = [(h[2][:1], f in ("blank", "duplicate"), f == "truncated") for h, f in zip(held, found, strict=True)]
            initials = [t[0] for t in lattice]
            facts = [*map(found.count, ("blank", "duplicate", "truncated")), _illegal(initials), initials[0], initials[-1]]
            for i, j in PAIRS:
                option = cheapest(lattice, i, (j,))
                if option:
                    yield (*key, i, j, *facts, *option)

    counts = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string"
    pieces = written(_mapped(dealt, judge, f"conv_id bigint, piece bigint, i int, j int, {counts}, cost bigint, audit string"), "pieces")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A row per group of pieces and pair of border states."""
        for key, held in _conversations(batches, 2):
            parts: dict[int, dict] = {}
            facts: dict[int, tuple] = {}
            for at, i, j, *rest, cost, audit, inner in held:
                parts.setdefault(at, {})[i, j] = (cost, audit, inner)
                facts[at] = tuple(rest)
            ordered = [facts[at] for at in sorted(facts)]
            sums = [sum(f[k] for f in ordered) for k in range(4)]
            sums[3] += sum(_illegal([a[5], b[4]]) for a, b in zip(ordered, ordered[1:], strict=False))
            for (i, j), option in combined([parts[at] for at in sorted(parts)]).items():
                yield (*key, i, j, *sums, ordered[0][4], ordered[-1][5], *option)

    level = pieces.withColumn("inner", F.array().cast("array<int>"))
    most = pieces.agg(F.coalesce(F.max("piece"), F.lit(0))).first()[0]
    while True:
        up = level.withColumn("at", F.col("piece")).withColumn("piece", F.floor(F.col("piece") / 256).cast("bigint"))
        up = up.select("conv_id", "piece", "at", "i", "j", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cost", "audit", "inner")
        level = written(_mapped(up.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at"), join_up, f"conv_id bigint, piece bigint, i int, j int, {counts}, cost bigint, audit string, inner array<int>"), "joined-pieces")
        most //= 256
        if not most:
            break
    ended = level.where(f"i = {NOTHING} and j in ({NOTHING}, {ASSISTANT})")
    whole = ended.groupBy("conv_id").agg(F.min_by(F.struct("j", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "inner"), F.struct("cost", "audit")).alias("w")).select("conv_id", "w.*")
    states = F.concat(F.array(F.lit(NOTHING)), "inner", F.array("j"))
    route = whole.select("conv_id", F.posexplode(F.transform(F.slice(states, 1, F.size(states) - 1), lambda s, k: F.struct(s.alias("i"), F.get(states, k + 1).alias("j")))).alias("piece", "s")).select("conv_id", F.col("piece").cast("bigint").alias("piece"), "s.*")
    same = [pieces["conv_id"].eqNullSafe(route["conv_id"]), *(pieces[c] == route[c] for c in ("piece", "i", "j"))]
    chosen = pieces.join(route, same[0] & same[1] & same[2] & same[3]).select(pieces["conv_id"], pieces["piece"], F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), pieces["i"])
    both = chosen.unionByName(marked.select("conv_id", "piece", "pos", "role", "text", F.lit(0).alias("i")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, held in _conversations(batches, 2):
            turns = edited([h[1:3] for h in held[1:]], held[0][2], held[0][3])
            if turns:
                yield (*key, spelt(turns))

    texts = written(_mapped(both.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "pos"), apply, "conv_id bigint, piece bigint, text string"), "repaired-pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Hashes of pieces in order, held one at a time."""
        key = state = None
        for batch in batches:
            for conv, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or (conv,) != key:
                    if state is not None:
                        yield key[0], state.hexdigest()
                    key, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.encode("utf-8", "surrogatepass"))
        if state is not None:
            yield key[0], state.hexdigest()

    hashed = _mapped(texts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "text"), digest, "c bigint, repaired_sha256 string")
    numbers = turns.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("t")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = whole.join(numbers, F.col("conv_id").eqNullSafe(F.col("t")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired(turns: DataFrame, there: Column | None = None, piece_rows: int = 2000) -> DataFrame:
    """A row per ``conv_id`` of ``turns`` (conv_id, turn, role, text): faults, gaps, cost, audit and the hash of the repaired text.

    Where ``there`` is given and false, a row stands for its conversation's key
    only. Cases as of the module.
    """
    small_batches(turns)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(there, F.lit(False)).alias("there") if there is not None else F.lit(True).alias("there"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > piece_rows)
    long = written(sizes.select(F.col("conv_id").alias("c")), "long-conversations")
    if long.first() is None:
        return _short_ones(rows)
    is_long = F.col("conv_id").eqNullSafe(F.col("c"))
    some = rows.join(checked(long), is_long, "left_semi")
    least = _short_ones(rows.join(checked(long), is_long, "left_anti").unionByName(some.where("not there").select("conv_id", "there", F.lit(None).cast("bigint").alias("turn"), F.lit(" ").alias("role"), F.lit(" ").alias("text")).distinct()))
    found = _long_ones(some, piece_rows)
    return least.join(found.select(F.col("conv_id").alias("c")), is_long, "left_anti").unionByName(found)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with ``there``, damaged by the contract's rules; a dropped row stays with ``there`` false."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), rule.alias("rule"))
    bare = F.regexp_replace("text", "[.!?]", "")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, bare).otherwise(F.col("text")).alias("text"),
        (F.col("rule") != 0).alias("there"),
        F.explode(F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after damage; one without rows after it has zeros, an empty audit and the hash of nothing."""
    return repaired(damaged(table(spark, sf_dir, "conversations")), F.col("there"))
