"""Repair of the turn structure of conversations with the cheapest edits, by a run-length program over min-plus matrices.

A conversation is well formed if its role initials are s?(ua)+ or nothing. Each message is a symbol: what role it has, whether its text
is cut off, or that it has to go (blank, or seen before). Going past a symbol, with insertions before it, is a 4 x 4 matrix of costs
between the states of that pattern. Equal symbols next to each other are one run; a run of n is passed with the matrix's cached powers of two, by the
binary digits of n. From the costs to the end that this gives the choices are unrolled forwards, the ASCII-least of the cheapest letter at
each step; as a letter tells the next state, this is the least audit.

Messages are range-sorted by conversation and turn into blocks. A conversation inside one block is solved there. One that goes over
several, however many, is solved in each block as a matrix: the matrices of its blocks give the costs to the end of each, these the state each is
left in from each state, and these the state each begins in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.sources.shared import materialize

# The costs of edits, and of a message that stays though its text is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
NEVER = 1 << 50
# States: nothing yet, after s, after u, after a; and those in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
#: The state after a message whose role fits; a user or assistant message fits each state in one way.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: The symbol of a message that has to go; others are an initial and whether the text is cut off.
GONE = ("", False)
#: Steps that are unrolled from one list of costs.
STRETCH = 64

Symbol = tuple[str, bool]
Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[p][r] + b[r][q] for r in STATES) for q in STATES) for p in STATES)


def before(matrix: Matrix, after: Costs) -> Costs:
    """The costs to the end before the matrix's symbols, from those after them."""
    return tuple(min(min(matrix[p][q] + after[q] for q in STATES), NEVER) for p in STATES)


IDENTITY: Matrix = tuple(tuple(0 if p == q else NEVER for q in STATES) for p in STATES)
ONE_INSERT: Matrix = tuple(tuple(0 if p == q else INSERT if NEXT[p] == q else NEVER for q in STATES) for p in STATES)
#: Two insertions lead to any state that more lead to.
INSERTS = product(ONE_INSERT, ONE_INSERT)
#: Any state can be completed, so no cost to the end is NEVER.
AT_END: Costs = before(INSERTS, tuple(0 if p in ENDS else NEVER for p in STATES))


def moves(symbol: Symbol, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a message, letters in order."""
    initial, cut_off = symbol
    yield "D", DELETE, state
    if symbol != GONE:
        if (state, initial) in STEP:
            yield "K", CUT_OFF * cut_off, STEP[state, initial]
        yield "R", REROLE + CUT_OFF * cut_off, NEXT[state]


@lru_cache(maxsize=None)
def power(symbol: Symbol, exponent: int) -> Matrix:
    """The matrix of 2^exponent messages with this symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        return product(half, half)
    own = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, after in moves(symbol, state):
            own[state][after] = min(own[state][after], cost)
    return product(INSERTS, tuple(map(tuple, own)))


def before_run(symbol: Symbol, count: int, after: Costs) -> Costs:
    for exponent in range(count.bit_length()):
        if count >> exponent & 1:
            after = before(power(symbol, exponent), after)
    return after


def run_matrix(symbol: Symbol, count: int) -> Matrix:
    out = IDENTITY
    for exponent in range(count.bit_length()):
        if count >> exponent & 1:
            out = product(out, power(symbol, exponent))
    return out


def collapsed(symbols: Iterable[tuple[Symbol, int]]) -> list[tuple[Symbol, int]]:
    """Runs of equal symbols."""
    runs: list[tuple[Symbol, int]] = []
    for symbol, count in symbols:
        if runs and runs[-1][0] == symbol:
            runs[-1] = (symbol, runs[-1][1] + count)
        elif count:
            runs.append((symbol, count))
    return runs


def unrolled_run(symbol: Symbol, count: int, state: int, after: Costs, out: list[str]) -> int:
    """Adds the letters of the cheapest edits of a run to out; the state it is left in. Long runs are halved, so few costs are held."""
    while count > STRETCH:
        half = 1 << (count.bit_length() - 1) - (count & (count - 1) == 0)
        state = unrolled_run(symbol, half, state, before_run(symbol, count - half, after), out)
        count -= half
    costs = [after]
    for _ in range(count):
        costs.append(before(power(symbol, 0), costs[-1]))
    for left in range(count, 0, -1):
        now, then = costs[left], costs[left - 1]
        while True:
            fits = {letter: step for letter, cost, step in moves(symbol, state) if cost + then[step] == now[state]}
            if "D" in fits:
                out.append("D")
                break
            if INSERT + now[NEXT[state]] == now[state]:
                out.append("I")
                state = NEXT[state]
                continue
            letter = min(fits)
            out.append(letter)
            state = fits[letter]
            break
    return state


def unrolled(runs: Sequence[tuple[Symbol, int]], state: int = START, after: Costs = AT_END, last: bool = True) -> tuple[str, int]:
    """(letters, state at the end) of the cheapest, ASCII-least edits; last: the conversation ends here, so its pattern is completed."""
    costs = [after]
    for symbol, count in reversed(runs):
        costs.append(before_run(symbol, count, costs[-1]))
    out: list[str] = []
    for (symbol, count), then in zip(runs, reversed(costs[:-1])):
        state = unrolled_run(symbol, count, state, then, out)
    while last and state not in ENDS:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def symbols_of(row: dict) -> list[tuple[Symbol, int]]:
    """The symbols of equal messages: at most the first one may stay."""
    if row["blank"] or not row["first"]:
        return [(GONE, row["n"])]
    initial = row["role"][:1]
    return [((initial if initial and initial in "sua" else "?", row["truncated"]), 1), (GONE, row["n"] - 1)]


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            yield dict(zip(names, values))


def _groups(batches, *keys: str) -> Iterator[list[dict]]:
    """Rows that follow each other with equal keys."""
    group: list[dict] = []
    for row in _rows(batches):
        if group and any(group[0][k] != row[k] for k in keys):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _batches(rows: Iterable[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pending), schema.types)], schema=schema)

    for row in rows:
        pending.append(row)
        if len(pending) >= at_once:
            yield batch()
            pending = []
    if pending:
        yield batch()


def _placed(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Each message with the digest of its text; null roles and texts are one space."""
    of = lambda column: F.coalesce(F.col(column), F.lit(" "))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), of(role).alias("role"), of(text).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_cut_off(text: Column) -> Column:
    """The last character that is no space is not one of . ! ?"""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


ORDER = ("conv_id", "turn", "role", "digest")
KEY_TYPES = [("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, digest, place, n, blank, first, truncated, edits, parts): one row per distinct message, with its edits.

    Messages are in the order of turn, nulls first, equal turns by role and then by the SHA-256 of the text; place rises in that order. n equal
    messages are one row, blank those without a character that is no space; first: none with the role and text comes before; truncated: the
    text does not end in one of . ! ? before spaces. edits are the letters of its n messages in order (Keep, Rerole, Delete), each after
    the Inserts before it, and after the last message of a conversation those that end it. parts say what the messages become: K stays, U and A
    stay as user or assistant, u and a are inserted ones without text. Together the edits cost least, and of those edits the
    letters of a conversation are ASCII-least.

    Null roles and texts are one space, and a role that is empty or begins with another letter cannot stay; null ids are one conversation; extra columns
    are left out; an empty table gives no rows. Texts are not moved, only their digests, and a conversation of any length is cut into blocks.
    """
    id_type = df.schema[conv_id].dataType.simpleString()
    arrow_id = pa.string() if id_type == "string" else pa.int64()
    if arrow_id == pa.int64():
        df, id_type = df.withColumn(conv_id, F.col(conv_id).cast("bigint")), "bigint"
    rows = _placed(df, conv_id, turn, role, text)
    facts = rows.select(*ORDER, is_blank(F.col("text")).alias("blank"), is_cut_off(F.col("text")).alias("truncated"))
    counted = facts.groupBy(*ORDER).agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    ordered = counted.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "messages")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    known = placed.join(firsts, "place", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    symbols = materialize(known.withColumn("block", F.shiftright("place", 33)), "message-symbols")

    spread = symbols.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select(F.col("conv_id").alias("_c"))
    plan = _plan(symbols.join(spread, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi"), id_type, arrow_id)
    plan = plan.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "ends", "begin", "last")
    joined = symbols.join(plan, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")
    schema = pa.schema(
        [("conv_id", arrow_id), *KEY_TYPES, ("place", pa.int64()), ("n", pa.int64()), ("blank", pa.bool_()), ("first", pa.bool_()), ("truncated", pa.bool_()), ("edits", pa.string()), ("parts", pa.string())]
    )

    def solved(batches):
        def rows():
            for group in _groups(batches, "conv_id", "block"):
                head = group[0]
                known_state = head["ends"] is not None
                begin, ends, last = (head["begin"], tuple(head["ends"]), head["last"]) if known_state else (START, AT_END, True)
                letters, _ = unrolled(collapsed(s for row in group for s in symbols_of(row)), begin, ends, last)
                for row, edits, parts in _dealt(group, letters, begin):
                    yield (row["conv_id"], row["turn"], row["role"], row["digest"], row["place"], row["n"], row["blank"], row["first"], row["truncated"], edits, parts)

        yield from _batches(rows(), schema)

    return joined.repartition("block").sortWithinPartitions("block", "place").mapInArrow(
        solved, f"conv_id {id_type}, turn bigint, role string, digest binary, place bigint, n bigint, blank boolean, first boolean, truncated boolean, edits string, parts string"
    )


def _dealt(group: list[dict], letters: str, state: int) -> Iterator[tuple[dict, str, str]]:
    """Each row with its letters and what its messages become."""
    at = 0
    for number, row in enumerate(group):
        begin, parts, left = at, [], row["n"]
        while left or number + 1 == len(group) and at < len(letters):
            letter = letters[at]
            at += 1
            if letter != "I":
                left -= 1
            if letter == "K":
                state = STEP[state, row["role"][0]]
                parts.append("K")
            elif letter != "D":
                state = NEXT[state]
                name = NAME[state][0]
                parts.append(name if letter == "I" else name.upper())
        yield row, letters[begin:at], "".join(parts)


def _plan(symbols: DataFrame, id_type: str, arrow_id: pa.DataType) -> DataFrame:
    """(conv_id, block, ends, begin, last) for conversations in several blocks: costs to the end after each block, and the state before it."""
    key = [("conv_id", arrow_id), ("block", pa.int64())]
    keys = f"conv_id {id_type}, block bigint"

    def matrices(batches):
        def rows():
            for group in _groups(batches, "conv_id", "block"):
                whole = IDENTITY
                for symbol, count in collapsed(s for row in group for s in symbols_of(row)):
                    whole = product(whole, run_matrix(symbol, count))
                yield group[0]["conv_id"], group[0]["block"], [cost for line in whole for cost in line]

        yield from _batches(rows(), pa.schema([*key, ("matrix", pa.list_(pa.int64()))]))

    def to_the_end(batches):
        def rows():
            for group in _groups(batches, "conv_id"):
                costs = AT_END
                for number, row in enumerate(reversed(group)):
                    yield row["conv_id"], row["block"], list(costs), number == 0
                    flat = row["matrix"]
                    costs = before(tuple(tuple(flat[4 * p : 4 * p + 4]) for p in STATES), costs)

        yield from _batches(rows(), pa.schema([*key, ("ends", pa.list_(pa.int64())), ("last", pa.bool_())]))

    def left_in(batches):
        def rows():
            for group in _groups(batches, "conv_id", "block"):
                runs, ends = collapsed(s for row in group for s in symbols_of(row)), tuple(group[0]["ends"])
                after = [unrolled(runs, state, ends, False)[1] for state in STATES]
                yield group[0]["conv_id"], group[0]["block"], list(ends), after, group[0]["last"]

        yield from _batches(rows(), pa.schema([*key, ("ends", pa.list_(pa.int64())), ("after", pa.list_(pa.int32())), ("last", pa.bool_())]))

    def begun(batches):
        def rows():
            for group in _groups(batches, "conv_id"):
                state = START
                for row in group:
                    yield row["conv_id"], row["block"], row["ends"], state, row["last"]
                    state = row["after"][state]

        yield from _batches(rows(), pa.schema([*key, ("ends", pa.list_(pa.int64())), ("begin", pa.int32()), ("last", pa.bool_())]))

    # One row per block of a conversation meets its others: as many as the range sort has made blocks at most.
    ordered = symbols.repartition("block").sortWithinPartitions("block", "place")
    matrix = ordered.mapInArrow(matrices, f"{keys}, matrix array<bigint>")
    ends = matrix.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(to_the_end, f"{keys}, ends array<bigint>, last boolean")
    ends = ends.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "ends", "last")
    met = symbols.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    after = met.repartition("block").sortWithinPartitions("block", "place").mapInArrow(left_in, f"{keys}, ends array<bigint>, after array<int>, last boolean")
    return after.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(begun, f"{keys}, ends array<bigint>, begin int, last boolean")


def repaired_messages(df: DataFrame, edits: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, position, role, text) of the repaired conversations; place and position order them. df: what repair was given."""
    texts = _placed(df, conv_id, turn, role, text).dropDuplicates(list(ORDER))
    same = F.lit(True)
    for column in ORDER:
        same = same & F.col(f"t.{column}").eqNullSafe(F.col(f"e.{column}"))
    parts = edits.where(F.length("parts") > 0).alias("e").join(texts.alias("t"), same)
    listed = parts.select("e.conv_id", "e.place", "e.role", "t.text", F.posexplode(F.split("e.parts", "")).alias("position", "part"))
    name = F.when(F.col("part") == "K", F.col("role")).when(F.lower("part") == "u", "user").otherwise("assistant")
    own = F.when(F.col("part").isin("u", "a"), "").otherwise(F.col("text"))
    return listed.where(F.col("part") != "").select("conv_id", "place", "position", name.alias("role"), own.alias("text"))


def summary(df: DataFrame, edits: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation. df: what repair was given.

    The digest is that of all role:text lines in order, so the messages of a conversation pass one task in order, a batch at a time; texts are
    moved once, to follow their edits. gaps: turns between the least and the greatest that are missing, 0 without turns.
    """
    id_type, arrow_id = ("string", pa.string()) if edits.schema["conv_id"].dataType.typeName() == "string" else ("bigint", pa.int64())
    texts = _placed(df, conv_id, turn, role, text).withColumn("conv_id", F.col("conv_id").cast(id_type))
    none = F.lit(None)
    facts = edits.select(*ORDER, F.lit(0).alias("kind"), none.cast("string").alias("text"), "n", "blank", "first", "truncated", "edits", "parts")
    bodies = texts.where(~is_blank(F.col("text"))).select(
        *ORDER, F.lit(1).alias("kind"), "text", none.cast("bigint").alias("n"), *[none.cast("boolean").alias(c) for c in ("blank", "first", "truncated")], *[none.cast("string").alias(c) for c in ("edits", "parts")]
    )
    schema = pa.schema([("conv_id", arrow_id), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def told(batches):
        def rows():
            current = None
            for row in _rows(batches):
                if current is None or row["conv_id"] != current.conv_id:
                    if current is not None:
                        yield current.result()
                    current = _Conversation(row["conv_id"])
                current.take(row)
            if current is not None:
                yield current.result()

        yield from _batches(rows(), schema)

    stream = facts.unionByName(bodies).repartition("conv_id").sortWithinPartitions(*ORDER, "kind")
    return stream.mapInArrow(told, f"conv_id {id_type}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """Counts, letters and digest of a conversation whose messages come in order, each one's edits before its text."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial: str | None = None
        self.letters: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False
        self.open: dict | None = None

    def take(self, row: dict) -> None:
        if row["kind"] == 0:
            self._close(None)
            self._count(row)
            self.open = row
        elif self.open is not None:
            # Further copies of a text find nothing open.
            self._close(row["text"])

    def _count(self, row: dict) -> None:
        turn, n, initial = row["turn"], row["n"], row["role"][:1]
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1
        stays = not row["blank"] and row["first"]
        self.blank += n if row["blank"] else 0
        self.duplicate += 0 if row["blank"] else n - row["first"]
        self.truncated += bool(stays and row["truncated"])
        self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + n - 1
        self.initial = initial
        kept = "K" in row["edits"] or "R" in row["edits"]
        self.cost += sum(row["edits"].count(letter) * cost for letter, cost in (("D", DELETE), ("I", INSERT), ("R", REROLE)))
        self.cost += CUT_OFF * bool(kept and row["truncated"])
        self.letters.append(row["edits"])

    def _close(self, text: str | None) -> None:
        """Adds what the open message becomes."""
        if self.open is None:
            return
        for part in self.open["parts"]:
            name = self.open["role"] if part == "K" else {"u": "user", "a": "assistant"}[part.lower()]
            line = f"{name}:{'' if part in 'ua' else text}"
            self.digest.update(("\n" * self.begun + line).encode("utf-8", "surrogatepass"))
            self.begun = True
        self.open = None

    def result(self) -> tuple:
        self._close(None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by the remainder of crc32 of conv_id:turn and 20.

    0 drops a message, 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes its role user. Nulls are one space there and in role and text.
    """
    of = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(of(conv_id), F.lit(":"), of(turn)).cast("binary")) % 20
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), of(role).alias("role"), of(text).alias("text"), h.alias("h")).where("h <> 0")
    body = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    named = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), "h")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))
    return named.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")
