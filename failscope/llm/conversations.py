"""Conversation repair: the cheapest edits that make the roles alternate, as one integer minimum.

A conversation is right if its role initials read ``(s?(ua)+)?``. Rows are kept (0), given
another role (2) or deleted (3, a must for blank and repeated rows); empty turns are put in
anywhere (2); a row left cut off costs 1 more. Among the cheapest edits the ASCII-least list of
their initials (D, I, K, R) wins.

*Weights*: a path's weight is one integer. Its high digits are the cost; below them is a field
of fixed width with one octal digit per letter, the first letter highest, and zeros behind the
last letter. So the smaller integer is the cheaper path and, at equal cost, the smaller word;
the search is nothing but the minimum over a DAG of (rows done, state of the pattern). A letter's
place is its node's own length. This is sound because insertions are written with the row that
follows them: no word up to a node is the beginning of another one there of equal cost, so what
is decided stays decided whatever follows.

*Long conversations*: rows are range-sorted by (conv_id, turn, role, text), so tasks get equal
shares however long a conversation is, and each task reads a stream. A conversation that fits
one block (``BLOCK_ROWS`` rows, ``BLOCK_BYTES`` bytes) inside a task is done there. Others come
out as blocks. Repeats are found by a grouping over digests; a block's weights for all pairs of
states at its ends depend on nothing else. Blocks of a task's stretch are chained by the same
integer minimum (cost, then the rank of each block's word as a digit), then the stretches of a
conversation. The states chosen go back to the blocks, which are written out and hashed in
order as a stream: SHA-256 of a conversation is one chain by its definition, but holds no more
than a block at a time.

Cases: a null role or text reads as one space, and so does a null conv_id or turn in the hash
that damages. Rows of one turn are ordered by role, then text. A null turn comes first; a null
conv_id is a conversation like any other. Roles count by their first letter, as written. A
conversation without rows after damage is returned with zeros and empty strings. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK_ROWS = 256
BLOCK_BYTES = 4_000_000
BATCH_ROWS = 1_000
CACHED = 50_000
WHITE = " \t\n\x0b\x0c\r"
SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + "".join(f"{c} long, " for c in SUMS) + "audit string, repaired_sha256 string"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: State after a role initial; pairs that are not here are not allowed.
STEP = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
LETTERS = "DIKR"  # in ASCII order; digit 0 is the padding
MOST_INSERTED = 2
WIDEST = MOST_INSERTED + 1


def wanted(state: int) -> str:
    """Initial that may follow a state, other than a first ``s``."""
    return "a" if state == USER else "u"


def word(letters: str) -> int:
    """Octal digits of some letters."""
    value = 0
    for c in letters:
        value = value * 8 + LETTERS.index(c) + 1
    return value


def edits(kind: str) -> list[list[tuple[int, int, int, int]]]:
    """For each state, the (state, cost, digits, letters) that one row can lead to.

    ``kind`` is the row's initial (x: none of s, u, a), upper case if it is cut off, or d if it
    has to go; empty for the end of the conversation, where only insertions are left.
    """
    out = []
    for state in STATES:
        found = []
        for n in range(MOST_INSERTED + 1):
            q = state
            for _ in range(n):
                q = STEP[q, wanted(q)]
            if not kind:
                if q in (START, ASSISTANT):
                    found.append((q, n * INSERT, "I" * n))
                continue
            found.append((q, n * INSERT + DELETE, "I" * n + "D"))
            if kind != "d":
                left = n * INSERT + (TRUNCATED if kind.isupper() else 0)
                if (q, kind.lower()) in STEP:
                    found.append((STEP[q, kind.lower()], left + KEEP, "I" * n + "K"))
                found.append((STEP[q, wanted(q)], left + REROLE, "I" * n + "R"))
        out.append([(q, cost, word(w), len(w)) for q, cost, w in found])
    return out


EDITS = {kind: edits(kind) for kind in ["", *"suaxSUAXd"]}


def cheapest(kinds: str, state: int, end: bool) -> dict[int, tuple[int, str]]:
    """{last state: (cost, letters)} of the least paths through rows of these kinds."""
    width = 3 * WIDEST * (len(kinds) + 1)
    best = {state: (0, width)}  # weight, and how far up the field its next letter goes
    for kind in [*kinds, ""] if end else kinds:
        then: dict[int, tuple[int, int]] = {}
        for q, (weight, top) in best.items():
            for q2, cost, digits, n in EDITS[kind][q]:
                place = top - 3 * n
                new = weight + (cost << width) + (digits << place)
                if q2 not in then or new < then[q2][0]:
                    then[q2] = new, place
        best = then
    field = (1 << width) - 1
    out = {}
    for q, (weight, _) in best.items():
        digits = format(weight & field, "o").zfill(width // 3).rstrip("0")
        out[q] = weight >> width, digits.translate({ord("1") + i: c for i, c in enumerate(LETTERS)})
    return out


@functools.lru_cache(maxsize=CACHED)
def whole(kinds: str) -> tuple[int, str]:
    """(cost, letters) of a whole conversation."""
    return min(cheapest(kinds, START, True).values())


def kind_of(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == "truncated" else initial


def fault_of(text: str, repeated: bool) -> str:
    bare = text.rstrip(WHITE)
    if not bare:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def repaired(rows: list[tuple[str, str]], letters: str, state: int) -> list[str]:
    """``role:text`` lines after the edits. Letters and roles leave no choice between u and a."""
    names = {"u": "user", "a": "assistant"}
    out, left = [], iter(rows)
    for c in letters:
        if c == "I":
            out.append(names[wanted(state)] + ":")
            state = STEP[state, wanted(state)]
            continue
        role, text = next(left)
        if c == "K":
            out.append(f"{role}:{text}")
            state = STEP[state, role[0]]
        elif c == "R":
            out.append(f"{names[wanted(state)]}:{text}")
            state = STEP[state, wanted(state)]
    return out


class Tally:
    """Sums over a conversation's rows in order, and the hash of what is repaired."""

    def __init__(self):
        self.n = dict.fromkeys(SUMS, 0)
        self.letters: list[str] = []
        self.sha = hashlib.sha256()
        self.begun = False
        self.last_initial = self.low = self.high = None
        self.turns = 0

    def rows(self, turns: list, roles: list, faults: list) -> None:
        for turn, role, fault in zip(turns, roles, faults, strict=True):
            if fault:
                self.n[fault] += 1
            if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
                self.n["illegal"] += 1
            self.last_initial = role[:1]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.turns += 1

    def edits(self, cost: int, letters: str, lines: list[str]) -> None:
        self.n["cost"] += cost
        self.letters.append(letters)
        for line in lines:
            self.sha.update(("\n" if self.begun else "").encode() + line.encode())
            self.begun = True

    def result(self, conv_id) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv_id, gaps, *[self.n[c] for c in SUMS[1:]], "".join(self.letters), self.sha.hexdigest())


def repair_whole(conv_id, rows: list[tuple]) -> tuple:
    """Result of a conversation given as ordered (turn, role, text) rows."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    tally = Tally()
    tally.rows([r[0] for r in rows], [r[1] for r in rows], faults)
    cost, letters = whole("".join(kind_of(r[1], f) for r, f in zip(rows, faults, strict=True)))
    tally.edits(cost, letters, repaired([r[1:] for r in rows], letters, START))
    return tally.result(conv_id)


# --- blocks of long conversations -----------------------------------------------------------

def entries(kinds: str) -> list[tuple[int, str] | None]:
    """Cost and letters for each pair of states at a block's ends, None where there is no way."""
    out: list[tuple[int, str] | None] = []
    for q in STATES:
        found = cheapest(kinds, q, False)
        out += [found.get(q2) for q2 in STATES]
    return out


def ranks(values: list) -> list[int]:
    """1 for the smallest of the values that are there, equal ones alike; 0 for None."""
    order = {v: i + 1 for i, v in enumerate(sorted({v for v in values if v is not None}))}
    return [order.get(v, 0) for v in values]


DIGIT = 5  # bits of a rank, which is at most 16


def chain(costs: list[list[int]], places: list[list[int]]) -> tuple[list[int], list[int], list[str | None]]:
    """Costs, ranks and states on the way, for each pair of states at the ends of a row of blocks.

    ``costs`` (-1: no way) and ``places`` (ranks of words) have 16 values for each block. Words of
    a block are never one the beginning of another, so their ranks decide like the words.
    """
    width = DIGIT * len(costs)
    out_cost, out_word, out_way = [], [], []
    for q in STATES:
        best, backs = {q: 0}, []
        for i, (cost, place) in enumerate(zip(costs, places, strict=True)):
            then, back = {}, {}
            for a, weight in best.items():
                for b in STATES:
                    if cost[4 * a + b] >= 0:
                        new = weight + (cost[4 * a + b] << width) + (place[4 * a + b] << (width - DIGIT * (i + 1)))
                        if b not in then or new < then[b]:
                            then[b], back[b] = new, a
            best = then
            backs.append(back)
        for b in STATES:
            if b not in best:
                out_cost.append(-1), out_word.append(None), out_way.append(None)
                continue
            way = [b]
            for back in reversed(backs):
                way.append(back[way[-1]])
            out_cost.append(best[b] >> width)
            out_word.append(best[b] & ((1 << width) - 1))
            out_way.append("".join(map(str, reversed(way))))
    return out_cost, ranks(out_word), out_way


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after damage; a dropped row leaves its conv_id, with gone set."""
    named = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Sorted over all partitions. Short texts heads suffice to split a crowded turn."""
    head = F.substring("text", 1, 32)
    return rows.repartitionByRange("conv_id", "turn", "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")


BLOCK = "part int, seq long, rows array<struct<turn: bigint, role: string, text: string>>"


def pieces(block_rows: int, block_bytes: int):
    """Function for mapInArrow: finished conversations, and blocks of those that may go on elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["conv_id", *SUMS, "audit", "repaired_sha256", "part", "seq", "rows"]
        row_type = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
        types = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int32(), pa.int64(), row_type]
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal held
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names
            )
            out.clear()
            held = 0
            return made

        conv, rows, size, seq, first, open_ = None, [], 0, 0, True, False

        def block() -> None:
            nonlocal rows, size, seq, held
            packed = [{"turn": t, "role": r, "text": x} for t, r, x in rows]
            out.append((conv, *[None] * 8, part, seq, packed))
            held += size
            rows, size, seq = [], 0, seq + 1

        begun = False
        for piece in slices(batches, BATCH_ROWS):
            for conv_id, turn, role, text, gone in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if not begun or conv_id != conv:
                    if begun:
                        # The partition's first conversation may have begun in an earlier one.
                        if open_ or first:
                            block()
                        else:
                            out.append((*repair_whole(conv, rows), None, None, None))
                        first = False
                    conv, rows, size, seq, open_, begun = conv_id, [], 0, 0, False, True
                if gone:
                    continue
                if rows and (len(rows) >= block_rows or size + len(text) > block_bytes):
                    block()
                    open_ = True
                rows.append((turn, role, text))
                size += len(text)
                if held > block_bytes:
                    yield batch()
            if out:
                yield batch()
        if begun:
            block()  # and its last may go on in a later one
            yield batch()

    return run


def with_faults(blocks: DataFrame) -> DataFrame:
    """Blocks with ``repeats``, the places of rows that the conversation has seen before."""
    key = ["part", "seq", "i"]
    rows = blocks.select("conv_id", "part", "seq", F.posexplode("rows").alias("i", "row"))
    rows = cut(rows.select("conv_id", *key, F.sha2(F.concat_ws(":", "row.role", "row.text").cast("binary"), 256).alias("digest")), "digests")
    firsts = rows.groupBy("conv_id", "digest").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts.filter("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first"), "firsts")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    again = rows.join(firsts, same).filter(F.struct(*key) != F.col("first"))
    # A block has BLOCK_ROWS rows at most.
    again = again.groupBy(F.col("part").alias("_part"), F.col("seq").alias("_seq"), F.col("conv_id").alias("_conv")).agg(
        F.collect_list("i").alias("repeats")
    )
    return blocks.join(again, this_block("_"), "left").drop("_part", "_seq", "_conv")


def this_block(mark: str) -> Column:
    return (
        (F.col("part") == F.col(f"{mark}part")) & (F.col("seq") == F.col(f"{mark}seq"))
        & F.col("conv_id").eqNullSafe(F.col(f"{mark}conv"))
    )


def block_kinds(rows: list[dict], repeats: list[int] | None) -> tuple[list[str], str]:
    again = set(repeats or [])
    faults = [fault_of(r["text"], i in again) for i, r in enumerate(rows)]
    return faults, "".join(kind_of(r["role"], f) for r, f in zip(rows, faults, strict=True))


def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, seq, costs, places) of blocks that have rows."""
    for batch in slices(batches, 50):
        out = []
        for conv_id, part, seq, rows, repeats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = entries(block_kinds(rows, repeats)[1])
            out.append((conv_id, part, seq, [-1 if e is None else e[0] for e in found], ranks([e and e[1] for e in found])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
            names=["conv_id", "part", "seq", "costs", "places"],
        )


def chain_stretch(table: pa.Table) -> pa.Table:
    """The blocks of a conversation in one partition as one row, with the states on each way."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    costs, places, ways = chain([r["costs"] for r in rows], [r["places"] for r in rows])
    one = {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "seqs": [r["seq"] for r in rows],
           "costs": costs, "places": places, "ways": ways}
    return pa.Table.from_pylist([one], schema=pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int32()), ("seqs", pa.list_(pa.int64())),
        ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("ways", pa.list_(pa.string())),
    ]))


def choose(table: pa.Table) -> pa.Table:
    """(conv_id, part, pair): the states at the ends of each stretch on the least way of all."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    close = [cheapest("", q, True) for q in STATES]
    # The end is a block of its own whose ways all lead to the first state.
    last = [min(c.values()) for c in close]
    end_cost, end_word = [-1] * 16, [None] * 16
    for q in STATES:
        end_cost[4 * q], end_word[4 * q] = last[q]
    _, _, ways = chain([r["costs"] for r in rows] + [end_cost], [r["places"] for r in rows] + [ranks(end_word)])
    way = ways[4 * START + START]
    return pa.table({
        "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int32()),
        "pair": pa.array([4 * int(way[i]) + int(way[i + 1]) for i in range(len(rows))], pa.int32()),
    })


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results from all blocks in order: (conv_id, part, seq, rows, repeats, ends)."""
    schema = [pa.int64()] * 7 + [pa.string()] * 2
    names = ["conv_id", *SUMS, "audit", "repaired_sha256"]

    def closed(conv_id, tally, state):
        cost, letters = min(cheapest("", state, True).values())
        tally.edits(cost, letters, repaired([], letters, state))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(tally.result(conv_id), schema, strict=True)], names=names)

    conv, tally, state = None, None, START
    for batch in slices(batches, 50):
        for conv_id, _, _, rows, repeats, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tally is None or conv_id != conv:
                if tally is not None:
                    yield closed(conv, tally, state)
                conv, tally, state = conv_id, Tally(), START
            if not rows:
                continue
            faults, kinds = block_kinds(rows, repeats)
            tally.rows([r["turn"] for r in rows], [r["role"] for r in rows], faults)
            cost, letters = cheapest(kinds, int(ends[0]), False)[int(ends[1])]
            tally.edits(cost, letters, repaired([(r["role"], r["text"]) for r in rows], letters, int(ends[0])))
            state = int(ends[1])
    if tally is not None:
        yield closed(conv, tally, state)


def long_ones(blocks: DataFrame) -> DataFrame:
    """Results of the conversations that came out as blocks."""
    blocks = cut(with_faults(blocks), "blocks")
    weights = blocks.filter(F.size("rows") > 0).select("conv_id", "part", "seq", "rows", "repeats").mapInArrow(
        weigh, "conv_id long, part int, seq long, costs array<long>, places array<long>"
    )
    # A partition holds as many blocks as its size allows, and a conversation as many stretches as there are partitions.
    stretches = cut(weights.groupBy("conv_id", "part").applyInArrow(
        chain_stretch, "conv_id long, part int, seqs array<long>, costs array<long>, places array<long>, ways array<string>"
    ), "stretches")
    chosen = stretches.select("conv_id", "part", "costs", "places").groupBy("conv_id").applyInArrow(
        choose, "conv_id long, part int, pair int"
    ).toDF("_conv", "_part", "pair")
    way = F.get("ways", F.col("pair"))
    ends = F.transform("seqs", lambda seq, i: F.struct(seq.alias("_seq"), F.substr(way, i + 1, F.lit(2)).alias("ends")))
    same = (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    ends = stretches.join(chosen, same).select("_conv", "_part", F.explode(ends).alias("e")).select("_conv", "_part", "e.*")
    rows = blocks.join(ends, this_block("_"), "left").select("conv_id", "part", "seq", "rows", "repeats", "ends")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(finish, RESULT)


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conv_id: gaps, faults, cost, edits and the hash of the repaired conversation."""
    out = cut(ordered(damaged(conversations)).mapInArrow(pieces(block_rows, block_bytes), f"{RESULT}, {BLOCK}"), "conversations")
    whole_ones = out.filter("rows is null").select("conv_id", *SUMS, "audit", "repaired_sha256")
    return whole_ones.unionByName(long_ones(out.filter("rows is not null").select("conv_id", "part", "seq", "rows")))
