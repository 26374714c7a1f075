"""Conversation structure repair by Four-Russians block tables.

A repair deletes, reroles, keeps and inserts rows so that the initials of the roles read
``(s?(ua)+)?``. The cost of finishing from each state of that pattern is a short vector;
less its least entry, only a few dozen vectors exist. ``tables`` holds the vector before
every kind of row, and before every block of ``BLOCK`` rows, for each vector after it. A
conversation is read from its end by block lookups; then each block is expanded backward
from the vector that follows it and walked forward, the ASCII-least cheapest edit first.

Long conversations are split into pieces. A piece gives its whole map of vectors, which
compose whatever task they come from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut, runs, small

WORD = "[^\\x20\\x09-\\x0D]"
#: states of the pattern: nothing yet, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: where an initial leads
NEXT = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: where an inserted or reroled row leads, and its role
INSERTED = {START: (AFTER_U, "user"), AFTER_S: (AFTER_U, "user"), AFTER_U: (AFTER_A, "assistant"), AFTER_A: (AFTER_U, "user")}
DELETE, INSERT, KEEP, REROLE = 3, 2, 0, 2
#: kinds of rows: one that must go, then each initial (x: any other), as it is and truncated; the last stands for no row
MUST_GO, INITIALS, NO_ROW = 0, "suax", 9
SYMBOLS = 10
#: rows of a block
BLOCK = 4
#: rows of a piece: conversations beyond that are repaired in pieces
PIECE = 4096


def _closed(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs if rows may be inserted first."""
    out = list(costs)
    for _ in range(4):
        out = [min(c, INSERT + out[INSERTED[s][0]]) for s, c in enumerate(out)]
    return tuple(out)


def row_costs(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from before a row, insertions not counted, given those after it."""
    if symbol == NO_ROW:
        return after
    costs = [DELETE + c for c in after]
    if symbol != MUST_GO:
        initial, truncated = INITIALS[(symbol - 1) % 4], symbol > 4
        for s in range(4):
            to = NEXT[s].get(initial)
            if to is not None:
                costs[s] = min(costs[s], KEEP + truncated + after[to])
            costs[s] = min(costs[s], REROLE + truncated + after[INSERTED[s][0]])
    return tuple(costs)


END = _closed((0, 99, 99, 0))


@cache
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised vectors (the first is the end's), and for each and every symbol or block the vector before it and the cost to add."""
    vectors = [tuple(c - min(END) for c in END)]
    index, steps = {vectors[0]: 0}, []
    for v in vectors:  # grows while it is read
        row = []
        for symbol in range(SYMBOLS):
            before = v if symbol == NO_ROW else _closed(row_costs(symbol, v))
            least = min(before)
            normal = tuple(c - least for c in before)
            if normal not in index:
                index[normal] = len(vectors)
                vectors.append(normal)
            row.append((index[normal], least))
        steps.append(row)
    step = np.array(steps, np.int32)
    to, add = step[:, :, 0], step[:, :, 1]
    block_to, block_add = to, add
    for _ in range(BLOCK - 1):  # the new symbol stands before the block: it is the most significant digit
        longer = to[block_to].transpose(0, 2, 1)
        more = block_add[:, None, :] + add[block_to].transpose(0, 2, 1)
        block_to, block_add = longer.reshape(len(vectors), -1), more.reshape(len(vectors), -1)
    return vectors, to, add, block_to, block_add


def codes(symbols: np.ndarray) -> np.ndarray:
    """Block numbers of a row of symbols, the first block filled up in front."""
    padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NO_ROW, np.int64)
    if len(symbols):
        padded[-len(symbols):] = symbols
    return padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def piece_map(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector after a piece the one before it, and the cost to add."""
    vectors, _, _, block_to, block_add = tables()
    at, cost = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for code in codes(symbols)[::-1]:
        cost += block_add[at, code]
        at = block_to[at, code]
    return at, cost


@cache
def _walk(code: int, after: int, state: int) -> tuple[str, int]:
    """Edits of the rows of a block and the state behind it, by the ASCII-least cheapest choice."""
    vectors = tables()[0]
    block = [code // SYMBOLS**i % SYMBOLS for i in range(BLOCK - 1, -1, -1)]
    costs = [vectors[after]]
    for symbol in reversed(block):
        costs.insert(0, _closed(row_costs(symbol, costs[0])) if symbol != NO_ROW else costs[0])
    edits = []
    for i, symbol in enumerate(block):
        if symbol == NO_ROW:
            continue
        here, there = costs[i], costs[i + 1]
        truncated = symbol > 4
        while True:
            to = INSERTED[state][0]
            if DELETE + there[state] == here[state]:
                edits.append("D")
                break
            if INSERT + here[to] == here[state]:
                edits.append("I")
                state = to
                continue
            kept = NEXT[state].get(INITIALS[(symbol - 1) % 4])
            if kept is not None and truncated + there[kept] == here[state]:
                edits.append("K")
                state = kept
            else:
                edits.append("R")
                state = to
            break
    return "".join(edits), state


def _trace(symbols: np.ndarray, after: int, state: int) -> tuple[str, int]:
    """Edits of a piece whose following vector is known, from a state on, and the state behind it."""
    block_to = tables()[3]
    numbers = codes(symbols).tolist()
    vectors = [after]
    for code in reversed(numbers):
        vectors.append(int(block_to[vectors[-1], code]))
    vectors.pop()
    edits = []
    for code in numbers:
        made, state = _walk(code, vectors.pop(), state)
        edits.append(made)
    return "".join(edits), state


def _closing(state: int) -> str:
    """Insertions behind the last row."""
    edits = ""
    while state not in (START, AFTER_A):
        edits, state = edits + "I", INSERTED[state][0]
    return edits


def repaired_lines(edits: str, state: int, rows: Iterator[tuple[bytes, bytes]]) -> Iterator[bytes]:
    """``role:text`` of what a row of edits leaves."""
    for edit in edits:
        to, role = INSERTED[state]
        if edit == "I":
            state = to
            yield role.encode() + b":"
            continue
        own, text = next(rows)
        if edit == "K":
            state = NEXT[state][own[:1].decode()]
            yield own + b":" + text
        elif edit == "R":
            state = to
            yield role.encode() + b":" + text


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage of the test: by checksum of ``conv_id:turn``.

    Dropped rows stay with ``gone`` true, so that no conversation is lost.
    """
    blank = F.lit(" ")
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("hit"))
    hit = hit.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"),
    )
    return hit.drop("copy")


def _symbol(fault: Column) -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    return F.when(fault.isin("blank", "duplicate"), MUST_GO).otherwise(kind + F.when(fault == "truncated", 4).otherwise(0))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with fault, symbol and place, written in order.

    Order: conv_id, turn (nulls first), role, text. Ranges of rows, not conversations, go
    to a task, so one conversation may hold any share of the table. A row is a duplicate
    if its role and text come up earlier in the conversation; first places are found by a
    partial aggregate and only those of repeated rows are joined back.
    """
    rows = cut(rows.withColumn("digest", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).withColumn("at", F.monotonically_increasing_id()), "damaged")
    live = rows.where(~F.col("gone"))
    place = F.struct(F.coalesce(F.col("turn").isNotNull().cast("int"), F.lit(0)).alias("known"), "turn", "at")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    first = live.groupBy(conv.alias("conv"), "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = small(cut(first.select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), F.col("first.at").alias("_first")), "repeated"))
    joined = rows.join(first, (conv == F.col("_conv")) & (rows["digest"] == F.col("_digest")), "left")
    last = F.substring(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", ""), -1, 1)
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank")
        .when(F.col("_first").isNotNull() & (F.col("_first") != F.col("at")), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    judged = joined.select("conv_id", "turn", "role", "text", "gone", "at", F.when(~F.col("gone"), fault).alias("fault"))
    judged = judged.withColumn("symbol", F.coalesce(_symbol(F.coalesce("fault", F.lit(""))), F.lit(0)).cast("int"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "at"]
    ranged = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("place", F.monotonically_increasing_id()).drop("at"), "ordered")


_COUNTS = ["rows", "turns", "blank", "duplicate", "truncated", "illegal"]
PIECES = (
    "conv_id long, place long, last long, " + ", ".join(f"`{c}` long" for c in _COUNTS) + ", first_turn long, last_turn long, first_role binary, last_role binary, "
    "vectors array<int>, costs array<long>, cost long, audit string, repaired_sha256 string"
)
TOTALS = [*_COUNTS, "first_turn", "last_turn", "cost"]
LEGAL = {b"su", b"ua", b"au"}


def _summary(t: pa.Table) -> dict:
    """Counts and ends of the live rows of a piece."""
    turns = [x for x in t.column("turn").to_pylist() if x is not None]
    initials = [r[:1] for r in t.column("role").to_pylist()]
    faults = t.column("fault").to_pylist()
    return {
        "rows": t.num_rows, "turns": len(set(turns)), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_role": initials[0] if initials else None, "last_role": initials[-1] if initials else None,
    }


def _text_rows(t: pa.Table) -> Iterator[tuple[bytes, bytes]]:
    yield from zip(t.column("role").to_pylist(), t.column("text").to_pylist(), strict=True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations repaired, and the maps of pieces of those that may go on elsewhere.

    A conversation is whole if rows of others come right before and after it in the order
    of places, and if it is no longer than a piece.
    """
    kind = pa.schema([
        ("conv_id", pa.int64()), ("place", pa.int64()), ("last", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("first_turn", pa.int64()), ("last_turn", pa.int64()),
        ("first_role", pa.binary()), ("last_role", pa.binary()), ("vectors", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())),
        ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ])
    out: list[dict] = []
    held: list[pa.RecordBatch] = []
    size, opened, last, conv = 0, True, None, None

    def flush(whole: bool) -> None:
        nonlocal held, size
        if not size:
            return
        t = pa.Table.from_batches(held)
        live = t.filter(pa.compute.invert(t.column("gone")))
        symbols = live.column("symbol").to_numpy()
        row = {"conv_id": t.column("conv_id")[0].as_py(), "place": t.column("place")[0].as_py(), "last": t.column("place")[-1].as_py(), **_summary(live)}
        at, cost = piece_map(symbols)
        if whole:
            edits, state = _trace(symbols, 0, START)
            edits += _closing(state)
            digest = hashlib.sha256(b"\n".join(repaired_lines(edits, START, _text_rows(live))))
            row |= {"cost": int(tables()[0][at[0]][START] + cost[0]), "audit": edits, "repaired_sha256": digest.hexdigest()}
        else:
            row |= {"vectors": at.tolist(), "costs": cost.tolist()}
        out.append(row)
        held, size = [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        places = batch.column("place").to_numpy()
        names = batch.column("conv_id").to_pylist()
        start = 0
        for i in range(batch.num_rows):
            gap = last is not None and places[i] != last + 1
            if i and not gap and names[i] == conv and size + i - start < PIECE:
                last = places[i]
                continue
            changed = last is not None and names[i] != conv
            full = size + i - start >= PIECE and not changed and not gap
            if last is not None and (gap or changed or full):
                if i > start:
                    held.append(batch.slice(start, i - start))
                    size += i - start
                flush(whole=changed and not gap and not opened)
                start = i
                opened = gap or full
            last, conv = places[i], names[i]
        if batch.num_rows > start:
            held.append(batch.slice(start))
            size += batch.num_rows - start
        if len(out) >= 512:
            yield pa.RecordBatch.from_pylist(out, kind)
            out = []
    flush(whole=False)
    yield pa.RecordBatch.from_pylist(out, kind)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation from its last to its first: the vector after each, and the totals from it to the end."""
    conv, at, cost, following, total = object(), 0, 0, {}, {}
    kind = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("after", pa.int32()), *[(c, pa.int64()) for c in TOTALS]])
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if piece["conv_id"] != conv:
                conv, at, cost, following = piece["conv_id"], 0, 0, {}
                total = dict.fromkeys(_COUNTS, 0) | {"first_turn": None, "last_turn": None}
            row = {"conv_id": conv, "place": piece["place"], "after": at}
            cost, at = cost + piece["costs"][at], piece["vectors"][at]
            for c in _COUNTS:
                total[c] += piece[c]
            if piece["last_turn"] is not None:
                total["turns"] -= piece["last_turn"] == total["first_turn"]  # one turn in two pieces
                total["first_turn"] = piece["first_turn"]
                total["last_turn"] = piece["last_turn"] if total["last_turn"] is None else total["last_turn"]
            if piece["rows"]:
                total["illegal"] += bool(following) and piece["last_role"] + following["first_role"] not in LEGAL
                following = piece
            out.append(row | total | {"cost": cost + tables()[0][at][START]})
        yield pa.RecordBatch.from_pylist(out, kind)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of conversations in pieces: one piece and the digest's state are held at a time."""
    conv, state, audit, digest, lines = None, START, [], None, 0
    names = ["_conv", "audit", "repaired_sha256"]

    def closed() -> pa.RecordBatch:
        edits = _closing(state)
        feed(repaired_lines(edits, state, iter(())))
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join([*audit, edits])]), pa.array([digest.hexdigest()])], names=names)

    def feed(some: Iterator[bytes]) -> None:
        nonlocal lines
        for line in some:
            digest.update(b"\n" + line if lines else line)
            lines += 1

    for t in runs(batches, ["piece"]):
        name = t.column("conv_id")[0].as_py()
        if name != conv or digest is None:
            if digest is not None:
                yield closed()
            conv, state, audit, digest, lines = name, START, [], hashlib.sha256(), 0
        live = t.filter(pa.compute.invert(t.column("gone")))
        edits, end = _trace(live.column("symbol").to_numpy(), t.column("after")[0].as_py(), state)
        feed(repaired_lines(edits, state, _text_rows(live)))
        audit.append(edits)
        state = end
    if digest is not None:
        yield closed()


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, gone): faults, cheapest repair and its digest.

    Rows with ``gone`` are no part of a conversation but keep its row in the result; a
    conversation of such rows alone has zeros, an empty audit and the digest of nothing.
    conv_id null is a conversation as well. Null turns come first and take no part in
    gaps; rows of one turn are in order of role and text; equal rows are duplicates of
    their first. A role's initial is its first character, whatever the role (an empty one
    is legal beside nothing). Other columns are not read. An empty table gives no rows.

    Conversations inside one task are repaired there. Those that go on in another task,
    or are longer than ``PIECE`` rows, give maps by piece; these compose from the last to
    the first, a few dozen numbers for each piece. Only the digest of such a conversation
    reads its rows in one stream, as SHA-256 can't be split, one piece in memory at a time.
    """
    ordered = ordered_rows(rows)
    live = ordered.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "gone", "fault", "symbol", "place")
    pieces = cut(live.mapInArrow(_pieces, PIECES), "pieces")
    gap = F.when(F.col("last_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).cast("long").alias("gaps")
    result = ["conv_id", gap, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = pieces.where("audit is not null").select(*result)

    parts = pieces.where("audit is null").select("conv_id", "place", "vectors", "costs", *_COUNTS, "first_turn", "last_turn", "first_role", "last_role")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place"))
    after = cut(parts.mapInArrow(_composed, "conv_id long, place long, after int, " + ", ".join(f"`{c}` long" for c in TOTALS)), "after")
    totals = F.min_by(F.struct(*[F.col(f"`{c}`") for c in TOTALS]), "place").alias("t")
    ends = cut(after.groupBy("conv_id").agg(totals).select("conv_id", "t.*"), "ends")

    # a piece's place marks its first row; the rows up to the next mark belong to it
    marks = small(cut(after.select(F.col("place").alias("_place"), "after"), "marks"))
    ids = small(cut(ends.select(F.col("conv_id").alias("_conv")), "open"))
    mine = live.join(ids, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").join(marks, F.col("place") == F.col("_place"), "left")
    stream = mine.repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("_place", "turn", "fault")
    marked = stream.mapInArrow(_marked, "conv_id long, role binary, text binary, gone boolean, symbol int, piece long, after int")
    texts = marked.mapInArrow(_repaired, "_conv long, audit string, repaired_sha256 string")
    whole = ends.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*result)
    return done.unionByName(whole)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the first place of its piece and the vector after that piece."""
    piece, after = -1, -1
    for batch in batches:
        pieces, vectors = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int32)
        for i, (place, mark) in enumerate(zip(batch.column("place").to_pylist(), batch.column("after").to_pylist(), strict=True)):
            if mark is not None:
                piece, after = place, mark
            pieces[i], vectors[i] = piece, after
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("conv_id", "role", "text", "gone", "symbol")] + [pa.array(pieces), pa.array(vectors)],
            names=["conv_id", "role", "text", "gone", "symbol", "piece", "after"],
        )
