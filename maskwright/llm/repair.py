"""Repair of conversation structure by a dynamic program over whole batches of conversations.

A well-formed conversation is empty, or has pairs of user and assistant turns, perhaps
after one system turn. Four states say what was read last: nothing, system, user or
assistant. A turn can be kept (0), given the role that fits (3) or deleted (4); an empty
user or assistant turn can be inserted anywhere (3). Blank turns and repeats of an
earlier turn must go; a truncated turn that stays adds 3.

Rows are ordered by (conversation, turn) over range partitions, equal rows counted as one
beforehand, so that a conversation of any length is dealt over partitions: a piece is
what one partition has of one conversation. Pieces of a batch are bucketed by length and
solved together in NumPy tensors, time first: a step goes one turn back and updates the
costs of all states of all pieces, which are kept; a trace goes forward along them, also
for all pieces at once. A piece alone gives the cost from each state before it to each
state after it. Where a conversation has several pieces, these matrices, 16 numbers for
each partition it reaches into, say what each piece's end costs, and the traces from all
four states say in which state each piece begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of a range partition.
PART_ROWS = 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = ("user", "assistant")
INF = 1 << 60
#: State after the turn that fits: nothing, system and assistant are followed by user, user by assistant.
FITS = np.array([2, 2, 3, 2])
#: State after keeping a turn of initial s, u, a or another one; 4 where that is illegal.
KEPT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
#: What is left to pay in each state at the conversation's end, inserts included.
END = np.array([0, 2 * INSERT, INSERT, 0])
MUST_GO, WHOLE, CUT, PAD = 0, 1, 2, 3

_WHITE = " \t\n\x0b\f\r"


def ordered(messages: DataFrame) -> DataFrame:
    """Distinct rows in order: conv_id, turn, role, text, n, fault, code, part, i.

    ``n`` says how often a row stands there, ``fault`` what is wrong with its first copy
    (blank, duplicate, truncated or empty); further copies are duplicates, unless blank.
    """
    rows = messages.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min(at).alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.col("first").isNotNull() & ~at.eqNullSafe(F.col("first"))
    whole = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(again, "duplicate").when(~whole, "truncated").otherwise("")
    initial = F.expr("locate(left(role, 1), 'sua')") - 1
    rows = rows.select("conv_id", "turn", "role", "text", "n", "key", fault.alias("fault"), F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial).alias("initial"))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT).otherwise(WHOLE)
    parts = max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), messages.count() // PART_ROWS)
    order = ["conv_id", "turn", "key"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    i = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select("conv_id", "turn", "role", "text", "n", "fault", (F.col("initial") + 4 * kind).cast("tinyint").alias("code"), F.spark_partition_id().alias("part"), i.alias("i"))


def costs(code: np.ndarray, copies: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost to go, [time + 1, piece, state, end], from ``code`` and ``copies`` [time, piece] and ``ends`` [piece, state, end]."""
    steps, n = code.shape
    out = np.empty((steps + 1, *ends.shape), np.int64)
    out[steps], each = ends, np.arange(n)[:, None]
    for t in range(steps - 1, -1, -1):
        later, kind, more = out[t + 1], code[t] >> 2, DELETE * (copies[t] - 1)
        stay = (more + np.where(kind == CUT, TRUNCATED, 0) + np.where(kind == MUST_GO, INF, 0))[:, None, None]
        beyond = np.concatenate([later, np.full((n, 1, ends.shape[2]), INF)], 1)
        best = np.minimum(later[:, FITS] + REROLE, beyond[each, KEPT[:, code[t] & 3].T] + KEEP) + stay
        best = np.minimum(best, later + (more + DELETE)[:, None, None])
        best = np.where((kind == PAD)[:, None, None], later, best)
        user, assistant = best[:, 2].copy(), best[:, 3].copy()
        best[:, 2], best[:, 3] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
        best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + INSERT)
        out[t] = np.minimum(best, INF)
    return out


def traces(code: np.ndarray, copies: np.ndarray, togo: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits along the least costs, ties to the least initial: inserts before each turn, edit and state after it, [time, piece].

    ``togo`` is [time + 1, piece, state]. A deletion comes before an insertion, and that before what keeps a turn.
    """
    steps, n = code.shape
    before, edit, after, each = np.zeros((steps, n), np.int8), np.zeros((steps, n), "S1"), np.zeros((steps, n), np.int8), np.arange(n)
    for t in range(steps):
        now, later, kind, more = togo[t], togo[t + 1], code[t] >> 2, DELETE * (copies[t] - 1)
        gone = (kind == PAD) | (now[each, state] == later[each, state] + more + DELETE)
        puts = ~gone & (now[each, state] == now[each, FITS[state]] + INSERT)
        while puts.any():
            before[t] += puts
            state = np.where(puts, FITS[state], state)
            puts &= now[each, state] == now[each, FITS[state]] + INSERT
        kept = KEPT[state, code[t] & 3]
        stay = more + np.where(kind == CUT, TRUNCATED, 0)
        keeps = ~gone & (kept < 4) & (now[each, state] == later[each, np.minimum(kept, 3)] + stay + KEEP)
        edit[t] = np.where(kind == PAD, b"", np.where(gone, b"D", np.where(keeps, b"K", b"R")))
        state = np.where(gone, state, np.where(keeps, kept, FITS[state]))
        after[t] = state
    return before, edit, after


def _tensors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces bucketed by length: their rows in the batch, lengths, and code, copies and row number [time, piece], padded."""
    lists = batch.column(batch.schema.get_field_index("rows"))
    starts, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    i, code, copies = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    size = np.diff(starts)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for b in np.unique(bucket):
        rows = np.flatnonzero(bucket == b)
        steps = int(size[rows].max())
        for part in np.array_split(rows, max(1, len(rows) * steps // 200_000)):
            time = np.arange(steps)[:, None]
            there = time < size[part]
            at = np.minimum(starts[part] + time, len(code) - 1)
            yield part, size[part], np.where(there, code[at], PAD << 2), np.where(there, copies[at], 1).astype(np.int64), i[at]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's least costs from each state before it to each state after it."""
    unit = np.where(np.eye(4, dtype=bool), 0, INF)
    for batch in batches:
        out = np.zeros((batch.num_rows, 16), np.int64)
        for rows, _, code, copies, _ in _tensors(batch):
            out[rows] = costs(code, copies, np.broadcast_to(unit, (len(rows), 4, 4)))[0].reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), 16).cast(pa.list_(pa.int64()))], names=["conv_id", "part", "matrix"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each state after a piece costs up to the conversation's end; rows (conv_id, pieces: part, matrix), in order."""
    for batch in batches:
        who, part, ends, more = [], [], [], []
        for row, pieces in enumerate(batch.column(1).to_pylist()):
            left = END
            for p in reversed(pieces):
                who.append(row)
                part.append(p["part"])
                ends.append(left)
                more.append(len(pieces))
                own = np.array(p["matrix"]).reshape(4, 4)
                left = np.minimum((own + left).min(1), INF)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(part, pa.int32()), pa.array(ends, pa.list_(pa.int64())), pa.array(more, pa.int32())], names=["conv", "in_part", "ends", "pieces"])


def _traced(batch: pa.RecordBatch, entry: np.ndarray):
    """_tensors with the trace of each piece from its state in ``entry``."""
    ends = np.array(batch.column(batch.schema.get_field_index("ends")).to_pylist(), np.int64).reshape(-1, 4)
    for rows, size, code, copies, i in _tensors(batch):
        togo = costs(code, copies, ends[rows][:, :, None])[..., 0]
        yield rows, size, i, traces(code, copies, togo, entry[rows])


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a piece, for each state before it."""
    for batch in batches:
        out = np.zeros((batch.num_rows, 4), np.int32)
        for state in range(4):
            for rows, _, _, (_, _, after) in _traced(batch, np.full(batch.num_rows, state)):
                out[rows, state] = after[-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), 4).cast(pa.list_(pa.int32()))], names=["conv_id", "part", "route"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each piece; rows (conv_id, pieces: part, route), in order."""
    for batch in batches:
        who, part, entry = [], [], []
        for row, pieces in enumerate(batch.column(1).to_pylist()):
            state = 0
            for p in pieces:
                who.append(row)
                part.append(p["part"])
                entry.append(state)
                state = p["route"][state]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(part, pa.int32()), pa.array(entry, pa.int32())], names=["conv", "in_part", "entry"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each turn: inserts before it, its edit and the state after it; at a conversation's end also the inserts after it."""
    for batch in batches:
        last = np.array(batch.column(batch.schema.get_field_index("is_last")).to_pylist(), bool)
        part = batch.column(1).to_numpy()
        entry = batch.column(batch.schema.get_field_index("entry")).to_numpy()
        for rows, size, i, (before, edit, after) in _traced(batch, entry):
            there = np.arange(len(edit))[:, None] < size
            behind = np.zeros(there.shape, np.int8)
            behind[size - 1, np.arange(len(rows))] = np.where(last[rows], END[after[size - 1, np.arange(len(rows))]] // INSERT, 0)
            columns = [np.broadcast_to(part[rows], there.shape)[there], i[there], before[there], edit[there], after[there], behind[there]]
            kinds = [pa.int32(), pa.int64(), pa.int8(), pa.binary(), pa.int8(), pa.int8()]
            arrays = [pa.array(c.tolist() if k == pa.binary() else c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:3], arrays[3].cast(pa.string()), *arrays[4:]], names=["part", "i", "before", "edit", "after", "behind"])


def _on_piece(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on (conv_id, part); a null conversation is one like any other."""
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("in_part")), how).drop("conv", "in_part")


def repair(messages: DataFrame) -> DataFrame:
    """One row per edit: conv_id, part, place, edit, times, fault, turn, was, role, text.

    Rows in the order (part, place) whose edit is K (keep), R (rerole) or I (insert) are
    the repaired conversation, with ``role`` and ``text``; ``was`` is the role before. D
    rows have the role and text that went, ``times`` times. Of the cheapest repairs, the
    one whose edits' initials are least in ASCII order. Rows of one turn come in the order
    of the MD5 of their role and text.

    Null role or text counts as one space, a null turn comes first, and a null conv_id is
    a conversation. Repeated rows are duplicates. Very long texts count whole; a table
    without rows gives none. Columns but conv_id, turn, role and text play no part; a
    column ``copies`` of ``damaged`` says how often a row stands there.
    """
    spark = messages.sparkSession
    kind = messages.schema["conv_id"].dataType.simpleString()
    n = F.col("copies") if "copies" in messages.columns else F.lit(1)
    plain = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], n.cast("long").alias("n"))
    rows = stored(ordered(plain), "ordered")
    pieces = stored(rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("i", "code", "n"))).alias("rows")), "pieces")
    in_order = lambda df, what: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", what))).alias("pieces"))  # noqa: E731  as many as there are partitions at most
    matrices = pieces.mapInArrow(_matrices, f"conv_id {kind}, part int, matrix array<long>")
    ends = stored(in_order(matrices, "matrix").mapInArrow(_ends, f"conv {kind}, in_part int, ends array<long>, pieces int"), "ends")
    known = stored(_on_piece(pieces, ends), "known")
    routes = known.filter("pieces > 1").mapInArrow(_routes, f"conv_id {kind}, part int, route array<int>")
    entries = in_order(routes, "route").mapInArrow(_entries, f"conv {kind}, in_part int, entry int")
    tails = known.groupBy("conv_id").agg(F.max("part").alias("in_part")).select(F.col("conv_id").alias("conv"), "in_part", F.lit(True).alias("is_last"))
    full = _on_piece(_on_piece(known, entries, "left"), tails, "left").select("conv_id", "part", "rows", "ends", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
    edits = full.mapInArrow(_edits, "part int, i long, before tinyint, edit string, after tinyint, behind tinyint")
    return _edit_rows(rows.join(edits, ["part", "i"]))


def _edit_rows(rows: DataFrame) -> DataFrame:
    role = lambda state: F.when(state == 2, ROLES[0]).otherwise(ROLES[1])
    gone, after = F.col("edit") == "D", F.col("after")

    def one(place, edit: Column, times, fault, was, new, text) -> Column:
        return F.struct((F.col("i") * 8 + place).alias("place"), edit.alias("edit"), times.alias("times"), fault.alias("fault"), was.alias("was"), new.alias("role"), text.alias("text"))

    none, once, empty = F.lit(None).cast("string"), F.lit(1).cast("long"), F.lit("")
    # before a turn: the states that inserts pass through alternate and end where the turn finds its place
    found = F.when(F.col("role_kept") | (F.col("edit") == "R"), F.when(after == 2, 3).otherwise(2)).otherwise(after)
    puts = F.transform(F.sequence(F.lit(1), F.col("before").cast("int")), lambda k: one(k - 1, F.lit("I"), once, empty, none, role(F.when((F.col("before") - k) % 2 == 0, F.col("found")).otherwise(5 - F.col("found"))), empty))
    behind = F.transform(F.sequence(F.lit(1), F.col("behind").cast("int")), lambda k: one(F.lit(5) + k, F.lit("I"), once, empty, none, role(F.when((F.col("behind") - k) % 2 == 0, 3).otherwise(2)), empty))
    itself = one(F.lit(4), F.col("edit"), F.when(gone, F.when(F.col("fault").isin("blank", "duplicate"), F.col("n")).otherwise(1)).otherwise(1).cast("long"), F.col("fault"), F.col("role"), F.when(F.col("edit") == "R", role(after)).otherwise(F.col("role")), F.col("text"))
    copies = F.array(one(F.lit(5), F.lit("D"), F.col("n") - 1, F.lit("duplicate"), F.col("role"), F.col("role"), F.col("text")))
    nothing = F.slice(copies, 1, 0)
    rows = rows.withColumn("role_kept", F.col("edit") == "K").withColumn("found", found)
    each = F.concat(
        F.when(F.col("before") > 0, puts).otherwise(nothing), F.array(itself), F.when((F.col("n") > 1) & ~F.col("fault").isin("blank", "duplicate"), copies).otherwise(nothing), F.when(F.col("behind") > 0, behind).otherwise(nothing)
    )
    return rows.select("conv_id", "part", "turn", F.explode(each).alias("e")).select("conv_id", "part", "e.place", "e.edit", "e.times", "e.fault", "turn", "e.was", "e.role", "e.text")


class _Digest:
    """What the audit says of one conversation, from its edit rows in order."""

    def __init__(self) -> None:
        self.counts, self.illegal, self.cost = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.first = self.last = self.before = None
        self.turns, self.audit, self.hash, self.empty = 0, [], hashlib.sha256(), True

    def add(self, edit: str, times: int, fault: str, turn: int | None, was: str | None, role: str, text: str) -> None:
        self.audit.append(edit * times)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] * times
        if fault:
            self.counts[fault] += times
            self.cost += TRUNCATED * (fault == "truncated" and edit != "D")
        if was is not None:
            self.illegal += (self.before is not None and self.before + was[:1] not in ("su", "ua", "au")) + times - 1
            self.before = was[:1]
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if edit != "D":
            self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_DIGEST = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, conv, kind, out = None, None, pa.null(), []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]], names=["conv", *_DIGEST])

    for batch in batches:
        kind = batch.schema.field(0).type
        for key, *edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != conv:
                if now:
                    out.append((conv, *now.row()))
                now, conv = _Digest(), key
            now.add(*edit)
        yield flush()
        out.clear()
    if now:
        out.append((conv, *now.row()))
        yield flush()


def audits(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``'s result: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A hash of a whole conversation is a chain: its edits stream through one task in order,
    which keeps counts and the audit alone.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    rows = edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "edit", "times", "fault", "turn", "was", "role", "text")
    return rows.mapInArrow(_digests, f"conv {kind}, " + ", ".join(f"{c} {'long' if i < 6 else 'string'}" for i, c in enumerate(_DIGEST)))


def damaged(messages: DataFrame) -> DataFrame:
    """Messages with faults put in by a hash of (conv_id, turn), one kind in 20 each: dropped, emptied, without marks of sentences, repeated (``copies``), made the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    body = F.when(hit == 1, "").when(hit == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    return messages.filter(hit != 0).select("conv_id", "turn", F.when(hit == 4, "user").otherwise(text("role")).alias("role"), body.alias("text"), F.when(hit == 3, 2).otherwise(1).alias("copies"))


def damage_audit(messages: DataFrame) -> DataFrame:
    """The audit of ``messages`` after ``damaged``, for every conversation that they have, also where no row is left."""
    found = audits(repair(damaged(messages)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long") if c not in _DIGEST[6:] else F.lit("" if c == "audit" else hashlib.sha256().hexdigest())).alias(c)
    return messages.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *[zero(c) for c in _DIGEST])
