"""Conversation structure repair by a lightest-derivation agenda.

An item says: rows up to here, read from state ``p``, leave the automaton of the wanted role order in state ``q``. Edits derive items from items; a block of
rows and the rows before it derive together the rows up to the block's end. Items are popped by weight (cost, rows covered, audit) and a popped item is final:
every deduction makes the weight larger, because an edit either covers a row more or costs something, and it never changes the order of two weights of one item.

Rows of all conversations are sorted over the cluster by range, so that a conversation of any length is cut into blocks; only the few conversations that are cut
meet again, as block items without texts. Texts are shuffled once, with the found edits, to hash the repaired rows in order: SHA-256 reads them one after the
other, so a conversation's texts pass through one task as a stream, of which nothing is kept.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import cut

BLOCK = 256
SPACE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: nothing yet, after the system row, after a user row, after an assistant row. Wanted: (s?(ua)+)?
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTED = (0, 3)
LEGAL = {"su", "ua", "au"}

Weight = tuple[int, int, str]


def lightest(axioms: Iterable[tuple[Weight, Hashable]], deduce: Callable, goal: Hashable = None) -> dict[Hashable, Weight]:
    """Final items with their least weights; stops when ``goal`` is final. ``deduce(item, weight, final)`` yields what the item derives with final ones."""
    agenda, final = list(axioms), {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item == goal:
            break
        for new in deduce(item, weight, final):
            if new[1] not in final:
                heapq.heappush(agenda, new)
    return final


def _edits(codes: str):
    """Deductions over the rows of one block. A row's code: initial and fault in two characters (fault: ``.`` none, ``t`` truncated, ``x`` must go)."""
    n = len(codes) // 2

    def deduce(item, weight, final):
        if item == "goal":
            return
        p, i, q = item
        cost, covered, audit = weight
        for then in (STEP[q].get("u"), STEP[q].get("a")):
            if then is not None:
                yield (cost + INSERT, covered, audit + "I"), (p, i, then)
        if i == n:
            if q in ACCEPTED:
                yield (cost, covered + 1, audit), "goal"
            return
        initial, fault = codes[2 * i], codes[2 * i + 1]
        yield (cost + DELETE, covered + 1, audit + "D"), (p, i + 1, q)
        if fault == "x":
            return
        extra = TRUNCATED if fault == "t" else 0
        if initial in STEP[q]:
            yield (cost + KEEP + extra, covered + 1, audit + "K"), (p, i + 1, STEP[q][initial])
        for role in "ua":
            if role in STEP[q]:
                yield (cost + REROLE + extra, covered + 1, audit + "R"), (p, i + 1, STEP[q][role])

    return deduce


@lru_cache(maxsize=20_000)
def repaired(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of whole rows."""
    cost, _, audit = lightest([((0, 0, ""), (0, 0, 0))], _edits(codes), "goal")["goal"]
    return cost, audit


@lru_cache(maxsize=2_000)
def block_items(codes: str, starts: tuple[int, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """(p, q, cost, audit) of a block of rows, from each state in ``starts``."""
    n, out = len(codes) // 2, []
    for p in starts:
        for item, (cost, _, audit) in lightest([((0, 0, ""), (p, 0, p))], _edits(codes)).items():
            if item != "goal" and item[1] == n:
                out.append((p, item[2], cost, audit))
    return tuple(sorted(out))


def joined(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of consecutive blocks: the rows before a block and the block's item derive the rows up to its end."""

    def deduce(item, weight, final):
        if item == "goal":
            return
        k, q = item
        cost, covered, audit = weight
        if k == len(blocks):
            if q in ACCEPTED:
                yield (cost, covered + 1, audit), "goal"
            return
        for p, then, more, edits in blocks[k]:
            if p == q:
                yield (cost + more, covered + 1, audit + edits), (k + 1, then)

    cost, _, audit = lightest([((0, 0, ""), (0, 0))], deduce, "goal")["goal"]
    return cost, audit


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage, with what orders and judges them. Dropped rows stay as empty marks (``alive`` false), so that no conversation is lost."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    damage = F.crc32(F.encode(F.concat(conv, F.lit(":"), turn), "UTF-8")) % 20
    alive = F.explode(F.when(damage == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(damage != 0))).alias("alive")
    new_role = F.when(damage == 4, "user").when(damage == 0, "").otherwise(role)
    new_text = F.when(damage.isin(0, 1), "").when(damage == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), new_role.alias("role"), new_text.alias("text"), alive)
    who = [F.isnull("conv_id"), F.col("conv_id"), F.col("role")]
    return rows.withColumns({"head": F.substring("text", 1, 64), "k1": F.xxhash64(*who, F.col("text")), "k2": F.xxhash64(F.col("text"), *who, F.lit(2))})


def _order() -> list[Column]:
    """Rows of one turn are ordered by role and text, so that repeats stand side by side."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("k1"), F.col("k2")]


COUNTS = ("blank", "duplicate", "truncated", "illegal")
STATS = ("rows", "min_turn", "max_turn", "n_turns", "first_turn", "last_turn", "first_initial", "last_initial", *COUNTS)
LONGS = ("gaps", *COUNTS, "cost")


class _Piece:
    """Rows of one conversation as they come, in blocks."""

    def __init__(self, conv, seq: int, opens: bool, before: tuple | None = None):
        self.conv, self.seq, self.opens, self.before = conv, seq, opens, before
        self.codes: list[str] = []
        self.low = self.high = self.first = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial, blank, truncated, later, digest) -> None:
        old, fault = self.before, "."
        if blank:
            self.blank += 1
            fault = "x"
        elif later or (old and old[0] == turn and old[2] == digest):
            self.duplicate += 1
            fault = "x"
        elif truncated:
            self.truncated += 1
            fault = "t"
        if turn is not None:  # turns come in ascending order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.n_turns += not old or old[0] != turn
        self.illegal += bool(old) and old[1] + initial not in LEGAL
        self.before = (turn, initial, digest)
        self.first = self.first or self.before
        self.codes.append((initial if initial in ("s", "u", "a") else "?") + fault)

    def row(self, part: int, whole: bool) -> tuple:
        codes = "".join(self.codes)
        items = [(0, 0, *repaired(codes))] if whole else block_items(codes, (0,) if self.opens else (0, 1, 2, 3))
        ends = (self.first, self.before) if self.codes else ((None, None), (None, None))
        stats = (len(self.codes), self.low, self.high, self.n_turns, ends[0][0], ends[1][0], ends[0][1], ends[1][1], self.blank, self.duplicate, self.truncated, self.illegal)
        return self.conv, part, self.seq, whole, *stats, [dict(zip(("p", "q", "cost", "audit"), x, strict=True)) for x in items]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows; ``whole`` where a conversation began and ended inside the partition, in one block."""
    part, piece, out, met, schema = TaskContext.get().partitionId(), None, [], False, None
    item = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        if schema is None:
            kinds = [pa.string() if c.endswith("initial") else pa.int64() for c in STATS]
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *zip(STATS, kinds, strict=True), ("items", item)])
        for conv, turn, alive, initial, blank, truncated, later, *digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    out.append(piece.row(part, piece.opens))
                piece, met = _Piece(conv, 0, met), True  # a partition's first conversation may have begun in the one before
            if not alive:
                continue
            if len(piece.codes) == BLOCK:
                out.append(piece.row(part, False))
                piece = _Piece(conv, piece.seq + 1, False, piece.before)
            piece.add(turn, initial, blank, truncated, later, digest)
        if len(out) >= 2000:
            yield batch_of(out)
            out = []
    if piece is not None:
        yield batch_of([*out, piece.row(part, False)])


def _met(pieces: pa.Table) -> pa.Table:
    """One conversation's blocks, put together."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    cost, audit = joined([[(x["p"], x["q"], x["cost"], x["audit"]) for x in r["items"]] for r in rows])
    total = {c: sum(r[c] for r in rows) for c in ("n_turns", *COUNTS)}
    seen = [r for r in rows if r["rows"]]
    for a, b in zip(seen, seen[1:], strict=False):
        if a["part"] != b["part"]:  # inside a partition the rows before a block were known
            total["n_turns"] -= b["first_turn"] is not None and a["last_turn"] == b["first_turn"]
            total["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    turns = [t for r in seen for t in (r["min_turn"], r["max_turn"]) if t is not None]
    gaps = max(turns) - min(turns) + 1 - total["n_turns"] if turns else 0
    found = {"conv_id": pieces.column("conv_id")[:1].combine_chunks(), "gaps": pa.array([gaps]), **{c: pa.array([total[c]]) for c in COUNTS}, "cost": pa.array([cost]), "audit": pa.array([audit])}
    return pa.table(found)


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``damaged`` rows."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = rows.where("alive").groupBy("k1", "k2").agg(F.min(at).alias("first"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    small = rows.select(
        "conv_id", "turn", "alive", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
        "role", "head", "k1", "k2",
    )
    faults = small.join(firsts, ["k1", "k2"], "left").withColumn("later", F.col("alive") & ~F.col("turn").eqNullSafe(F.col("first.at")))
    ordered = faults.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "turn", "alive", "initial", "blank", "truncated", "later", "k1", "k2")
    stats = ", ".join(f"{c} {'string' if c.endswith('initial') else 'long'}" for c in STATS)
    pieces = cut(ordered.mapInArrow(_pieces, f"conv_id {conv}, part int, seq int, whole boolean, {stats}, items array<struct<p:int,q:int,cost:long,audit:string>>"))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0))
    alone = pieces.where("whole").select("conv_id", gaps.alias("gaps"), *COUNTS, F.col("items")[0]["cost"].alias("cost"), F.col("items")[0]["audit"].alias("audit"))
    longs = ", ".join(f"{c} long" for c in LONGS)
    return alone.unionByName(pieces.where("NOT whole").groupBy("conv_id").applyInArrow(_met, f"conv_id {conv}, {longs}, audit string"))


class _Hash:
    """SHA-256 of one conversation's repaired rows, as they come."""

    def __init__(self, found: tuple):
        self.found, self.audit, self.at, self.state = found, found[-1], 0, 0
        self.sha, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any, self.state = True, STEP[self.state][role[0]]

    def _due(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(self._due(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else self._due(), text)

    def row(self) -> tuple:
        self._inserts()
        return *self.found, self.sha.hexdigest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the row of findings comes first, then its rows in order."""
    at, out, kind = None, [], None
    names = ["conv_id", *LONGS, "audit", "repaired_sha256"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * len(LONGS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, found, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found is not None:
                if at is not None:
                    out.append(at.row())
                at = _Hash((conv, *(found[c] for c in LONGS), found["audit"]))
            else:
                at.add(role, text)
        if len(out) >= 2000:
            yield batch_of(out)
            out = []
    if at is not None:
        yield batch_of([*out, at.row()])


def repairs(conversations: DataFrame) -> DataFrame:
    """Per conversation: what the damage did to it, the cheapest edits that give it a legal role order, and a digest of the repaired rows.

    Null conversations are one conversation; null turns come first and leave no gap; null roles and texts are one space. Rows of one turn are ordered by role
    and text. An empty role has no initial: such a row is given a role or deleted. Repeated rows are duplicates. A conversation whose rows were all dropped has
    zeros, no edits and the digest of nothing. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    conv = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    found = judged(rows)
    plan = found.select("conv_id", F.struct(*LONGS, "audit").alias("found"))
    stream = rows.where("alive").select("conv_id", "turn", "role", "head", "k1", "k2", "text").unionByName(plan, allowMissingColumns=True)
    conv_order, *row_order = _order()
    longs = ", ".join(f"{c} long" for c in LONGS)
    ordered = stream.repartition("conv_id").sortWithinPartitions(conv_order, F.col("found").isNull(), *row_order).select("conv_id", "found", "role", "text")
    return ordered.mapInArrow(_hashes, f"conv_id {conv}, {longs}, audit string, repaired_sha256 string")
