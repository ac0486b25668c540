"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of anchored suffixes.

Any two equal 200-byte strings hold the same anchor: the start of the smallest-hashed 32 bytes in them. So only anchored suffixes are sorted, about one
in 85 bytes. Every task sorts those of its documents to a run: 32 bytes of text, then a hash of everything up to 200 bytes around. Runs are
front-coded, cut at sampled splitters, exchanged, and merged in each range by a loser tree that knows the common prefixes and compares only what
follows them. Neighbours in the merged order tell, for every suffix, whether its whole surroundings repeat, or only the anchor does; then the single
200-byte strings around it are told apart by their hashes, which combine before the shuffle.

A run holds equal entries once, so a passage in a third of all documents is a few entries per task. Text is never sent for comparison.
Null and empty texts have no bytes. Matches never cross documents: every hash is taken inside one document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import PASS_BYTES, cut, flat, mixed, pieces, prefix_hash, spans_hash

STRING = 200
ANCHOR = 32
WINDOW = STRING - ANCHOR + 1
KEY = ANCHOR + 8
RUN_ENTRIES = 1 << 20  # entries of one sorted run
BLOCK_ENTRIES = 4096
RANGE_BYTES = 32 << 20  # text for which one more range is made
HEADS_PER_RANGE = 40
GROUP = 16  # strings around an anchor that are first judged together
WHOLE, PARTLY = 1, 2  # the surroundings repeat; the anchor also stands in other surroundings
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over every ``width`` consecutive values, by running picks from both ends of blocks of that width."""
    n = len(values)
    size = -(-(n + width) // width) * width
    padded = np.full(size, fill, dtype=np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = pick.accumulate(table, axis=1).reshape(-1)
    back = pick.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[:n], ahead[width - 1 : n + width - 1])


class Anchors:
    """Anchors of texts that stand one after the other: places, texts, and the hash of the surroundings of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.offsets, self.sums, self.data = offsets, prefix_hash(data), data
        sizes = np.diff(offsets)
        end = np.repeat(offsets[1:], sizes)
        at = np.arange(n)
        value = np.full(n, _MOST)
        ok = np.flatnonzero(at + ANCHOR <= end)
        value[ok] = spans_hash(data, ok, ok + ANCHOR, self.sums) >> np.uint64(1)
        self.least = _sliding(value, WINDOW, np.minimum, int(_MOST))
        self.least[at + STRING > end] = 0  # no string starts here
        shifted = np.concatenate([np.zeros(WINDOW - 1, np.uint64), self.least])
        chosen = (_sliding(shifted, WINDOW, np.maximum, 0)[:n] == value) & (value != _MOST)
        self.place = np.flatnonzero(chosen)
        self.value = value
        self.text = np.searchsorted(offsets, self.place, "right") - 1

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """All strings that hold the anchor lie between these two places."""
        return np.maximum(self.place - (WINDOW - 1), self.offsets[self.text]), np.minimum(self.place + STRING, self.offsets[self.text + 1])

    def surroundings(self) -> np.ndarray:
        low, high = self.around()
        return mixed(spans_hash(self.data, low, high, self.sums) + (self.place - low).astype(np.uint64))

    def groups(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """The strings whose smallest hash stands at these anchors (the leftmost of equal ones), in groups of ``GROUP`` by their distance to it.

        Per group: hash of the bytes that all its possible strings share, hash of all bytes of the strings it has, anchor, first start, number of strings.
        """
        order = np.lexsort((self.place, self.value[self.place]))
        before = np.full(len(self.place), -1)
        before[order[1:]] = np.where(self.value[self.place[order[1:]]] == self.value[self.place[order[:-1]]], self.place[order[:-1]], -1)
        place, apart = self.place[which], np.arange(-(-WINDOW // GROUP) * GROUP)
        start = place[:, None] - apart[None, :]
        own = (start > before[which][:, None]) & (apart < WINDOW)[None, :]
        own &= self.least[np.maximum(start, 0)] == self.value[place][:, None]
        own = own.reshape(len(place), -1, GROUP)
        anchor, group = np.nonzero(own.any(axis=2))
        mine = own[anchor, group]
        last = place[anchor] - group * GROUP - mine.argmax(axis=1)
        first = place[anchor] - group * GROUP - (GROUP - 1 - mine[:, ::-1].argmax(axis=1))
        core = place[anchor] - group * GROUP
        shared = mixed(spans_hash(self.data, core, core - GROUP + 1 + STRING, self.sums) + group.astype(np.uint64) + np.uint64(1))
        return shared, spans_hash(self.data, first, last + STRING, self.sums), anchor, first, last - first + 1


def front_coded(keys: np.ndarray) -> bytes:
    """Sorted rows of ``KEY`` bytes: per row the prefix it shares with the row before and the bytes after that."""
    shared = np.zeros(len(keys), np.uint8)
    differ = keys[1:] != keys[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), KEY)
    rest = keys[np.arange(KEY)[None, :] >= shared[:, None]]
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(4, "little") + shared.tobytes() + rest.tobytes())


def decoded(body: bytes) -> tuple[list[bytes], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(raw[:4], "little")
    shared, at, key, keys = list(raw[4 : 4 + n]), 4 + n, b"", []
    for s in shared:
        to = at + KEY - s
        key = key[:s] + raw[at:to]
        keys.append(key)
        at = to
    return keys, shared


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int]]:
    """All keys of sorted runs in order, each with the prefix it shares with the key before it and its run.

    A loser tree: every inner node keeps the run that lost there and the prefix its key shares with the winner. Of two runs the one that shares more
    with the last key put out is smaller; only if they share the same are bytes compared, from there on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    keys = [r[0] for r in runs]
    shares = [r[1] for r in runs]
    place = [0] * len(runs)
    head: list[bytes | None] = [k[0] if k else None for k in keys] + [None] * (leaves - len(runs))
    loser, lost = [0] * leaves, [-1] * leaves

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and what it shares with the last key; loser and what it shares with the winner."""
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = head[a], head[b]
        if x is None or y is None:
            return (a, la, b, -1) if y is None else (b, lb, a, -1)
        h, end = la, len(x)
        while h < end and x[h] == y[h]:
            h += 1
        if h == end or x[h] < y[h]:
            return a, la, b, h
        return b, lb, a, h

    def build(node: int) -> tuple[int, int]:
        if node >= leaves:
            leaf = node - leaves
            return leaf, 0 if head[leaf] is not None else -1
        (a, la), (b, lb) = build(2 * node), build(2 * node + 1)
        winner, share, loser[node], lost[node] = play(a, la, b, lb)
        return winner, share

    winner, share = build(1)
    while head[winner] is not None:
        yield head[winner], share, winner
        run = winner
        place[run] += 1
        at = place[run]
        if at < len(keys[run]):
            head[run], share = keys[run][at], shares[run][at]
        else:
            head[run], share = None, -1
        node = (run + leaves) >> 1
        while node:
            other, theirs = loser[node], lost[node]
            if theirs > share:
                loser[node], lost[node], winner, share = winner, share, other, theirs
            elif theirs == share:
                winner, share, loser[node], lost[node] = play(winner, share, other, theirs)
            node >>= 1


def _run(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and which stand more than once."""
    words = keys.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    fresh = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
    first = np.flatnonzero(fresh)
    return keys[order[first]], np.diff(np.concatenate([first, [len(keys)]])) > 1


PREPARED = "row long, doc_id long, n_bytes long, packed binary, run long, head binary, body binary, many binary"


def prepared(docs: DataFrame) -> DataFrame:
    """Rows of two sorts: packed documents, numbered, and front-coded blocks of this task's sorted runs."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        row, run, waiting, held = base, base, [], 0
        tool = zstandard.ZstdCompressor(level=1)
        names = [f.split()[0] for f in PREPARED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

        def batch_of(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            keys, many = _run(np.concatenate(waiting))
            starts = range(0, len(keys), BLOCK_ENTRIES)
            yield batch_of({
                "run": [run] * len(starts), "head": [keys[s].tobytes() for s in starts], "body": [front_coded(keys[s : s + BLOCK_ENTRIES]) for s in starts],
                "many": [many[s : s + BLOCK_ENTRIES].tobytes() for s in starts],
            }, len(starts))

        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = flat(part.column(1))
                n = part.num_rows
                packed = [tool.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield batch_of({"row": np.arange(row, row + n), "doc_id": part.column(0), "n_bytes": np.diff(offsets), "packed": packed}, n)
                row += n
                anchors = Anchors(data, offsets)
                if len(anchors.place):
                    text = data[anchors.place[:, None] + np.arange(ANCHOR)[None, :]]
                    around = anchors.surroundings().astype(">u8").view(np.uint8).reshape(-1, 8)
                    waiting.append(np.concatenate([text, around], axis=1))
                    held += len(text)
                if held >= RUN_ENTRIES:
                    yield from close()
                    run, waiting, held = run + 1, [], 0
        if held:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(prepare, PREPARED)


def dealt(runs: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Blocks cut at the splitters: (part, run, head, body, many)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for run, body, many in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                keys, _ = decoded(body)
                table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
                at = 0
                while at < len(keys):
                    part = bisect_left(splitters, keys[at] + b"\0")  # a splitter is the first key of its range
                    to = bisect_left(keys, splitters[part], at) if part < len(splitters) else len(keys)
                    out.append((part, run, keys[at], front_coded(table[at:to]), many[at:to]))
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=["part", "run", "head", "body", "many"])

    return runs.select("run", "body", "many").mapInArrow(deal, "part long, run long, head binary, body binary, many binary")


def judged(blocks: DataFrame, splitters: list[bytes]) -> DataFrame:
    """(around, mark) of every surroundings hash that repeats or whose anchor stands in other surroundings too."""
    edges = {s[:ANCHOR] for s in splitters}

    def judge(group: pa.Table) -> pa.Table:
        runs: dict[int, list] = {}
        for row in sorted(group.to_pylist(), key=lambda r: (r["run"], r["head"])):
            runs.setdefault(row["run"], []).append(row)
        sides, many = [], []
        for blocks_ in runs.values():
            keys, shares, flags = [], [], bytearray()
            for row in blocks_:
                k, s = decoded(row["body"])
                if keys:  # what the block's first key shares with the last one before it
                    s[0] = next((i for i in range(KEY) if k[0][i] != keys[-1][i]), KEY)
                keys += k
                shares += s
                flags += row["many"]
            sides.append((keys, shares))
            many.append(flags)
        at = [0] * len(sides)
        found: list[bytes] = []
        marks = bytearray()
        first = 0  # of the entries with the same anchor
        anchor = b""

        def settle() -> None:
            other = PARTLY if len(found) - first > 1 or anchor in edges else 0
            for i in range(first, len(marks)):
                marks[i] |= other

        for key, share, run in merged(sides):
            repeated = many[run][at[run]]
            at[run] += 1
            if share == KEY and found:
                marks[-1] |= WHOLE
                continue
            if share < ANCHOR:
                settle()
                first, anchor = len(found), key[:ANCHOR]
            found.append(key[ANCHOR:])
            marks.append(WHOLE if repeated else 0)
        settle()
        around = np.frombuffer(b"".join(found), ">i8").astype(np.int64)
        mark = np.frombuffer(bytes(marks), np.uint8).astype(np.int32)
        return pa.table({"around": pa.array(around[mark > 0]), "mark": pa.array(mark[mark > 0])})

    return blocks.groupBy("part").applyInArrow(judge, "around long, mark int")


def _opened(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch in passes of a bounded size: (first row, row after the last, bytes, offsets)."""
    tool = zstandard.ZstdDecompressor()
    texts, size, first = [], 0, 0
    for k, packed in enumerate(batch.column(column).to_pylist()):
        text = tool.decompress(packed)
        if texts and size + len(text) > PASS_BYTES:
            yield first, k, *_joined(texts)
            texts, size, first = [], 0, k
        texts.append(text)
        size += len(text)
    if texts:
        yield first, batch.num_rows, *_joined(texts)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def anchor_rows(texts: DataFrame) -> DataFrame:
    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for first, _, data, offsets in _opened(batch, 1):
                a = Anchors(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(a.surroundings().view(np.int64)), pa.array(rows[first + a.text]), pa.array((a.place - offsets[a.text]).astype(np.int32))], names=["around", "row", "place"])

    return texts.select("row", "packed").mapInArrow(list_, "around long, row long, place int")


def group_rows(texts: DataFrame) -> DataFrame:
    """(core, full, row, first, n) of the groups of strings around anchors that also stand in other surroundings. ``texts``: row, packed, partly (places)."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = batch.column(0).to_numpy(), batch.column(2)
            for first_row, last_row, data, offsets in _opened(batch, 1):
                a = Anchors(data, offsets)
                wanted = np.concatenate([np.array(places[k].as_py(), np.int64) + offsets[k - first_row] for k in range(first_row, last_row)])
                which = np.searchsorted(a.place, np.sort(wanted))
                core, full, anchor, first, n = a.groups(which)
                text = a.text[which[anchor]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(rows[first_row + text]), pa.array((first - offsets[text]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["core", "full", "row", "first", "n"],
                )

    return texts.select("row", "packed", "partly").mapInArrow(list_, "core long, full long, row long, first int, n int")


def string_rows(texts: DataFrame) -> DataFrame:
    """(string, row, start) of every string of open groups; strings of groups that are settled come without a place. ``texts``: row, packed, open (first, n, settled)."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, opened = batch.column(0).to_numpy(), batch.column(2)
            for first_row, last_row, data, offsets in _opened(batch, 1):
                sums = prefix_hash(data)
                groups = [(g["first"] + int(offsets[k - first_row]), g["n"], k, g["settled"]) for k in range(first_row, last_row) for g in opened[k].as_py()]
                first, n, owner, settled = (np.array(x) for x in zip(*groups, strict=True))
                start = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
                owner, settled = np.repeat(owner, n), np.repeat(settled, n).astype(bool)
                own = spans_hash(data, start, start + STRING, sums).view(np.int64)
                known = np.unique(own[settled])
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.nulls(len(known), pa.int64()), pa.nulls(len(known), pa.int32())], names=["string", "row", "start"])
                fresh = ~settled
                yield pa.RecordBatch.from_arrays([pa.array(own[fresh]), pa.array(rows[owner[fresh]]), pa.array((start[fresh] - offsets[owner[fresh] - first_row]).astype(np.int32))], names=["string", "row", "start"])

    return texts.select("row", "packed", "open").mapInArrow(list_, "string long, row long, start int")


def repeated_strings(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(row, runs, starts): where strings around partly repeated anchors repeat; runs are (first, n) of neighbouring starts.

    A string of a group can only repeat if the bytes shared by the group do; if all bytes of a group repeat, all its strings do. Only groups in between
    are opened, together with the settled ones that share their bytes.
    """
    groups = cut(group_rows(texts.select("row", "packed").join(places.where(F.size("partly") > 0).select("row", "partly"), "row")))
    keys = groups.select(F.explode(F.array("core", "full")).alias("key")).groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    groups = groups.join(keys.select(F.col("key").alias("core")), "core").join(keys.select(F.col("key").alias("full"), F.lit(True).alias("settled")), "full", "left")
    groups = cut(groups.select("core", "row", "first", "n", F.coalesce("settled", F.lit(False)).alias("settled")))
    unsettled = groups.groupBy("core").agg(F.bool_and("settled").alias("all")).where("NOT all").select("core")
    opened = groups.join(unsettled, "core").groupBy("row").agg(F.collect_list(F.struct("first", "n", "settled")).alias("open"))
    strings = cut(string_rows(texts.select("row", "packed").join(opened, "row")))
    repeated = strings.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
    starts = strings.where("row IS NOT NULL").join(repeated, "string").groupBy("row").agg(F.collect_list("start").alias("starts"))
    runs = groups.where("settled").groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    return runs.join(starts, "row", "full")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removal(joined: DataFrame) -> DataFrame:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, whole, runs, starts in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                data = np.frombuffer(tool.decompress(packed), np.uint8)
                n = len(data)
                depth = np.zeros(n + 1, np.int64)
                if starts:
                    begin = np.array(starts, np.int64)
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + STRING, -1)
                if runs:
                    begin, many = (np.array([r[c] for r in runs], np.int64) for c in ("first", "n"))
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + many - 1 + STRING, -1)
                if whole:
                    begin = np.maximum(np.array(whole, np.int64) - (WINDOW - 1), 0)
                    end = np.minimum(np.array(whole, np.int64) + STRING, n)
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, end, -1)
                gone = np.cumsum(depth)[:n] > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc_id, n, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", "packed", "whole", "runs", "starts").mapInArrow(remove, REMOVED)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    everything = cut(prepared(docs))
    texts, runs = everything.where("row IS NOT NULL"), everything.where("run IS NOT NULL")
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(16, -(-size // RANGE_BYTES))
    heads = sorted(r[0] for r in runs.select("head").orderBy(F.xxhash64("head")).limit(HEADS_PER_RANGE * ranges).collect())
    splitters = sorted({bytes(heads[k * len(heads) // ranges]) for k in range(1, ranges)}) if heads else []
    marks = cut(judged(dealt(runs, splitters), splitters))
    marks = marks.groupBy("around").agg(F.bit_or("mark").alias("mark"))
    flagged = anchor_rows(texts).join(marks, "around")
    whole, partly = F.expr("mark & 1 = 1"), F.expr("mark & 2 = 2")
    places = cut(flagged.groupBy("row").agg(F.collect_list(F.when(whole, F.col("place"))).alias("whole"), F.collect_list(F.when(partly, F.col("place"))).alias("partly")))
    spans = places.select("row", "whole").join(repeated_strings(texts, places), "row", "left")
    return _removal(texts.select("row", "doc_id", "packed").join(spans, "row", "left"))
