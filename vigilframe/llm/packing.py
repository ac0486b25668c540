"""Packing of tokenized documents into fixed-length sequences by cutting-stock column generation.

Every document becomes its token ids and an end id, cut into full sequences and one remainder. The remainders' length histogram, in classes of
``UNIT`` tokens, is the cutting-stock problem: a linear program over patterns of classes that fit one sequence. Columns are priced by an unbounded
knapsack over the duals; the solution is rounded down and what it leaves is packed greedily by class. The histogram and the plan have a fixed size
however many documents there are. Pieces are ranked inside their class, and a rank alone tells a piece its sequence and slot, so no task sees more
than a pattern's worth of pieces together.

The token counts are written to the shared folder once. A null text is an empty one: it is the end id alone.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, pieces, released

SEQUENCE = 2048
UNIT = 8
END_ID = 1
_STEM = re.compile(r"([A-Za-z]+)([.,;:!?]+)")
_MARKS = re.compile(r"[.,;:!?]+")
KEPT_BYTES = 48 << 20  # of words that a worker remembers, their places counted
JOINED = 2000  # words encoded in one go
COLUMNS = 4000  # pivots of the linear program at most; the plan is valid after any of them

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of texts through a cache. The tokenizer drops blanks and line feeds and never joins across them, so words can be encoded apart; what a worker remembers
    of them is bounded in bytes.

    New words of letters alone, or of marks alone, are encoded many at a time with blanks between them: the token that ends a word tells them apart again. If their
    ends do not come out right, or the tokenizer has no such tokens, they are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Words and where their two stems stand; stems and where their ids stand. Stem 0 is empty."""
        self.place: dict[str, int] = {}
        self.stems: dict[str, int] = {"": 0}
        self.first, self.second = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids, self.filled, self.held = np.zeros(1 << 14, np.uint32), 0, 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray, at: int) -> None:
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while at + len(sizes) > len(self.size):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.size[at : at + len(sizes)] = sizes
        self.start[at : at + len(sizes)] = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(ids)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. ASCII letters with marks after them are two runs to the tokenizer, whatever their case, so most new words are known stems."""
        stems = self.stems
        parts = [(w.lower() if w.isascii() else w, "") if w.isalpha() else (m.group(1).lower(), m.group(2)) if (m := _STEM.fullmatch(w)) else (w, "") for w in words]
        fresh = [x for x in dict.fromkeys(chain.from_iterable(parts)) if x not in stems]
        single = [x for x in fresh if x.isalpha() or _MARKS.fullmatch(x)] if self.ends.any() else []
        known_ends = set(single)
        alone = [x for x in fresh if x not in known_ends] if len(single) < len(fresh) else []
        for at in range(0, len(single), JOINED):
            block = single[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids])
            if len(cuts) != len(block) or cuts[-1] != len(ids) - 1:
                alone += block
                continue
            self._keep(ids, np.diff(np.concatenate([[-1], cuts])), len(stems))
            stems.update(zip(block, range(len(stems), len(stems) + len(block)), strict=True))
        for at in range(0, len(alone), JOINED):
            block = alone[at : at + JOINED]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(block, add_special_tokens=False)]
            self._keep(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)), len(stems))
            stems.update(zip(block, range(len(stems), len(stems) + len(block)), strict=True))
        known = len(self.place) - len(words)
        while len(self.place) > len(self.first):
            self.first, self.second = np.resize(self.first, 2 * len(self.first)), np.resize(self.second, 2 * len(self.second))
        self.first[known : len(self.place)] = np.fromiter((stems[a] for a, _ in parts), np.int32, len(parts))
        self.second[known : len(self.place)] = np.fromiter((stems[b] for _, b in parts), np.int32, len(parts))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, with the end id after each text, and where each text's ids start. Python sees the distinct words of the texts only."""
        if self.held > KEPT_BYTES:
            self._forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in distinct if w not in self.place]
        self.held += sum(map(len, fresh)) + 100 * len(fresh)
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
        self._learn(fresh)
        places = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        which = places[coded.indices.to_numpy()]
        which = np.stack([self.first[which], self.second[which]], axis=1).reshape(-1)
        size = self.size[which]
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = self.ids[np.repeat(self.start[which] - before[:-1], size) + np.arange(before[-1])]
        ends = before[2 * np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)]
        out = np.insert(out, ends, END_ID)
        return out.astype("<u4"), np.concatenate([[0], ends + np.arange(1, len(texts) + 1)]).astype(np.int64)


def tokenized(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: full sequences and the remainder of each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                ids, starts = encoder.encode(part.column(1))
                doc, start, length, crc, total = [], [], [], [], []
                view = memoryview(ids).cast("B")
                for key, a, b in zip(part.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    for at in range(a, b, sequence):
                        to = min(at + sequence, b)
                        doc.append(key)
                        start.append(at - a)
                        length.append(to - at)
                        crc.append(zlib.crc32(view[4 * at : 4 * to]))
                        total.append(b - a)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(encode), PIECES)


def _knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of classes whose sizes (class k has size k + 1) fit the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth = best[room - 1 :: -1][: len(prices)] + prices[: room]
        k = int(worth.argmax())
        best[room], taken[room] = (worth[k], k) if worth[k] > best[room - 1] else (best[room - 1], -1)
    counts, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= int(taken[room]) + 1
    return float(best[capacity]), counts


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, one rank-one step a column; needs no threaded library."""
    n = len(a)
    work = np.concatenate([a, np.eye(n)], axis=1)
    for k in range(n):
        at = k + int(np.abs(work[k:, k]).argmax())
        work[[k, at]] = work[[at, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        work -= np.outer(factors, work[k])
    return work[:, n:]


def solve(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each class) and how many sequences follow each; together they hold ``counts`` pieces of each class."""
    classes = np.flatnonzero(counts)
    if not len(classes):
        return []
    need = counts[classes].astype(float)
    m = len(classes)
    columns = np.zeros((m, m))
    np.fill_diagonal(columns, capacity // (classes + 1))
    inverse = np.diag(1 / np.diag(columns))
    for pivot in range(COLUMNS):
        duals = inverse.sum(axis=0)
        prices = np.full(capacity, -1.0)
        prices[classes] = duals
        worth, pattern = _knapsack(prices, capacity)
        if worth <= 1 + 1e-7:
            break
        column = pattern[classes].astype(float)
        change, now = inverse @ column, inverse @ need
        ratio = np.where(change > 1e-9, np.maximum(now, 0) / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        if pivot % 100 == 99:
            inverse = _inverse(columns)
        else:
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
    times = np.floor(np.maximum(inverse @ need, 0) + 1e-9).astype(np.int64)
    plan, left = [], counts.astype(np.int64).copy()
    for k in np.argsort(-times, kind="stable"):
        pattern = np.zeros(len(counts), np.int64)
        pattern[classes] = np.rint(columns[:, k]).astype(np.int64)
        used = pattern > 0
        fits = min(int(times[k]), int((left[used] // pattern[used]).min())) if used.any() else 0
        if fits:
            plan.append((pattern, fits))
            left -= pattern * fits
    while left.any():  # largest first; the rounding leaves at most a few pieces of each class
        pattern, room, k = np.zeros(len(counts), np.int64), capacity, len(left) - 1
        while k >= 0 and room > 0:
            take = min(int(left[k]) - int(pattern[k]), room // (k + 1))
            if take > 0:
                pattern[k] += take
                room -= take * (k + 1)
            k = min(k - 1, room - 1)
        used = pattern > 0
        fits = int((left[used] // pattern[used]).min())
        plan.append((pattern, fits))
        left -= pattern * fits
    return plan


@dataclass
class Places:
    """For each class the first ranks of its runs, in order, with the sequence of each run's first piece and the slot."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    slot: dict[int, np.ndarray]


def places(plan: list[tuple[np.ndarray, int]]) -> Places:
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            for _ in range(int(pattern[k])):
                runs.setdefault(k + 1, []).append((used.get(k, 0), base, slot))
                used[k] = used.get(k, 0) + times
                slot += 1
        base += times
    arrays = {k: np.array(v, dtype=np.int64) for k, v in runs.items()}
    return Places(*({k: a[:, c] for k, a in arrays.items()} for c in range(3)))


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    rows = cut(tokenized(docs, tokenizer, sequence))
    n_buckets = 16 * max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.ceil(F.col("length") / UNIT).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "doc_tokens"), F.lit(n_buckets)).cast("int")
    rows = rows.withColumn("class", own).withColumn("bucket", bucket)
    sizes = rows.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    counts = np.zeros(sequence // UNIT, np.int64)
    for k, n in sizes.groupBy("class").agg(F.sum("n")).collect():  # one row per class: at most sequence / UNIT
        counts[k - 1] = n
    where = places(solve(counts, sequence // UNIT))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).drop("n")
    in_bucket = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")) - 1
    ranked = rows.withColumn("in_bucket", in_bucket).join(before, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("in_bucket"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).to_numpy(zero_copy_only=False)
            sequence_id, slot = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds).tolist():
                mine = np.flatnonzero(kinds == k)
                run = np.searchsorted(where.first[k], ranks[mine], "right") - 1
                sequence_id[mine] = where.sequence[k][run] + ranks[mine] - where.first[k][run]
                slot[mine] = where.slot[k][run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence_id), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", F.col("rank").cast("long")).mapInArrow(released(place), PIECES + ", sequence_id long, slot long")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.withColumn("offset", offset).drop("slot")
