"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a stretch of documents of one task. Its words become symbols of the benchmark's vocabulary; words that the benchmark does not have
end a phrase, so stretches between them that are shorter than the shortest window cannot hold one and are left out. The rest is indexed, all
windows are searched backwards through the wavelet matrix at once, their places are read from sampled suffixes, and the hit words of a document
are merged to spans. Documents are read once per block of the benchmark and never shuffled.

A benchmark is handled in blocks of ``BLOCK_WORDS`` words, one pass each, so what is sent to the tasks is bounded.
Null and empty texts have no words; an item whose id is null counts as the empty id; repeated items are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import Words, flat, lowered, pieces, released
from vigilframe.llm.fmindex import FMIndex

WINDOW = 13
BLOCK_WORDS = 500_000
SHARD_WORDS = 1 << 20  # indexed words at which a shard is closed
SHARD_BYTES = 1 << 25  # and bytes of text

FOUND = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Phrases:
    """Distinct windows of a block: symbols (right-aligned), lengths, and the items each belongs to."""

    vocabulary: np.ndarray  # sorted word hashes; the symbol is the place here plus 2, and 1 separates
    symbols: np.ndarray
    lengths: np.ndarray
    item_start: np.ndarray
    item: np.ndarray
    names: list[str]


def phrases_of(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    data, offsets = flat(pa.array([t or "" for _, t in items], pa.string()))
    words = Words(lowered(data), offsets, alnum=True)
    hashes = words.hashes()
    vocabulary = np.unique(hashes)
    symbols = np.searchsorted(vocabulary, hashes) + 2
    names = sorted({n for n, _ in items})
    place = {n: k for k, n in enumerate(names)}
    belongs: dict[bytes, set[int]] = {}
    for (name, _), first, n in zip(items, words.first.tolist(), words.per_text.tolist(), strict=True):
        own = symbols[first : first + n]
        for at in range(max(1, n - window + 1) if n else 0):
            belongs.setdefault(own[at : at + window].astype(np.int32).tobytes(), set()).add(place[name])
    table = np.zeros((len(belongs), window), dtype=np.int32)
    lengths = np.zeros(len(belongs), dtype=np.int64)
    for row, phrase in enumerate(belongs):
        own = np.frombuffer(phrase, np.int32)
        table[row, window - len(own) :], lengths[row] = own, len(own)
    sizes = [len(x) for x in belongs.values()]
    return Phrases(vocabulary, table, lengths, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([i for x in belongs.values() for i in sorted(x)], dtype=np.int64), names)


class Shard:
    """Symbols of consecutive documents, with the document row and word place of each."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.shortest = phrases, int(phrases.lengths.min()) if len(phrases.lengths) else 0
        self.symbols: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, words: Words, row: int) -> None:
        """Documents of ``words`` get the rows from ``row`` on."""
        known = self.phrases.vocabulary
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        inside = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        text = words.text_of()
        ends = np.flatnonzero(np.concatenate([inside[1:] != inside[:-1], [True]]) | np.concatenate([text[1:] != text[:-1], [True]])) + 1 if len(inside) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        keep = inside[starts] & (ends - starts >= self.shortest) if len(ends) else np.zeros(0, bool)
        starts, sizes = starts[keep], (ends - starts)[keep]
        if not len(starts):
            return
        total = sizes + 1  # each stretch and its separator
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(total)[:-1]]), total)
        index = np.arange(int(total.sum())) + shift
        closing = np.cumsum(total) - 1
        symbols = at[np.minimum(index, len(at) - 1)] + 2
        symbols[closing] = 1
        index[closing] -= 1
        self.symbols.append(symbols)
        self.rows.append(text[index] + row)
        self.places.append(index - words.first[text[index]])
        self.size += len(symbols)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans (row, start, end) of hit words, and distinct (row, item) pairs."""
        none = np.zeros(0, np.int64)
        if not self.size:
            return none, none, none, none, none
        p, rows, places = self.phrases, np.concatenate(self.rows), np.concatenate(self.places)
        index = FMIndex(np.concatenate(self.symbols))
        low, high = index.search(p.symbols, p.lengths)
        found = high - low
        phrase = np.repeat(np.arange(len(found)), found)
        at = index.locate(np.arange(int(found.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found))
        depth = np.zeros(len(rows) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + p.lengths[phrase], -1)
        hit = np.cumsum(depth)[:-1] > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        pairs = np.unique(np.stack([rows[at], phrase], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        many = p.item_start[pairs[:, 1] + 1] - p.item_start[pairs[:, 1]]
        item = p.item[np.arange(int(many.sum())) + np.repeat(p.item_start[pairs[:, 1]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)] if len(pairs) else none
        both = np.unique(np.stack([np.repeat(pairs[:, 0], many), item], axis=1), axis=0) if len(pairs) else np.zeros((0, 2), np.int64)
        return rows[first], places[first], places[last] + 1, both[:, 0], both[:, 1]


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _pass(docs: DataFrame, phrases: Phrases) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, row, held = Shard(phrases), [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            spans: dict[int, list] = {}
            items: dict[int, list] = {}
            span_row, start, end, item_row, item = (x.tolist() for x in shard.hits())
            for r, s, e in zip(span_row, start, end, strict=True):
                spans.setdefault(r, []).append({"start": s, "end": e})
            for r, i in zip(item_row, item, strict=True):
                items.setdefault(r, []).append(phrases.names[i])
            for first, batch, counts in waiting:
                old_spans, old_items = batch.column(3), batch.column(4)
                new_spans, new_items = [], []
                for k in range(batch.num_rows):
                    s, i = spans.get(first + k), items.get(first + k)
                    before = old_spans[k].as_py() or []
                    new_spans.append(_merged(before + s) if s else before)
                    new_items.append(sorted({*(old_items[k].as_py() or []), *(i or [])}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(new_spans, _SPANS), pa.array(new_items, pa.list_(pa.string())), *batch.columns[5:]], names=batch.schema.names)

        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = flat(part.column(1))
                words = Words(lowered(data), offsets, alnum=True)
                if len(phrases.lengths):
                    shard.add(words, row)
                waiting.append((row, part, pa.array(words.per_text, pa.int64())))
                row, held = row + part.num_rows, held + len(data)
                if shard.size >= SHARD_WORDS or held >= SHARD_BYTES:
                    yield from flush()
                    shard, waiting, row, held = Shard(phrases), [], 0, 0
        yield from flush()

    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[5:])
    return docs.mapInArrow(released(search), FOUND + carried)


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``block_words`` words, one partition of the benchmark at a time."""
    block, size = [], 0
    for name, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).toLocalIterator():
        block.append((name, text))
        size += len((text or "").split())
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_words, spans, items, and the columns named in ``carry``): merged spans of hit words, end exclusive, and the ids of the items that occur."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("CAST(NULL AS array<struct<start:long,end:long>>)").alias("spans"), F.expr("CAST(NULL AS array<string>)").alias("items"), *(F.col(c) for c in carry))
    for block in blocks_of(benchmark):
        out = _pass(out, phrases_of(block, window))
    return out


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: a twentieth of the words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
