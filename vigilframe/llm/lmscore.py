"""Language-model scores: prediction by partial matching over byte contexts, and a unigram base, both learned from the training fold.

Documents go into chunks of bounded size. A chunk reports the distinct tokens (64-bit hashes) and the distinct byte contexts of order 4 with the byte
that followed, each with its count in training rows. Ranges of tokens, and contexts that end in the same two bytes, meet in one group each; there
the counts are summed, and the context trie of orders 4 to 2 gives every context and byte its code length: escape by the number of distinct symbols, and
symbols of the longer context excluded from the shorter one. Orders 1 and 0 come from one table of 256 x 256 counts. Each chunk gets back the values
of its own keys only, so no table of the corpus is ever sent to all tasks.

Null and empty texts are the end symbol alone. Texts are lower-cased (A-Z) first. The bytes of a text are followed by the end symbol, byte 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import Words, cut, flat, fold, lowered, mixed, pieces

FOLDS = 10
ORDER = 4
CHUNK_BYTES = 48 << 20  # text of one chunk
SETTLE_KEYS = 1_500_000  # keys a chunk holds before equal ones are summed
RANGE_BYTES = 16 << 20  # text for which one more range of keys is made
TOKEN, GRAM = 0, 1
END_TOKEN = np.uint64(0x656E64)

REPORT = "kind int, chunk long, part long, body binary, cell int, n long"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, compressed."""
    tool = zstandard.ZstdCompressor(level=1)
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    return tool.compress(len(arrays[0]).to_bytes(8, "little") + b"".join(planes))


def _unpack(body: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        size = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and for the end symbol of each text: nearest byte of the context first, the symbol last. And the text of each."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(n), sizes)  # each text stands behind ORDER zero bytes and before the end symbol
    wide = np.zeros(len(data) + (ORDER + 1) * n, np.uint64)
    wide[np.arange(len(data)) + ORDER + (ORDER + 1) * text] = data
    where = np.arange(len(data) + n) + ORDER * (1 + np.repeat(np.arange(n), sizes + 1))
    key = np.zeros(len(where), np.uint64)
    for back in range(1, ORDER + 1):
        key = key << np.uint64(8) | wide[where - back]
    return key << np.uint64(8) | wide[where], np.repeat(np.arange(n), sizes + 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes in text order, the end token after each text's words. And the text of each."""
    words = Words(data, offsets, alnum=False)
    n = len(words.per_text)
    return np.insert(words.hashes(), words.first + words.per_text, END_TOKEN), np.repeat(np.arange(n), words.per_text + 1)


class Report:
    """What one chunk has seen. Every so often the keys are summed, so it stays as small as its distinct keys."""

    def __init__(self):
        self.keys: dict[int, list] = {TOKEN: [], GRAM: []}
        self.pending = self.bytes = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> None:
        for kind, found in ((TOKEN, tokens), (GRAM, grams)):
            keys, text = found(data, offsets)
            self.keys[kind].append(_summed(keys, train[text].astype(np.int64)))
            self.pending += len(self.keys[kind][-1][0])
        self.bytes += len(data)
        if self.pending > SETTLE_KEYS:
            self.settle()

    def settle(self) -> None:
        for kind, parts in self.keys.items():
            self.keys[kind] = [_summed(*map(np.concatenate, zip(*parts, strict=True)))] if parts else []
        self.pending = 0


def _part(kind: int, keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range a key belongs to. Contexts go by their two nearest bytes, so that a trie from order 2 on is whole in one range."""
    return (mixed(keys >> np.uint64(24)) if kind == GRAM else mixed(keys)) % np.uint64(ranges)


def reported(docs: DataFrame, ranges: int) -> DataFrame:
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, packer = TaskContext.get().partitionId() << 32, Report(), zstandard.ZstdCompressor(level=1)

        def rows(kind, part, body, cell, n) -> pa.RecordBatch:
            k = len(kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array([chunk] * k, pa.int64()), pa.array(part, pa.int64()), pa.array(body, pa.binary()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())],
                names=["kind", "chunk", "part", "body", "cell", "n"],
            )

        def close() -> Iterator[pa.RecordBatch]:
            seen.settle()
            for kind, found in seen.keys.items():
                for keys, counts in found:
                    part = _part(kind, keys, ranges)
                    order = np.argsort(part, kind="stable")
                    bounds = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
                    for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                        if b > a:
                            mine = order[a:b]
                            yield rows([kind], [p], [_pack(_steps(keys[mine]), counts[mine])], [None], [None])
                    if kind == GRAM:
                        cells, n = _summed(((keys >> np.uint64(32)) << np.uint64(8)) | (keys & np.uint64(255)), counts)
                        yield rows([2] * len(cells), [None] * len(cells), [None] * len(cells), cells.astype(np.int32), n)

        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = flat(piece.column(1))
                seen.add(lowered(data), offsets, ~piece.column(2).to_numpy(zero_copy_only=False).astype(bool))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as writer:
                    writer.write_batch(piece)
                yield rows([-1], [None], [packer.compress(sink.getvalue())], [None], [piece.num_rows])
                if seen.bytes >= CHUNK_BYTES:
                    yield from close()
                    chunk, seen = chunk + 1, Report()
        yield from close()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold("doc_id", FOLDS) == 0).alias("held_out"))
    return chosen.mapInArrow(report, REPORT)


def _level(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted-or-not (context, symbol) keys: distinct keys, their counts, place of each input key; and per distinct key its context's total and distinct symbols."""
    own, place = np.unique(keys, return_inverse=True)
    n = np.bincount(place, counts, len(own))
    contexts, at = np.unique(own >> np.uint64(8), return_inverse=True)
    total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, n > 0, len(contexts))
    return own, n, place, total[at], kinds[at], at


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each (context of order 4, byte). ``keys`` holds whole groups of contexts that end in the same two bytes.

    ``pairs``: counts of (last byte, byte) over the training rows.
    """
    n = len(keys)
    symbol = (keys & np.uint64(255)).astype(np.int64)
    near = (keys >> np.uint64(32)).astype(np.int64)
    level = {j: _level(((keys >> np.uint64(8 * (ORDER - j + 1))) << np.uint64(8)) | (keys & np.uint64(255)), counts) for j in (4, 3, 2)}
    count, total, kinds, excluded = {}, {}, {}, {}
    for j, (_, own_n, place, t, d, _) in level.items():
        count[j], total[j], kinds[j] = own_n[place], t[place], d[place]
    count[1], total[1], kinds[1] = pairs[near, symbol], pairs.sum(axis=1)[near], (pairs > 0).sum(axis=1)[near]
    single = pairs.sum(axis=0)
    count[0], total[0], kinds[0] = single[symbol], np.full(n, single.sum()), np.full(n, (single > 0).sum())
    for j in (3, 2, 1):  # mass, at order j, of the symbols that order j + 1 has seen
        own, own_n, place, _, _, at = level[j + 1]
        if j > 1:
            low_own, low_n = level[j][0], level[j][1]
            below = low_n[np.searchsorted(low_own, ((own >> np.uint64(16)) << np.uint64(8)) | (own & np.uint64(255)))]
        else:
            below = pairs[((own >> np.uint64(16)) & np.uint64(255)).astype(np.int64), (own & np.uint64(255)).astype(np.int64)]
        excluded[j] = np.bincount(at, below * (own_n > 0))[at][place]
    excluded[0] = ((pairs > 0) @ single)[near]
    log, open_ = np.zeros(n), np.ones(n, bool)
    for j in range(ORDER, -1, -1):
        mass = total[j] - (excluded[j] if j < ORDER else 0)
        fresh = kinds[j] - (kinds[j + 1] if j < ORDER else 0)
        seen = open_ & (mass + fresh > 0)
        hit = seen & (count[j] > 0)
        log[hit] += np.log10(count[j][hit] / (mass + fresh)[hit])
        miss = seen & ~hit
        log[miss] += np.log10(np.maximum(fresh[miss], 1e-9) / (mass + fresh)[miss])
        open_ &= ~hit
    log[open_] -= np.log10(np.maximum(256 - kinds[0][open_], 1))
    return log


def valued(reports: DataFrame, pairs: np.ndarray) -> DataFrame:
    """Per chunk and range: its keys with the corpus count (tokens) or the log10 probability (contexts); chunk -1: total and distinct tokens."""

    def value(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        chunks, found = group.column("chunk").to_pylist(), []
        for body in group.column("body"):
            steps, counts = _unpack(body.as_py(), np.uint64, np.int64)
            found.append((np.cumsum(steps, dtype=np.uint64), counts))
        keys, counts = _summed(*map(np.concatenate, zip(*found, strict=True)))
        values = counts.astype(np.float64) if kind == TOKEN else code_lengths(keys, counts, pairs)
        bodies = [_pack(_steps(own), values[np.searchsorted(keys, own)].astype(np.float64 if kind == TOKEN else np.float32)) for own, _ in found]
        if kind == TOKEN:
            chunks, bodies = [*chunks, -1], [*bodies, None]
        k = len(bodies)
        sums, kinds = [None] * k, [None] * k
        if kind == TOKEN:
            sums[-1], kinds[-1] = int(counts.sum()), int((counts > 0).sum())
        return pa.table({"kind": pa.array([kind] * k, pa.int32()), "chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * k, pa.int64()), "body": pa.array(bodies, pa.binary()), "total": pa.array(sums, pa.int64()), "kinds": pa.array(kinds, pa.int64())})

    return reports.where("kind IN (0, 1)").select("kind", "chunk", "part", "body").groupBy("kind", "part").applyInArrow(value, "kind int, chunk long, part long, body binary, total long, kinds long")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(16, -(-size // RANGE_BYTES))
    reports = cut(reported(docs, ranges))
    pairs = np.zeros((256, 256))
    for cell, n in reports.where("kind = 2").groupBy("cell").agg(F.sum("n")).collect():  # at most 256 x 256 rows
        pairs[cell >> 8, cell & 255] = n
    values = cut(valued(reports, pairs))
    total, kinds = (int(x or 0) for x in values.where("chunk = -1").agg(F.sum("total"), F.sum("kinds")).first())

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        tables = {}
        for kind, form in ((TOKEN, np.float64), (GRAM, np.float32)):
            parts = [_unpack(b, np.uint64, form) for k, b in zip(known.column("kind").to_pylist(), known.column("body").to_pylist(), strict=True) if k == kind]
            keys = np.concatenate([np.cumsum(s, dtype=np.uint64) for s, _ in parts])
            order = np.argsort(keys)
            tables[kind] = keys[order], np.concatenate([v for _, v in parts])[order]
        tool, out = zstandard.ZstdDecompressor(), []
        for body in texts.column("body").to_pylist():
            for piece in pa.ipc.open_stream(tool.decompress(body)):
                data, offsets = flat(piece.column(1))
                data, rows = lowered(data), piece.num_rows
                keys, text = tokens(data, offsets)
                count = tables[TOKEN][1][np.searchsorted(tables[TOKEN][0], keys)]
                base = np.bincount(text, np.log10((count + 0.1) / (total + 0.1 * (kinds + 1))), rows)
                n_tokens, n_known = np.bincount(text, minlength=rows), np.bincount(text, count > 0, rows).astype(np.int64)
                keys, text = grams(data, offsets)
                model = np.bincount(text, tables[GRAM][1][np.searchsorted(tables[GRAM][0], keys)], rows)
                columns = [piece.column(0), piece.column(2), *(pa.array(x, pa.int64()) for x in (n_tokens, n_known, np.full(rows, total))), pa.array(base), pa.array(model)]
                out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out)

    texts = reports.where("kind = -1").select("chunk", "body").groupBy("chunk")
    return texts.cogroup(values.where("chunk >= 0").select("chunk", "kind", "body").groupBy("chunk")).applyInArrow(score, SCORED)
