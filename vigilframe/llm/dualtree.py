"""Vector code compression: Lloyd's algorithm over parts of vectors, by two trees.

The parts of a block of vectors form one tree for each part position, the entries of that position's codebook another. Pairs of nodes go down both trees, all
pairs of a level at once. A pair goes when even its least distance is above the least of the largest distances of the part node's pairs, or when some entry
is nearer to the whole box of parts. A node with one entry left is assigned whole, with its cached count and sums; leaves that keep several are settled by
integer distances, ties to the lower entry.

Rounds hold no rows: tasks send one row for each entry with its count and sums, at most 16 x 64 in all after they are added up. Trees are built anew in every
pass from the vectors, so a lost executor costs its blocks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Vectors that form one tree, and parts in a leaf at most.
BLOCK, LEAF = 4096, 16


def _limit(width: int) -> float:
    """Components beyond this count as this: squared distances of parts stay below 2^62."""
    return float(int((2**60 / max(1, width // PARTS)) ** 0.5))


def integers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and floor(256 x) of their components, one row each. Without ``width``: that of the first row kept."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    fine = (sizes > 0) & (sizes % PARTS == 0) & (bad[ends] == bad[ends - sizes])
    if width is None:
        width = int(sizes[fine][0]) if fine.any() else 0
    fine &= sizes == width
    if not fine.any():
        return fine, np.zeros((0, width), np.int64)
    at = (ends - sizes)[fine]
    found = values[at[:, None] + np.arange(width)] if len(at) * width != len(values) else values.reshape(-1, width)
    return fine, np.clip(np.floor(found * SCALE), -_limit(width), _limit(width)).astype(np.int64)


class Tree:
    """Balanced k-d trees, one per part position, over points[position, point, component]; level l has 2^l nodes. Padding repeats a point with count 0."""

    def __init__(self, points: np.ndarray, leaf: int):
        parts, n, d = points.shape
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        width = -(-n // 2**self.depth)
        self.order = np.broadcast_to(np.arange(2**self.depth * width) % n, (parts, 2**self.depth * width)).copy()
        self.real = np.broadcast_to(np.arange(2**self.depth * width) < n, self.order.shape).copy()
        pts = np.take_along_axis(points, self.order[:, :, None], 1)
        for level in range(self.depth):
            shape = (parts, 2**level, -1)
            block = pts.reshape(*shape, d)
            axis = (block.max(2) - block.min(2)).argmax(-1)
            values = np.take_along_axis(block, axis[:, :, None, None], 3)[..., 0]
            half = values.shape[2] // 2
            place = np.argpartition(values, half, axis=2) if half else np.zeros_like(values, dtype=np.int64)
            pts = np.take_along_axis(block, place[..., None], 2).reshape(parts, -1, d)
            self.order = np.take_along_axis(self.order.reshape(shape), place, 2).reshape(parts, -1)
            self.real = np.take_along_axis(self.real.reshape(shape), place, 2).reshape(parts, -1)
        self.points = pts
        leaves = pts.reshape(parts, 2**self.depth, width, d)
        self.low, self.high = [leaves.min(2)], [leaves.max(2)]
        weight = self.real.reshape(parts, 2**self.depth, width)
        self.count, self.sums = [weight.sum(2)], [(leaves * weight[..., None]).sum(2)]
        for _ in range(self.depth):
            for stack, put in ((self.low, np.minimum), (self.high, np.maximum), (self.count, np.add), (self.sums, np.add)):
                stack.insert(0, put(stack[0][:, ::2], stack[0][:, 1::2]))


def _apart(low: np.ndarray, high: np.ndarray, elow: np.ndarray, ehigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between two boxes."""
    gap = np.maximum(0, np.maximum(elow - high, low - ehigh))
    far = np.maximum(ehigh - low, high - elow)
    return (gap * gap).sum(-1), (far * far).sum(-1)


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def assign(points: np.ndarray, entries: np.ndarray, leaf: int = LEAF, want: str = "codes") -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point, points[position, point, component] against entries[position, entry, component].

    ``want="codes"``: (entry, squared distance) per position and point. ``want="sums"``: (count, component sums) per position and entry.
    """
    parts, n, d = points.shape
    k = entries.shape[1]
    tree, book = Tree(points, leaf), Tree(entries, 1)
    code = np.zeros((parts, tree.order.shape[1]), np.int64)
    count, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
    width = tree.order.shape[1] >> tree.depth
    at = np.arange(parts)
    pos, node, enode = at, np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    level = elevel = 0
    while len(pos):
        # one level down in the entries first, so that part nodes of some size meet single entries; then in the parts
        if elevel < book.depth and (elevel <= level or level == tree.depth):
            pos, node, enode = np.repeat(pos, 2), np.repeat(node, 2), (2 * np.repeat(enode, 2) + np.tile([0, 1], len(enode)))
            elevel += 1
        elif level < tree.depth:
            pos, node, enode = np.repeat(pos, 2), (2 * np.repeat(node, 2) + np.tile([0, 1], len(node))), np.repeat(enode, 2)
            level += 1
        else:
            break
        rank = np.lexsort((enode, node, pos))
        pos, node, enode = pos[rank], node[rank], enode[rank]
        group = pos * (1 << level) + node
        first = _starts(group)
        low, high = tree.low[level][pos, node], tree.high[level][pos, node]
        near, far = _apart(low, high, book.low[elevel][pos, enode], book.high[elevel][pos, enode])
        sizes = np.diff(np.append(first, len(pos)))
        keep = near <= np.repeat(np.minimum.reduceat(far, first), sizes)
        if elevel == book.depth:
            keep &= ~_beaten(low, high, pos, enode, far, first, sizes, book, entries)
        pos, node, enode, group = pos[keep], node[keep], enode[keep], group[keep]
        if elevel < book.depth:
            continue
        first = _starts(group)
        alone = np.diff(np.append(first, len(pos))) == 1
        whole = first[alone]
        if len(whole):
            p, x, e = pos[whole], node[whole], book.order[pos[whole], enode[whole]]
            np.add.at(count, (p, e), tree.count[level][p, x])
            np.add.at(sums, (p, e), tree.sums[level][p, x])
            if want == "codes":
                span = width << (tree.depth - level)
                code[p[:, None], x[:, None] * span + np.arange(span)] = e[:, None]
            rest = np.repeat(~alone, np.diff(np.append(first, len(pos))))
            pos, node, enode = pos[rest], node[rest], enode[rest]
    for some in _shares(pos, node, 1 << 14):  # uncertain leaves, by integer distances
        p, x, e = pos[some], node[some], book.order[pos[some], enode[some]]
        block = tree.points.reshape(parts, -1, width, d)[p, x]
        gap = block - entries[p, e][:, None]
        dist = (gap * gap).sum(-1)
        first = _starts(p * (1 << tree.depth) + x)
        sizes = np.diff(np.append(first, len(p)))
        best = np.repeat(np.minimum.reduceat(dist, first, axis=0), sizes, axis=0)
        won = np.minimum.reduceat(np.where(dist == best, e[:, None], k), first, axis=0)
        lp, lx = p[first], x[first]
        code[lp[:, None], lx[:, None] * width + np.arange(width)] = won
        real = tree.real.reshape(parts, -1, width)[lp, lx]
        np.add.at(count, (np.broadcast_to(lp[:, None], won.shape)[real], won[real]), 1)
        np.add.at(sums, (np.broadcast_to(lp[:, None], won.shape)[real], won[real]), block[first][real])
    if want == "sums":
        return count, sums
    out = np.zeros((parts, n), np.int64)
    out[np.broadcast_to(at[:, None], code.shape)[tree.real], tree.order[tree.real]] = code[tree.real]
    gap = points - np.take_along_axis(entries, out[:, :, None], 1)
    return out, (gap * gap).sum(-1)


def _beaten(low, high, pos, enode, far, first, sizes, book: Tree, entries: np.ndarray) -> np.ndarray:
    """Entries that lose to the node's likeliest entry everywhere in the box: the difference of two squared distances is linear, so its sign at the worst corner decides."""
    index = book.order[pos, enode]
    least = np.repeat(np.minimum.reduceat(far, first), sizes)
    lead = np.repeat(np.minimum.reduceat(np.where(far == least, index, entries.shape[1]), first), sizes)
    a, b = entries[pos, lead], entries[pos, index]
    slope = 2 * (b - a)
    worst = (a * a).sum(-1) - (b * b).sum(-1) + np.where(slope > 0, slope * high, slope * low).sum(-1)  # largest |x-a|^2 - |x-b|^2
    return (index != lead) & ((worst < 0) | ((worst == 0) & (lead < index)))


def _shares(pos: np.ndarray, node: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of about ``size`` pairs that do not part the pairs of one node."""
    ends = np.append(np.flatnonzero((pos[1:] != pos[:-1]) | (node[1:] != node[:-1])) + 1, len(pos)) if len(pos) else []
    begin = 0
    for end, then in zip(ends, [*ends[1:], None], strict=True) if len(pos) else ():
        if then is None or then - begin > size:
            yield slice(begin, int(end))
            begin = int(end)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Other columns and parts[position, vector, component] of the rows kept, at most ``BLOCK`` rows at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            fine, found = integers(part.column(0), width)
            if len(found):
                yield [c.filter(pa.array(fine)) for c in part.columns[1:]], found.reshape(len(found), PARTS, -1).transpose(1, 0, 2)


def first_codebook(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """entries[position, entry, component]: the parts of the kept vectors of smallest id (null ids last; equal ids by components)."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_pylist()
            for width in sorted({s for s in sizes if s and s % PARTS == 0}):
                fine, found = integers(batch.column(1), width)
                if len(found):
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), pa.array(list(found), pa.list_(pa.int64()))], names=["vec_id", "parts"])

    kept = vectors.select("vec_id", "embedding").mapInArrow(smallest, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, parts array<long>")
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()  # at most ``entries`` rows
    if not rows:
        return np.zeros((PARTS, 0, 0), np.int64)
    width = len(rows[0].parts)
    book = np.array([r.parts for r in rows if len(r.parts) == width], np.int64)
    return book.reshape(len(book), PARTS, -1).transpose(1, 0, 2)


def moved(vectors: DataFrame, book: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""
    width, d = PARTS * book.shape[2], book.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
        for _, parts in _blocks(batches, width):
            c, s = assign(parts, book, want="sums")
            count += c
            total += s
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *(pa.array(total[p, e, j]) for j in range(d))], names=["part", "entry", "n", *(f"s{j}" for j in range(d))])

    columns = ["n", *(f"s{j}" for j in range(d))]
    each = vectors.select("embedding").mapInArrow(sums, "part int, entry int, " + ", ".join(f"{c} long" for c in columns))
    new = book.copy()
    for r in each.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in columns)).collect():  # one row for each entry
        new[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(d)]
    return new


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per kept row of (vec_id, embedding, label).

    Rows go whose vector is null or holds a null or a component that is not finite; so do rows that have no 16 equal parts, or another length than the row of
    smallest id. Components beyond 2^30 over the root of a part's width count as that. Repeated rows each count; null labels are one label. Null ids come last
    where ids are ordered. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    own = vectors.schema["label"].dataType.simpleString()
    book = first_codebook(vectors, entries)
    if book.shape[1]:
        for _ in range(rounds):
            book = moved(vectors, book)
    width, empty = PARTS * book.shape[2], not book.shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for others, parts in () if empty else _blocks(batches, width):
            code, error = assign(parts, book)
            digits = np.ascontiguousarray(code.T.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([*others, pa.array([row.tobytes().hex() for row in digits]), pa.array(error.sum(0))], names=["vec_id", "label", "code", "error"])

    found = cut(vectors.select("embedding", "vec_id", "label").mapInArrow(coded, f"vec_id {kind}, label {own}, code string, error long"))
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
