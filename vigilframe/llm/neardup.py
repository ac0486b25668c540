"""Near-duplicate documents by an LSH forest.

Every document's set of word shingles gets one minhash signature. The signature is laid out in several orders of its slots; each order is sorted
over all documents by range partitions, so a crowded region is spread over many tasks. In a sorted order the neighbours with the longest common
prefix are the candidates: where many documents share a prefix, the sort goes on to deeper slots by itself, which is the depth that adapts to each
region. A sketch kept in each entry drops neighbours that are plainly different. What is left is compared on the full sets, hub by hub, and the
confirmed links are closed to components. A refused pair proposes the hubs of either side to the other, until none proposes a new pair: so all edits
of one text meet it, however many of them crowd around it.

Equal sets are one class from the start, so copies are never paired with each other. A text without words is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import Words, cut, flat, lowered, mixed, pieces, released, runs_of

SHINGLE = 5
SLOTS = 128
ORDERS = 20
WHOLE = 2  # slots that stand whole at the start of a sort key
DEPTH = 18  # slots that one order sorts by; those after the first ``WHOLE`` give 16 bits each
NEIGHBOURS = 3  # entries before and after that are looked at in each order
SKETCH_AGREE = 98  # of 128 two-bit slots: below it a link at 0.85 is out by more than four standard deviations
BEST = 3  # candidates of each set that the first round compares; later ones compare all that is open between different components
HUB = 2  # a neighbour with so many times a text's links counts as a hub of it
PART_ROWS = 100_000  # rows of pairs or links that one task writes
ROUNDS = 100  # a guard: every round compares pairs that no earlier one has, so the rounds end by themselves

_SEEDS = np.random.default_rng(85).integers(1, 1 << 63, (2, SLOTS), dtype=np.uint64) | np.uint64(1)
_LAYOUT = np.stack([np.random.default_rng(order).permutation(SLOTS)[:DEPTH] for order in range(ORDERS)])
_TIES = np.random.default_rng(86).integers(1, 1 << 63, ORDERS, dtype=np.uint64) | np.uint64(1)

SIGNED = "doc_id long, n_shingles long, set_id binary, signature binary, packed binary"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text's words are one shingle."""
    data, offsets = flat(texts)
    words = Words(lowered(data), offsets, alnum=False)
    hashes = words.hashes()
    runs = runs_of(hashes, size)
    out = []
    for first, n in zip(words.first.tolist(), words.per_text.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(runs[first : first + n - size + 1]))
        else:
            out.append(mixed(runs_of(hashes[first : first + n], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def _signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(SLOTS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _SEEDS[0] + _SEEDS[1]
        np.minimum(low, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=low)
    return low


def signed(docs: DataFrame, size: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: set size, identity of the set, signature, the packed text for the comparison on full sets, and the columns named in ``carry``."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    schema = SIGNED + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(1)
                sets = shingle_sets(texts, size)
                ids = [np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mixed(s))], dtype=np.uint64).tobytes() if len(s) else None for s in sets]
                signatures = [_signature(s).tobytes() if len(s) else None for s in sets]
                packed = [pack.compress(t.as_buffer()) if t.is_valid else None for t in texts]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (ids, signatures, packed)), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "signature", "packed", *part.schema.names[2:]])

    return chosen.mapInArrow(released(sign), schema)


def _entries(sets: DataFrame) -> DataFrame:
    """One row per set and order: the key that is sorted (order, slots, and a tie-break of this order's own), the two-bit sketch, the set."""

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                slots = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, SLOTS)
                sketch = _sketch(slots)
                n = len(slots)
                laid = slots[:, _LAYOUT]
                ties = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64).reshape(n, -1)[:, :1] * _TIES
                keys = np.concatenate([
                    np.broadcast_to(np.arange(ORDERS, dtype=np.uint8)[None, :, None], (n, ORDERS, 1)),
                    np.ascontiguousarray(laid[:, :, :WHOLE].astype(">u4")).view(np.uint8),
                    np.ascontiguousarray(laid[:, :, WHOLE:].astype(np.uint16).astype(">u2")).view(np.uint8),
                    (ties >> np.uint64(48)).astype(">u2")[:, :, None].view(np.uint8),
                ], axis=2)
                numbers = np.repeat(np.arange(n), ORDERS)
                yield pa.RecordBatch.from_arrays(
                    [_fixed(keys.reshape(n * ORDERS, -1)), _fixed(sketch).take(pa.array(numbers)), part.column(0).take(pa.array(numbers))], names=["key", "sketch", "set_id"],
                )

    return sets.select("set_id", "signature").mapInArrow(released(lay_out), "key binary, sketch binary, set_id binary")


def _sketch(slots: np.ndarray) -> np.ndarray:
    bits = np.unpackbits((slots & 3).astype(np.uint8)[:, :, None], axis=2)[:, :, 6:].reshape(len(slots), -1)
    return np.packbits(bits, axis=1)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots in which two-bit sketches agree."""
    apart = x ^ y
    apart = (apart | (apart >> 1)) & 0x55
    return SLOTS - np.bitwise_count(apart).sum(axis=1, dtype=np.int64)


def _fixed(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _close(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of sorted entries of one order that share a prefix and whose sketches agree, with the slots that agree."""
    left, right, agree = [], [], []
    for lag in range(1, NEIGHBOURS + 1):
        if len(keys) <= lag:
            break
        near = np.flatnonzero((keys[lag:, :5] == keys[:-lag, :5]).all(axis=1))
        same = _agreeing(sketches[near + lag], sketches[near])
        keep = same >= SKETCH_AGREE
        left.append(near[keep])
        right.append(near[keep] + lag)
        agree.append(same[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, agree))


PAIR = "a binary, b binary, agree int, edge int, rank int, key binary, sketch binary"


def _neighbours(entries: DataFrame) -> DataFrame:
    """Candidate pairs of neighbouring entries. Entries at the two ends of each range are passed on, so that neighbours in different ranges meet too."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no = TaskContext.get().partitionId()
        tail: tuple = ()
        first = True
        for batch in (b for b in batches if b.num_rows):
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ids = batch.column(2).to_pylist()
            if first:
                yield _edge(keys[:NEIGHBOURS], sketches, ids, part_no, 1)
                first = False
            if tail:
                keys, sketches, ids = np.concatenate([tail[0], keys]), np.concatenate([tail[1], sketches]), tail[2] + ids
            a, b, agree = _close(keys, sketches)
            fresh = b >= (len(tail[2]) if tail else 0)
            a, b, agree = a[fresh], b[fresh], agree[fresh]
            names = pa.array(ids, pa.binary())
            none = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(agree, pa.int32()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()), none, none], names=["a", "b", "agree", "edge", "rank", "key", "sketch"])
            tail = keys[-NEIGHBOURS:], sketches[-NEIGHBOURS:], ids[-NEIGHBOURS:]
        if tail:
            yield _edge(*tail, part_no + 1, 0)

    return entries.mapInArrow(released(pairs), PAIR)


def _edge(keys: np.ndarray, sketches: np.ndarray, ids: list, edge: int, side: int) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:n], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array([side * NEIGHBOURS + k for k in range(n)], pa.int32()),
         pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([s.tobytes() for s in sketches[:n]], pa.binary())],
        names=["a", "b", "agree", "edge", "rank", "key", "sketch"],
    )


def _across(edges: DataFrame) -> DataFrame:
    """Pairs between the last entries of one range and the first of the next: at most twice ``NEIGHBOURS`` rows a group."""

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        a, b, agree = _close(*(np.array([list(r[c]) for r in rows], dtype=np.uint8) for c in ("key", "sketch")))
        ids = [r["a"] for r in rows]
        return pa.table({"a": pa.array([ids[i] for i in a], pa.binary()), "b": pa.array([ids[i] for i in b], pa.binary()), "agree": pa.array(agree, pa.int32())})

    return edges.groupBy("edge").applyInArrow(meet, "a binary, b binary, agree int")


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct (a, b, agree) with a < b: neighbours in at least one order whose sketches agree. ``sets``: set_id, signature, one row a set."""
    entries = _entries(sets)
    spread = max(8, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut(_neighbours(entries.repartitionByRange(spread, "key", "set_id").sortWithinPartitions("key", "set_id")))
    pairs = found.where("b IS NOT NULL").select("a", "b", "agree").unionByName(_across(found.where("edge IS NOT NULL")))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "agree").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """Pairs with ``linked``: whether 100 * intersection >= percent * union on the full sets. ``texts``: set_id, packed."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for part in _chunks(batch):
                linked = []
                for a, b, x, y in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if len(known) > 64:
                        known.clear()
                    for key, packed in ((a, x), (b, y)):
                        if key not in known:
                            known[key] = shingle_sets(pa.array([unpack.decompress(packed)], pa.binary()), size)[0]
                    common = len(np.intersect1d(known[a], known[b], assume_unique=True))
                    linked.append(100 * common >= percent * (len(known[a]) + len(known[b]) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    left = texts.select(F.col("set_id").alias("a"), F.col("packed").alias("x"))
    right = texts.select(F.col("set_id").alias("b"), F.col("packed").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(released(compare), "a binary, b binary, linked boolean")


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 256):
        yield batch.slice(at, 256)


def components(links: DataFrame, parts: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each linked node reaches. Alternates large-star and small-star steps until nothing changes.

    A node's smallest neighbour is an aggregate that combines before the shuffle, and the join that follows is an ordinary one, which Spark can
    split where one node has very many links. Nothing is collected; each step is written to the shared folder, in ``parts`` files.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().coalesce(parts))
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, before = cut(small.where("u <> v").distinct().coalesce(parts)), mark
        mark = _mark(edges)
        if mark == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another: how many there are, and two sums of their hashes."""
    return tuple(edges.select(F.xxhash64("u", "v").alias("h"), F.hash("u", "v").alias("g")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.sum("g")).first())


def _resolved(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """(set_id, root): the component of every set, named by one of its sets. ``rows``: what ``signed`` gives, with a ``row`` number.

    Only sets that have a candidate take part in what follows, and their texts are written once.
    """
    classes = cut(rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("row")))
    open_pairs = cut(candidates(rows.select("row", "signature").join(classes, "row").select("set_id", "signature")))
    parts = max(8, -(-open_pairs.count() // PART_ROWS))
    members = open_pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    # the sketch stays beside the text: proposals are judged by it before texts are compared
    texts = cut(rows.select("row", "packed", "signature").join(classes.join(members, "set_id"), "row").select("set_id", "packed", _sketches("signature").alias("sketch")))
    checked = roots = fresh = refused = hubs = None
    for turn in range(ROUNDS):
        if checked is None:  # each set's best neighbours first; links between those usually join a whole group, and the rest need no comparison
            ends = open_pairs.select(F.col("a").alias("n"), "a", "b", "agree").unionByName(open_pairs.select(F.col("b").alias("n"), "a", "b", "agree"))
            best = F.slice(F.sort_array(F.collect_list(F.struct("agree", "a", "b")), asc=False), 1, BEST)  # of at most 2 * NEIGHBOURS * ORDERS
            left = ends.groupBy("n").agg(best.alias("p")).select(F.inline("p")).select("a", "b").distinct()
        else:
            # a pair is judged by components once when it is refused: proposals are new when the refusal is, or when a hub is new to an earlier refusal
            lately, before = cut(_apart(fresh.where("NOT linked").select("a", "b"), roots)), hubs
            hubs = cut(_hubs(checked.where("linked").select("a", "b")))
            proposed = _proposed(lately, hubs).join(checked, ["a", "b"], "left_anti")
            if refused is not None:
                late = cut(hubs.join(before, ["n", "hub"], "left_anti"))
                proposed = proposed.unionByName(_apart(_proposed(refused, late).join(checked, ["a", "b"], "left_anti"), roots)).distinct()
            left = _alike(proposed, texts)
            if turn == 1:  # what the first round left of the candidates; afterwards they are all compared or inside one component
                left = _apart(open_pairs.select("a", "b").join(checked, ["a", "b"], "left_anti"), roots).unionByName(left).distinct()
            refused = lately if refused is None else cut(refused.unionByName(lately).coalesce(parts))
        fresh = cut(confirmed(left, texts, percent, size).coalesce(16 * parts))
        if fresh.isEmpty():
            break
        links = fresh.where("linked").select("a", "b")
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        checked = fresh if checked is None else cut(checked.unionByName(fresh).coalesce(parts))
        if roots is None or not fresh.where("linked").isEmpty():  # without a new link the components stay as they are
            roots = cut(components(links, parts).coalesce(parts))
    else:
        raise RuntimeError(f"near-duplicate candidates are left after {ROUNDS} rounds")
    named = classes.select("set_id")
    if roots is None:
        return named.withColumn("root", F.col("set_id"))
    return named.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A null id names no component unless all its members have none. Rows that repeat an id are judged by their own text each.
    """
    rows = cut(signed(docs, size).withColumn("row", F.monotonically_increasing_id()))
    roots = _resolved(rows, percent, size)
    ids = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least_id")).join(roots, "set_id")
    named = roots.join(ids.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("set_id", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def kept_rows(docs: DataFrame, percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """``docs`` with exactly one row of each component: the one with the smallest id. Rows without words all stay."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = cut(signed(docs, size, carry).withColumn("row", F.monotonically_increasing_id()))
    roots = _resolved(rows, percent, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    own = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(first.alias("first")).join(roots, "set_id")
    kept = own.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    kept = kept.unionByName(rows.where("set_id IS NULL").select("row"))
    chosen = rows.join(kept, "row", "left_semi").select("doc_id", "packed", *(c for c in rows.columns if c.startswith("carried_")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _chunks(batch):
                texts = [None if p is None else tool.decompress(p).decode() for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *part.columns[2:]], names=["doc_id", "text", *part.schema.names[2:]])

    schema = "doc_id long, text string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:])
    return chosen.mapInArrow(released(unpack), schema).select(*(F.col(c if c in ("doc_id", "text") else f"carried_{c}").alias(c) for c in docs.columns))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The (a, b) whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _hubs(links: DataFrame) -> DataFrame:
    """(n, hub): a text's most linked neighbour, and all neighbours with ``HUB`` times its own links or more."""
    ends = links.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(links.select(F.col("b").alias("n"), F.col("a").alias("m")))
    degree = ends.groupBy("n").agg(F.count("*").alias("degree"))
    rated = ends.join(degree.select(F.col("n").alias("m"), "degree"), "m")
    top = rated.groupBy("n").agg(F.max_by("m", F.struct("degree", "m")).alias("hub"))
    large = rated.join(degree.withColumnRenamed("degree", "own"), "n").where(F.col("degree") >= HUB * F.col("own")).select("n", F.col("m").alias("hub"))
    return top.unionByName(large).distinct()


def _proposed(refused: DataFrame, hubs: DataFrame) -> DataFrame:
    """For every refused pair: each side with the hubs of the other, one of which is often the text both were made from.

    A hub is linked with its text, so a proposal of a pair between two components is one between the same two.
    """
    one = refused.join(hubs.withColumnRenamed("n", "b"), "b").select("a", F.col("hub").alias("b"))
    other = refused.join(hubs.withColumnRenamed("n", "a"), "a").select("b", F.col("hub").alias("a"))
    return one.unionByName(other).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sketches(signature: str) -> Column:
    def lay(signatures: pd.Series) -> pd.Series:
        if signatures.empty:
            return signatures
        return pd.Series([r.tobytes() for r in _sketch(np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, SLOTS))])

    return F.pandas_udf(lay, "binary")(signature)


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sketches agree as much as a candidate's must."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(_agreeing(x, y) >= SKETCH_AGREE))

    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(texts.select(F.col("set_id").alias(end), F.col("sketch").alias(name)), end)
    return pairs.select("a", "b", "x", "y").mapInArrow(released(judge), "a binary, b binary")
