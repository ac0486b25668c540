"""Quality rules with an isolation forest over rule statistics.

The statistics of a text are counted on the whole of it. A forest of random splits is grown on all labelled rows that pass the base rules: each row is
dealt to one tree, or to several while trees have fewer than ``TREE_ROWS``, and one aggregation a level gives every node's row count and ranges. A text
whose statistics are isolated after few splits is anomalous. The threshold on that score is exact over all those rows: the highest share of bad ones
falls while at most ``GOOD_LOST`` of the good ones do. Counting and judging are one map over the documents.

Null and empty texts have no words and zero counts. Without labelled rows the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import Words, cut, flat, pieces, runs_of, spans_hash

TREES = 100
TREE_ROWS = 256  # least rows of a tree, if there are so many
DEPTH = 8
BINS = 1000  # of one pass that looks for the threshold
GOOD_LOST = 0.01
MIN_WORDS = 50
REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_lines", "n_distinct")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _lut(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(chars)] = True
    return mask


_SYMBOLS, _DIGITS, _UPPER = _lut(b"#*$%&|<>"), _lut(b"0123456789"), _lut(bytes(range(65, 91)))
_PUNCT = _lut(b".,;:!?'\"()-[]{}/\\_=+@^~`")
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, on all texts of the array at once."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    words = Words(data, offsets, alnum=False)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    points = np.concatenate([[0], np.cumsum(_LEAD[data])])
    text = words.text_of()
    out = {"n_words": words.per_text, "word_chars": np.bincount(text, points[words.end] - points[words.start], n).astype(np.int64)}
    out |= {"n_symbols": per_text(_SYMBOLS[data]), "n_upper": per_text(_UPPER[data]), "n_digits": per_text(_DIGITS[data]), "n_punct": per_text(_PUNCT[data])}

    # lines: between line feeds, never across texts
    feeds = np.flatnonzero(data == 10)
    feed_text = np.searchsorted(offsets, feeds, "right") - 1
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_text = np.sort(np.concatenate([np.arange(n), feed_text]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    has_word = np.searchsorted(words.start, begin) < np.searchsorted(words.start, end)
    begin, end, line_text = begin[has_word], end[has_word], line_text[has_word]
    lines = spans_hash(data, begin, end)
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_text, lines, n)

    hashes = words.hashes()
    out["n_distinct"] = _distinct(text, hashes, n)
    windows = runs_of(hashes, 3)
    same = text[: len(windows)] == text[2:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(same)
    order = at[np.lexsort((windows[at], text[at]))]
    equal = (windows[order[1:]] == windows[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    found = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])] if len(order) else order
    covered = np.zeros(len(text), dtype=bool)
    for k in range(3):
        covered[found + k] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    return out


def _distinct(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, text))
    t, v = text[order], values[order]
    fresh = np.ones(len(t), dtype=bool)
    fresh[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return np.bincount(t[fresh], minlength=n)


def counted(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = text_counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, STATS)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not depend on a text's length: word length, symbols and marks per word, capitals per character.

    Repeats of lines and words are left to the base rules: among texts that pass those they vary for good reasons, and every further statistic makes
    the few that tell bad texts rarer among the splits.
    """
    c = {k: np.asarray(v, dtype=float) for k, v in counts.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / chars, c["n_punct"] / words], axis=1)


@dataclass
class Forest:
    """Trees as arrays: node k splits ``feature`` at ``value`` into nodes 2k+1 and 2k+2; a leaf has feature -1 and its path length in ``value``."""

    feature: np.ndarray
    value: np.ndarray
    usual: float
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, value in zip(self.feature, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                split = feature[node]
                inner = np.flatnonzero(split >= 0)
                if not len(inner):
                    break
                node[inner] = 2 * node[inner] + 1 + (x[inner, split[inner]] >= value[node[inner]])
            total += value[node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _extents(x: np.ndarray, tree: np.ndarray, copies: int, feature: np.ndarray, value: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and greatest values at each (tree, node of ``level``). Row i is in ``copies`` trees from ``tree[i]`` on; rows in leaves above are left out."""
    first, width, n = 2**level - 1, 2**level, x.shape[1]
    count, low, high = np.zeros(TREES * width, np.int64), np.full((TREES * width, n), np.inf), np.full((TREES * width, n), -np.inf)
    for k in range(copies):
        t, node, at = (tree + k) % TREES, np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(level):
            split = feature[t[at], node[at]]
            at, split = at[split >= 0], split[split >= 0]
            node[at] = 2 * node[at] + 1 + (x[at, split] >= value[t[at], node[at]])
        place = t[at] * width + node[at] - first
        count += np.bincount(place, minlength=len(count))
        np.minimum.at(low, place, x[at])
        np.maximum.at(high, place, x[at])
    return count, low, high


def _grown(rows: int, measure: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> Forest:
    """Grows all trees level by level. ``measure(copies, feature, value, level)`` gives ``_extents`` over all rows."""
    copies = min(TREES, -(-TREES * TREE_ROWS // rows))
    usual = max(rows * copies // TREES, 1)
    depth = min(DEPTH, int(np.ceil(np.log2(max(usual, 2)))))
    size = 2 ** (depth + 1) - 1
    feature, value = np.full((TREES, size), -1, np.int64), np.zeros((TREES, size))
    for level in range(depth + 1):
        width = 2**level
        count, low, high = measure(copies, feature, value, level)
        for place in range(TREES * width):
            tree, node = place // width, place % width + width - 1
            if level and feature[tree, (node - 1) // 2] < 0:
                continue
            wide = np.flatnonzero(high[place] > low[place])
            if level == depth or count[place] <= 1 or not len(wide):
                value[tree, node] = level + _path(count[place])
                continue
            rng = np.random.default_rng((seed, tree, node))
            f = int(rng.choice(wide))
            feature[tree, node] = f
            # above the least value, or nothing would go down on the left
            value[tree, node] = max(rng.uniform(low[place, f], high[place, f]), np.nextafter(low[place, f], np.inf))
    return Forest(feature, value, max(_path(usual), 1e-9))


def grow(x: np.ndarray, seed: int = 9) -> Forest:
    """A forest from rows in hand."""
    tree = np.arange(len(x)) % TREES
    return _grown(len(x), lambda copies, feature, value, level: _extents(x, tree, copies, feature, value, level), seed)


def _grow_on(rows: DataFrame, n: int, seed: int = 9) -> Forest:
    """A forest from the ``n`` rows (tree, f0, f1, ...). A task sends one row for each node that it has rows of."""
    names = [c for c in rows.columns if c.startswith("f")]
    schema = "place int, n long, " + ", ".join(f"low{c} double, high{c} double" for c in names)

    def measure(copies: int, feature: np.ndarray, value: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in (b for b in batches if b.num_rows):
                x = np.stack([batch.column(1 + k).to_numpy() for k in range(len(names))], axis=1)
                found = _extents(x, batch.column(0).to_numpy().astype(np.int64), copies, feature, value, level)
                total = found if total is None else (total[0] + found[0], np.minimum(total[1], found[1]), np.maximum(total[2], found[2]))
            if total is not None:
                at = np.flatnonzero(total[0])
                sides = [pa.array(side[at, k]) for k in range(len(names)) for side in total[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), *sides], schema=None, names=["place", "n", *(f"{s}{c}" for c in names for s in ("low", "high"))])

        sides = [f(f"{s}{c}").alias(f"{s}{c}") for c in names for s, f in (("low", F.min), ("high", F.max))]
        got = rows.select("tree", *names).mapInArrow(extents, schema).groupBy("place").agg(F.sum("n").alias("n"), *sides).collect()
        count, low, high = np.zeros(TREES * 2**level, np.int64), np.full((TREES * 2**level, len(names)), np.inf), np.full((TREES * 2**level, len(names)), -np.inf)
        for r in got:
            count[r["place"]], low[r["place"]], high[r["place"]] = r["n"], [r[f"low{c}"] for c in names], [r[f"high{c}"] for c in names]
        return count, low, high

    return _grown(n, measure, seed)


def _from_top(scores: DataFrame, rank: int) -> float:
    """The value of column ``score`` that exactly ``rank`` rows stand before, in falling order: the range that holds it is cut into bins until it is one value."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        place = F.least(F.lit(BINS - 1), F.floor((F.col("score") - F.lit(low)) / F.lit(high - low) * BINS))
        bins = scores.where(F.col("score").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
        for r in sorted(bins, key=lambda r: r["bin"], reverse=True):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def learn(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest and threshold from all labelled rows that pass the base rules."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    schema = "tree int, " + ", ".join(f"f{k} double" for k in range(4)) + ", quality int"

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(COUNTS)}
            passed = pa.array(~base_failed(found["n_words"], found["n_repeat_words"]))
            columns = [batch.column(len(COUNTS)), *(pa.array(f) for f in features(found).T), batch.column(len(COUNTS) + 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", *(f"f{k}" for k in range(4)), "quality"]).filter(passed)

    tree = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(TREES)).cast("int").alias("tree")
    rows = cut(counted(docs).join(known, "doc_id").select(*COUNTS, tree, F.col("quality").cast("int").alias("quality")).mapInArrow(usable, schema))
    n, good = rows.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    if n < 4:
        return None
    forest = _grow_on(rows, n)
    if good:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(forest.score(np.stack([c.to_numpy() for c in batch.columns], axis=1)))], names=["score"])

        scores = cut(rows.where("quality = 1").select(*(f"f{k}" for k in range(4))).mapInArrow(score, "score double"))
        forest.threshold = _from_top(scores, int(GOOD_LOST * good)) + 1e-9
    return forest


def judged(counts: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds base_failed, anomaly (0 to 1) and kept to the columns of ``counted``."""
    schema = STATS + ", base_failed boolean, anomaly double, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: batch.column(1 + k).to_numpy(zero_copy_only=False) for k, c in enumerate(COUNTS)}
            failed = base_failed(found["n_words"], found["n_repeat_words"])
            anomaly = forest.score(features(found)) if forest else np.zeros(batch.num_rows)
            kept = ~failed & (anomaly <= (forest.threshold if forest else 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(anomaly), pa.array(kept)], names=[*batch.schema.names, "base_failed", "anomaly", "kept"])

    return counts.mapInArrow(judge, schema)
