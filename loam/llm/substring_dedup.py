"""Operator 7, substring dedup: a count-min sketch of all windows, merged from sketches of the partitions, overestimates how often each
window occurs; a second pass groups exactly only the windows that it estimates repeated, and so loses none.

The sketch has two rows of 2**16 to 2**max_log2 counters, chosen at about four a window, that stop at 255. Beside it, and in the same
pass, a smaller one counts the minimisers of windows: a window occurs no more often than its minimiser, so a window is estimated
repeated only if both sketches say so, which holds the number of wrong estimates down when the counters fill. Sketches of partitions
are sparse and cut into blocks of counters; the merge streams through the partitions' parts of one block at a time. What goes to the
executors is one bit a counter, whether it has LEAST or more: 72 MB at most as the defaults stand. Beyond that many windows the
filter grows weaker and the second pass larger, but the result stays the same.

Defined cases: a null, empty or blank text has no words; texts under SIZE words lose none; a very long text is one row of a task, with
a few numbers of 8 bytes for each of its words; rows with one doc_id are documents of their own that are no repeats of one another; a
null doc_id neither removes nor loses words; an empty table gives no rows; extra columns, whatever their names, are ignored by
`removals` and kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, mixed, modest_batches, raw_texts, table, word_hashes, written
from .passages import GRAM, SIZE, WINDOW_SCHEMA, Windows, classes, covered, grams_and_minimisers, keyed, repeats, representatives, rewritten, tools

MAX_LOG2, BLOCK_LOG2, LEAST = 28, 16, 2
#: The minimisers are so many times fewer that their sketch has 2**3 times fewer counters.
FEWER_LOG2 = 3
HOLD = 1 << 20


def block_log2(log2: int) -> int:
    """A block's counters, as a power of two."""
    return min(BLOCK_LOG2, log2)


def cells(h: np.ndarray, log2: int) -> np.ndarray:
    """The two counters of each window hash; those of the second row come after all of the first."""
    low = np.uint64((1 << log2) - 1)
    with np.errstate(over="ignore"):
        return np.stack([h & low, (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) & low) + np.uint64(1 << log2)])


def blocks_of(h: np.ndarray, log2: int, kind: int) -> pa.RecordBatch:
    """A sparse sketch of hashes of a kind: for each block of counters the places in it and, behind them, their counts."""
    flat = np.sort(cells(h, log2).ravel())
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.minimum(np.diff(at, append=len(flat)), 255).astype(np.uint8)
    flat = flat[at]
    wide = block_log2(log2)
    block = (flat >> np.uint64(wide)).astype(np.int32)
    place = (flat & np.uint64((1 << wide) - 1)).astype("<u2")
    edges = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    parts = [place[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(flat)])]
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(edges), pa.int32()), "block": pa.array(block[edges]), "counts": pa.array(parts, pa.binary())})


def merged(parts: DataFrame) -> DataFrame:
    """kind, block and its counters (a byte each), summed over the sparse sketches of all partitions."""

    def merge(batches):
        now, counter = None, np.zeros(1 << BLOCK_LOG2, np.uint32)

        def done():
            return pa.RecordBatch.from_pydict({"kind": pa.array(now[:1], pa.int32()), "block": pa.array(now[1:], pa.int32()), "counters": pa.array([np.minimum(counter, 255).astype(np.uint8).tobytes()], pa.binary())})

        for batch in batches:
            for *key, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "counts"))):
                if key != now:
                    if now is not None:
                        yield done()
                    now = key
                    counter[:] = 0
                n = len(counts) // 3
                place, own = np.frombuffer(counts, "<u2", n), np.frombuffer(counts, np.uint8, n, 2 * n)
                counter[place] = np.minimum(counter[place] + own, 255)
        if now is not None:
            yield done()

    return parts.repartition("kind", "block").sortWithinPartitions("kind", "block").mapInArrow(merge, "kind int, block int, counters binary")


def logs(log2: int) -> tuple[int, int]:
    """The counters in a row of both sketches, as powers of two."""
    return log2, max(4, log2 - FEWER_LOG2)


def sketch(documents: DataFrame, log2: int, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The merged count-min sketches of all windows (kind 0) and their minimisers (kind 1): kind, block, counters."""

    def partial(batches):
        seen, a, _ = tools()
        held: tuple[list, list] = ([], [])
        n = 0

        def flush():
            for kind, own in enumerate(held):
                yield blocks_of(np.concatenate(own), logs(log2)[kind], kind)

        for batch in batches:
            for text in raw_texts(batch):
                words = text.split()
                if len(words) >= size:
                    w = word_hashes(words, seen)
                    g, at = grams_and_minimisers(w, a, size, gram)
                    held[0].append(a(w, size))
                    held[1].append(g[np.unique(at)])
                    n += len(at)
                if n >= HOLD:
                    yield from flush()
                    held, n = ([], []), 0
        if n:
            yield from flush()

    modest_batches(documents.sparkSession)
    return merged(documents.select("text").mapInArrow(partial, "kind int, block int, counts binary"))


def often(counters: DataFrame, log2: int, least: int = LEAST) -> list[np.ndarray]:
    """For both sketches a bit for each counter, whether it is least or more; rows come one by one, a few thousand of 8 KB at most."""

    def run(batch: pa.RecordBatch) -> dict:
        bits = [np.packbits(np.frombuffer(c, np.uint8) >= least, bitorder="little").tobytes() for c in batch.column("counters").to_pylist()]
        return {"kind": batch.column("kind"), "block": batch.column("block"), "bits": pa.array(bits, pa.binary())}

    out = [np.zeros(max(2 << x >> 3, 1), np.uint8) for x in logs(log2)]
    for row in map_arrow(counters, run, "kind int, block int, bits binary").toLocalIterator():
        width = 1 << block_log2(logs(log2)[row.kind]) >> 3
        out[row.kind][row.block * width : (row.block + 1) * width] = np.frombuffer(row.bits, np.uint8)[:width]
    return out


def set_in(bits: np.ndarray, h: np.ndarray, log2: int) -> np.ndarray:
    """Whether both counters of each hash are set."""
    c = cells(h, log2)
    return ((bits[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def estimated(documents: DataFrame, bits, log2: int, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The windows that are estimated to occur LEAST times or more, as their minimisers are."""

    def run(batch: pa.RecordBatch) -> dict | None:
        seen, a, b = tools()
        (of_windows, of_grams), out = bits.value, Windows()
        for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), raw_texts(batch)):
            words = text.split()
            if len(words) < size:
                continue
            w = word_hashes(words, seen)
            g, at = grams_and_minimisers(w, a, size, gram)
            keep = np.flatnonzero(set_in(of_grams, g, logs(log2)[1])[at])
            if not len(keep):
                continue
            h = a(w, size)
            keep = keep[set_in(of_windows, h[keep], log2)]
            if len(keep):
                out.add(doc_id, part, keep, h[keep], b(w, size)[keep])
        return out.columns()

    return map_arrow(documents, run, WINDOW_SCHEMA)


def removals(documents: DataFrame, size: int = SIZE, max_log2: int = MAX_LOG2) -> DataFrame:
    """doc_id, part, whole (all words go) and starts of repeated windows, of the rows that lose words."""
    known = classes(documents)
    texts = representatives(documents, known, size)
    words = known.filter("doc_id = rep").agg(F.sum("n_words").alias("n")).first().n or 0
    log2 = int(min(max_log2, max(16, np.ceil(np.log2(4 * words + 1)))))
    bits = documents.sparkSession.sparkContext.broadcast(often(sketch(texts, log2, size), log2))
    found = repeats(written(estimated(texts, bits, log2, size), "windows"))
    copies = known.filter((F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= size)).select("doc_id", "part").distinct()
    return copies.select("doc_id", "part", F.lit(True).alias("whole"), F.expr("cast(null as array<int>)").alias("starts")).unionByName(found.select("doc_id", "part", F.lit(False).alias("whole"), "starts"))


def kept_words(text: bytes | None, whole: bool | None, starts: list | None, size: int = SIZE) -> tuple[int, list[bytes]]:
    """The number of words, and the words that stay."""
    words = text.split() if text else []
    if whole:
        return len(words), []
    if not starts:
        return len(words), words
    return len(words), [words[i] for i in np.flatnonzero(~covered(len(words), starts, size)).tolist()]


def digests(documents: DataFrame, size: int = SIZE) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        for text, whole, starts in zip(raw_texts(batch), batch.column("whole").to_pylist(), batch.column("starts").to_pylist()):
            n, stay = kept_words(text, whole, starts, size)
            n_words.append(n)
            n_removed.append(n - len(stay))
            kept.append(hashlib.sha256(b" ".join(stay)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed, "kept_sha256": kept}

    rows = keyed(documents).join(removals(documents, size), ["doc_id", "part"], "left")
    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """documents, same columns; a text that loses words is its remaining words joined by one space."""
    return rewritten(documents, removals(documents, size), lambda text, whole, starts: b" ".join(kept_words(text, whole, starts, size)[1]), ["whole", "starts"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
