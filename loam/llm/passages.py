"""What the two dedups of repeated passages share: classes of copies, rows, windows, and which windows go.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return, unchanged. A window is
SIZE consecutive words of a document. A window of a document is a repeat if its words also start somewhere in a document with a
smaller doc_id; the words that repeats cover are removed, judged on the input.

Every row is a document of its own: rows that share a doc_id but not a text are told apart by a hash of the text (`part`, 31 bits
within one doc_id), are never repeats of one another, and each loses its own words. Rows that are equal in doc_id and text are treated
alike.

The minimiser of a window is the leftmost of its GRAM-word sequences with the lowest hash: it follows from the window's words alone,
so equal windows have equal minimisers, and the minimisers of a document are about one in eighteen of its words.

Documents with equal word sequences are one class, and its smallest doc_id stands for it: every window of the others starts in that
document, so of them all words go (if there are SIZE at least), and they take no part in what follows. Rows whose doc_id is null
remove nothing and lose nothing.

Windows are equal if two independent hashes of them are, 96 bits together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, Rolling, WordHash, apart, join_hot, map_arrow, raw_texts, signed, small, worker_state, written

SIZE, GRAM = 50, 16
BROADCAST_ROWS = 1_000_000


def tools() -> tuple[WordHash, Rolling, Rolling]:
    return worker_state("windows", lambda: (WordHash(), Rolling(BASE_A), Rolling(BASE_B)))


def grams_and_minimisers(w: np.ndarray, rolling, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all gram-word sequences, and for each window the place of its minimiser."""
    g = rolling(w, gram)
    span = size - gram + 1
    if len(g) < span:
        return g, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    return g, np.arange(len(view)) + view.argmin(1)


def part_of(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, part and text of each row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), part_of(F.col("text")).alias("part"), "text")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, part, n_words and rep (the smallest doc_id with the same words) of each row; written."""

    def run(batch: pa.RecordBatch) -> dict:
        n, d1, d2 = [], [], []
        for text in raw_texts(batch):
            words = text.split() if text else []
            h = xxhash.xxh3_128_intdigest(b" ".join(words))
            n.append(len(words))
            d1.append((h >> 64) - (1 << 63))
            d2.append((h & (1 << 64) - 1) - (1 << 63))
        return {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "n_words": n, "d1": d1, "d2": d2}

    rows = written(map_arrow(keyed(documents), run, "doc_id long, part int, n_words long, d1 long, d2 long"), "words")
    copies = rows.filter("doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("last > rep").drop("last")
    out = join_hot(rows, written(copies, "copies"), ["d1", "d2"], "left")
    return written(out.select("doc_id", "part", "n_words", F.coalesce("rep", "doc_id").alias("rep")), "classes")


def representatives(documents: DataFrame, known: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, part and text of the rows that stand for their class and have a window."""
    copies = small(known.filter("doc_id > rep").select("doc_id", "part").distinct(), BROADCAST_ROWS)
    # fewer characters than two to a word, one separator and the last word can't have a window
    long = keyed(documents).filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * size - 1))
    return long.join(copies, ["doc_id", "part"], "left_anti")


#: at: part and start in one number. h1 and h2: the hashes.
WINDOW_SCHEMA = "h1 long, h2 int, doc_id long, at long"


class Windows:
    """Columns of WINDOW_SCHEMA, gathered document by document."""

    def __init__(self):
        self.doc_ids, self.at, self.h1, self.h2 = [], [], [], []

    def add(self, doc_id: int, part: int, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        self.doc_ids.append(np.full(len(starts), doc_id, np.int64))
        self.at.append((part << 32) + starts.astype(np.int64))
        self.h1.append(h1)
        self.h2.append(h2)

    def columns(self) -> dict | None:
        if not self.doc_ids:
            return None
        return {"h1": signed(np.concatenate(self.h1)), "h2": folded(np.concatenate(self.h2)), "doc_id": np.concatenate(self.doc_ids), "at": np.concatenate(self.at)}


def folded(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def repeats(windows: DataFrame) -> DataFrame:
    """doc_id, part and starts of the windows (written) that also start in a document with a smaller doc_id.

    Per window the smallest and largest doc_id, reduced before the shuffle; only windows of two documents or more go on, and those of
    hot ones meet their first document by broadcast."""
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("last > first").drop("last")
    found = join_hot(windows, written(first, "repeated"), ["h1", "h2"]).filter("doc_id > first")
    start = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return found.groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("part")).agg(F.array_sort(F.collect_list(start)).alias("starts"))


def covered(n: int, starts, size: int = SIZE) -> np.ndarray:
    """Whether each of n words is in [s, s + size) of one of the starts."""
    change = np.zeros(n + 1, np.int64)
    s = np.asarray(starts, np.int64)
    np.add.at(change, s, 1)
    np.add.at(change, s + size, -1)
    return np.cumsum(change[:-1]) > 0


def rewritten(documents: DataFrame, gone: DataFrame, kept, columns: list[str]) -> DataFrame:
    """documents, same columns; kept(text, *columns of gone) gives the text of each row that gone (doc_id, part and columns) names."""
    own, names = apart(documents)
    doc_id, text = names["doc_id"], names["text"]
    rows = own.withColumns({"doc_id": F.col(doc_id).cast("long"), "part": part_of(F.col(text))}).join(gone, ["doc_id", "part"], "left").drop("doc_id", "part")

    def run(batch: pa.RecordBatch) -> dict:
        texts = [kept(t, *x) if any(v is not None for v in x) else t for t, *x in zip(raw_texts(batch, text), *(batch.column(c).to_pylist() for c in columns))]
        return {c: batch.column(c) for c in names.values()} | {text: pa.array(texts, pa.binary()).cast(pa.string())}

    return map_arrow(rows, run, ", ".join(f"{c} {t}" for c, t in own.dtypes)).toDF(*names)


def brute(documents: list[tuple], size: int = SIZE) -> list[tuple]:
    """(doc_id, words, list of whether each goes) of each row, by a table of all windows."""
    words = [(d, (t or "").encode().split()) for d, t in documents]
    first: dict = {}
    for d, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, w, gone))
    return out
