"""Operator 10, suffix-array dedup: a sparse suffix array of the suffixes that begin at minimisers, sorted; neighbours are compared,
and matches extended to the left and right of the minimiser.

1. A suffix is known by its key: the hash of its first GRAM words and a byte of hash for each pair of the words after it, as far as a
   window can go. Keys are dealt by the first GRAM words and sorted; in sorted order a suffix's longest match with any other is its
   match with one of its two neighbours. Equal words have equal bytes, so that length is the true one or a little more: to the right
   of a minimiser there is no repeat beyond it, and a suffix without a neighbour goes no further.
2. The others come with their words: those of the suffix to its reach, and those before it that a window can hold. Sorted by the
   words to the right, and once more by those to the left, each is compared with the nearest suffixes above and below that belong to a
   smaller doc_id, and with that of the smallest; the match is extended to the right and, from the minimiser, to the left. SIZE words or more are a repeated span.
3. Windows within reach that no such match covers (the first occurrence itself, and repeats whose left and right sides match
   different neighbours best) are matched exactly by their hashes. A window that is covered has an occurrence in a smaller document
   that is not, so the first occurrence is always among those left.
   A hot gram is dealt to many tasks by its documents, each of which compares and extends the suffixes it has; what they miss of
   one another is left to this step, where equal windows are reduced before the shuffle.

The result is the same set of words as that of substring dedup: those in a window that also starts in a document with a smaller
doc_id. Every window has a minimiser within it, so none is missed.

Defined cases: a null, empty or blank text has no words; texts under SIZE words have no span; a very long text is one row of a task,
with a few numbers of 8 bytes for each of its words; rows with one doc_id are documents of their own that are no repeats of one another;
a null doc_id neither removes nor loses words; an empty table gives no rows; extra columns, whatever their names, are ignored by `spans`
and kept by `deduplicated`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_FROM, hot_keys, map_arrow, mixed, raw_texts, signed, table, word_hashes, written
from .passages import GRAM, SIZE, classes, folded, grams_and_minimisers, repeats, representatives, rewritten, tools

def suffixes(documents: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """gram, rest (a byte for each pair of words), doc_id, part and place of each retained suffix."""
    pairs = (size - gram + 1) // 2

    def run(batch: pa.RecordBatch) -> dict | None:
        seen, a, _ = tools()
        grams, rests, owner, counts, places = [], [], [], [], []
        for i, text in enumerate(raw_texts(batch)):
            words = text.split()
            if len(words) < size:
                continue
            w = word_hashes(words, seen)
            g, at = grams_and_minimisers(w, a, size, gram)
            at = np.unique(at)
            with np.errstate(over="ignore"):
                two = np.concatenate([(mixed(w[:-1] * np.uint64(3) + w[1:]) >> np.uint64(40)).astype(np.uint8), np.zeros(2 * pairs + 1, np.uint8)])
            rests.append(two[(at + gram)[:, None] + 2 * np.arange(pairs)])
            grams.append(g[at].view(np.int64))
            places.append(at.astype(np.int32))
            owner.append(i)
            counts.append(len(at))
        if not counts:
            return None
        flat = np.concatenate(rests)
        rest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(pairs), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
        rows = np.repeat(np.array(owner), counts)
        return {"gram": np.concatenate(grams), "rest": rest, "doc_id": batch.column("doc_id").take(pa.array(rows)), "part": batch.column("part").take(pa.array(rows)), "place": np.concatenate(places)}

    return map_arrow(documents, run, "gram long, rest binary, doc_id long, part int, place int")


REACHED = "doc_id long, part int, place int, reach int"


def reaches(sparse: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, part, place and reach: the words that a suffix has in common with a neighbour, or one more, where that is gram or more.

    Each task streams through its sorted suffixes and holds one row beyond the batch, however many suffixes are alike."""
    pairs = (size - gram + 1) // 2
    columns = ("doc_id", "part", "place")

    def run(batches):
        held = None  # the last row so far, and its match with the row before it

        def emit(own, reach):
            keep = reach >= gram
            return pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip((*own, np.minimum(reach, size)), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], [*columns, "reach"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", *columns)]
            rest = np.frombuffer(b"".join(batch.column("rest").to_pylist()), np.uint8).reshape(n, pairs)
            before = np.zeros(1, np.int64)
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held[0], rows)]
                rest, before = np.concatenate([held[1], rest]), held[2]
            same = np.concatenate([rest[1:] == rest[:-1], np.zeros((len(rest) - 1, 1), bool)], 1).argmin(1)
            same = np.where(rows[0][1:] == rows[0][:-1], gram + 2 * same + 1, 0)
            left = np.concatenate([before, same])
            reach = np.maximum(left[:-1], same)
            held = ([x[-1:] for x in rows], rest[-1:], left[-1:])
            if len(reach):
                yield emit([x[:-1] for x in rows[1:]], reach)
        if held is not None:
            yield emit(held[0][1:], held[2])

    return sparse.repartition("gram").sortWithinPartitions("gram", "rest").mapInArrow(run, REACHED)


CONTEXT = "gram long, rights binary, doc_id long, part int, place int, lefts binary, first int, h1 binary, h2 binary, salt int"


def contexts(texts: DataFrame, reached: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """For each suffix with a neighbour: its words after the gram to its reach and those before it, as hashes, and its windows within
    reach (the first start and the hashes of each); written."""
    more = size - gram
    per_row = written(reached.groupBy("doc_id", "part").agg(F.collect_list(F.struct("place", "reach", "salt")).alias("found")), "reached")
    rows = texts.hint("shuffle_merge").join(per_row, ["doc_id", "part"])

    def run(batch: pa.RecordBatch) -> dict | None:
        seen, a, b = tools()
        out: dict = {c: [] for c in ("gram", "rights", "doc_id", "part", "place", "lefts", "first", "h1", "h2", "salt")}
        for doc_id, part, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), raw_texts(batch), batch.column("found").to_pylist()):
            words = text.split()
            if len(words) < size:
                continue
            w = word_hashes(words, seen)
            g, at = grams_and_minimisers(w, a, size, gram)
            h1, h2 = a(w, size), folded(b(w, size))
            reach = {x["place"]: (x["reach"], x["salt"]) for x in found}
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)).tolist()
            for i, j in zip(edges[:-1], edges[1:]):
                p = int(at[i])
                if p not in reach:
                    continue
                far, salt = reach[p]
                j = min(j, p + far - size + 1)  # windows start at i .. j - 1
                if i >= j:
                    continue
                out["gram"].append(int(g[p].view(np.int64)))
                # big-endian, so that bytes sort as words do
                out["rights"].append(w[p + gram : p + gram + min(far - gram, more)].astype(">u8").tobytes())
                out["lefts"].append(w[max(0, p - more) : p][::-1].astype(">u8").tobytes())
                for c, v in (("doc_id", doc_id), ("part", part), ("place", p), ("first", i), ("h1", signed(h1[i:j]).tobytes()), ("h2", h2[i:j].tobytes()), ("salt", salt)):
                    out[c].append(v)
        return out if out["gram"] else None

    return written(map_arrow(rows, run, CONTEXT), "contexts")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """The number of leading words that two runs of words have in common."""
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


EXTENDED = "doc_id long, part int, first int, last int, h1 binary, h2 binary"


def extended(found: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """From contexts to the starts first .. last of windows in matches with a neighbour of a smaller doc_id (h1 is null), and the
    windows that are left (h1 and h2 hold a window's hashes each)."""

    def groups(batches):
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "salt", "rights", "doc_id", "part", "place", "lefts", "first", "h1", "h2")]
            for g, salt, *row in zip(*columns):
                if (g, salt) != now:
                    if rows:
                        yield rows
                    now, rows = (g, salt), []
                rows.append(row)
        if rows:
            yield rows

    def run(batches):
        out: list = []
        for rows in groups(batches):
            words = [(np.frombuffer(r[0], ">u8"), np.frombuffer(r[4], ">u8")) for r in rows]
            spans: list[list] = [[] for _ in rows]
            by_left = sorted(range(len(rows)), key=lambda i: rows[i][4])
            least = min(range(len(rows)), key=lambda i: rows[i][1])
            partners = [{least} if r[1] > rows[least][1] else set() for r in rows]
            for order in (range(len(rows)), range(len(rows) - 1, -1, -1), by_left, by_left[::-1]):
                smaller: list[int] = []  # the nearest suffixes so far, of ever smaller doc_ids towards the bottom
                for i in order:
                    while smaller and rows[smaller[-1]][1] >= rows[i][1]:
                        smaller.pop()
                    partners[i].update(smaller[-1:])
                    smaller.append(i)
            for i, near in enumerate(partners):
                (r, l), place = words[i], rows[i][3]
                for j in near:
                    before, after = common(words[j][1], l), gram + common(words[j][0], r)
                    if before + after >= size:
                        spans[i].append((place - before, place + after - size))
            for (_, doc_id, part, _, _, first, h1, h2), own in zip(rows, spans):
                h1, h2 = np.frombuffer(h1, np.int64), np.frombuffer(h2, np.int32)
                left = np.ones(len(h1), bool)
                for a, b in own:
                    out.append((doc_id, part, a, b, None, None))
                    left[max(0, a - first) : max(0, b + 1 - first)] = False
                if left.any():
                    at = np.flatnonzero(left)
                    for run_ in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        i, j = int(run_[0]), int(run_[-1]) + 1
                        out.append((doc_id, part, first + i, first + j - 1, h1[i:j].tobytes(), h2[i:j].tobytes()))
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "part", "first", "last", "h1", "h2"])

    return found.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "rights").mapInArrow(run, EXTENDED)


def unrolled(left: DataFrame) -> DataFrame:
    """Windows, a row each, from rows with the hashes of a run of them."""

    def run(batch: pa.RecordBatch) -> dict:
        h1 = [np.frombuffer(x, np.int64) for x in batch.column("h1").to_pylist()]
        h2 = [np.frombuffer(x, np.int32) for x in batch.column("h2").to_pylist()]
        counts = [len(x) for x in h1]
        at = [(p << 32) + f + np.arange(n) for p, f, n in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(), counts)]
        return {"h1": np.concatenate(h1), "h2": np.concatenate(h2), "doc_id": np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), counts), "at": np.concatenate(at)}

    return map_arrow(left, run, "h1 long, h2 int, doc_id long, at long")


def removals(documents: DataFrame, known: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, part and starts: runs (first, last) of the starts of repeated windows."""
    texts = representatives(documents, known, size)
    sparse = written(suffixes(texts, size, gram), "suffixes")
    hot = hot_keys(sparse.groupBy("gram").agg(F.count("*").alias("n")), ["gram"])
    cold = reaches(sparse.join(F.broadcast(hot), "gram", "left_anti"), size, gram).withColumn("salt", F.lit(0))
    salt = F.pmod(F.xxhash64("doc_id", "part"), F.ceil(F.col("n") / HOT_FROM)).cast("int")
    warm = sparse.join(F.broadcast(hot), "gram").select("doc_id", "part", "place", F.lit(size).alias("reach"), salt.alias("salt"))
    matched = written(extended(contexts(texts, cold.unionByName(warm), size, gram), size, gram), "extended")
    left = matched.filter("h1 is not null").select("doc_id", "part", "first", "h1", "h2")
    run_of = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    exact = repeats(written(unrolled(left), "windows")).select("doc_id", "part", F.transform("starts", lambda x: run_of(x, x)).alias("starts"))
    near = matched.filter("h1 is null").groupBy("doc_id", "part").agg(F.collect_set(run_of(F.col("first"), F.col("last"))).alias("starts"))
    return exact.unionByName(near).groupBy("doc_id", "part").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))


def joined(starts: list | None, size: int) -> list[dict]:
    """Spans of words, merged and ascending, from runs of starts in order."""
    out: list = []
    for s in starts or []:
        a, b = s["first"], s["last"] + size
        if out and a <= out[-1]["to"]:
            out[-1]["to"] = max(out[-1]["to"], b)
        else:
            out.append({"from": a, "to": b})
    return out


def spans(documents: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, part, n_words and spans (from, to: places of words, merged, ascending) of the repeated passages of each row."""
    known = classes(documents)
    rows = known.join(removals(documents, known, size, gram), ["doc_id", "part"], "left")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for doc_id, n, rep, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "rep", "starts"))):
            if doc_id is not None and doc_id > rep:
                out.append([{"from": 0, "to": n}] if n >= size else [])
            else:
                out.append(joined(starts, size))
        return {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "n_words": batch.column("n_words"), "spans": out}

    return map_arrow(rows, run, "doc_id long, part int, n_words long, spans array<struct<`from`:int,`to`:int>>")


def deduplicated(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """documents, same columns; a text that has repeated passages is its remaining words joined by one space."""
    gone = spans(documents, size).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "part"]).select("doc_id", "part", "spans")

    def kept(text: bytes, own: list) -> bytes:
        words = text.split()
        for s in reversed(own):
            del words[s["from"] : s["to"]]
        return b" ".join(words)

    return rewritten(documents, gone, kept, ["spans"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.expr("aggregate(spans, 0L, (s, x) -> s + x.to - x.from)")
    return spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), "spans")
