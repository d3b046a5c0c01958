"""Operator 13, packing documents into sequences: a configuration linear program over the histogram of lengths, solved by
multiplicative weights whose prices meet in a knapsack dynamic program, then rounded.

A document's tokens are cut into pieces of at most `capacity` tokens (only documents that are longer); pieces are packed whole. What is
planned is the histogram of their lengths, which has at most `capacity` entries whatever the corpus holds, so the driver never sees a
row of a document:

* lengths over `capacity // SAND` are put into at most CLASSES classes of about equal counts, each as large as its longest length
  (if there are no more distinct lengths than that, each is a class); shorter ones are sand, which fills what configurations leave;
* each round of `solved` prices classes and sand by their weights, takes the best configuration by a knapsack program over all
  fillings, adds a share of copies of it, and lowers the weight of what it covers by the factor exp(-ETA * share covered);
* copies are rounded down, slots of classes get real lengths, the longest first, and the pieces that no whole copy takes, and the
  sand, go where they fit best, in descending order of length, still by counts and not by pieces (`fitted`).

Spark then numbers the pieces of each length (in buckets, so that a length that a third of all pieces have is dealt to many tasks), and
a piece's number says its sequence and place by arithmetic on the plan, a broadcast of a few entries for each configuration.

Defined cases: a null or empty text is one piece of the end id alone; a very long text is many pieces; repeated rows, and rows that
share a doc_id, are documents of their own, and so are rows without a doc_id; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bpe import vocabulary
from .common import list_array, map_arrow, table, worker_state, written

CAPACITY, END_ID = 4096, 1
#: Classes of lengths at most; lengths up to a SAND-th of the capacity are sand; rounds at most, the share of a class that one round
#: covers at most, how fast weights fall with it, and by what share the first weight of a piece as large as a sequence is above its
#: size: large pieces are hard to place later, small ones aren't.
CLASSES, SAND, ROUNDS, SHARE, ETA, LARGE = 384, 8, 5000, 0.25, 0.1, 0.3
#: Pieces of a bucket, about, when the pieces of a length are numbered: a length that most pieces have is many buckets.
BUCKET = 500
#: Words (or units) that a worker remembers; twice as many for a while.
WORDS = 250_000
#: Lower-case letters (with a few others) of texts that are split here; all other texts are split by the library alone.
_L = "a-zß-öø-ɏ"
#: Texts of these letters, other ASCII characters and the marks of U+2010 to U+2027.
PLAIN = rf"[\x00-\x1b\x20-\x7f{_L}‐-‧]*"
#: Fixed by the vocabulary file: what it takes for a word, for those texts, and for lower-cased ASCII.
FIND, FIND_ASCII = rf"[{_L}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\s0-9{_L}]+", r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\s0-9a-z]+"


class Table(dict):
    """Remembers most entries of late: when full it becomes the one before, from which entries still in use come back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def missing(self, keys: set) -> list:
        """The keys that aren't known, after those of the table before have come back."""
        if len(self) + len(keys) > self.most:
            self.before = dict(self)
            self.clear()
        out = []
        for k in keys:
            if k not in self:
                if (x := self.before.get(k)) is None:
                    out.append(k)
                else:
                    self[k] = x
        return out


class Ids:
    """Ids of texts from the library, word by word for texts of usual letters, else unit by unit: white space separates units and is
    dropped by the vocabulary's pattern. Words and units are remembered; new words go to the library many at once, and each ends at
    the token that ends a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=False)
        suffix = self.library.model.end_of_word_suffix
        if not suffix:
            raise ValueError(f"{path} doesn't mark the ends of words")
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith(suffix)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.plain, self.odd = re.compile(PLAIN).fullmatch, re.compile(r"[\x1c-\x1f]").search
        self.find, self.find_ascii = re.compile(FIND).findall, re.compile(FIND_ASCII).findall
        self.words, self.units = Table(WORDS), Table(WORDS)

    def alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        new = self.words.missing(words)
        for first in range(0, len(new), 2000):
            part = new[first : first + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.words.update((w, raw[a:b]) for w, a, b in zip(part, at, at[1:]))
            else:
                self.words.update(zip(part, self.alone(part)))

    def split(self, text: str) -> list[str] | None:
        """The words of a text of usual letters, else None."""
        if any(t in text for t in self.special) or self.odd(text):
            return None
        low = text.lower()
        if low.isascii():
            return self.find_ascii(low)
        return self.find(low) if self.plain(low) else None

    def whole(self, text: str) -> bytes:
        """The ids of a text that `split` doesn't take."""
        if any(t in text for t in self.special) or self.odd(text):
            return self.alone([text])[0]
        units = text.split()
        new = self.units.missing(set(units))
        self.units.update(zip(new, self.alone(new)))
        return b"".join(map(self.units.__getitem__, units))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, 32 bits each; a few texts at a time, so that what is new among them is learnt at once."""
        out = []
        for first in range(0, len(texts), 50):
            part = [t or "" for t in texts[first : first + 50]]
            words = [self.split(t) for t in part]
            self.learn({w for x in words if x for w in x})
            get = self.words.__getitem__
            out += [self.whole(t) if x is None else b"".join(map(get, x)) for t, x in zip(part, words)]
        return out


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids_crc32 of each piece, and its ids if asked for."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> dict:
        coder, end = worker_state(("packing", path), lambda: Ids(path)), end_id.to_bytes(4, "little")
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, raw in enumerate(coder.encode(batch.column("text").to_pylist())):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                own = raw[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
                if with_ids:
                    ids.append(own)
        out = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}
        return out | ({"ids": list_array(np.frombuffer(b"".join(ids), "<i4"), length)} if with_ids else {})

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def classed(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sizes of the classes of the lengths that aren't sand, and the lengths of each, the longest first."""
    lengths = sorted((x for x in counts if x > capacity // SAND), reverse=True)
    if len(lengths) <= CLASSES:
        return np.array(lengths, np.int64), [[x] for x in lengths]
    n, groups, held = sum(counts[x] for x in lengths), [], 0
    for x in lengths:
        if not groups or held * CLASSES >= n * len(groups):
            groups.append([])
        groups[-1].append(x)
        held += counts[x]
    return np.array([g[0] for g in groups], np.int64), groups


def knapsack(sizes: np.ndarray, profit: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size, at most `most` times, for the greatest profit within the capacity."""
    best = np.zeros(capacity + 1)
    taken = []
    for k in np.flatnonzero((profit > 0) & (most > 0)):
        size, left, step = int(sizes[k]), int(min(most[k], capacity // sizes[k])), 1
        while left > 0:  # copies in powers of two: any number of them can be taken
            step = min(step, left)
            gain = best[: capacity + 1 - step * size] + step * profit[k]
            better = gain > best[step * size :]
            if better.any():
                best[step * size :][better] = gain[better]
            taken.append((k, step, better))
            left -= step
            step *= 2
    out, room = np.zeros(len(sizes), np.int64), int(best.argmax())
    for k, step, better in reversed(taken):
        at = room - step * int(sizes[k])
        if at >= 0 and better[at]:
            out[k] += step
            room = at
    return out


def solved(sizes: np.ndarray, demand: np.ndarray, sand: int, capacity: int) -> dict[tuple, float]:
    """Copies of each configuration (class, times ...): a fractional solution that covers no class more often than it is asked for."""
    left, dust = demand.astype(float), float(sand)
    weight, grain = sizes / capacity * (1 + LARGE * sizes / capacity), 1 / capacity  # of a piece, of a token of sand
    copies: dict[tuple, float] = defaultdict(float)
    for _ in range(ROUNDS):
        if not (left >= 1).any():
            break
        price = grain if dust > 0 else 0.0
        config = knapsack(sizes, np.where(left >= 1, weight - price * sizes, 0), left.astype(np.int64), capacity)
        if not config.any():  # sand alone is worth more than any class: its price was too high
            grain /= 2
            continue
        used = config > 0
        share = min(max(SHARE * (demand[used] / config[used]).min(), 1), np.floor((left[used] / config[used]).min()))
        rest = (capacity - config @ sizes) * share
        weight[used] *= np.exp(-ETA * share * config[used] / demand[used])
        if dust > 0:
            grain *= np.exp(-ETA * rest / sand)
        left -= config * share
        dust -= rest
        copies[tuple((int(k), int(config[k])) for k in np.flatnonzero(used))] += share
    return copies


def rounded(copies: dict[tuple, float], groups: list[list[int]], counts: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(copies, [(length, times) ...]) of whole copies; counts loses the pieces that they take."""
    out = []
    for config, x in copies.items():
        whole = int(x)
        if not whole:
            continue
        slots = []  # of each slot the lengths that its copies get, as (length, copies)
        for k, times in config:
            for _ in range(times):
                need, runs = whole, []
                for length in groups[k]:
                    if got := min(need, counts[length]):
                        runs.append((length, got))
                        counts[length] -= got
                        need -= got
                slots.append(runs)
        while whole:
            n = min(runs[0][1] for runs in slots)
            pattern: dict[int, int] = defaultdict(int)
            for runs in slots:
                length, have = runs[0]
                pattern[length] += 1
                if have == n:
                    runs.pop(0)
                else:
                    runs[0] = (length, have - n)
            out.append((n, sorted(pattern.items(), reverse=True)))
            whole -= n
    return out


def fitted(open_: list[tuple[int, list[tuple[int, int]]]], counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """open_ and more sequences, with all pieces of counts: each, in descending order of length, where it fits best; by counts."""
    by_room: dict[int, list] = defaultdict(list)
    rooms = 0  # bit r: by_room[r] has something

    def put(n: int, pattern: list, room: int) -> None:
        nonlocal rooms
        by_room[room].append((n, pattern))
        rooms |= 1 << room

    for n, pattern in open_:
        put(n, pattern, capacity - sum(x * t for x, t in pattern))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = rooms >> length
            if fits:
                room = (fits & -fits).bit_length() - 1 + length
                n, pattern = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, n, pattern = capacity, left, []
            times = room // length
            whole = min(n, left // times)
            if whole:
                put(whole, [*pattern, (length, times)], room - times * length)
                left -= whole * times
            if whole < n and left:  # fewer than `times` are left, for one more copy
                put(1, [*pattern, (length, left)], room - left * length)
                whole, left = whole + 1, 0
            if whole < n and pattern:
                put(n - whole, pattern, room)
    return [x for found in by_room.values() for x in found]


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences as (copies, [(length, times) ...]): together they hold every piece of the histogram once."""
    left = dict(counts)
    sizes, groups = classed(counts, capacity)
    demand = np.array([sum(counts[x] for x in g) for g in groups], np.int64)
    sand = sum(x * n for x, n in counts.items() if x <= capacity // SAND)
    return fitted(rounded(solved(sizes, demand, sand, capacity), groups, left), left, capacity)


def runs(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length the rows (first number, first sequence, times, offset), ascending: where the pieces of that length go by number."""
    out: dict[int, list] = defaultdict(list)
    number: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, pattern in plan:
        offset = 0
        for length, times in pattern:
            out[length].append((number[length], sequence, times, offset))
            number[length] += n * times
            offset += length * times
        sequence += n
    return {length: np.array(x, np.int64) for length, x in out.items()}


def numbered(found: DataFrame, counts: dict[int, int]) -> DataFrame:
    """found (written; counts: pieces by length) with number: from 0 among the pieces of a length, by bucket, doc_id and piece. A
    length has a bucket for each BUCKET of its pieces."""
    buckets = found.sparkSession.createDataFrame([(x, n // BUCKET + 1) for x, n in counts.items()], "length long, buckets long")
    rows = found.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets")).drop("buckets")
    firsts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    firsts = firsts.select("length", "bucket", (F.sum("n").over(W.Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("first"))
    own = F.row_number().over(W.Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("own", own).join(firsts, ["length", "bucket"]).withColumn("number", F.col("first") + F.col("own")).drop("bucket", "own", "first")


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (pieces, written) with sequence_id and offset."""
    spark = found.sparkSession
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most, and so below
    where, names = spark.sparkContext.broadcast(runs(planned(counts, capacity))), found.columns

    def run(batch: pa.RecordBatch) -> dict:
        length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at, rows = np.flatnonzero(length == x), where.value[int(x)]
            row = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
            own = number[at] - row[:, 0]
            sequence[at] = row[:, 1] + own // row[:, 2]
            offset[at] = row[:, 3] + own % row[:, 2] * x
        return {c: batch.column(c) for c in names} | {"sequence_id": sequence, "offset": offset}

    kinds = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    return map_arrow(numbered(found, counts), run, f"{kinds}, sequence_id long, offset long")


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, ids and docs (doc_id, piece, offset, length) of each sequence; rows: packed pieces with ids. A sequence holds no
    more than its capacity, so a group is small."""
    whole = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    docs = F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return rows.groupBy("sequence_id").agg(whole.alias("x")).select("sequence_id", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"), docs.alias("docs"))


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of documents with its sequence and its place there."""
    return packed(written(pieces(documents, path, capacity, end_id, with_ids), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
