"""Operator 6, token-ID output: Simple-8b words in binary files, written in doc_id order and read back.

A 64-bit word holds a selector in its upper 4 bits and 60 bits of ids: 240 or 120 zeros, or 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3,
2 or 1 ids of 1 to 60 bits. An id of 60 bits or more is escaped: a one-id word of all ones, and the id in the word after it. Ids of
a document are cut into blocks of BLOCK ids, and a word never crosses a block, so blocks decode alone or many at once; the reader takes
runs of whole blocks and checks that each holds the ids it should.

A file is a run of at most CHUNKS_PER_FILE chunks of about CHUNK_IDS ids (or one document), each: magic, number of documents, of blocks and of words (4 bytes each); doc_ids (8 bytes; the lowest
number stands for null), ids per document (8 bytes), the word at which each block begins (4 bytes), the words (8 bytes each), and
one line feed, all little-endian. Files are written by Spark's text writer from bytes (so any file system and its commit protocol
serve, and a lost executor's task is simply run again) and read by its binary reader.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; rows with equal doc_id follow each other in
the order of their texts; a very long text is one chunk; an empty table gives no rows; extra columns are ignored. A vocabulary file that
doesn't split texts as PATTERN says is an error.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import map_arrow, modest_batches, new_path, ranges, table, worker_state, written

END_ID, BLOCK, CHUNK_IDS, SEEN = 2, 4096, 1 << 18, 600_000
#: Chunks of a file at most, and words that are decoded at once (in whole blocks).
CHUNKS_PER_FILE, WORDS_AT_ONCE = 64, 1 << 16
MAGIC = b"S8B1"
#: Fixed values of the coding: ids in a word, and bits of each, by selector.
COUNTS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
SELECTOR = np.array([COUNTS.index(c) if c in COUNTS else 0 for c in range(241)], np.int8)
ESCAPE = (1 << 60) - 1
NULL_ID = -(1 << 63)
#: Fixed by the vocabulary file: how it splits a text before its merges.
PATTERN = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of PLAIN characters alone: ASCII, Latin letters, and dashes, quotes and dots of U+2010 to U+2027.
PLAIN = r"[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u2010-\u2027]*"
_L = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
PLAIN_PATTERN = rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r 0-9{_L}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def widths(ids: np.ndarray) -> np.ndarray:
    """The bits of each id, from 0 to 60; 61 for those that need an escape."""
    out = worker_state("widths", lambda: np.array([x.bit_length() for x in range(1 << 16)], np.uint8))
    if not len(ids) or ids.max() < 1 << 16:
        return out[ids]
    big = ids.astype(np.uint64)
    found = np.zeros(len(ids), np.uint8)
    for b in range(60):
        found += big >= np.uint64(1 << b)
    return found + (big >= np.uint64(ESCAPE))


def packed(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids (uint64) and the word at which each block begins; ends: of the blocks, ascending, the last is len(ids)."""
    n = len(ids)
    bits = widths(ids)
    ids = ids.astype(np.uint64)
    top = int(ids.max()) if n else 0
    take = np.ones(n, np.uint8)
    width, peak = 1, bits  # peak[i]: the largest of bits[i : i + width]
    for s in range(14, -1, -1):
        c = COUNTS[s]
        if c > n:
            break
        while 2 * width <= c:
            peak = np.maximum(peak[:-width], peak[width:])
            width *= 2
        most = np.maximum(peak[: n - c + 1], peak[c - width : c - width + n - c + 1]) if c > width else peak[: n - c + 1]
        fits = most <= BITS[s]
        crossing = (ends[:, None] - np.arange(1, c)).ravel()  # starts from which c ids would cross the end of a block
        fits[crossing[(crossing >= 0) & (crossing <= n - c)]] = False
        at = np.flatnonzero(fits)
        if len(at):
            take[at] = c
        elif not (most <= BITS[s]).any():
            break
    steps, starts, i = take.tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts, np.int64)
    chosen = SELECTOR[take[starts]]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if BITS[s]:
            at = np.flatnonzero(chosen == s)
            parts = ids[starts[at][:, None] + np.arange(COUNTS[s])]
            words[at] |= np.bitwise_or.reduce(np.minimum(parts, np.uint64(ESCAPE)) << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])), axis=1)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    at_word = np.searchsorted(starts, begins)
    if top >= ESCAPE:
        large = np.flatnonzero((chosen == 15) & (ids[starts] >= ESCAPE))
        words = np.insert(words, large + 1, ids[starts[large]])
        at_word = at_word + np.searchsorted(large, at_word)
    return words, at_word


def unpacked(words: np.ndarray) -> np.ndarray:
    """The ids of words that begin at a block."""
    mark = np.uint64((15 << 60) | ESCAPE)
    raw = {}
    if (words == mark).any():
        keep, i = np.ones(len(words), bool), 0
        at = np.flatnonzero(words == mark).tolist()
        for i in at:
            if keep[i]:
                keep[i + 1] = False
                raw[i] = words[i + 1]
        place = np.cumsum(keep) - 1
        raw = {int(place[i]): v for i, v in raw.items()}
        words = words[keep]
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.array(COUNTS)[selector]
    starts = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector):
        if BITS[s]:
            at = np.flatnonzero(selector == s)
            parts = (words[at][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s]))) & np.uint64((1 << BITS[s]) - 1)
            out[starts[at][:, None] + np.arange(COUNTS[s])] = parts
    for i, v in raw.items():
        out[starts[i]] = v
    return out


def chunk(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in ids], np.int64)
    blocks = -(-lengths // BLOCK)
    last = np.cumsum(lengths)
    ends = np.minimum(np.repeat(last - lengths, blocks) + BLOCK * (ranges(np.zeros(len(blocks), np.int64), blocks) + 1), np.repeat(last, blocks))
    words, at = packed(np.concatenate(ids), ends)
    names = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<III", len(ids), len(at), len(words)), names.tobytes(), lengths.astype("<i8").tobytes(), at.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def decoded(words: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of a chunk, by its block offsets: runs of whole blocks of about WORDS_AT_ONCE words, each of which must hold the ids
    that the lengths of its documents say."""
    blocks = -(-lengths // BLOCK)
    last = np.cumsum(blocks)
    size = np.full(len(at), BLOCK, np.int64)
    some = blocks > 0
    size[last[some] - 1] = lengths[some] - BLOCK * (blocks[some] - 1)
    ends = np.append(at[1:], len(words)).astype(np.int64)
    out, first = [], 0
    while first < len(at):
        stop = max(first + 1, int(np.searchsorted(ends, at[first] + WORDS_AT_ONCE, side="right")))
        ids = unpacked(words[at[first] : ends[stop - 1]])
        if len(ids) != size[first:stop].sum():
            raise ValueError(f"blocks {first} to {stop - 1} hold {len(ids)} ids, not {size[first:stop].sum()}")
        out.append(ids)
        first = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def chunks(content: bytes):
    """doc_ids, ids per document and ids of each chunk of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no chunk begins at byte {at}")
        n, blocks, words = struct.unpack_from("<III", content, at + 4)
        at += 16
        names = np.frombuffer(content, "<i8", n, at)
        lengths = np.frombuffer(content, "<i8", n, at + 8 * n)
        at += 16 * n
        begins = np.frombuffer(content, "<u4", blocks, at)
        at += 4 * blocks
        yield names, lengths, decoded(np.frombuffer(content, "<u8", words, at), begins, lengths)
        at += 8 * words + 1


def check_pattern(path: str) -> None:
    """An error unless the vocabulary file splits a text as PATTERN does and changes nothing before."""
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    how = d.get("pre_tokenizer") or {}
    if d.get("normalizer") or how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex", True):
        raise ValueError(f"{path} does not split texts by the pattern that this operator knows")


class LibraryIds:
    """Ids of texts from the library, which encodes each distinct piece between two splits; pieces seen before are kept as bytes."""

    def __init__(self, path: str):
        import os
        import re

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        check_pattern(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.plain = re.compile(PLAIN).fullmatch
        self.find, self.find_plain = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Puts the pieces into the table. A full table becomes the one before, from which pieces still in use come back."""
        if len(self.seen) + len(pieces) > SEEN:
            self.seen, self.before = {}, self.seen
        missing = []
        for p in pieces:
            if p not in self.seen:
                if (ids := self.before.get(p)) is None:
                    missing.append(p)
                else:
                    self.seen[p] = ids
        for first in range(0, len(missing), 2000):
            part = missing[first : first + 2000]
            for piece, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self.seen[piece] = array("I", got.ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of text, 32 bits each."""
        if not text:
            return b""
        out: list[bytes] = []
        for part in self.cut(text) if any(t in text for t in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            pieces = (self.find_plain if part.isascii() or self.plain(part) else self.find)(part)
            ids = list(map(self.seen.get, pieces))
            if None in ids:
                new = [i for i, x in enumerate(ids) if x is None]
                self.learn({pieces[i] for i in new})
                for i in new:
                    ids[i] = self.seen[pieces[i]]
            out += ids
        return b"".join(out)


def library(path: str) -> LibraryIds:
    return worker_state(("library", path), lambda: LibraryIds(path))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(documents: DataFrame, vocabulary_path: str, out: str, end_id: int = END_ID) -> None:
    """Files of the ids of all documents, in ascending doc_id order over the files and in each."""

    def run(batches):
        lib, end = library(vocabulary_path), end_id.to_bytes(4, "little")
        names, ids, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = np.frombuffer(lib.encode(text) + end, "<u4")
                names.append(doc_id)
                ids.append(own)
                held += len(own)
                if held >= CHUNK_IDS:
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk(names, ids)], pa.binary())})
                    names, ids, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk(names, ids)], pa.binary())})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    modest_batches(documents.sparkSession)
    rows.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict = {"file": [], "doc_id": [], "before": [], "n_tokens": [], "ids_crc32": []}
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            before = 0
            for names, lengths, ids in chunks(content):
                at = np.concatenate([[0], np.cumsum(lengths)])
                raw = ids.astype("<u4").tobytes()
                for i, (doc_id, n) in enumerate(zip(names.tolist(), lengths.tolist())):
                    cols["file"].append(file)
                    cols["doc_id"].append(None if doc_id == NULL_ID else doc_id)
                    cols["before"].append(before)
                    cols["n_tokens"].append(n)
                    cols["ids_crc32"].append(zlib.crc32(raw[4 * at[i] : 4 * at[i + 1]]))
                    before += n
        return cols

    rows = map_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content"), run, "file string, doc_id long, before long, n_tokens long, ids_crc32 long")
    rows = written(rows, "token-rows")
    # a row for each file, and no more, goes to the one task of this window: the task's number in a name, then the file's among the
    # task's, rise with the range of doc_ids
    number = lambda p: F.regexp_extract("file", p, 1).try_cast("long")
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns({"task": number(r"part-(\d+)-[^/]*$"), "place": number(r"-c(\d+)\.[^/]*$")})
    firsts = sizes.select("file", (F.sum("n").over(W.Window.orderBy("task", "place")) - F.col("n")).alias("first"))
    return rows.join(firsts, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), vocabulary(), out)
    return read(spark, out)
