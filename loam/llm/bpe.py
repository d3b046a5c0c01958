"""Operator 5, BPE encoding and decoding: per word, a segment tree over the ranks of adjacent pairs.

The root of the tree holds the lowest rank and, among equals, the leftmost pair; a merge changes at most three leaves, each update
takes logarithmic time, and it ends when the root holds no mergeable pair. Words come from the vocabulary file's own normaliser
(NFC, white space to one space, lower case) and splitting pattern; special tokens in a text become their ids, as the library does.

Defined cases: a null or empty text has no ids and decodes to the empty string; repeated rows are encoded each; a null doc_id stays.
A very long text is one row of a task, with its ids; a very long word costs its length times the logarithm. An empty table gives no rows.
Words already seen are kept in a bounded table per worker. Nothing is shuffled; extra columns are ignored by `query` and kept by
`encoded`.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import list_array, map_arrow, table, worker_state

#: Fixed by the vocabulary file: what it keeps of a normalised text.
PATTERN = r"\p{L}+|'(?:[stmd]|re|ve|ll)|\p{N}|[^\s\p{L}\p{N}]+"
#: Fixed by the vocabulary file: its own words for that, and what it does to a text before.
SPLIT, CHANGES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", ["NFC", "Replace", "Lowercase"]
NONE = 1 << 62
SEEN = 120_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


class PairTree:
    """The lowest of `rank << 32 | place` over all places, with updates of single places."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = [NONE] * self.size + keys + [NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def set(self, place: int, key: int) -> None:
        node, i = self.node, self.size + place
        node[i] = key
        while i > 1:
            i >>= 1
            low = min(node[2 * i], node[2 * i + 1])
            if node[i] == low:
                break
            node[i] = low

    def root(self) -> int:
        return self.node[1]


class Encoder(dict):
    """ids of a word as bytes (little-endian, 32 bits each), for words seen before: a full table becomes the one before, from which
    words still in use come back."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        self.before: dict[str, bytes] = {}
        spec = json.load(open(path, encoding="utf-8"))
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        changes = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if changes != CHANGES or splits != [SPLIT, None]:
            raise ValueError(f"{path} does not normalise and split texts as this operator knows")
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.inner = [vocab.get(c) for c in self.letters]
        self.final = [vocab.get(c + self.suffix) for c in self.letters]
        self.pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.find = regex.compile(PATTERN).findall
        # Characters newer than Python's own tables: whether the library takes them for letters or numbers, and their lower case, is
        # asked of the library, since it depends on the Unicode version that it was built with.
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        pieces = lambda t: len(library.pre_tokenizer.pre_tokenize_str(t))
        new = [c for c in map(chr, range(0x80, 0x34000)) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
        late = regex.escape("".join(c for c in new if (pieces("a" + c) > 1 if regex.match(r"\p{L}", c) else pieces(c + c) == 1)))
        self.lower = {ord(c): low for c in new if (low := library.normalizer.normalize_str(c)) != c.lower()}
        # in the first plane a table look-up for each character; beyond it, only for texts that reach it
        low, high = ("".join(c for c in new if (c > "\uffff") == far) for far in (False, True))
        in_low, beyond, in_high = (re.compile(f"[{x}]").search if x else lambda t: None for x in (re.escape(low), "\U00010000-\U0010ffff", re.escape(high)))
        self.new = lambda t: in_low(t) or (beyond(t) and in_high(t))
        self.find_new = regex.compile(rf"(?:(?![{late}])\p{{L}})+|'(?:[stmd]|re|ve|ll)|(?![{late}])\p{{N}}|(?:[^\s\p{{L}}\p{{N}}]|[{late}])+").findall if late else self.find
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.space = regex.compile(r"\s+").sub

    def merge(self, ids: list[int]) -> list[int]:
        """ids after all merges, lowest rank first and leftmost among equals."""
        n = len(ids)
        if n < 2:
            return ids
        get = self.pairs.get
        keys = [got[0] << 32 | i if (got := get((ids[i], ids[i + 1]))) else NONE for i in range(n - 1)]
        tree, after, before = PairTree(keys), list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree.root()) != NONE:
            i = low & 0xFFFFFFFF
            j = after[i]
            ids[i] = get((ids[i], ids[j]))[1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.set(j, NONE)
            if k < n:
                before[k] = i
                tree.set(i, got[0] << 32 | i if (got := get((ids[i], ids[k]))) else NONE)
            else:
                tree.set(i, NONE)
            if (h := before[i]) >= 0:
                tree.set(h, got[0] << 32 | h if (got := get((ids[h], ids[i]))) else NONE)
        return [x for x in ids if x >= 0]

    def __missing__(self, word: str) -> bytes:
        if (out := self.before.get(word)) is None:
            raw = word.encode()
            ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
            out = array("I", self.merge([x for x in ids if x is not None])).tobytes()
        if len(word) <= 64:
            if len(self) >= SEEN:
                self.before = dict(self)
                self.clear()
            self[word] = out
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.space(" ", text).lower()

    def encode(self, whole: str | None) -> bytes:
        if not whole:
            return b""
        out = []
        for part in self.cut(whole) if any(t in whole for t in self.special) else [whole]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                text = self.normal(part)
                new = not text.isascii() and self.new(text)
                out += map(self.__getitem__, self.find_new(text.translate(self.lower)) if new else self.find(text))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between each two: what the library does for a file that names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    return worker_state(("bpe", path), lambda: Encoder(path))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: each text encoded, and what its ids decode to."""

    def run(batch: pa.RecordBatch) -> dict:
        bpe = encoder(path)
        ids = [bpe.encode(text) for text in batch.column("text").to_pylist()]
        n = [len(x) // 4 for x in ids]
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids": list_array(np.frombuffer(b"".join(ids), "<i4"), n), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]}

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """documents with the column ids, array<int>, in place of any column of that name."""
    rest = documents.drop("ids")

    def run(batch: pa.RecordBatch) -> dict:
        bpe = encoder(path)
        ids = [bpe.encode(text) for text in batch.column("text").to_pylist()]
        return {c: batch.column(c) for c in batch.schema.names} | {"ids": list_array(np.frombuffer(b"".join(ids), "<i4"), [len(x) // 4 for x in ids])}

    return map_arrow(rest, run, ", ".join(f"`{c}` {t}" for c, t in rest.dtypes) + ", ids array<int>")


def decoded(frame: DataFrame, path: str) -> DataFrame:
    """frame with the column decoded: the text that its ids (array<int>) stand for; null ids decode to the empty string."""
    rest = frame.drop("decoded")

    def run(batch: pa.RecordBatch) -> dict:
        bpe = encoder(path)
        return {c: batch.column(c) for c in batch.schema.names} | {"decoded": [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]}

    return map_arrow(rest, run, ", ".join(f"`{c}` {t}" for c, t in rest.dtypes) + ", decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")
