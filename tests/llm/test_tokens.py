import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loam.llm import bpe
from loam.llm import token_output as out

WORDS = Tokenizer.from_file(bpe.vocabulary())
BYTES = Tokenizer.from_file(out.vocabulary())
MINE = bpe.Encoder(bpe.vocabulary())
TEXTS = st.text(st.characters(max_codepoint=0x24F) | st.sampled_from("'’…中文αΣ  <|>endoftxs"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_as_the_library(text):
    for t in (text, text + "<|endoftext|>" + text):
        want = WORDS.encode(t, add_special_tokens=False).ids
        ids = MINE.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert MINE.decode(ids) == WORDS.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_as_the_library(text):
    lib = out.library(out.vocabulary())
    for t in (text, text + "<|endoftext|>" + text):
        assert np.frombuffer(lib.encode(t), "<u4").tolist() == BYTES.encode(t, add_special_tokens=False).ids


def test_long_word_and_small_table(monkeypatch):
    monkeypatch.setattr(bpe, "SEEN", 3)
    e = bpe.Encoder(bpe.vocabulary())
    for t in ("ab" * 5000, "one two three four five one two", ""):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == WORDS.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.just(0) | st.integers(2**60 - 3, 2**60 + 3), min_size=1, max_size=400), st.data())
def test_simple8b_round_trip(ids, data):
    ids = np.array(ids, np.uint64)
    ends = np.array(sorted(set(data.draw(st.lists(st.integers(1, len(ids)), max_size=4))) | {len(ids)}))
    words, at = out.packed(ids, ends)
    assert (out.unpacked(words) == ids).all()
    for a, b, x, y in zip(at, [*at[1:], len(words)], [0, *ends[:-1]], ends):
        assert (out.unpacked(words[a:b]) == ids[x:y]).all()


def test_other_vocabularies_are_an_error():
    with pytest.raises(ValueError):
        bpe.Encoder(out.vocabulary())
    with pytest.raises(ValueError):
        out.LibraryIds(bpe.vocabulary())


def test_decoding_by_block_offsets(monkeypatch):
    rnd = np.random.default_rng(1)
    ids = [rnd.integers(0, 50_000, n).astype("<u4") for n in (1, 4096, 4097, 30_000, 2, 12_288)]
    content = out.chunk([1, 2, 3, 4, 5, None], ids)
    for words in (1, 3000, 1 << 16):
        monkeypatch.setattr(out, "WORDS_AT_ONCE", words)
        names, lengths, got = next(out.chunks(content))
        assert lengths.tolist() == [len(x) for x in ids] and (got == np.concatenate(ids)).all()


def test_runs_of_zeros_take_few_words():
    assert len(out.packed(np.zeros(720, np.uint64), np.array([720]))[0]) == 3


def test_bpe_query(odd, none, pairs):
    got = {r.doc_id: r for r in bpe.encoded_digests(odd, bpe.vocabulary()).collect()}
    for d, t in pairs:
        ids = WORDS.encode(t or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids) and got[d].ids == ids
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(WORDS.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded_digests(none, bpe.vocabulary()).count() == 0
    assert sorted(bpe.encoded(odd, bpe.vocabulary()).columns) == sorted(odd.columns)
    back = bpe.decoded(bpe.encoded(odd, bpe.vocabulary()), bpe.vocabulary()).filter("doc_id = 8").first()
    assert back.decoded == "one</w> two</w>"


def test_token_files(spark, odd, none, monkeypatch):
    monkeypatch.setattr(out, "CHUNKS_PER_FILE", 1)
    path = out.new_path(spark, "tokens-test")
    out.write(odd, out.vocabulary(), path)
    got = [tuple(r) for r in out.read(spark, path).collect()]
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, at = [], 0
    for d, t in rows:
        ids = [*BYTES.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    path = out.new_path(spark, "tokens-test")
    out.write(none, out.vocabulary(), path)
    assert out.read(spark, path).count() == 0


def test_queries_over_documents_against_the_library(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    words, ids = ([lib.encode(t or "", add_special_tokens=False).ids for _, t in rows] for lib in (WORDS, BYTES))
    got = {r.doc_id: tuple(r)[1:] for r in bpe.query(spark, small).collect()}
    assert got == {d: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(WORDS.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (d, _), x in zip(rows, words)}
    want, at = {}, 0
    for (d, _), x in zip(rows, ids):
        want[d] = (at, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        at += len(x) + 1
    assert {r.doc_id: tuple(r)[1:] for r in out.query(spark, small).collect()} == want
