"""Ragged primitives, token counts and token ids against their libraries."""

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tributary.llm import ragged, rans
from tributary.llm.token_counts import Counter, WordVocabulary, token_counts
from tributary.llm.token_ids import Encoder, read_ids, token_ids, write_ids

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "don't it's WE'LL 'tis ''s a's's 'rex \n's", "İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|>c", "123 4５6 x'reyou", "日本語テスト", "é café e\u0301", "a\n\n\n b\t'll  x \n y",
    "!!!'s " + "a" * 500 + " " + "ab" * 300, " \x1c \x85 \xa0x", "Привет мир 'll", "x  ", "  \n", "a'", "\U0001f600 x\u200d", "0123456789" * 50, "\x00\x01",
]
texts = st.text(alphabet=st.one_of(st.sampled_from("ab'sStTrelvmd 1\n\t!é<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def counter():
    return Counter(WordVocabulary(open(WORD).read())), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(open(BYTE).read()), Tokenizer.from_file(BYTE)


def ids_of(encoder, rows):
    out = []
    for ids, counts in encoder.texts(pa.array(rows, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_counts_of_odd_texts(counter):
    mine, library = counter
    assert mine.texts(pa.array(ODD)).tolist() == [len(library.encode(x or "", add_special_tokens=False).ids) for x in ODD]


def test_counts_of_every_code_point(counter):
    """Rows of 97 characters on end, with letters, digits and blanks among them, over all planes that have any."""
    mine, library = counter
    points = [c for lo, hi in ((0x20, 0xD800), (0xE000, 0x34000), (0xE0000, 0xE1000), (0x10FF00, 0x110000)) for c in range(lo, hi, 7 if lo else 3)]
    rows = ["".join(chr(c) + ("", "a", " ", "1", chr(c))[i % 5] for i, c in enumerate(points[at : at + 97])) for at in range(0, len(points), 97)]
    assert mine.texts(pa.array(rows)).tolist() == [len(x.ids) for x in library.encode_batch(rows, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4))
def test_counts_are_the_library_s(counter, rows):
    mine, library = counter
    assert mine.texts(pa.array(rows, pa.string())).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in rows]


def test_ids_of_odd_texts(encoder):
    mine, library = encoder
    assert ids_of(mine, ODD) == [library.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_ids_of_every_code_point(encoder):
    """Rows of 97 characters on end, with letters, digits and blanks among them, over all planes that have any."""
    mine, library = encoder
    points = [c for lo, hi in ((0x20, 0xD800), (0xE000, 0x34000), (0xE0000, 0xE1000), (0x10FF00, 0x110000)) for c in range(lo, hi, 7 if lo else 3)]
    rows = ["".join(chr(c) + ("", "a", " ", "1", chr(c))[i % 5] for i, c in enumerate(points[at : at + 97])) for at in range(0, len(points), 97)]
    assert ids_of(mine, rows) == [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_ids_are_the_library_s(encoder, rows):
    mine, library = encoder
    assert ids_of(mine, rows) == [library.encode(x, add_special_tokens=False).ids for x in rows]


def test_known_words_may_be_forgotten(encoder):
    mine, library = encoder
    mine.known._forget = lambda: (mine.known.key.fill(0), setattr(mine.known, "used", 0), setattr(mine.known, "store", np.zeros(64, mine.known.kind)))
    mine.known._forget()
    rows = [" ".join(f"word{i}x{j}" for j in range(40)) for i in range(5)]
    assert ids_of(mine, rows) == [library.encode(x, add_special_tokens=False).ids for x in rows]
    del mine.known._forget
    mine.known._forget()


def test_token_counts_query(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(ODD)] + [(None, "a", "b"), (3, "a", "b"), (3, "a", "b")], "doc_id long, text string, n_tokens string")
    got = token_counts(df, WORD, limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(ODD) + 3
    first = {r.doc_id: r for r in got.collect()}
    assert (first[0].n_bytes, first[0].n_tokens, first[0].over_limit) == (0, 0, False)
    assert token_counts(df.limit(0), WORD).count() == 0


@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_rans_round_trip(symbols, repeat):
    s = np.array(symbols * repeat, np.uint32)
    table = rans.Table(rans.quantised(np.bincount(s, minlength=301)))
    again = rans.Table.unpacked(table.packed())
    assert (rans.decode(rans.unpack(rans.pack(rans.encode(s, table))), again) == s).all()


def test_rans_parts_and_checksums():
    s = np.random.default_rng(0).zipf(1.4, 400_000).clip(0, 5000).astype(np.uint32)
    table = rans.Table(rans.quantised(np.bincount(s, minlength=5001)))
    block = rans.encode(s, table)
    per = rans.lanes_for(len(s)) * rans.CHECKPOINT
    assert block.parts() > 1 and (rans.decode_part(block, table, 1) == s[per : 2 * per]).all()
    p = np.bincount(s) / len(s)
    ideal = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(s) / 8
    assert len(rans.pack(block)) < 1.12 * ideal
    block.words.setflags(write=True)
    block.words[len(block.words) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(block, table)


def test_quantised_tables():
    for counts in ([0, 0], [5], [1] * 4000, [10**12, 1, 0, 1]):
        f = rans.quantised(np.array(counts))
        assert f.sum() in (0, 1 << rans.SCALE) and ((f > 0) == (np.array(counts) > 0)).all()


def test_token_files(spark, tmp_path):
    rows = [(20 - i, x) for i, x in enumerate(ODD)] + [(None, "null id"), (7, "same id"), (7, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    write_ids(df, str(tmp_path / "t"), BYTE)
    library = Tokenizer.from_file(BYTE)
    got = read_ids(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert sorted(map(str, (r.ids for r in got))) == sorted(str([*library.encode(x or "", add_special_tokens=False).ids, 0]) for _, x in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert token_ids(df.limit(0), BYTE).count() == 0


def test_segments_of_several_blocks(spark, tmp_path, monkeypatch):
    from tributary.llm import token_ids as module

    writer = module.SegmentWriter(3, 50_257)
    monkeypatch.setattr(module, "SEGMENT", 4000)
    monkeypatch.setattr(module, "BLOCK", 1000)
    g = np.random.default_rng(1)
    batches, all_ids = [], []
    for i in range(40):
        ids = g.integers(0, 50_000, g.integers(1, 1500)).astype(np.uint32)
        all_ids.append(ids)
        batches += writer.add(ids, np.array([len(ids)]), [i])
    batches += writer.close()
    assert len(batches) > 3 and max(len(b.column(5)[0]) for b in batches) > 2
    spark.createDataFrame(pa.Table.from_batches(batches)).write.parquet(str(tmp_path / "t"))
    got = read_ids(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    assert [r.ids for r in got] == [x.tolist() for x in all_ids]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(x) for x in all_ids])[:-1]]).tolist()


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tÉé", max_size=30)), max_size=6), st.integers(1, 40))
@settings(deadline=None)
def test_words_and_chunks(rows, size):
    import re

    got = []
    for t in ragged.chunks(pa.array(rows, pa.string()), size):
        w = ragged.words(t, ragged.NOT_SPACE)
        h = ragged.word_hashes(t, w)
        for r in range(t.hi - t.lo):
            own = [bytes(t.buf[a:b]).decode() for a, b in zip(w.start[w.woff[r] : w.woff[r + 1]], w.end[w.woff[r] : w.woff[r + 1]], strict=True)]
            got.append(own)
            assert [ragged.hash_word(x) for x in own] == h[w.woff[r] : w.woff[r + 1]].tolist()
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in rows]


def test_slices_of_columns():
    col = pa.array(["zero", "one two", None, "three"]).slice(1, 3)
    assert [ragged.words(t, ragged.NOT_SPACE).counts.tolist() for t in ragged.chunks(col)] == [[2, 0, 1]]
