"""Alignment of two tokenizers' tokens against a byte-by-byte computation with the libraries."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tributary.llm import alignment as al
from tributary.llm.catalog import vocabulary
from tributary.llm.ragged import chunks
from tributary.llm.tables import Workspace

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def sides():
    return al._sides(open(A, encoding="utf-8").read(), open(B, "rb").read())


def spans(libraries, text):
    """Ids and byte ranges of both sides; none where a side doesn't give the text back."""
    a, b = libraries
    if not text:
        return [], []
    whole = " " + text
    at, side_a = 0, []
    e = a.encode(whole, add_special_tokens=False)
    back = {v: k for k, v in _byte_characters().items()}
    for i in e.ids:
        n = len(bytes(back[c] for c in a.id_to_token(i)))
        side_a.append((i, at, at + n))
        at += n
    joined, side_b = b"", []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        raw = bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
        side_b.append((i, len(joined), len(joined) + len(raw)))
        joined += raw
    joined_a = b"".join(bytes(back[c] for c in a.id_to_token(i)) for i in e.ids)
    return (side_a, side_b) if joined == joined_a == whole.encode() else ([], [])


def _byte_characters():
    from tokenizers.pre_tokenizers import ByteLevel

    out, free = {}, 256
    assert len(ByteLevel.alphabet()) == 256
    for i in range(256):
        if chr(i) in ByteLevel.alphabet() and (33 <= i < 127 or i > 160):
            out[i] = chr(i)
        else:
            out[i], free = chr(free), free + 1
    return out


def brute(libraries, texts):
    rows, counts = [], Counter()
    for text in texts:
        a, b = spans(libraries, text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, begin = [], 0
        for e in ends:
            part = ["%d" % i for i, s, t in a if begin <= s and t <= e], ["%d" % i for i, s, t in b if begin <= s and t <= e]
            groups.append("|".join(map(",".join, part)))
            begin = e
        rows.append((a, b, groups, links))
        counts.update(links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "the quick brown foxes", "▁", "a▁b", "x<|endoftext|>y", "<s>a</s>", "<0x0A>", "line\nbreak\r\n\ttab", "naïve café", "ﬁ①", "日本語のテキスト", "👩‍👩‍👧 family", "\x00\x01", "'s 'll don't", "1234567890", "  　", "é", None]
pieces = st.sampled_from([" ", "  ", "a", "the", "ing", "\n", "\t", "é", "▁", "中文", "😀", "<s>", "<|endoftext|>", "don't", "123", ".", " ", "\x00", "ﬁ"])
texts = st.lists(pieces, max_size=14).map("".join) | st.text(max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts | st.none(), min_size=1, max_size=5))
def test_owners_are_byte_by_byte(libraries, sides, rows):
    found = []
    for t in chunks(pa.array(rows, pa.string())):
        columns = al._aligned(t, *sides, 0)
        found += list(zip(*(c.to_pylist() for c in (*columns[1:5], columns[5])), strict=True))
    want = [(len(a), len(b), g, n) for a, b, g, n in ((a, b, [], 0) for a, b in (spans(libraries, x) for x in rows))]
    assert [f[:2] for f in found] == [w[:2] for w in want]
    for f, (n_a, n_b, n_groups, n_links, _, _, digest) in zip(found, brute(libraries, rows), strict=True):
        assert f[:4] == (n_a, n_b, n_groups, n_links)
        assert (hashlib.sha256(f[4].encode()).hexdigest() if n_a else f[4]) == digest


@pytest.mark.parametrize("known", [1 << 20, 40, 0])
def test_alignment_query(spark, libraries, known):
    long = " ".join(f"word{i % 97} of réel x{i % 13}." for i in range(12000))
    rows = [*ODD, long, "the quick brown foxes", "the quick brown foxes"]
    ids = [*range(len(ODD)), 100, None, 7]
    df = spark.createDataFrame([(i, x, -1) for i, x in zip(ids, rows, strict=True)], "doc_id long, text string, n_links long").repartition(5)
    found = al.alignment(df, A, B, known=known)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    got = sorted((tuple(r) for r in found.collect()), key=key)
    assert got == sorted(((i, *w) for i, w in zip(ids, brute_fast(libraries, rows), strict=True)), key=key)


def brute_fast(libraries, rows):
    """brute(), with overlaps found by walking both sides at once."""
    parts, counts = [], Counter()
    for text in rows:
        a, b = spans(libraries, text)
        i = j = 0
        links, groups, held = [], [], ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            x, y = a[i][2], b[j][2]
            if x <= y:
                held[0].append(a[i][0])
                i += 1
            if y <= x:
                held[1].append(b[j][0])
                j += 1
            if x == y:
                groups.append("|".join(",".join(map(str, h)) for h in held))
                held = ([], [])
        parts.append((a, b, groups, links))
        counts.update(links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(len(a), len(b), len(g), len(n), sum(counts[x] == most[x[1]] for x in n), sum(counts[x] for x in n), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, n in parts]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert al.alignment(df, A, B).count() == 0


def test_rows_without_tokens_only(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert [tuple(r) for r in al.alignment(df, A, B).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_kept_rows_hold_both_sides(spark, libraries):
    df = spark.createDataFrame([(1, "two words"), (2, "")], "doc_id long, text string")
    a, b = Workspace(spark, "t").keep(al.align(df, A, B), "x").orderBy("doc_id").collect()
    side_a, side_b = spans(libraries, "two words")
    assert [int.from_bytes(a["a"][i : i + 2], "little") for i in range(0, len(a["a"]), 2)] == [i for i, _, _ in side_a]
    assert [int.from_bytes(a["b"][i : i + 2], "little") for i in range(0, len(a["b"]), 2)] == [i for i, _, _ in side_b]
    assert b["groups"] == "" and b["a"] == b""
