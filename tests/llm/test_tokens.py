"""Operators 3, 4 and 6: against the tokenizer libraries and full re-encoding."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest

from sylvan.llm import bpe, token_counts, token_store

BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  world's\n\n", "漢字 éà😀 ", "a" * 5000, "12 345\t\x1c\x85\xa0 x", "<|endoftext|> Σς", "word " * 20_000, "Hello  world's\n\n"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})


def numbers(raw):
    out = array("I")
    out.frombytes(raw)
    return out.tolist()


def test_transducer_equals_library(reference):
    rng, enc, dec = random.Random(1), bpe.encoder(BYTES, P.PATTERN), bpe.decoder(BYTES)
    sets = ["ab", "abcdefghij", " \n\t", "0123456789", "éàü漢字😀", "=-*/_#", "aeiou the", "  x'reslld"]
    for _ in range(3000):
        chars = rng.choice(sets) + rng.choice(sets)
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))
        ids = numbers(enc.encode(text))
        assert ids == reference.encode_ordinary(text)
        assert "".join([dec.feed(ids[:3]), dec.feed(ids[3:]), dec.finish()]) == text  # a character may be split between calls


def test_transducer_equals_merging_and_forgets():
    rng, t = random.Random(2), bpe.Transducer(bpe.load_ranks(BYTES), max_states=50)
    for _ in range(1500):
        data = bytes(rng.choice(b"abcdeghilnorst \xc3\xa9") for _ in range(rng.randint(0, 40)))
        assert t.encode(data) == t.merge(data)
    long = b"ab" * 10_000 + b"theing" * 3000
    assert t.encode(long) == bpe.Transducer(bpe.load_ranks(BYTES)).encode(long)


def test_tokens_leave_after_bounded_lookahead():
    t, out = bpe.Transducer(bpe.load_ranks(BYTES)), []
    state, ahead = t.start, 0
    for i, b in enumerate(b"internationalisation" * 200):
        state = t.feed(state, bytes([b]), out)
        ahead = max(ahead, i + 1 - sum(len(t.bytes_of[x]) for x in out))
    assert ahead < 40


def test_malformed_utf8():
    for raw in (b"\xff", b"\xc3", b"\xe2\x82", b"a\xf0\x9f\x98b", b"\xed\xa0\x80", b"\xc0\xaf", "é😀".encode() + b"\x80"):
        state, _, text = bpe.utf8_step(0, b"", raw)
        assert text + ("�" if state else "") == raw.decode("utf-8", "replace")


def test_bpe_query(spark, reference):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.digests(d, BYTES, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decoded(bpe.encoded(d.select("doc_id", "text"), BYTES, P.PATTERN), BYTES).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both)
    assert bpe.digests(d.limit(0), BYTES, P.PATTERN).count() == 0


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    own, rng = token_store.WordEncoder(WORDS), random.Random(3)
    own.MOST_BYTES = 20_000
    chars = "aAéÉİΣσß'sdm 12\n\t\r\x1c\x85\xa0 ̈漢😀<|endoftext|>-_."
    for _ in range(2000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>"])
        assert numbers(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 20_000))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert token_store.PerfectHash.build(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5


def test_shards(spark):
    from tokenizers import Tokenizer

    rows = [(5, "b c"), (3, "a"), (None, "null key"), (None, None), (3, "again"), (3, "again"), (-7, None), (9, "word " * 3000), (8, "")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    folder = token_store.new_folder(spark)
    manifest = token_store.written_shards(d, folder, WORDS, shard_docs=2)
    got = sorted((tuple(r) for r in token_store.read_documents(manifest, folder).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(WORDS)
    assert [r[0] for r in got] == [None, None, -7, 3, 3, 3, 5, 8, 9]
    at, want = 0, {}
    for k, t in rows:
        want.setdefault(k, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    for key, start, n, crc in got:
        assert start == at
        at += n
        ids = next(x for x in want[key] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        want[key].remove(ids)
    assert not any(want.values())
    found = token_store.lookup(manifest, folder, spark.createDataFrame([(3,), (4,), (9,), (None,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in found) == [3, 3, 3, 9]
    empty = token_store.written_shards(d.limit(0), token_store.new_folder(spark), WORDS)
    assert token_store.read_documents(empty, folder).count() == 0


def test_edits_equal_full_encoding():
    rng, enc = random.Random(5), bpe.encoder(BYTES, P.PATTERN)
    sets = ["ab 's", "abc  \n", "'re've s", " 12é漢", "\t  x'll"]
    for k in range(1200):
        chars = rng.choice(sets) + rng.choice(sets)
        draw = lambda n: "".join(rng.choice(chars) for _ in range(n))  # noqa: B023, E731
        text = draw(rng.randint(0, 900 if k % 20 == 0 else 60))
        tree = token_counts.PieceTree(text, enc)
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 0, 1, 3, 10])), draw(rng.choice([0, 1, 2, 30]))
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.n_chars == len(text) and tree.n_tokens == len(enc.encode(text)) // 4
            assert [p for x in tree.blocks for p in x] == enc.split.findall(text)


def test_edits_touch_little():
    enc, text = bpe.encoder(BYTES, P.PATTERN), "some words of a text " * 5000
    tree = token_counts.PieceTree(text, enc)
    tree.replace(50_000, 50_004, "other")
    assert tree.encoded < 20


def test_counts_query(spark):
    enc = bpe.encoder(BYTES, P.PATTERN)
    texts = [*TEXTS, "a ##$$ b  c\n%%%"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in token_counts.counted(d, BYTES, P.PATTERN).collect():
        t = texts[r["doc_id"]] or ""
        e = token_counts.cleaning_edits(t)
        assert (r["n_edits"], r["n_tokens_before"], r["n_tokens_after"]) == (len(e), len(enc.encode(t)) // 4, len(enc.encode(token_counts.edited(t, e))) // 4)
    assert token_counts.counted(d.limit(0), BYTES, P.PATTERN).count() == 0
