"""Steps that sent too much through the driver or did more work than their result needs."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from sylvan.llm import bpe, decontaminate, simhash
from sylvan.operators import overlay as ov


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_never_go_through_the_driver(spark, monkeypatch):
    """The file of the nodes of many networks is tiny beside its rows, so no estimate may make them a broadcast table."""
    written, write = [], ov.written_table
    monkeypatch.setattr(ov, "written_table", lambda df: written.append((set(df.columns), optimized(df).count("strategy=merge"))) or write(df))
    edges = spark.createDataFrame([(p, i, i + 1, 10.0 + i) for p in range(3) for i in range(4)], "park_id long, a long, b long, length double")
    net = ov.network(edges)
    src = net.nodes.select("park_id", F.col("node").alias("src"))
    dep, dist = ov.dependencies(net, src), ov.distances(net, src)
    joins = {name: [n for cols, n in written if name in cols] for name in ("part2", "blk")}
    assert joins == {"part2": [2], "blk": [2, 2]}  # arcs with both ends, sources with their place, in two uses
    assert optimized(dep).count("strategy=merge") == 2 and optimized(dist).count("strategy=merge") == 3  # sources with their part, results with their node
    assert {(r.park_id, r.node): r.dependency for r in dep.collect()} == {(p, n): 2.0 * n * (4 - n) for p in range(3) for n in (1, 2, 3)}
    assert dist.filter("src = 0 and node = 4 and distance = 46").count() == 3


def test_tiles_are_paired_by_the_counts_of_quarters(spark):
    """Fingerprints of equal counts in both halves, but not in their quarters, are never compared; near ones of neighbouring tiles are."""
    rnd = random.Random(4)
    ones = lambda at, n: sum(1 << b for b in rnd.sample(range(at, at + 16), n))
    one, other = ({ones(0, a) | ones(16, 16 - a) | ones(32, 8) | ones(48, 8) for _ in range(32)} for a in (4, 12))
    fps = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in one | other], "fp long")
    tiles = simhash.tiles_of(fps, 8)
    held = {r.tile: {x & (1 << 64) - 1 for x in r.fps} for r in tiles.collect()}
    pairs = {(r.a, r.b) for r in simhash.tile_pairs(tiles).collect()}
    # eight tiles: four of each kind, all of a kind paired
    assert sorted(map(len, held.values())) == [8] * 8 and len(pairs) == 20
    assert not any(held[a] | held[b] > {x, y} for a, b in pairs for x in one for y in other)


def test_blocks_of_any_order_lose_no_link():
    """More fingerprints than a block, near copies far apart in the order of counts: the same groups as all pairs give."""
    rnd = np.random.default_rng(5)
    f = rnd.integers(0, 1 << 63, 1200, dtype=np.uint64)
    for i in range(0, 600, 2):  # bits of one quarter, or of all
        f[1199 - i] = f[i] ^ sum((np.uint64(1) << np.uint64(b) for b in rnd.choice(16 if i % 4 else 64, rnd.integers(1, 6), replace=False)), np.uint64(0))
    f = np.unique(f)
    for a, b in ((f, None), (f[:700], f[700:])):
        every = a if b is None else np.concatenate([a, b])
        x, y = np.nonzero(np.bitwise_count(a[:, None] ^ (a if b is None else b)[None]) <= 4)
        want, got = simhash.Groups(len(every)), simhash.Groups(len(every))
        want.join(x, y + (0 if b is None else len(a)))
        at = {int(v): i for i, v in enumerate(every)}
        u, v = simhash.forest(a, b, 4)
        got.join(np.array([at[int(x)] for x in u], int), np.array([at[int(x)] for x in v], int))
        assert len(u) and (want.root == got.root).all()


def test_full_tables_keep_their_states():
    """Words met before the table was full need no new state after it, whatever came between; the ids stay right and the tables bounded."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    t, whole, rnd, made = bpe.Transducer(ranks, max_states=600), bpe.Transducer(ranks), random.Random(6), []
    move = t._move
    t._move = lambda at, byte: made.append(byte) or move(at, byte)
    usual = [" the", " of", " water", "stone", " 1984", "été"]
    for w in usual:
        t.encode(w.encode())
    full = 0
    for _ in range(400):
        w = "".join(rnd.choice("abdegiklmnorstu é€") for _ in range(rnd.randint(1, 12))).encode()
        assert t.encode(w) == whole.encode(w)
        # tables dropped as a whole leave less
        full += len(t.states) == 601
        if t.passed:
            made.clear()
            assert [t.encode(u.encode()) for u in usual] == [whole.encode(u.encode()) for u in usual] and not made
            break
    assert full
    most = len(t.moves)
    for _ in range(3000):
        w = "".join(rnd.choice("abdegiklmnorstu é€") for _ in range(rnd.randint(1, 12))).encode() * rnd.choice((1, 1, 1, 900))
        assert t.encode(w) == whole.encode(w)
        assert len(t.states) == len(t.number) <= 601 and len(t.same_paths) <= 601 and all(at <= 600 for at in t.ends)
        most = max(most, len(t.moves))
    assert most < 2000


def test_broken_characters_are_decoded_in_any_pieces():
    bytes_of = {i: b for b, i in bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    dec, rnd, ids = bpe.Decoder(bytes_of), random.Random(7), sorted(bytes_of)
    broken = [i for i in ids if i not in dec.whole]
    for _ in range(300):
        row = [rnd.choice(broken if rnd.random() < 0.4 else ids) for _ in range(rnd.randint(0, 30))]
        at = rnd.randint(0, len(row))
        state, _, text = bpe.utf8_step(0, b"", b"".join(bytes_of[i] for i in row))
        dec.reset()
        assert dec.feed(iter(row[:at])) + dec.feed(row[at:]) + dec.finish() == text + ("\ufffd" if state else "")


def test_documents_stay_where_they_are_while_few_are_dropped(spark):
    """The few dropped are sent to the documents, not the documents to them."""
    docs = spark.createDataFrame([(i, f"text number {i} has some words of its own and ends at {i * i}", "en") for i in range(20)] + [(20, "text number 3 has some words of its own and ends at 9", "en")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([("b", "number 7 has some words of its own and ends")], "item_id string, text string")
    for df, gone in ((simhash.without_copies(docs), 20), (decontaminate.clean_documents(docs, bench), 7)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        left = {r.doc_id for r in df.collect()}
        assert gone not in left and 3 in left
