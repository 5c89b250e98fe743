"""Operators on documents against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import blocks, media, minhash, packing, pitmanyor, quality, suffixdedup, wavelet, wordtable

SCHEMA = "doc_id bigint, text string, id string, uri string, bucket bigint, payload string, component string, class string, n bigint, rep bigint, unit string, label int"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def corpus() -> list[tuple[int, str | None]]:
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghilmnoprstuéüß") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared, base = line(40), line(120).split()
    texts: list[str | None] = [None, "", " \n\t", "one", "One", "two words", "İstanbul ΣΑΣ 数据 <|endoftext|> don't", "a b c  d\x1cf", "x" * 400, "ab " * 500]
    texts += [line(draw.randint(1, 80)) for _ in range(25)]
    texts += [f"{line(20)}\n{shared}\n{line(15)}" for _ in range(6)]
    for _ in range(8):  # near copies of one text
        copy = base[:]
        for _ in range(draw.randint(0, 5)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[12], texts[12], texts[20]]
    texts.append(line(9000))
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *("x",) * 2, 1, "y", "z", "c", 2, 3, "u", 4) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_map(df, key="doc_id"):
    out = {}
    for r in df.collect():
        assert r[key] not in out
        out[r[key]] = r
    return out


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_is_whole_and_gapless(docs, rows, empty):
    out = packing.packed_documents(docs, WORD, capacity=256).collect()
    pieces = defaultdict(dict)
    for r in out:
        pieces[r.doc_id][r.piece] = r
    for doc, text in rows:
        ids = [*ids_of(WORD, text), 0]
        own = pieces[doc]
        assert sorted(own) == list(range(-(-len(ids) // 256)))
        for k, r in own.items():
            part = ids[k * 256 : (k + 1) * 256]
            assert (r.start, r.length, r.ids_crc32) == (k * 256, len(part), crc(part))
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(own)) and sum(n for _, n in own) <= 256
    assert packing.packed_documents(empty, WORD).count() == 0
    with_ids = packing.packed_documents(docs, WORD, capacity=256, with_ids=True).where("doc_id is not null").collect()
    assert all(crc(r.ids) == r.ids_crc32 for r in with_ids)


def test_local_search_reaches_givers_behind_the_emptiest():
    """Twenty emptiest bins with one large piece offer nothing; the next one runs empty into the fuller ones."""
    lengths = [89] * 20 + [6] * 15 + [94] * 15
    start = [[i] for i in range(20)] + [list(range(20, 35))] + [[i] for i in range(35, 50)]
    found = packing.local_search(start, lengths, 100)
    assert sorted(i for b in found for i in b) == list(range(50))
    assert sorted(sum(lengths[i] for i in b) for b in found) == [89] * 20 + [100] * 15


def test_local_search_empties_bins():
    draw = np.random.default_rng(3)
    for lengths in (draw.integers(300, 900, 3000).tolist(), draw.integers(600, 1400, 3000).tolist(), [1500] * 50, [2048] * 3, [1], []):
        start = packing.best_fit(lengths, 2048)
        found = packing.local_search([b[:] for b in start], lengths, 2048)
        assert sorted(i for b in found for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in found)
        assert len(found) <= len(start)
    lengths = draw.integers(300, 900, 3000).tolist()
    assert len(packing.pack_lengths(lengths)) < len(packing.best_fit(lengths, 2048))


@pytest.mark.parametrize("swap", [([700, 700, 600], [1300, 700]), ([2000], [48, 48])])
def test_exchanges_raise_the_squared_fill(swap):
    giver, taker = (packing._Bin([(x, i + 10 * k) for i, x in enumerate(b)]) for k, b in enumerate(swap))
    if giver.fill > taker.fill:
        giver, taker = taker, giver
    before = giver.fill**2 + taker.fill**2
    if packing._improve(giver, taker, 2048):
        assert giver.fill**2 + taker.fill**2 > before and taker.fill <= 2048


@pytest.mark.parametrize("block_bytes", [8_000_000, 500])
def test_word_table_round_trip(docs, rows, empty, monkeypatch, block_bytes):
    monkeypatch.setitem(blocks.write_blocks.__kwdefaults__, "block_bytes", block_bytes)
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (3000,))
    tokenizer = Tokenizer.from_file(WORD)
    out = as_map(wordtable.encode_decode(docs, WORD))
    for doc, text in rows:
        ids = ids_of(WORD, text)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (out[doc].n_tokens, out[doc].ids_sha256, out[doc].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert wordtable.encode_decode(empty, WORD).count() == 0


def test_wavelet_shards_read_back(docs, rows, empty):
    out = as_map(wavelet.token_shards(docs, BYTE, shard_tokens=3000))
    start = 0
    for doc, text in sorted(rows):
        ids = [*ids_of(BYTE, text), 2]
        assert (out[doc].start, out[doc].n_tokens, out[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert wavelet.token_shards(empty, BYTE).count() == 0


def test_wavelet_matrix_access_count_select():
    draw = np.random.default_rng(2)
    for values in (draw.integers(0, 50, 3000), np.zeros(1, int), np.array([], int), np.full(700, 49)):
        values = values.astype(np.uint16)
        m = wavelet.WaveletMatrix.build(values, 6)
        assert (m.values() == values).all()
        for at in range(0, len(values), 97):
            assert m.access(at) == values[at]
        for v in (0, 7, 49, 63):
            places = np.flatnonzero(values == v)
            assert m.count(v) == len(places) and m.count(v, 5, 900) == ((places >= 5) & (places < 900)).sum()
            for nth in range(0, len(places), 13):
                assert m.select(v, nth) == places[nth]
            with pytest.raises(IndexError):
                m.select(v, len(places))
    shard = wavelet.Shard(wavelet.shard_bytes([3, None], [2, 1], np.array([50_000, 2, 2], np.uint16)))
    assert shard.docs == [3, None] and shard.tokens().tolist() == [50_000, 2, 2] and len(shard.matrix.planes) == 1
    assert [shard.token(i) for i in range(3)] == [50_000, 2, 2] and shard.count(2) == 2 and shard.find(2, 1) == 2 and shard.count(3) == 0
    with pytest.raises(ValueError):
        wavelet.Shard(b"nothing")


def brute_sets(rows, width):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = {}
    for doc, text in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().translate(table)) if x]
        out[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("width", "block", "key_block"), [(2, 1024, 2048), (5, 1024, 2048), (2, 3, 4)])
def test_minhash_components(docs, rows, empty, monkeypatch, width, block, key_block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "KEY_BLOCK", key_block)
    sets = brute_sets(rows, width)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = as_map(minhash.near_duplicates(docs, width=width))
    for d, s in sets.items():
        assert (out[d].n_shingles, out[d].component_id, out[d].kept) == (len(s), find(d), find(d) == d)
    assert len(set(map(find, sets))) < len(sets) - 3
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("block", "key_block"), [(1024, 2048), (8, 4), (3, 16)])
def test_minhash_large_groups_and_rows_without_ids(spark, monkeypatch, block, key_block):
    """Two groups of near copies, some of which are near others only, rows without ids, and ids with several texts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "KEY_BLOCK", key_block)
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    long, short = ([draw.choice(words) for _ in range(n)] for n in (200, 60))

    def edited(base, most):
        copy = base[:]
        for _ in range(draw.randint(0, most)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        return " ".join(copy)

    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))) for i in range(30)]
    rows += [(100 + i, edited(long, 14)) for i in range(50)] + [(200 + i, edited(short, 5)) for i in range(25)]
    rows += [(None, edited(short, 2)), (None, edited(short, 2)), (None, " ".join(long[:30])), (None, " ".join(long[:30])), (None, " ".join(long[:31])), (None, None), (301, ""), (7, edited(short, 1)), (302, rows[3][1])]
    sets = [brute_sets([(0, t)], 2)[0] for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and (rows[i][0] is not None and rows[i][0] == rows[j][0] or 100 * len(a & b) >= 80 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), width=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_minhash_index_keys_follow_the_pigeonhole():
    draw = np.random.default_rng(9)
    a = draw.integers(0, 1 << 16, (1, minhash.ROWS)).astype("<u2")
    for _ in range(200):
        b = a.copy()
        places = draw.choice(minhash.ROWS, minhash.MOST_ERRORS, replace=False)
        b[0, places] = b[0, places] ^ 1
        assert set(minhash.index_keys(a)[0]) & set(minhash.index_keys(b)[0])


def brute_repeats(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        mark = np.zeros(len(body) + 1, int)
        for a in range(len(body) - 99):
            w = body[a : a + 100]
            if w in seen:
                mark[a] += 1
                mark[a + 100] -= 1
            seen.add(w)
        gone = np.cumsum(mark[:-1]) > 0
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc] = (len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize(("block_bytes", "hot"), [(8_000_000, 20_000), (700, 20_000), (700, 1)])
def test_suffix_dedup(docs, rows, empty, monkeypatch, block_bytes, hot):
    monkeypatch.setitem(blocks.write_blocks.__kwdefaults__, "block_bytes", block_bytes)
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (3000,))
    monkeypatch.setattr(suffixdedup, "HOT_PHRASES", hot)
    want = brute_repeats(rows)
    out = as_map(suffixdedup.removal_digests(docs))
    for doc, _ in rows:
        r = out[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[doc][:4]
    assert sum(w[1] for w in want.values()) > 3000
    assert suffixdedup.removal_digests(empty).count() == 0


def test_suffix_dedup_keeps_rows_and_columns(docs, rows):
    want = brute_repeats(rows)
    out = suffixdedup.without_repeats(docs)
    assert out.schema == docs.schema
    for doc, r in as_map(out).items():
        assert r.text == want[doc][4].decode("utf-8", "ignore") and r.uri == "x" and r.n == 2


def test_suffix_dedup_of_repeated_rows(spark):
    text = "".join(chr(97 + i % 23) for i in range(150)) + "é" * 80
    out = suffixdedup.removal_digests(spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id bigint, text string")).collect()
    assert sorted(r.n_removed == r.n_bytes for r in out) == [False, False, True, True]


@pytest.mark.parametrize("block_bytes", [8_000_000, 600, 1])
@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_of_rows_that_share_an_id(spark, monkeypatch, block_bytes, hot):
    """Equal strings at one start of one id don't remove each other, whatever the blocks and the order of rows."""
    monkeypatch.setitem(blocks.write_blocks.__kwdefaults__, "block_bytes", block_bytes)
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (2000,))
    monkeypatch.setattr(suffixdedup, "HOT_PHRASES", hot)
    draw = random.Random(block_bytes + hot)
    words = ["".join(draw.choice("abcdef") for _ in range(5)) for _ in range(60)]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared = line(60)
    rows = [(7, shared + line(10)), (7, shared + line(10)), (7, line(5) + shared), (None, shared), (None, shared), (3, line(30) + "ab" * 300), (9, shared + "ab" * 200)]
    rows += [(20 + i % 3, line(10) + shared[50 * (i % 4) :] + line(8)) for i in range(9)]
    rows += [rows[0], rows[5]]
    order = lambda d, at: (d is not None, d or 0, at)
    first: dict[str, tuple] = {}
    for d, t in rows:
        for at in range(len(t) - 99):
            first[t[at : at + 100]] = min(first.get(t[at : at + 100], order(d, at)), order(d, at))
    want = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - 99):
            if first[t[at : at + 100]] < order(d, at):
                gone[at : at + 100] = True
        want.append((d, int(gone.sum()), hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()))
    draw.shuffle(rows)
    out = suffixdedup.removal_digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in out), key=str) == sorted(want, key=str)


def test_media_round_trip(docs, rows, empty):
    out = as_map(media.media_features(docs))
    for doc, text in rows:
        body = (text or "").encode()
        padded = body + b"\0" * (-len(body) % 64 if body else 64)
        r = out[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.mux(padded)).hexdigest() and r.feature.startswith("brand=isom;codec=raw ")
    assert media.media_features(empty).count() == 0
    index = media.media_index(media.media_column(docs)).where("keyframe = 0").collect()
    assert len(index) == len(rows)


def test_media_probe_of_odd_files():
    whole = media.mux(bytes(range(256)) * 600)
    info = media.probe(whole)
    track = info["tracks"][0]
    assert media.sample_bytes(whole, track) == bytes(range(256)) * 600
    ranges = media.keyframe_ranges(track)
    assert (ranges[1:, 0] == ranges[:-1, 1]).all() and ranges[-1, 1] - ranges[0, 0] == 600 * 256
    for bad in (None, b"", b"abc", whole[:200], whole[:-1000], b"\0\0\0\7free"):
        assert media.probe(bad)["error"] and media.probe(bad)["tracks"] == []
    unknown = media.box(b"wide") + whole.replace(b"ftyp", b"ftyp", 1)
    assert media.probe(unknown)["tracks"] and media.probe(unknown)["error"] is None or media.probe(unknown)["error"]


def test_pitman_yor_base_and_held_out(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (20_000,))
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {d: [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().translate(table)) if x] + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = as_map(pitmanyor.text_scores(docs))
    for d, ws in tokens.items():
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    assert pitmanyor.text_scores(empty).count() == 0


def test_pitman_yor_probabilities_sum_to_one():
    draw = np.random.default_rng(1)
    count = draw.integers(1, 40, 30).astype(np.int64)
    pair_word = np.repeat(np.arange(30), 2)
    pair_context = np.tile([0, 1], 30)
    pair_count = draw.integers(0, 5, 60).astype(np.int64)
    pair_count = np.minimum(pair_count, count[pair_word] // 2)
    direct = count - np.bincount(pair_word, pair_count, 30).astype(np.int64)
    state = pitmanyor.State(np.arange(30, dtype=np.uint64), count, direct, np.ones(30, np.int64), pair_word, pair_context, pair_count, (pair_count > 0).astype(np.int64))
    for step in range(3):
        state = pitmanyor.Restaurants(state.totals(2), (0.6, 0.7), 30).sweep(state, step)
        rules = pitmanyor.Restaurants(state.totals(2), (0.6, 0.7), 30)
        parent = rules.parent(state.parent_customers(), state.parent_tables)
        unknown = rules.parent(0, 0)
        assert abs(parent.sum() + unknown - 1) < 1e-9
        for u in (0, 1):
            own = pair_context == u
            child = rules.child(np.full(30, u), pair_count[own], state.pair_tables[own], parent)
            assert abs(child.sum() + rules.child(u, 0, 0, unknown) - 1) < 1e-9
        assert (state.pair_tables <= pair_count).all() and ((state.pair_tables > 0) == (pair_count > 0)).all()
    assert pitmanyor.State.read(state.pack()).pair_tables.tolist() == state.pair_tables.tolist()


def test_pitman_yor_gives_every_context_a_restaurant(spark, monkeypatch):
    """Scores as of a plain sampler over all contexts, however rare beside the 36,000 training tokens."""
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (60_000,))
    draw = random.Random(11)
    frequent = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(draw.choice(frequent) for _ in range(440))) for i in range(100)]
    # Each r word comes two or three times, always before its own s word.
    rows += [(1000 + i, f"r{i % 40} s{i % 40}") for i in range(120)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    ids = [d for d in range(5000, 6000) if held(d)]
    rows += [(ids[0], "r1 s1"), (ids[1], "r1 s2"), (ids[2], "unheard s1"), (ids[3], "r1 unheard"), (ids[4], None)]
    out = as_map(pitmanyor.text_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))

    pairs = Counter()
    for d, t in rows:
        if not held(d):
            pairs.update(zip([None, *(t or "").split()], [*(t or "").split(), None], strict=True))
    count = Counter()
    for (_, w), n in pairs.items():
        count[w] += n
    assert sum(count.values()) > 30_000 and 2 <= count["r1"] <= 3
    discount = lambda c: pitmanyor._discount(*(sum(n == k for n in c.values()) for k in (1, 2)))
    upper, lower = discount(count), discount(pairs)
    tables, top = dict.fromkeys(pairs, 1), dict.fromkeys(count, 1)

    def sums():
        own, customers = Counter(), Counter()
        for (u, w), t in tables.items():
            own[u] += t
            customers[w] += t
        return own, customers

    def parent(w, customers, before):
        return (max(customers[w] - upper * before.get(w, 0), 0) + (1 + upper * sum(before.values())) / (len(count) + 1)) / (1 + customers.total())

    def seat(n, fresh, d):
        t = 1
        for k in range(1, n):
            t += draw.random() < fresh / (fresh + k - d * t)
        return t

    mean = Counter()
    for step in range(12):
        own, customers = sums()
        above = {w: parent(w, customers, top) for w in count}
        tables = {(u, w): seat(n, (1 + lower * own[u]) * above[w], lower) for (u, w), n in pairs.items()}
        customers = sums()[1]
        top_tables = sum(top.values())
        top = {w: seat(customers[w], (1 + upper * top_tables) / (len(count) + 1), upper) for w in count}
        if step >= 2:
            own, customers = sums()
            above = {w: parent(w, customers, top) for w in [*count, "unheard"]}
            for u, w in {p for _, t in rows for p in zip([None, *(t or "").split()], [*(t or "").split(), None], strict=True)}:
                mean[u, w] += (max(pairs[u, w] - lower * tables.get((u, w), 0), 0) + (1 + lower * own[u]) * above[w]) / (1 + count[u]) / 10
    for d, t in rows:
        expected = sum(np.log10(mean[p]) for p in zip([None, *(t or "").split()], [*(t or "").split(), None], strict=True))
        assert abs(out[d].score - expected) < 0.02 * abs(expected) + 0.05, (t, out[d].score, expected)
    assert out[ids[0]].score > out[ids[1]].score + 0.5


def quality_rows():
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    out, labels = [], []
    for i in range(400):
        clean = [" ".join(draw.choice(words) for _ in range(draw.randint(5, 30))) + "." for _ in range(draw.randint(1, 6))]
        bad = i % 4 == 0
        if bad:
            clean[draw.randrange(len(clean)) :] = [" | ".join(draw.choice(words) for _ in range(40))] * 3
        out.append((i, "\n".join(clean)))
        labels.append((i, 0 if bad else 1))
    return out, labels


def test_quality_learns_held_out_labels(spark, empty):
    rows, labels = quality_rows()
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "\n \n")], "doc_id bigint, text string")
    known = spark.createDataFrame([*labels, (5000, 1), (None, 0), (7, None)], "doc_id bigint, quality int")
    out = as_map(quality.quality_scores(docs, known))
    held = {i for i in out if out[i].held_out}
    assert held == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = dict(labels)
    right = [out[i].predicted == truth[i] for i in held if i in truth]
    assert len(right) > 50 and np.mean(right) > 0.95
    again = as_map(quality.quality_scores(docs.orderBy("text").repartition(5), known))
    assert {i: r.score for i, r in again.items()} == {i: r.score for i, r in out.items()}
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1000].score == out[1001].score == out[1002].score
    assert quality.quality_scores(empty.select("doc_id", "text"), known).count() == 0
    nothing = quality.quality_scores(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in nothing.collect()} == {0.5}


def test_quality_gradients_match_differences():
    draw = np.random.default_rng(4)
    model = quality.Model(6)
    x, bags = draw.normal(size=(9, 6)), np.array([4, 2, 3])
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.5, 0.5])

    def loss():
        p = model.forward(x, bags)["score"]
        return float(-(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum())

    grads = model.gradients(x, bags, target, weight)
    for name, w in model.weights.items():
        for at in [tuple(i) for i in np.argwhere(np.ones(w.shape))[:: max(1, w.size // 5)]]:
            kept = w[at]
            w[at] = kept + 1e-6
            up = loss()
            w[at] = kept - 1e-6
            down = loss()
            w[at] = kept
            assert abs(grads[name][at] - (up - down) / 2e-6) < 1e-5, name
