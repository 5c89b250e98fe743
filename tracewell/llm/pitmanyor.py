"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants: one per word of the training part, for the tokens that follow it,
and one parent that all of them share.  The parent's base is uniform over the
training words and one unknown word.  A token's probability is that of its
context's restaurant, which backs off to the parent; after a word that the
training part lacks it is the parent's.

Seating is sampled by blocked Gibbs steps: a dish's customers in a restaurant
are seated anew by the Chinese-restaurant rule, given the parent's current
probabilities and the table totals of the sweep before.  Customers are seated
one by one up to ``ONE_BY_ONE`` and then in groups of a sixteenth of those
seated.  After the burn-in, predictive probabilities are averaged over
``SAMPLES`` sweeps.

All counts are gathered from the whole training part of the corpus through
word buckets (see ``blocks``).  Words are numbered, rank in the bucket times
buckets plus the bucket, and a bucket holds all pairs of its words with the
words before them.  A dish that a context has once always has one table there,
so a sweep seats the pairs seen twice or more; the number of the others is kept
per word and per context.  A context's tables lie in many buckets: each sends
its sums to the context's bucket and gets the totals back.  Only totals of the
whole corpus go through the driver.

Defined results: a null text is an empty one, whose only token is the end; an
empty training part gives every token the probability 1 / 1 of the unknown
word; repeated rows are scored and counted each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .blocks import MOST_PARTITIONS, PACKED_DDL, answer, ask, bucket_count, expand, planes, settle, squeeze, unplanes, write_blocks
from .strings import batches_of, words

BURN_IN, SAMPLES = 1, 2
ONE_BY_ONE = 16
STRENGTH = 1.0
#: Bytes of text whose words are hashed at a time.
STEP_BYTES = 1_000_000

#: The end of a document, which is also the context of its first word.
END = np.uint64(0x5EED0E9D00000001)
#: The number of all words that the training part lacks, and their rank.
UNKNOWN, UNRANKED = np.uint64(2**64 - 1), 2**32 - 1


def in_training(doc: int | None, parts: int = 5, held_out: int = 1) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % parts != held_out


def make_block(ids: list, bodies: list[bytes], _rest: pa.Table) -> tuple[bytes, int]:
    """Documents as places in the block's sorted list of distinct words; the weight is the training tokens."""
    hashed, counts = [], []
    for part in batches_of(bodies, STEP_BYTES):
        own, n = words(bodies[part])
        ends = np.cumsum(n)
        hashed.append(np.insert(own, ends, END))
        counts.append(n + 1)
    counts = np.concatenate(counts)
    distinct, places = np.unique(np.concatenate(hashed), return_inverse=True)
    train = np.array([in_training(d) for d in ids])
    none = np.array([d is None for d in ids], np.uint8)
    known = np.array([0 if d is None else d for d in ids], "<i8")
    return squeeze(known, none, counts.astype("<i8"), train.astype(np.uint8), planes(places.astype("<u4")), distinct), int(counts[train].sum())


class Block:
    def __init__(self, data: bytes):
        ids, none, counts, train, places, distinct = expand(data)
        self.docs = [None if gone else d for d, gone in zip(np.frombuffer(ids, "<i8").tolist(), none, strict=True)]
        self.counts = np.frombuffer(counts, "<i8")
        self.train = np.frombuffer(train, np.uint8).astype(bool)
        self.places = unplanes(places, "<u4").astype(np.int64)
        self.words = np.frombuffer(distinct, np.uint64)
        self.token_train = np.repeat(self.train, self.counts)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words by bucket, and where each bucket's end."""
        own = (self.words % np.uint64(buckets)).astype(np.int64)
        return np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=buckets))

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.places[self.token_train], minlength=len(self.words))


class Numbered(Block):
    """A block whose words are numbers in ascending order; those that the training part lacks are one word, the last."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.words = unplanes(self.words.tobytes(), "<u8")
        self.known = int(np.searchsorted(self.words, UNKNOWN))
        end = self.places[self.counts[0] - 1]
        self.before = np.concatenate(([end], self.places[:-1]))  # a document's first word follows the end of the one before

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        own = (self.words[: self.known] % np.uint64(buckets)).astype(np.int64)
        return np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=buckets))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of training words as word << 32 | context, their training counts, and each token's pair (-1: an unknown word)."""
        known = (self.places < self.known) & (self.before < self.known)
        keys, inverse = np.unique(self.places[known] << 32 | self.before[known], return_inverse=True)
        token = np.full(len(self.places), -1, np.int64)
        token[known] = inverse
        return keys, np.bincount(inverse[self.token_train[known]], minlength=len(keys)), token

    def pairs_by_bucket(self, keys: np.ndarray, buckets: int):
        """Bucket, its words' places, the pairs of each of them, and the pairs' rows, for every bucket with words of this block."""
        order, ends = self.by_bucket(buckets)
        begins = np.searchsorted(keys >> 32, np.arange(self.known + 1))
        for bucket, own in enumerate(np.split(order, ends[:-1])):
            if len(own):
                n = begins[own + 1] - begins[own]
                yield bucket, own, n, np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _ints(data: bytes, kind: str) -> np.ndarray:
    return unplanes(data, kind) if data else np.zeros(0, kind)


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers; ``fresh`` is the weight of a new table, that of an old one is its customers less the discount."""
    tables = (customers > 0).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        group = 1 if seated < ONE_BY_ONE else seated // 16
        come = np.minimum(group, customers[active] - seated)
        weight = fresh[active]
        old = seated - discount * tables[active]
        tables[active] += draw.binomial(come, weight / (weight + old))
        seated += group
        active = active[customers[active] > seated]
    return tables


class State:
    """A bucket's seating: words with their counts, parent customers that come directly, and parent tables; pairs with counts and tables.

    A word's pairs that come once are direct customers of the parent; contexts are places in the bucket's list of them.
    """

    KINDS = ("<u8", "<i8", "<i8", "<i8", "<i4", "<i4", "<i4", "<i4")

    def __init__(self, words_, count, direct, parent_tables, pair_word, pair_context, pair_count, pair_tables):
        self.words, self.count, self.direct, self.parent_tables = words_, count, direct, parent_tables
        self.pair_word, self.pair_context, self.pair_count, self.pair_tables = pair_word, pair_context, pair_count, pair_tables

    @classmethod
    def read(cls, data: bytes) -> State:
        return cls(*(_ints(p, k) for p, k in zip(expand(data), cls.KINDS, strict=True)))

    def pack(self) -> bytes:
        fields = (self.words, self.count, self.direct, self.parent_tables, self.pair_word, self.pair_context, self.pair_count, self.pair_tables)
        return squeeze(*(planes(x.astype(k)) for x, k in zip(fields, self.KINDS, strict=True)))

    def parent_customers(self) -> np.ndarray:
        return self.direct + np.bincount(self.pair_word, self.pair_tables, len(self.words)).astype(np.int64)

    def totals(self, contexts: int) -> np.ndarray:
        """Customers and tables of each context, then of the parent in the last row."""
        own = np.zeros((contexts + 1, 2), np.int64)
        own[:contexts, 0] = np.bincount(self.pair_context, self.pair_count, contexts)
        own[:contexts, 1] = np.bincount(self.pair_context, self.pair_tables, contexts)
        own[contexts] = self.parent_customers().sum(), self.parent_tables.sum()
        return own


class Restaurants:
    """What a sweep knows of the whole corpus: totals (contexts, then the parent), discounts and the number of words."""

    def __init__(self, totals: np.ndarray, discounts: tuple[float, float], vocabulary: int):
        self.totals, self.discounts, self.base = totals, discounts, 1 / (vocabulary + 1)

    def parent(self, customers, tables):
        """Predictive probabilities of the parent for dishes with these customers and tables there."""
        discount = self.discounts[0]
        all_customers, all_tables = self.totals[-1]
        return (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * all_tables) * self.base) / (STRENGTH + all_customers)

    def child(self, context, customers, tables, parent):
        discount = self.discounts[1]
        all_customers, all_tables = self.totals[context, 0], self.totals[context, 1]
        return (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * all_tables) * parent) / (STRENGTH + all_customers)

    def sweep(self, state: State, seed: int) -> State:
        """The bucket's dishes seated anew: first in the contexts, then their tables in the parent."""
        draw = np.random.default_rng((seed, len(state.words), int(state.words[0]) if len(state.words) else 0))
        parent = self.parent(state.parent_customers(), state.parent_tables)
        if len(state.pair_word):
            fresh = (STRENGTH + self.discounts[1] * self.totals[state.pair_context, 1]) * parent[state.pair_word]
            state.pair_tables = seat(state.pair_count, fresh, self.discounts[1], draw)
        fresh = np.full(len(state.words), (STRENGTH + self.discounts[0] * self.totals[-1, 1]) * self.base)
        state.parent_tables = seat(state.parent_customers(), fresh, self.discounts[0], draw)
        return state


def _discount(ones: int, twos: int) -> float:
    """The usual estimate from how many dishes come once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


#: Rows between buckets: states, what one asks of the other, and questions of blocks.
ROWS = pa.schema([("kind", pa.string()), ("uri", pa.string()), ("bucket", pa.int64()), ("payload", pa.binary()), ("facts", pa.list_(pa.int64()))])
ROWS_DDL = "kind string, uri string, bucket bigint, payload binary, facts array<bigint>"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS) if rows else ROWS.empty_table()


def _by_target(contexts: np.ndarray, buckets: int):
    """Each bucket that has some of the contexts, and their places."""
    target = (contexts % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
        if len(own):
            yield int(target[own[0]]), own


def _open_state(payload: bytes) -> tuple[State, np.ndarray]:
    state, contexts = expand(payload)
    return State.read(state), _ints(contexts, "<u8")


def _state_row(bucket: int, state: State, contexts: np.ndarray, facts: list[int]) -> tuple:
    """Facts start with the parent's customers and tables."""
    return "state", str(bucket), bucket, squeeze(state.pack(), planes(contexts)), [int(state.parent_customers().sum()), int(state.parent_tables.sum()), *facts]


def text_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every text."""
    spark = docs.sparkSession
    folder = work.workspace(spark, "pitmanyor")
    manifest = write_blocks(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")), folder, make_block)
    buckets = bucket_count(manifest)
    tokens = int(manifest.agg(F.sum("weight")).first()[0] or 0)
    parts_of_shuffle = min(2 * buckets, MOST_PARTITIONS)

    def ask_words(data: bytes):
        block = Block(data)
        order, ends = block.by_bucket(buckets)
        counts = block.train_counts()
        for bucket, own in enumerate(np.split(order, ends[:-1])):
            if len(own):
                yield bucket, squeeze(block.words[own], planes(counts[own].astype("<u4")))

    def rank_words(payloads: list[bytes]) -> list[bytes]:
        """Ranks by falling count, so that frequent words have small numbers."""
        parts = [expand(p) for p in payloads]
        hashes = [np.frombuffer(p[0], np.uint64) for p in parts]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unplanes(p[1], "<u4") for p in parts]), len(distinct))
        order = np.argsort(-counts, kind="stable")
        ranks = np.empty(len(distinct), np.int64)
        ranks[order] = np.arange(len(distinct))
        ranks[counts == 0] = UNRANKED
        return [squeeze(planes(own.astype("<u4"))) for own in np.split(ranks[inverse], np.cumsum([len(h) for h in hashes])[:-1])]

    def number(data: bytes, told: dict[int, bytes]) -> pa.Table:
        block = Block(data)
        order, ends = block.by_bucket(buckets)
        numbers = np.empty(len(block.words), np.uint64)
        for bucket, own in enumerate(np.split(order, ends[:-1])):
            if len(own):
                ranks = unplanes(expand(told[bucket])[0], "<u4").astype(np.uint64)
                numbers[own] = np.where(ranks == UNRANKED, UNKNOWN, ranks * np.uint64(buckets) + np.uint64(bucket))
        distinct, places = np.unique(numbers, return_inverse=True)
        uri = f"{folder}/numbered/{work.fresh_name('block')}"
        work.write_file(uri, squeeze(*expand(data)[:4], planes(places[block.places].astype("<u4")), planes(distinct)))
        return pa.table({"uri": [uri]})

    numbered = work.materialize(settle(manifest, answer(ask(manifest, ask_words), buckets, rank_words), number, "uri string"), f"{folder}/numbered-manifest")
    work.remove(spark, f"{folder}/blocks")

    def ask_pairs(data: bytes):
        block = Numbered(data)
        keys, counts, _ = block.pairs()
        for bucket, own, n, rows in block.pairs_by_bucket(keys, buckets):
            contexts = block.words[keys[rows] & 0xFFFFFFFF]
            yield bucket, squeeze(planes((block.words[own] // np.uint64(buckets)).astype("<u4")), planes(n.astype("<u4")), planes(contexts), planes(counts[rows].astype("<u4")))

    def start(table: pa.Table) -> pa.Table:
        """A bucket's state, with a table for every kind of dish; each context's pairs that come once; and the blocks' questions as places in the state."""
        bucket = table.column("bucket")[0].as_py()
        parts = [[_ints(x, k).astype(np.int64) for x, k in zip(expand(p), ("<u4", "<u4", "<u8", "<u4"), strict=True)] for p in table.column("payload").to_pylist()]
        size = 1 + max(int(p[0].max()) for p in parts)
        contexts, context = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        asked = np.concatenate([np.repeat(p[0], p[1]) for p in parts]) << 32 | context
        seen = np.concatenate([p[3] for p in parts])
        keys, inverse = np.unique(asked[seen > 0], return_inverse=True)
        pair_count = np.bincount(inverse, seen[seen > 0], len(keys)).astype(np.int64)
        word, context = keys >> 32, keys & 0xFFFFFFFF
        count = np.bincount(word, pair_count, size).astype(np.int64)
        many = pair_count > 1
        used, place = np.unique(context[many], return_inverse=True)
        direct = np.bincount(word[~many], minlength=size)
        state = State(np.arange(size, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket), count, direct, np.ones(size, np.int64), word[many], place, pair_count[many], np.ones(len(place), np.int64))
        facts = [size, *(int(np.count_nonzero(x == k)) for x in (count, pair_count) for k in (1, 2))]
        out = [_state_row(bucket, state, contexts[used].astype(np.uint64), facts)]

        once = np.bincount(context[~many], minlength=len(contexts))
        single = np.flatnonzero(once)
        for target, own in _by_target(contexts[single].astype(np.uint64), buckets):
            out.append(("once", str(bucket), target, squeeze(planes((contexts[single[own]] // buckets).astype("<u4")), planes(once[single[own]].astype("<u4"))), None))

        at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        hit = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
        code = np.where(hit, 1 + many[at], 0).astype(np.uint8) if len(keys) else np.zeros(len(asked), np.uint8)
        active = np.cumsum(many) - 1
        ends = np.cumsum([len(p[2]) for p in parts])
        for uri, own, begin, end in zip(table.column("uri").to_pylist(), parts, [0, *ends[:-1]], ends, strict=True):
            mine = code[begin:end]
            places = active[at[begin:end][mine == 2]] if len(keys) else np.zeros(0, np.int64)
            out.append(("question", uri, bucket, squeeze(planes(np.diff(own[0], prepend=0).astype("<u4")), mine, planes(np.diff(places, prepend=0).astype("<u4"))), None))
        return _rows(out)

    begun = work.materialize(ask(numbered, ask_pairs).repartition(parts_of_shuffle, "bucket").groupBy("bucket").applyInArrow(start, ROWS_DDL), f"{folder}/begun")

    def add_up(table: pa.Table) -> pa.Table:
        parts = [expand(p) for p in table.column("payload").to_pylist()]
        ranks = np.concatenate([unplanes(p[0], "<u4") for p in parts])
        total = np.bincount(ranks, np.concatenate([unplanes(p[1], "<u4") for p in parts])).astype("<i8")
        return _rows([("once", "", table.column("bucket")[0].as_py(), squeeze(planes(total)), None)])

    once = work.materialize(begun.where("kind = 'once'").repartition(parts_of_shuffle, "bucket").groupBy("bucket").applyInArrow(add_up, ROWS_DDL), f"{folder}/once")

    def send(batches):
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                state, contexts = _open_state(payload)
                tables = np.bincount(state.pair_context, state.pair_tables, len(contexts))
                rows = [("ask", str(bucket), target, squeeze(planes((contexts[own] // np.uint64(buckets)).astype("<u4")), planes(tables[own].astype("<i8"))), None) for target, own in _by_target(contexts, buckets)]
                yield from _rows(rows).combine_chunks().to_batches()

    def reply(table: pa.Table) -> pa.Table:
        """Tables of the bucket's words as contexts, for every bucket that asks and as a whole."""
        bucket, payloads = table.column("bucket")[0].as_py(), table.column("payload").to_pylist()
        kinds, uris = table.column("kind").to_pylist(), table.column("uri").to_pylist()
        asks = [(uri, [_ints(x, k) for x, k in zip(expand(p), ("<u4", "<i8"), strict=True)]) for kind, uri, p in zip(kinds, uris, payloads, strict=True) if kind == "ask"]
        alone = [_ints(expand(p)[0], "<i8") for kind, p in zip(kinds, payloads, strict=True) if kind == "once"]
        size = max([len(x) for x in alone] + [1 + int(ranks.max()) for _, (ranks, _) in asks])
        total = np.zeros(size, np.int64)
        for x in alone:
            total[: len(x)] += x
        for _, (ranks, tables) in asks:
            total[ranks] += tables
        return _rows([("totals", "", bucket, squeeze(planes(total)), None), *(("reply", uri, bucket, squeeze(planes(total[ranks])), None) for uri, (ranks, _) in asks)])

    def exchange(state: DataFrame, name: str) -> DataFrame:
        asks = state.mapInArrow(send, ROWS_DDL).unionByName(once)
        return work.materialize(asks.repartition(parts_of_shuffle, "bucket").groupBy("bucket").applyInArrow(reply, ROWS_DDL), f"{folder}/{name}")

    def sums(state: DataFrame, n: int) -> list[int]:
        return [int(x or 0) for x in state.agg(*(F.sum(F.col("facts")[i]) for i in range(n))).first()]

    state = begun.where("kind = 'state'")
    *parent, vocabulary, word_once, word_twice, pair_once, pair_twice = sums(state, 7)
    discounts = (_discount(word_once, word_twice), _discount(pair_once, pair_twice))
    told = exchange(state, "totals-0")

    def sweep(parent: list[int], step: int):
        def run(table: pa.Table) -> pa.Table:
            rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True))
            bucket, payload = next((b, p) for kind, b, p in rows if kind == "state")
            totals_of = {b: p for kind, b, p in rows if kind == "reply"}
            state_, contexts = _open_state(payload)
            totals = np.zeros((len(contexts) + 1, 2), np.int64)
            totals[-1] = parent
            for target, own in _by_target(contexts, buckets):
                totals[own, 1] = unplanes(expand(totals_of[target])[0], "<i8")
            new = Restaurants(totals, discounts, vocabulary).sweep(state_, step)
            return _rows([_state_row(bucket, new, contexts, [])])

        return run

    models = []
    for step in range(BURN_IN + SAMPLES):
        both = state.unionByName(told.where("kind = 'reply'"))
        state = work.materialize(both.repartition(parts_of_shuffle, "uri").groupBy("uri").applyInArrow(sweep(parent, step), ROWS_DDL), f"{folder}/state-{step + 1}")
        parent = sums(state, 2)
        told = exchange(state, f"totals-{step + 1}")
        if step >= BURN_IN:
            models.append((step, state, told.where("kind = 'totals'"), tuple(parent)))
        if 1 <= step <= BURN_IN:
            work.remove(spark, f"{folder}/state-{step}")

    both = begun.where("kind = 'question'")
    for step, sampled, totals, _ in models:
        for rows, kind in ((sampled, f"state-{step}"), (totals, f"totals-{step}")):
            both = both.unionByName(rows.withColumn("kind", F.lit(kind)))

    def predict(table: pa.Table) -> pa.Table:
        """What each block needs of its words and pairs: counts, and customers and tables of every sample."""
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "uri", "payload")), strict=True))
        held = {kind: p for kind, _, p in rows if kind != "question"}
        samples = []
        for step, *_ in models_of:
            state_, _ = _open_state(held[f"state-{step}"])
            samples.append((state_, state_.parent_customers(), _ints(expand(held[f"totals-{step}"])[0], "<i8")))
        out_uris, out = [], []
        for kind, uri, payload in rows:
            if kind != "question":
                continue
            ranks, code, places = expand(payload)
            ranks, places = (np.cumsum(_ints(x, "<u4").astype(np.int64)) for x in (ranks, places))
            words_ = [samples[0][0].count[ranks]] + [x[ranks] for s, customers, totals in samples for x in (customers, s.parent_tables, totals)]
            pairs = [samples[0][0].pair_count[places]] + [s.pair_tables[places] for s, *_ in samples]
            out_uris.append(uri)
            out.append(squeeze(*(planes(x.astype("<i8")) for x in words_), code, *(planes(x.astype("<i4")) for x in pairs)))
        return pa.table({"uri": pa.array(out_uris, pa.string()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int64()), "payload": pa.array(out, pa.binary())})

    models_of = [(step, parent_) for step, _, _, parent_ in models]
    answers = both.repartition(parts_of_shuffle, "bucket").groupBy("bucket").applyInArrow(predict, PACKED_DDL)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(data: bytes, told: dict[int, bytes]) -> pa.Table:
        block = Numbered(data)
        keys, _, token_pair = block.pairs()
        words_ = np.zeros((1 + 3 * len(models_of), len(block.words)), np.int64)
        pairs = np.zeros((1 + len(models_of), len(keys) + 1), np.int64)  # the last is for tokens without a pair
        for bucket, own, _, rows in block.pairs_by_bucket(keys, buckets):
            *of_words, code, of_pairs = [*(parts := expand(told[bucket]))[: len(words_)], np.frombuffer(parts[len(words_)], np.uint8), parts[len(words_) + 1 :]]
            for i, x in enumerate(of_words):
                words_[i, own] = unplanes(x, "<i8")
            pairs[:, rows[code == 1]] = 1
            for i, x in enumerate(of_pairs):
                pairs[i, rows[code == 2]] = _ints(x, "<i4")
        count, place, context = words_[0], block.places, block.before
        probability = np.zeros(len(place))
        for i, (_, parent_) in enumerate(models_of):
            customers, tables, totals = words_[1 + 3 * i : 4 + 3 * i]
            rules = Restaurants(np.vstack((np.stack((count, totals), 1), [parent_])), discounts, vocabulary)
            probability += rules.child(context, pairs[0][token_pair], pairs[1 + i][token_pair], rules.parent(customers, tables)[place]) / len(models_of)
        base = np.log10((count + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        starts = np.cumsum(block.counts) - block.counts
        columns = (block.docs, ~block.train, block.counts, np.add.reduceat(count[place] > 0, starts, dtype=np.int64), np.full(len(starts), tokens), np.add.reduceat(base[place], starts), np.add.reduceat(np.log10(probability), starts))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return settle(numbered, answers, finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
