"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages, its lines cut after ``PASSAGE_WORDS`` words.
Every passage of every text is encoded: counts of byte classes and measures of
word repetition, then a learned layer.  Gated attention, learned from the
documents' labels alone, weighs a document's passages, and the weighted
representation gives the score.

The model is fitted in the driver on at most ``TRAIN_DOCUMENTS`` labelled
documents, with all their passages; scoring reads every passage of every
document.  A score is computed in a fixed order of the document's own passages,
so it does not depend on the rows that share a batch.

Defined results: a text without words (null, empty, blank) has one all-zero
passage; labels that are null or of unknown documents teach nothing; without
two classes of labels every score is the share of label 1 (0.5 without any);
rows of a repeated id are scored each; input columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import work
from .strings import batches_of, mixed, word_hashes

PASSAGE_WORDS = 48
#: Bound on the labelled rows that the model is fitted on.
TRAIN_DOCUMENTS = 3000
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 16, 8, 40, 0.02, 1e-4
#: Bytes of text whose passages are encoded at a time.
STEP_BYTES = 200_000

# Byte classes: each ASCII punctuation mark its own; then digits, lower and upper case, blanks, line ends, other bytes.
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS = np.full(256, len(_MARKS) + 5, np.int64)
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = _k
_CLASS[0x30:0x3A] = len(_MARKS)
_CLASS[0x61:0x7B] = len(_MARKS) + 1
_CLASS[0x41:0x5B] = len(_MARKS) + 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C]] = len(_MARKS) + 3
_CLASS[[0x0A, 0x0D]] = len(_MARKS) + 4
CLASSES = len(_MARKS) + 6
FEATURES = CLASSES + 5
_BLANK = np.isin(_CLASS, (len(_MARKS) + 3, len(_MARKS) + 4))


def passages(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts (rows), and each text's number of passages, at least 1."""
    data = np.frombuffer(b"\n" + b"\n".join(bodies) + b"\n", np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    stops = np.cumsum([len(b) + 1 for b in bodies])
    owner = np.searchsorted(stops, starts)
    out = np.zeros((len(bodies), FEATURES), np.float32)
    if not len(starts):
        return out, np.ones(len(bodies), np.int64)
    lines = np.cumsum(data == 0x0A)
    first = np.ones(len(starts), bool)
    first[1:] = lines[starts[1:]] != lines[starts[:-1]]
    at_line = np.flatnonzero(first)
    within = np.arange(len(starts)) - np.repeat(at_line, np.diff(np.append(at_line, len(starts))))
    first |= within % PASSAGE_WORDS == 0
    begin = np.flatnonzero(first)
    words = np.diff(np.append(begin, len(starts)))
    passage = np.cumsum(first) - 1
    edges = starts[begin]
    # A passage ends where the next one begins, the last one behind its text's end; what lies between belongs to none.
    behind = np.append(edges[1:], len(data))
    stop = np.minimum(behind, stops[owner[begin]] + 1)
    segments = np.stack((stop - edges, behind - stop), axis=1).ravel()
    counts = np.bincount(np.repeat(np.arange(len(segments)), segments) * CLASSES + _CLASS[data[edges[0] :]], minlength=len(segments) * CLASSES).reshape(-1, CLASSES)[::2]
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~first[1:]
    kinds = _distinct(passage, hashes)
    length = ends - starts
    features = np.concatenate(
        (
            np.minimum(counts / words[:, None], 16),
            np.bincount(passage, again, len(begin))[:, None] / words[:, None],
            (np.bincount(kinds.astype(np.int64), minlength=len(begin)) / words)[:, None],
            np.log1p(words)[:, None],
            np.minimum(np.bincount(passage, length, len(begin)) / words, 64)[:, None],
            np.minimum(np.maximum.reduceat(length, begin), 256)[:, None],
        ),
        axis=1,
    ).astype(np.float32)
    bags = np.bincount(owner[begin], minlength=len(bodies))
    empty = np.flatnonzero(bags == 0)
    if len(empty):
        places = np.cumsum(bags)[empty]
        features = np.insert(features, places, 0, axis=0)
        bags[empty] = 1
    return features, bags


def _distinct(passage: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The passage of each distinct (passage, word)."""
    both = np.unique(mixed(hashes) & np.uint64((1 << 40) - 1) | passage.astype(np.uint64) << np.uint64(40))
    return both >> np.uint64(40)


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Matrix product whose rows are each summed in the order of the columns of x, whatever rows are beside them."""
    out = x[:, :1] * w[0]
    for k in range(1, len(w)):
        out += x[:, k : k + 1] * w[k]
    return out


class Model:
    """Parameters as arrays, so that a task's closure holds a few kilobytes."""

    def __init__(self, features: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.constant: float | None = None
        scaled = lambda a, b: draw.normal(0, 1 / np.sqrt(a), (a, b))
        self.weights = {"encode": scaled(features, HIDDEN), "encode_bias": np.zeros(HIDDEN), "content": scaled(HIDDEN, ATTENTION), "gate": scaled(HIDDEN, ATTENTION), "attend": scaled(ATTENTION, 1), "score": scaled(HIDDEN, 1), "score_bias": np.zeros(1)}

    def forward(self, x: np.ndarray, bags: np.ndarray, product=product) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        starts = np.cumsum(bags) - bags
        bag = np.repeat(np.arange(len(bags)), bags)
        encoded = np.tanh(product(x, w["encode"]) + w["encode_bias"])
        content, gate = np.tanh(product(encoded, w["content"])), 1 / (1 + np.exp(-product(encoded, w["gate"])))
        raw = product(content * gate, w["attend"])[:, 0]
        raw = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
        attention = raw / np.add.reduceat(raw, starts)[bag]
        pooled = np.add.reduceat(attention[:, None] * encoded, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(product(pooled, w["score"])[:, 0] + w["score_bias"][0], -40, 40)))
        return {"x": x, "bag": bag, "starts": starts, "encoded": encoded, "content": content, "gate": gate, "attention": attention, "pooled": pooled, "score": score}

    def gradients(self, x: np.ndarray, bags: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, bags, np.matmul)
        error = ((f["score"] - target) * weight / weight.sum())[:, None]
        pooled = error @ w["score"].T
        from_pool = pooled[f["bag"]]
        along = (from_pool * f["encoded"]).sum(axis=1)
        attention = f["attention"] * along
        raw = (attention - f["attention"] * np.add.reduceat(attention, f["starts"])[f["bag"]])[:, None]
        gated = raw @ w["attend"].T
        content = gated * f["gate"] * (1 - f["content"] ** 2)
        gate = gated * f["content"] * f["gate"] * (1 - f["gate"])
        encoded = (from_pool * f["attention"][:, None] + content @ w["content"].T + gate @ w["gate"].T) * (1 - f["encoded"] ** 2)
        return {"encode": f["x"].T @ encoded, "encode_bias": encoded.sum(axis=0), "content": f["encoded"].T @ content, "gate": f["encoded"].T @ gate, "attend": (f["content"] * f["gate"]).T @ raw, "score": f["pooled"].T @ error, "score_bias": error.sum(axis=0)}

    def fit(self, bags_of_passages: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adam on small batches; both classes weigh the same."""
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        # Every document counts the same, however many passages it has.
        everything, share = np.concatenate(bags_of_passages), np.concatenate([np.full(len(b), 1 / len(b)) for b in bags_of_passages])
        self.mean = np.average(everything, axis=0, weights=share)
        self.scale = np.maximum(np.sqrt(np.average((everything - self.mean) ** 2, axis=0, weights=share)), 0.05)
        balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.weights.items()}
        draw, step = np.random.default_rng(seed), 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(labels))
            for at in range(0, len(order), 128):
                own = order[at : at + 128]
                step += 1
                grads = self.gradients(np.concatenate([bags_of_passages[i] for i in own]), np.array([len(bags_of_passages[i]) for i in own]), labels[own], balance[own])
                for name, grad in grads.items():
                    grad = grad + DECAY * self.weights[name]
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    self.weights[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x, bags)["score"] if self.constant is None else np.full(len(bags), self.constant)


def fold(id_col: str, parts: int = 5):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold, chosen by a hash of their ids."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & (fold("id") != 0))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    schema = pa.schema([("label", pa.float64()), ("passages", pa.binary())])

    def encode(batches):
        for batch in batches:
            bodies = [b.as_py() or b"" for b in batch.column(1)]
            packed = []
            for part in batches_of(bodies, STEP_BYTES):
                x, bags = passages(bodies[part])
                packed += [own.tobytes() for own in np.split(x, np.cumsum(bags)[:-1])]
            yield work.batch_of(schema, label=batch.column(0).to_pylist(), passages=packed)

    # The chosen labels are bounded by ``most``, so they are broadcast.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body")).join(F.broadcast(chosen), "id").select("label", "body")
    rows = sorted(texts.mapInArrow(encode, "label double, passages binary").collect(), key=lambda r: (bytes(r[1]), r[0]))
    model = Model(FEATURES)
    model.fit([np.frombuffer(r[1], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows], np.array([r[0] for r in rows]))
    return model


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with a score behind their columns; ``score_col`` must be a new name."""
    names = docs.columns
    if score_col in names:
        raise ValueError(f"the input has a column {score_col} already")
    fields = StructType([*docs.schema.fields]).add(score_col, "double")

    def run(batches):
        for batch in batches:
            bodies = [b.as_py() or b"" for b in batch.column(batch.num_columns - 1)]
            found = [model.scores(*passages(bodies[part])) for part in batches_of(bodies, STEP_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*names, score_col])

    return docs.select("*", F.col(text_col).cast("binary").alias(work.unused(docs, "body"))).mapInArrow(run, fields)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out rows are not learned from."""
    work.workspace(docs.sparkSession, "quality")
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
