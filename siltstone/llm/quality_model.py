"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches

#: Words of a passage.
PASSAGE = 64
#: Labelled documents a class that are fitted on at most (the training sample's bound).
SAMPLE = 3000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "symbol": np.isin(_BYTES, list(b"#*$%&|<>@^~_=+{}[]\\/")),
    "stop": np.isin(_BYTES, list(b".?")),
    "bang": np.isin(_BYTES, list(b"!")),
    "comma": np.isin(_BYTES, list(b",;:")),
    "letter_start": _BYTES >= 192,
    "char": (_BYTES < 128) | (_BYTES >= 192),
}
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
N_FEATURES = 17


def passage_features(text: bytes) -> np.ndarray:
    """One row of features per passage of ``PASSAGE`` words; one row of zeros for a text without words."""
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    cuts = np.arange(0, n, PASSAGE)
    begin = starts[cuts]
    n_words = np.diff(np.append(cuts, n)).astype(float)

    def per_passage(kind: str) -> np.ndarray:
        return np.add.reduceat(_KINDS[kind][raw], begin, dtype=float)

    width = (ends - starts).astype(float)
    at = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    words = np.add.reduceat(raw.astype(np.uint64) * _WEIGHTS[at & 63], starts) if n else raw
    in_passage = np.arange(n) // PASSAGE
    order = np.lexsort((words, in_passage))
    new = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (in_passage[order][1:] != in_passage[order][:-1])))
    distinct = np.add.reduceat(new, cuts, dtype=float)
    same = np.concatenate(([False], words[1:] == words[:-1]))
    lines = np.add.reduceat(raw == 10, begin, dtype=float)
    chars = np.maximum(per_passage("char"), 1)
    upper, lower = per_passage("upper"), per_passage("lower")
    mean = np.add.reduceat(width, cuts) / n_words
    return np.stack(
        [
            mean,
            np.sqrt(np.maximum(np.add.reduceat(width**2, cuts) / n_words - mean**2, 0)),
            upper / chars,
            lower / chars,
            per_passage("digit") / chars,
            per_passage("symbol") / chars,
            per_passage("letter_start") / chars,
            np.minimum(per_passage("stop") / n_words, 2),
            np.minimum(per_passage("bang") / n_words, 2),
            np.minimum(per_passage("comma") / n_words, 2),
            np.add.reduceat(same, cuts, dtype=float) / n_words,
            distinct / n_words,
            np.minimum(lines / n_words, 1),
            np.add.reduceat(width <= 3, cuts, dtype=float) / n_words,
            np.add.reduceat(width == 1, cuts, dtype=float) / n_words,
            np.add.reduceat(width > 20, cuts, dtype=float) / n_words,
            np.log(n_words),
        ],
        axis=1,
    ).astype(np.float32)


class AttentionMil:
    """score = sigmoid(w . sum_k a_k h_k + b), h = tanh(W x), a = softmax(u . (tanh(V h) * sigmoid(G h))).

    Ilse, Tomczak, Welling: Attention-based deep multiple instance learning, 2018.
    """

    def __init__(self, n_in: int = N_FEATURES, hidden: int = 16, gate: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "W": rng.normal(0, n_in**-0.5, (n_in, hidden)),
            "c": np.zeros(hidden),
            "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "G": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "u": rng.normal(0, gate**-0.5, gate),
            "w": rng.normal(0, hidden**-0.5, hidden),
            "b": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(n_in), np.ones(n_in)

    def _forward(self, x: np.ndarray, bag: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["c"])
        tv, sg = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["G"], -30, 30)))
        e = (tv * sg) @ p["u"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"], -30, 30)))
        return {"h": h, "tv": tv, "sg": sg, "a": a, "z": z, "y": y}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        first = np.cumsum(sizes) - sizes
        x = np.clip((np.concatenate(bags) - self.mean) / self.scale, -6, 6)
        return self._forward(x, np.repeat(np.arange(len(bags)), sizes), first)["y"]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> AttentionMil:
        """Full-batch Adam; both classes weigh the same."""
        sizes = np.array([len(b) for b in bags])
        first, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
        x = np.concatenate(bags).astype(float)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        m, v, p = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, self.p
        for t in range(1, steps + 1):
            f = self._forward(x, bag, first)
            dy = (f["y"] - labels) * share
            dz = dy[:, None] * p["w"]
            g = {"w": f["z"].T @ dy, "b": dy.sum(keepdims=True)}
            da = (f["h"] * dz[bag]).sum(1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
            gated = f["tv"] * f["sg"]
            g["u"] = gated.T @ de
            dgate = de[:, None] * p["u"]
            dv, dg = dgate * f["sg"] * (1 - f["tv"] ** 2), dgate * f["tv"] * f["sg"] * (1 - f["sg"])
            g["V"], g["G"] = f["h"].T @ dv, f["h"].T @ dg
            dh = (f["a"][:, None] * dz[bag] + dv @ p["V"].T + dg @ p["G"].T) * (1 - f["h"] ** 2)
            g["W"], g["c"] = x.T @ dh, dh.sum(0)
            for k in p:
                grad = g[k] + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
        return self


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionMil:
    """Fit on labelled documents outside the held-out fold: of each class the ``sample`` first ones in hash order.

    The sample's ids (at most ``2 * sample`` rows) are broadcast to pick its texts; their features are computed where the
    texts lie and gathered to the driver. Labels without a document, null labels, null ids and ids with labels of both classes teach nothing. With one class or
    none, the model stays as it was initialised.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where((fold("l_id") != 0) & F.col("quality").isin(0, 1)).groupBy("l_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.where("quality = most").drop("most")
    picked = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "quality", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [passage_features(x or b"").tobytes() for x in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["doc_id", "quality", "x"])

    got = sorted((tuple(r) for r in rows.mapInArrow(features, "doc_id long, quality int, x binary").collect()), key=lambda r: (r[0], r[2]))
    model = AttentionMil()
    y = np.array([r[1] for r in got])
    if len(set(y.tolist())) == 2:
        model.fit([np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in got], y)
    return model


def score(docs: DataFrame, model: AttentionMil, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the model's score in ``out`` (0 to 1, higher: better); a column of that name is replaced.

    Null and empty texts are a bag with one passage of zeros. Rows are scored each by itself from their text
    alone; all columns pass through, whatever they are called.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != out]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = rest.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            found = []
            for i in range(0, b.num_rows, 256):
                found.extend(model.scores([passage_features(x or b"") for x in texts.slice(i, 256).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(work, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns. A null id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
