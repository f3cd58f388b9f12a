"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention (a tanh branch
times a sigmoid branch) weighs the passages, and the weighted sum of their encodings is
scored. Only documents have labels: the attention is learned from them. The model is a few
hundred numbers, fitted on at most ``per_label`` labelled documents of each label; fitting and
scoring use every passage.

Edge cases: null and empty texts are one passage without bytes; rows whose label is null teach
nothing; with fewer than two classes every score is that class (0.0 without labels). A text of any
length gives all its passages; fitting holds those of at most ``2 * per_label`` documents on the
driver, 16 numbers each. Repeated rows are scored each; a score of exactly the threshold is label 1.
Without documents there are no rows; other columns than doc_id and text, and than doc_id and the label,
are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.common import fold, map_rows
from gpsight.llm.toxicity import labelled_sample

PER_LABEL, PASSAGE_BYTES = 2000, 1024
HIDDEN, GATE, STEPS, DECAY = 16, 8, 400, 1e-3

# Classes of bytes whose shares describe a passage.
_CLASSES = {c: i for i, group in enumerate((
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,", ";:'\"()-?",
    "!", "#$%&*+/<=>@[\\]^_`{|}~")) for c in group.encode()}
_CLASS_OF = np.array([_CLASSES.get(b, 10 if b >= 128 else 9) for b in range(256)], np.uint8)
N_CLASSES = 11
WIDTH = N_CLASSES + 5


def passages(text: str | None) -> list[bytes]:
    """Consecutive passages of PASSAGE_BYTES bytes; a short rest joins the last one."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data) // PASSAGE_BYTES)
    cuts = [i * PASSAGE_BYTES for i in range(n)] + [len(data)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def features(bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the first row of each bag."""
    flat = [p for bag in bags for p in bag]
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
    out = np.zeros((len(flat), WIDTH), np.float32)
    for i, p in enumerate(flat):
        if not p:
            continue
        codes = np.frombuffer(p, np.uint8)
        classes = _CLASS_OF[codes]
        out[i, :N_CLASSES] = np.bincount(classes, minlength=N_CLASSES) / len(p)
        letters = out[i, 0] + out[i, 1] + out[i, 10]
        words = p.split()
        out[i, N_CLASSES:] = (
            len(zlib.compress(p, 1)) / (len(p) + 40), letters * len(p) / (20 * (len(words) + 1)),
            len(set(words)) / (len(words) + 1), out[i, 1] / (letters + 0.01), np.log1p(len(p)) / 8)
    return out, first


def segments(first: np.ndarray, rows: int) -> np.ndarray:
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, rows)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    of = segments(first, len(x))
    x = (x - m["mean"]) / m["spread"]
    h = np.tanh(x @ m["w"] + m["wb"])
    v, u = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (v * u) @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[of])
    attention = e / np.add.reduceat(e, first)[of]
    bag = np.add.reduceat(attention[:, None] * h, first)
    logit = bag @ m["c"] + m["cb"]
    return {"x": x, "h": h, "v": v, "u": u, "at": attention, "bag": bag, "of": of,
            "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam on the logistic loss of whole bags."""
    rng = np.random.default_rng(7)
    new = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
    m = {"w": new(x.shape[1], HIDDEN), "wb": np.zeros(HIDDEN), "v": new(HIDDEN, GATE), "u": new(HIDDEN, GATE),
         "a": new(GATE), "c": new(HIDDEN), "cb": np.zeros(1)}
    fixed = {"mean": x.mean(0), "spread": x.std(0) + 0.02}
    moments = {k: [np.zeros_like(w), np.zeros_like(w)] for k, w in m.items()}
    for t in range(1, steps + 1):
        s = forward(m | fixed, x, first)
        d = (s["p"] - y) / len(y)
        of, at, h = s["of"], s["at"], s["h"]
        g = {"c": s["bag"].T @ d, "cb": np.array([d.sum()])}
        d_bag = d[:, None] * m["c"]
        d_at = (d_bag[of] * h).sum(1)
        d_e = at * (d_at - np.add.reduceat(at * d_at, first)[of])
        g["a"] = (s["v"] * s["u"]).T @ d_e
        d_gate = d_e[:, None] * m["a"]
        d_v, d_u = d_gate * s["u"] * (1 - s["v"] ** 2), d_gate * s["v"] * s["u"] * (1 - s["u"])
        g["v"], g["u"] = h.T @ d_v, h.T @ d_u
        d_h = (at[:, None] * d_bag[of] + d_v @ m["v"].T + d_u @ m["u"].T) * (1 - h ** 2)
        g["w"], g["wb"] = s["x"].T @ d_h, d_h.sum(0)
        for k in m:
            first_moment, second = moments[k]
            grad = g[k] + (DECAY * m[k] if m[k].ndim > 1 else 0)
            first_moment += 0.1 * (grad - first_moment)
            second += 0.001 * (grad ** 2 - second)
            m[k] -= 0.02 * (first_moment / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return m | fixed


def fit_sample(sample: DataFrame) -> dict[str, np.ndarray] | float:
    """The model of a bounded sample with text and label; a constant if there aren't two classes."""
    def step(part):
        return {"label": part["label"], "bag": [features([passages(t)])[0].tobytes() for t in part["text"]]}

    rows = map_rows(sample.select("text", "label"), step, "label int, bag binary").collect()
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows]
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
    return fit(np.concatenate(bags).astype(np.float64), first, y)


def score(docs: DataFrame, model: dict[str, np.ndarray] | float) -> DataFrame:
    """doc_id, score and attention (the weight of each passage in order)."""
    def step(part):
        if isinstance(model, float):
            n = [len(passages(t)) for t in part["text"]]
            return {"doc_id": part["doc_id"], "score": [model] * len(n), "attention": [[1 / k] * k for k in n]}
        x, first = features([passages(t) for t in part["text"]])
        s = forward(model, x.astype(np.float64), first)
        ends = np.append(first, len(x))
        return {"doc_id": part["doc_id"], "score": s["p"].tolist(),
                "attention": [s["at"][a:b].tolist() for a, b in zip(ends, ends[1:])]}

    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, score double, attention array<float>")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
            per_label: int = PER_LABEL, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and attention of every document."""
    sample = labelled_sample(docs, labels, "quality", folds, held_out, per_label)
    return (score(docs, fit_sample(sample)).withColumn("held_out", fold("doc_id", folds) == held_out)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "attention"))
