"""Toxicity scores from a counterfactual-regularised linear classifier.

Words and beginnings of words are features (present or not). The loss is the logistic loss plus an L1 term plus a
counterfactual term: in labelled sentences that mention a group, the identity term is swapped
for the other terms of its list, and the squared change of the score is penalised. A neutral
mention of one group therefore can't be scored unlike the same sentence about another.

The model is fitted on at most ``per_label`` labelled rows of each label (hash-ordered, the
same on every run). What it returns is bounded: ``features`` words and their weights.

Edge cases: null and empty texts get the model's base score; rows whose label is null teach
nothing; with fewer than two classes every score is the share of the class that there is
(0.0 if there are no labels at all). A text of any length is read whole; a word counts once a
text. Repeated rows are scored each, and a repeated label row counts once; equally frequent words
go by their bytes. Without documents there are no rows; other columns than doc_id and text, and than
doc_id and the label, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.common import bounded_sample, fold, map_rows

PER_LABEL, FEATURES, MIN_DOCS = 3000, 1024, 5
L1, SWAP_WEIGHT, STEPS = 3e-5, 1.0, 500
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes; inflected and derived forms share them

# Identity terms, a list for each grammatical form; a swap stays inside a list.
IDENTITY = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "atheists", "immigrants", "refugees", "foreigners",
     "lesbians", "gays", "transgender", "africans", "asians", "latinos", "whites", "blacks"),
    ("muslim", "christian", "jewish", "hindu", "atheist", "black", "white", "gay", "lesbian", "straight", "african",
     "asian", "latino", "female", "male", "deaf", "blind", "disabled"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
_WORD_BREAKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct lower-case words; ASCII other than letters and digits separates them."""
    return set((text or "").lower().encode("utf-8", "replace").translate(_WORD_BREAKS).split())


def features_of(text: str | None, known: dict[int, frozenset[bytes]] | None = None) -> set[bytes]:
    """Words, and beginnings marked with a star; only those in ``known`` (by length, 0: words) if given."""
    words = words_of(text)
    if known is None:
        return words.union(*({w[:k] + b"*" for w in words if len(w) > k} for k in BEGINNINGS))
    found = words & known[0]
    for k in BEGINNINGS:
        if known[k]:
            found.update(p + b"*" for p in {w[:k] for w in words if len(w) > k} & known[k])
    return found


def by_length(features) -> dict[int, frozenset[bytes]]:
    starred = [f[:-1] for f in features if f.endswith(b"*")]
    return {0: frozenset(f for f in features if not f.endswith(b"*"))} | {
        k: frozenset(f for f in starred if len(f) == k) for k in BEGINNINGS}


def choose_features(sample: DataFrame, features: int) -> list[bytes]:
    """The features whose presence differs most between the labels, and all identity terms."""
    def step(part):
        rows = [(w, y) for text, y in zip(part["text"], part["label"]) for w in features_of(text)]
        return {"word": [w for w, _ in rows], "label": [y for _, y in rows]}

    counts = map_rows(sample.select("text", "label"), step, "word binary, label int").groupBy("word").agg(
        F.sum("label").alias("pos"), F.count("*").alias("n"))
    total = sample.agg(F.sum("label"), F.count("*")).first()
    pos, n = float(total[0] or 0), float(total[1])
    share = (F.col("pos") + 0.5) / (pos + 1) - (F.col("n") - F.col("pos") + 0.5) / (n - pos + 1)
    spread = F.sqrt((F.col("n") + 1) / (n + 1))
    best = (counts.filter(F.col("n") >= MIN_DOCS)
            .orderBy(F.desc(F.abs(share) / spread), "word").limit(features).collect())
    # the beginnings of identity terms would go round the swaps
    shared = {t.encode()[:k] + b"*" for terms in IDENTITY for t in terms for k in BEGINNINGS}
    own = [bytes(r["word"]) for r in best if bytes(r["word"]) not in shared]
    return list(dict.fromkeys([*own, *(t.encode() for terms in IDENTITY for t in terms)]))


def swaps(present: set[bytes], number: dict[bytes, int]) -> list[tuple[int, int]]:
    """(term, other term) for each identity term that is present and each that could replace it."""
    return [(number[a.encode()], number[b.encode()]) for terms in IDENTITY for a in terms
            if a.encode() in present for b in terms if a != b]


def sentences(text: str | None) -> list[str]:
    return (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split(".")


def fit(labelled: DataFrame, features: int = FEATURES) -> tuple[dict[bytes, float], float]:
    """Weights and base score; ``labelled`` has text and label (0 or 1) and a bounded number of rows."""
    vocabulary = choose_features(labelled, features)
    number = {w: i for i, w in enumerate(vocabulary)}
    terms = {t.encode() for group in IDENTITY for t in group}
    known = by_length(vocabulary)

    def step(part):
        found = [features_of(t, known) for t in part["text"]]
        pairs = []
        for text, present in zip(part["text"], found):
            said = [words_of(s) for s in sentences(text)] if present & terms else []
            pairs.append([i * len(number) + j for s in said for i, j in swaps(s, number)])
        return {"label": part["label"], "present": [sorted(number[w] for w in p) for p in found],
                "swapped": pairs}

    rows = map_rows(labelled.select("text", "label"), step, "label int, present array<int>, swapped array<long>").collect()
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        mean = float(y.mean()) if len(y) else 0.0
        return {}, 40.0 if mean == 1 else -800.0
    x = np.zeros((len(y), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["present"]] = 1
    pairs, times = np.unique(np.array([p for r in rows for p in r["swapped"]], np.int64), return_counts=True)
    a, b = pairs // max(1, len(number)), pairs % max(1, len(number))
    w, bias = descend(x, y.astype(np.float32), a, b, times / max(1, times.sum()))
    return {word: float(v) for word, v in zip(vocabulary, w) if v}, float(bias)


def descend(x, y, a, b, share, l1: float = L1, swap_weight: float = SWAP_WEIGHT, steps: int = STEPS):
    """Accelerated proximal gradient descent."""
    n, width = x.shape
    w = np.zeros(width, np.float32)
    bias, z, zb, t = 0.0, w.copy(), 0.0, 1.0
    rare = np.linalg.norm(x, axis=1)
    rate = 1.0 / (0.25 * float((rare ** 2).mean()) + 0.25 + 4 * swap_weight)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z + zb, -30, 30)))
        g = x.T @ (p - y) / n
        d = 2 * swap_weight * share * (z[a] - z[b])
        np.add.at(g, a, d)
        np.add.at(g, b, -d)
        new = z - rate * g
        new = (np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)).astype(np.float32)
        new_bias = zb - rate * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


def score(docs: DataFrame, model: tuple[dict[bytes, float], float]) -> DataFrame:
    weights, bias = model
    known = by_length(weights)

    def step(part):
        logit = [bias + sum(weights[w] for w in sorted(features_of(t, known))) for t in part["text"]]
        return {"doc_id": part["doc_id"], "score": (1 / (1 + np.exp(-np.clip(logit, -745, 40)))).tolist()}

    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int,
                    per_label: int) -> DataFrame:
    """text and label of at most ``per_label`` rows of each label outside the held-out fold.

    The labels are sampled before the texts are read, so only a bounded number of ids is
    broadcast. An id that is labelled twice counts once, with its larger label.
    """
    known = (labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("l_id")).agg(F.max(column).cast("int").alias("label"))
             .filter(fold("l_id", folds) != held_out))
    chosen = bounded_sample(known, "l_id", "label", per_label)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
             per_label: int = PER_LABEL, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, per_label)
    return (score(docs, fit(sample)).withColumn("held_out", fold("doc_id", folds) == held_out)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .select("doc_id", "held_out", "score", "predicted"))
