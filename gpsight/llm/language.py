"""Language identification: script ranges, word scores and a Viterbi path over each text.

The script of a word narrows its candidates to the languages that use that script in the
learned texts. Each word has a score in each candidate (letter trigrams, the word's ends
included). A Viterbi path with a penalty for each switch labels every word, so mixed texts
come out as spans; the text's language is the one with the most letters.

The model is fitted on at most ``per_language`` texts of each language (hash-ordered); it is a
table of a fixed number of trigram buckets.

Edge cases: null texts and texts without a letter are ``und`` with score 0.0; a text whose
scripts no learned language uses gets the most frequent learned language with score 0.0; if
nothing was learned every text is ``und``. A long text is read in segments cut between words (a run
of letters beyond two segments is several words); equally likely labels go to the language that
sorts first; repeated rows are labelled each; an empty table gives no rows; other columns than
doc_id, text and lang are not read (``keep_identified`` hands them on).
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.common import bounded_batches, bounded_sample, fold, map_rows, once, tidied

PER_LANGUAGE, BUCKETS, SWITCH_PENALTY = 500, 1 << 15, 12.0
SMOOTHING, OTHER_SCRIPT = 0.5, -50.0
# Code points whose letters are looked at together, and of texts labelled together: memory only.
SEGMENT, TOGETHER = 250_000, 4_000_000

# First code point of each block of letters and its script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFDD, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.uint8)
LAST = 0x32400


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter; beyond the table none is."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(LAST)] + [False])


def words_of(texts: list[str | None], letters: np.ndarray):
    """Words (runs of letters) of several texts.

    Returns the trigram bucket of every letter, the first letter of each word in that list,
    each word's script, its text, its first code point there and its length. Texts are
    lower-cased code point by code point, so that places in the text stay valid.
    """
    parts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(p) + 1 for p in parts])
    code = np.full(int(lengths.sum()) + 1, 32, np.int64)
    starts = np.concatenate(([1], 1 + np.cumsum(lengths)[:-1]))
    for p, at in zip(parts, starts):
        code[at:at + len(p)] = p
    is_letter = letters[np.minimum(code, LAST)]
    upper = ((code >= 65) & (code <= 90)) | ((code >= 0xC0) & (code <= 0xDE)) | ((code >= 0x410) & (code <= 0x42F))
    code = np.where(is_letter, np.where(upper, code + 32, code), 32)
    at = np.flatnonzero(is_letter)
    bucket = ((code[at - 1] * 7919 + code[at] * 104729 + code[np.minimum(at + 1, len(code) - 1)] * 1299709) >> 2) % BUCKETS
    first = np.flatnonzero(np.diff(at, prepend=-9) > 1)
    size = np.diff(np.append(first, len(at)))
    place = at[first]
    script = _SCRIPT[np.searchsorted(_FIRST, code[place], "right") - 1]
    of = np.searchsorted(starts, place, "right") - 1
    return bucket, first, script, of, place - starts[of], size


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray, uses: np.ndarray, common: int):
        self.languages, self.logs, self.uses, self.common = languages, logs, uses, common

    def emissions(self, bucket, first, script) -> np.ndarray:
        scores = np.add.reduceat(self.logs[bucket], first, axis=0) if len(first) else np.zeros((0, len(self.languages)))
        allowed = self.uses[script]
        return np.where(allowed.any(1)[:, None], np.where(allowed, scores, scores.min(1, initial=0)[:, None] + OTHER_SCRIPT), 0)


def fit(sample: DataFrame) -> Model | None:
    """The model of a bounded sample with text and lang."""
    def step(part):
        letters = once("letters", letter_table)
        out = {"lang": [], "bucket": [], "n": []}
        for lang in sorted(set(part["lang"])):
            bucket, first, script, *_ , size = words_of([t for t, x in zip(part["text"], part["lang"]) if x == lang], letters)
            for shift, values, weights in ((0, bucket, None), (BUCKETS, script, size)):
                counts = np.bincount(values, weights)
                found = np.flatnonzero(counts)
                out["lang"] += [lang] * len(found)
                out["bucket"] += (found + shift).tolist()
                out["n"] += counts[found].astype(int).tolist()
        return out

    rows = (map_rows(sample.select("text", "lang"), step, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(rows["lang"].unique().tolist())
    if not languages:
        return None
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    counts[rows["bucket"].to_numpy(int), rows["lang"].map(languages.index).to_numpy(int)] = rows["n"]
    grams, scripts = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:]
    uses = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), uses, int(scripts.sum(0).argmax()))


def viterbi(scores: np.ndarray, of: np.ndarray, texts: int, penalty: float) -> np.ndarray:
    """The best label of every word; all texts advance together, a word at a time.

    ``of`` is the text of each word, in order.
    """
    n_words = np.bincount(of, minlength=texts)
    order = np.argsort(-n_words, kind="stable")
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))[order]
    n_sorted = n_words[order]
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    back = np.empty(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    steps = int(n_sorted[0])
    active = np.searchsorted(-n_sorted, -np.arange(steps), "left")  # texts with more than t words
    state = scores[first[:active[0]]]
    last = np.zeros(texts, np.int16)
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        if t:
            ended = len(state)
            if k < ended:
                last[k:ended] = state[k:].argmax(1)
                state = state[:k]
            best = state.argmax(1)
            switch = state[np.arange(k), best] - penalty
            stay = state >= switch[:, None]
            back[at] = np.where(stay, own, best[:, None])
            state = np.where(stay, state, switch[:, None]) + scores[at]
    last[:len(state)] = state.argmax(1)
    current = last
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        label[at] = current[:k]
        if t:
            current[:k] = back[at, current[:k]]
    return label


def segments(texts: list[str | None], limit: int):
    """Groups of (text number, first code point, part) with about ``limit`` code points each.

    A long text is cut where no letter stands; a run of letters that goes on for ``limit`` more is
    cut all the same, and its parts are words of their own.
    """
    group, held = [], 0
    for number, text in enumerate(texts):
        text, at = text or "", 0
        while at == 0 or at < len(text):
            end = min(len(text), at + limit)
            while end < len(text) and end < at + 2 * limit and text[end].isalpha():
                end += 1
            if held and held + end - at > limit:
                yield group
                group, held = [], 0
            group.append((number, at, text[at:end]))
            held += end - at
            at = max(end, 1)
    if group:
        yield group


def label_texts(texts: list[str | None], model: Model, letters: np.ndarray, penalty: float):
    """(language, score, spans) of each text; a span is (language, first code point, end)."""
    pieces = []
    for group in segments(texts, SEGMENT):
        numbers, begins, parts = zip(*group)
        bucket, first, script, of, place, size = words_of(list(parts), letters)
        pieces.append((model.emissions(bucket, first, script), np.array(numbers)[of], place + np.array(begins)[of], size,
                       model.uses[script].any(1)))
    scores, of, place, size, known = (np.concatenate(p) for p in zip(*pieces))
    label = viterbi(scores, of, len(texts), penalty)
    names, weight = model.languages, np.zeros((len(texts), len(model.languages)))
    np.add.at(weight, (of[known], label[known]), size[known])
    letters_of = np.bincount(of, size, minlength=len(texts))
    cut = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    stop = np.append(cut[1:], len(of)) - 1
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for a, b in zip(cut, stop):
        spans[of[a]].append((names[label[a]], int(place[a]), int(place[b] + size[b])))
    best, out = weight.argmax(1), []
    for i in range(len(texts)):
        if not letters_of[i]:
            out.append(("und", 0.0, []))
        elif not weight[i].any():
            out.append((names[model.common], 0.0, spans[i]))
        else:
            out.append((names[best[i]], float(weight[i, best[i]] / letters_of[i]), spans[i]))
    return out


def identify(docs: DataFrame, model: Model | None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score and spans of every text."""
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>"
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def done(ids, texts):
        letters = once("letters", letter_table)
        found = label_texts(texts, model, letters, penalty) if model else [("und", 0.0, [])] * len(texts)
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
            "spans": [[{"lang": a, "start": b, "end": c} for a, b, c in f[2]] for f in found]}, schema=arrow)

    def run(batches):
        for part in bounded_batches(batches, 20_000, TOGETHER):
            yield done(part["doc_id"].to_pylist(), part["text"].to_pylist())

    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def keep_identified(docs: DataFrame, model: Model | None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs`` whose text has an identified language, which becomes their ``lang``.

    Rejected are texts without a letter and texts in scripts that no learned language uses
    (score 0): nothing is known about their language.
    """
    at = docs.columns.index("lang")

    def run(batches):
        for part in bounded_batches(batches, 20_000, TOGETHER):
            texts = part.column("text").to_pylist()
            found = label_texts(texts, model, once("letters", letter_table), penalty) if model else [("und", 0.0)] * len(texts)
            lang = pa.array([f[0] for f in found], pa.string())
            columns = [lang if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array([f[1] > 0 for f in found]))

    return docs.mapInArrow(tidied(run), docs.schema)


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on text and non-null lang outside the held-out fold; ids are sampled before texts are read."""
    known = (docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
             .select(F.col("doc_id").alias("l_id"), F.col("lang").alias("l_lang")))
    chosen = bounded_sample(known, "l_id", "l_lang", per_language).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    return fit(sample.select("text", F.col("l_lang").alias("lang")))


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE,
                penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document."""
    return (identify(docs, learn(docs, folds, held_out, per_language), penalty)
            .withColumn("held_out", fold("doc_id", folds) == held_out)
            .select("doc_id", "held_out", "lang_pred", "score", "spans"))
