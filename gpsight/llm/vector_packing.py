"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens at once.

An example is a vector (tokens, 1 segment, loss-bearing tokens). Bins are filled one at a time by
the dot-product heuristic: of the examples that still fit, the one whose vector has the largest
product with the bin's remaining capacities, each dimension weighted by what all remaining
examples ask of it. The driver plans on counts of equal vectors only: a filled bin is repeated
while the counts last, so its work depends on the number of different vectors (at most
``2 * capacity * LOSS_LEVELS``), not on the number of examples. Spark ranks the examples of a vector and
looks their places up in the plan.

Some examples may be cut: what is left of a document longer than a sequence, and one in
``CUT_SHARE`` others. They are held back to fill what whole examples leave open, cut exactly to
the room. A bin that a limit closes early is planned again for the largest power of two that it
reaches, as such a sequence needs no padding.

Loss-bearing tokens of a plain document's piece are all but its first, which nothing predicts.

Edge cases: null and empty texts are documents of the end token alone; longer documents than the
capacity give full pieces and one rest, whatever their length; repeated rows are packed once
each; equal vectors are placed in the order of their keys; an empty table gives no rows; other
columns than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gpsight.llm.common import byte_slices, materialize, once

CAPACITY, MAX_SEGMENTS, MAX_LOSS, END_ID = 2048, 64, 2048, 1
# Loss-bearing tokens are planned in this many steps, rounded up, so that no limit is passed.
LOSS_LEVELS = 8
# One in so many whole examples may be cut to fill room.
CUT_SHARE = 16
# Examples of one vector that one task ranks; more are dealt over several slots.
RANKED_TOGETHER = 500_000


class ByteEncoder:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    Where the vocabulary numbers its tokens in the order of its merges, they are merged by a
    byte-pair core; a text that holds an added token goes through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [token["content"] for token in spec["added_tokens"]]
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        self.core = None
        if made == sorted(made) and len(vocab) == 256 + len(made):
            self.core = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                          mergeable_ranks={raw(token): i for token, i in vocab.items()})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.core is None or any(token in text for token in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        except ValueError:  # white space too long for the core's pattern
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies show for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenized_examples(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                       end_id: int = END_ID) -> DataFrame:
    """doc_id, start, tokens, loss, cuttable, doc_tokens, ids_crc32, ids (of cuttable ones) of pieces up to ``capacity``."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("tokens", pa.int32()), ("loss", pa.int32()),
                        ("cuttable", pa.bool_()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("byte ids", path), lambda: ByteEncoder(path))
        for part in byte_slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"]):
                ids = np.append(encoder.ids(text.as_py()), np.array([end_id], "<u4")).astype("<u4")
                chosen = zlib.crc32(b"%d" % (doc or 0)) % CUT_SHARE == 0
                for at in range(0, len(ids), capacity):
                    piece = ids[at:at + capacity].tobytes()
                    size = len(piece) // 4
                    cuttable = size < capacity and (at > 0 or chosen)
                    out.append((doc, at, size, size - 1, cuttable, len(ids), zlib.crc32(piece), piece if cuttable else None))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, tokens int, loss int, cuttable boolean, doc_tokens long, ids_crc32 long, ids binary")


class Plan:
    """Places for examples that are known by (vector, rank) alone.

    A rule covers a run of ranks of one vector: ``each`` of them go side by side into every bin from
    ``bin`` on. A cutting rule puts the first ``cut`` tokens there and turns the rest into an example of
    another vector, whose ranks follow ``rest_rank``.
    """

    def __init__(self, counts: dict[tuple[int, int, bool], int], capacity: int, max_segments: int, max_loss: int):
        self.limits = np.array([capacity, max_segments, max_loss], np.int64)
        self.number: dict[tuple[int, int, bool], int] = {}
        self.size = np.zeros((0, 3), np.int64)  # tokens, segments, loss of each vector
        self.cuttable = np.zeros(0, bool)
        self.left = np.zeros(0, np.int64)  # not placed yet
        self.used = np.zeros(0, np.int64)  # placed: the next rank
        self.rules: list[tuple[int, ...]] = []  # vector, rank, n, bin, each, offset, cut, rest, rest_rank
        self.bins = 0
        for vector in sorted(counts):
            number = self.vector(vector)
            self.left[number] = counts[vector]
        while self.left.any():
            self.fill()

    def vector(self, key: tuple[int, int, bool]) -> int:
        if key not in self.number:
            self.number[key] = len(self.number)
            if len(self.number) > len(self.size):  # room for more, doubled
                more = max(64, len(self.size))
                self.size = np.concatenate([self.size, np.zeros((more, 3), np.int64)])
                self.cuttable, self.left, self.used = (np.concatenate([x, np.zeros(more, x.dtype)])
                                                       for x in (self.cuttable, self.left, self.used))
            self.size[self.number[key]] = (key[0], 1, key[1])
            self.cuttable[self.number[key]] = key[2]
        return self.number[key]

    def pick(self, capacity: int) -> tuple[list[tuple[int, int, int]], int]:
        """What goes into one bin, as (vector, tokens taken, offset), and how full it gets."""
        demand = (self.left[:, None] * self.size).sum(axis=0) / self.limits
        weight = demand / demand.sum()
        room = self.limits.copy()
        room[0] = capacity
        scaled = self.size / self.limits
        free, taken, at = self.left.copy(), [], 0
        fits = (free > 0) & (self.size <= room).all(axis=1)
        while room[0] > 0 and room[1] > 0:
            fits &= (free > 0) & (self.size[:, 0] <= room[0]) & (self.size[:, 2] <= room[2])
            score = np.where(fits, scaled @ (weight * room / self.limits), -1.0)
            # cuttable examples wait for what others leave, or for their exact room
            score[self.cuttable & (self.size[:, 0] < room[0])] -= 2.0
            best = int(score.argmax())
            if not fits[best] or score[best] < -0.5:
                most = np.where(self.cuttable & (free > 0) & (self.size[:, 0] > room[0]), self.size[:, 0], 0)
                longest = int(most.argmax())
                if most[longest] and room[2] > 0:
                    cut = int(min(room[0], room[2]))
                    taken.append((longest, cut, at))
                    return taken, at + cut
                best = int(np.where(fits, score, -9.0).argmax())
                if not fits[best]:
                    break
            taken.append((best, int(self.size[best, 0]), at))
            at += int(self.size[best, 0])
            free[best] -= 1
            room -= self.size[best]
        return taken, at

    def fill(self) -> None:
        """Plans one bin and repeats it while the counts last."""
        capacity = int(self.limits[0])
        taken, filled = self.pick(capacity)
        if filled & (filled - 1) and filled < capacity:
            smaller, reached = self.pick(1 << (filled.bit_length() - 1))
            if not reached & (reached - 1):
                taken, filled = smaller, reached
        times: dict[int, int] = {}
        for vector, _, _ in taken:
            times[vector] = times.get(vector, 0) + 1
        repeat = min(int(self.left[vector]) // n for vector, n in times.items())
        if filled & (filled - 1):
            repeat = 1  # padded: better bins may follow once it is gone
        at = 0
        while at < len(taken):
            vector, cut, offset = taken[at]
            each = 1
            whole = cut == self.size[vector, 0]
            while whole and at + each < len(taken) and taken[at + each][:2] == (vector, cut):
                each += 1
            rest, rest_rank = -1, 0
            first = int(self.used[vector])
            self.used[vector] += each * repeat
            self.left[vector] -= each * repeat
            if not whole:
                tokens, _, loss = (int(x) for x in self.size[vector])
                rest = self.vector((tokens - cut, min(tokens - cut, loss), True))
                rest_rank = int(self.used[rest] + self.left[rest])
                self.left[rest] += repeat
            self.rules.append((vector, first, each * repeat, self.bins, each, offset, cut, rest, rest_rank))
            at += each
        self.bins += repeat

    def table(self) -> np.ndarray:
        """The rules as whole numbers, by vector and first rank."""
        rules = np.array(self.rules, np.int64).reshape(-1, 9)
        return rules[np.lexsort((rules[:, 1], rules[:, 0]))]


def places(rules: np.ndarray, vector: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, length, bin and offset of every part of the examples (vector, rank)."""
    row, start = np.arange(len(vector)), np.zeros(len(vector), np.int64)
    firsts = np.searchsorted(rules[:, 0], np.arange(rules[:, 0].max() + 2)) if len(rules) else np.zeros(1, int)
    span = int(rules[:, 1].max()) + 1 if len(rules) else 1
    if span > (1 << 62) // len(firsts):
        raise ValueError("too many examples of one vector")
    key = rules[:, 0] * span + rules[:, 1]
    found: list[tuple[np.ndarray, ...]] = []
    while len(row):
        rule = rules[np.searchsorted(key, vector * span + np.minimum(rank, span - 1), side="right") - 1]
        inside = rank - rule[:, 1]
        found.append((row, start, rule[:, 6], rule[:, 3] + inside // rule[:, 4],
                      rule[:, 5] + inside % rule[:, 4] * rule[:, 6]))
        more = rule[:, 7] >= 0
        row, start = row[more], start[more] + rule[more, 6]
        vector, rank = rule[more, 7], rule[more, 8] + inside[more]
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found)) if found else (
        np.zeros(0, np.int64),) * 5


def pack_vectors(examples: DataFrame, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS,
                 max_loss: int = MAX_LOSS) -> DataFrame:
    """Every part of every example with its sequence: the columns of ``examples`` with part_start, length,
    sequence_id and offset.

    ``examples`` needs tokens (1 to ``capacity``), loss (0 to the lesser of tokens and ``max_loss``) and cuttable;
    it is read twice and must be the same each time (a table). A cut part bears at most as much loss as it has
    tokens, and is counted as if it did. Counts of vectors and the plan pass through the driver.
    """
    spark = examples.sparkSession
    grain = max(1, -(-max_loss // LOSS_LEVELS))
    planned = F.least(F.ceil(F.col("loss") / F.lit(grain)) * grain, F.lit(max_loss), F.col("tokens")).cast("int")
    keyed = examples.withColumn("_loss", planned)
    counts = {(r["tokens"], r["_loss"], r["cuttable"]): r["n"]
              for r in keyed.groupBy("tokens", "_loss", "cuttable").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity, max_segments, max_loss)
    rules, number = spark.sparkContext.broadcast(plan.table()), plan.number
    slots = max(1, -(-max(counts.values(), default=1) // RANKED_TOGETHER))
    columns = examples.columns
    order = [F.col(f"`{c}`") for c in columns if c != "ids"]
    same = ["tokens", "_loss", "cuttable", "_slot"]
    ranked = keyed.withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(slots)).cast("int"))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*same).orderBy(*order)).cast("long") - 1)
    if slots > 1:
        sizes = ranked.groupBy(*same).agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*same[:-1]).orderBy("_slot")
        sizes = sizes.select(*same, (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
        ranked = ranked.join(sizes, same).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = zip(*(batch[c].to_pylist() for c in ("tokens", "_loss", "cuttable")))
            vector = np.array([number[v] for v in vectors], np.int64)
            row, *part = places(rules.value, vector, batch["_rank"].to_numpy())
            kept = batch.select(columns).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, part)],
                                             names=[*columns, "part_start", "length", "sequence_id", "offset"])

    schema = examples.schema
    for name in ("part_start", "length", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                   max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    examples = materialize(tokenized_examples(docs, vocabulary, capacity, end_id), "examples")
    parts = pack_vectors(examples, capacity, max_segments, max_loss)
    cut = F.expr("substring(ids, cast(4 * part_start + 1 AS int), cast(4 * length AS int))")
    return parts.select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "length",
        F.when(F.col("length") == F.col("tokens"), F.col("ids_crc32")).otherwise(F.crc32(cut)).alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")
