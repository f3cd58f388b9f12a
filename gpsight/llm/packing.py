"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so best-fit decreasing needs only how many
pieces have each length: at most ``capacity`` counts, whatever the number of documents. The
driver packs these counts. Open bins are kept as ranges of bin numbers by remaining capacity,
and a segment tree over the remaining capacities finds the tightest one that fits in
logarithmic time. A range of equal bins takes its pieces in one step; that leaves it with less
than half of its room, so it is touched at most log2(capacity) times, and the plan has at most
some tens of thousands of rules. Spark ranks the pieces of each length in parallel and looks
up each piece's place in the plan: the result is the best-fit decreasing packing of all pieces
at once, not of each task's share.

Edge cases: null and empty texts are documents of the end token alone; longer documents than
the capacity are cut, full pieces fill a bin alone; repeated rows are packed once each; pieces of one
length are placed in the order of doc_id, piece and ids; an empty table gives no rows; other
columns than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gpsight.llm.common import Remembered, map_rows, materialize, once

CAPACITY, END_ID = 4096, 1
# Pieces of one length that one task ranks; more are dealt over several slots.
RANKED_TOGETHER = 1_000_000
# Letters whose lower case and composed form don't depend on what stands around them.
PLAIN = regex.compile(r"[\x21-\x7e¡-įı-ňŊ-ž]+").fullmatch


class Words(Remembered):
    """Encodings of words, made when they are first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        return self.keep(word, self.encode(word))


class WordEncoder:
    """Ids of a word-end BPE vocabulary, as the tokenizers library gives them.

    Words between white space are encoded once and remembered. Plain words are merged by a
    byte-pair core whose byte 0xFF (never part of UTF-8) stands for the word's end; any other
    word goes through the library itself, and so does a whole text that holds an added token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            spec = json.load(file)
        # tokens that the library takes out of a text before it splits it into words
        self.added = [token["content"] for token in spec["added_tokens"]]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        shown = byte_letters()
        byte_of = {letter: byte for byte, letter in shown.items()}

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token.removesuffix(suffix) if ends else token)) + b"\xff" * ends

        units = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(255)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = dict.fromkeys([*units, *(raw(a) + raw(b) for a, b in merges)])
        ranks = {word: rank for rank, word in enumerate(order)}
        self.merge = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        name = lambda w: "".join(shown[b] for b in w.removesuffix(b"\xff")) + suffix * w.endswith(b"\xff")
        self.id_of = np.array([vocab.get(name(w), 0) if w != b"\xff" else 0 for w in order], "<u4")
        self.packed = [number.to_bytes(4, "little") for number in self.id_of.tolist()]
        # letters alone are one piece, unless this vocabulary splits them
        self.letters_whole = all(self.split(x) == [x] for x in ("ab", "zq" * 40, "st", "llvere", "a"))
        self.known = Words(self.word)

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if self.letters_whole and word.isascii() and word.isalpha():
            pieces = (word.lower(),)
        elif PLAIN(word):
            pieces = self.split(word.lower())
        else:
            return self.by_library(word)
        packed = self.packed
        return b"".join([packed[i] for piece in pieces for i in self.merge(piece.encode() + b"\xff")])

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return self.by_library(text)
        if any(token in text for token in self.added):
            return self.by_library(text)
        return b"".join(map(self.known.__getitem__, text.split()))


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies show for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenized_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                     end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def make():
        encoder = once(("words", path), lambda: WordEncoder(path))

        def step(part):
            out = {name: [] for name in names}
            for doc, text in zip(part["doc_id"], part["text"]):
                packed = encoder.ids(text) + end
                for number, at in enumerate(range(0, len(packed), 4 * capacity)):
                    cut = packed[at:at + 4 * capacity]
                    row = (doc, number, at // 4, len(cut) // 4, zlib.crc32(cut), cut)
                    for name, value in zip(names, row):
                        out[name].append(value)
            return out
        return step

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_rows(docs.select("doc_id", "text"), None, schema, make=make)


class TightestFit:
    """A segment tree over remaining capacities that holds ranges of equal bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self.ranges.setdefault(room, []).append((first, count))
        at = room + self.leaves
        while at and not self.filled[at]:
            self.filled[at] = 1
            at //= 2

    def take(self, length: int) -> tuple[int, int, int] | None:
        """Removes and returns (room, first bin, bins) of the least room that is enough."""
        at = length + self.leaves
        while not self.filled[at]:
            while at & 1:  # a right child: go up until there is a sibling to the right
                at //= 2
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # wrapped past the last leaf of a level
                return None
        while at < self.leaves:
            at = 2 * at if self.filled[2 * at] else 2 * at + 1
        room = at - self.leaves
        first, count = self.ranges[room].pop()
        if not self.ranges[room]:
            del self.ranges[room]
            self.filled[at] = 0
            at //= 2
            while at:
                self.filled[at] = self.filled[2 * at] | self.filled[2 * at + 1]
                at //= 2
        return room, first, count


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, pieces, first bin, pieces in a bin, offset in a bin)."""
    tree, rules, bins = TightestFit(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            found = tree.take(length)
            if found is None:
                each = capacity // length
                found = (capacity, bins, -(-left // each))
                bins += found[2]
            room, first, count = found
            each = room // length
            full = min(count, left // each)
            if full:
                rules.append((length, rank, full * each, first, each, capacity - room))
                tree.add(room - each * length, first, full)
                left -= full * each
                rank += full * each
            if full < count:
                if left:  # fewer than a bin takes
                    rules.append((length, rank, left, first + full, each, capacity - room))
                    tree.add(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < count:
                    tree.add(room, first + full, count - full)
    return rules


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; needs doc_id, piece and length (1 to capacity).

    ``pieces`` is read twice and must be the same each time (a table). At most ``capacity``
    counts and their plan pass through the driver.
    """
    spark = pieces.sparkSession
    # pieces of a length are dealt to slots so that no task ranks more than its share of them
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = max(1, -(-max(counts.values(), default=1) // RANKED_TOGETHER))
    rules = plan(counts, capacity)
    slot = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)).cast("int")
    ranked = pieces.withColumn("_slot", slot).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_slot").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    if slots > 1:
        sizes = ranked.groupBy("length", "_slot").agg(F.count("*").alias("_n"))
        before = sizes.select("length", "_slot", (F.sum("_n").over(
            Window.partitionBy("length").orderBy("_slot")) - F.col("_n")).alias("_before"))
        ranked = ranked.join(before, ["length", "_slot"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    table = spark.createDataFrame(rules, "length long, r_rank long, r_n long, r_bin long, r_each long, r_offset long")
    starts = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct(
        "r_rank", "r_bin", "r_each", "r_offset"))).alias("_rules"))
    # the last rule that starts at or before the rank
    rule = F.element_at(F.filter("_rules", lambda r: r["r_rank"] <= F.col("_rank")), -1)
    inside = F.col("_rank") - F.col("_rule.r_rank")
    return (ranked.join(F.broadcast(starts), "length").withColumn("_rule", rule)
            .withColumn("sequence_id", F.col("_rule.r_bin") + F.floor(inside / F.col("_rule.r_each")).cast("long"))
            .withColumn("offset", F.col("_rule.r_offset") + (inside % F.col("_rule.r_each")) * F.col("length"))
            .drop("_rule", "_rules", "_rank", "_slot", "_before"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = materialize(tokenized_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return best_fit_pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
