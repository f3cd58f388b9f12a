"""Byte-level BPE encoding and decoding with a lazily determinised merge transducer.

The merges are compiled into a transducer over bytes. Every prefix of a piece has one
encoding, so a position is described by the last token of the encoding of what lies before
it: of the tokens that end there, the one that the merges leave next to its own left
neighbour. A state is the longest part of a token that is being read and the last tokens of the
positions inside it. States and their transitions are made when first met and then reused.
Tokens are emitted once every position from which one may still be running agrees on them:
the lookahead is bounded by the longest token.

Edge cases: null and empty texts have no ids and decode to no bytes; a piece that is itself a
vocabulary entry is that one id; text of any length is read piece by piece; of equal merges the
leftmost comes first; repeated rows are encoded each; an empty table gives no rows; other columns than
doc_id and text are not read.
"""

from __future__ import annotations

import base64
import codecs
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.common import Remembered, map_rows, once

# Bounds of what a task remembers; when one is reached the memory starts anew.
MAX_STATES, MAX_NEIGHBOURS = 200_000, 1_000_000
NEVER = 1 << 62  # a rank beyond all others


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeTransducer:
    """Encodes one pre-split piece of bytes at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {rank: word for word, rank in ranks.items()}
        self.sizes = {rank: len(word) for word, rank in ranks.items()}
        self.child: dict[int, int] = {}  # (node << 8 | byte) -> node
        token, parent, depth = [-1], [(0, 0)], [0]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(token)
                    token.append(-1)
                    parent.append((node, byte))
                    depth.append(depth[node] + 1)
                node = nxt
            token[node] = rank
        # the longest proper suffix of each node that is a node too, and the tokens that end there
        self.depth, self.suffix = depth, [0] * len(token)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(token)
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            above, byte = parent[node]
            shorter = self.move(self.suffix[above], byte) if above else 0
            self.suffix[node] = shorter
            own = ((token[node], depth[node]),) if token[node] >= 0 else ()
            self.ending[node] = own + self.ending[shorter] if own else self.ending[shorter]
        self.longest = max(depth, default=1)
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        self.forget()

    def move(self, node: int, byte: int) -> int:
        """The longest suffix of what is read, with the next byte, that starts some token."""
        child = self.child
        while True:
            found = child.get(node << 8 | byte)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.suffix[node]

    def forget(self) -> None:
        start = (0, (-1,))
        self.states, self.number = [start], {start: 0}
        self.arcs: dict[int, int] = {}
        self.last = [-1]  # the last token of each state

    def parts(self, word: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes a token; None for a token that no merge makes."""
        below = self.ranks[word]
        pieces = [word[i:i + 1] for i in range(len(word))]
        while len(pieces) > 2:
            ranked = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            rank, at = min(ranked)
            if rank >= below:
                return None
            pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
        return tuple(pieces) if len(pieces) == 2 else None

    def edge(self, token: int, side: int) -> list[tuple[int, bytes]]:
        """What stands at one end of a token while it is being merged: (rank that ends it, bytes)."""
        known = self.edges.get((token, side))
        if known is None:
            word = self.words[token]
            two = self.parts(word) if len(word) > 1 else None
            inside = self.edge(self.ranks[two[side]], side) if two else []
            known = [(token if rank == NEVER else rank, part) for rank, part in inside] + [(NEVER, word)]
            self.edges[token, side] = known
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as neighbours.

        While merges go on in the order of their ranks, the parts on either side of the border
        grow; the border goes if the two parts can merge before either of them grows. Of equal
        ranks the leftmost merge comes first.
        """
        known = self.neighbours.get((left, right))
        if known is not None:
            return known
        ends, starts, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        apart = True
        while apart:
            (ends_at, a), (starts_at, b) = ends[i], starts[j]
            across = self.ranks.get(a + b, NEVER)
            if across < ends_at and across <= starts_at and across != NEVER:
                apart = False
            elif ends_at == NEVER and starts_at == NEVER:
                break
            elif ends_at <= starts_at:
                i += 1
            else:
                j += 1
        self.neighbours[left, right] = apart
        return apart

    def step(self, state: int, byte: int) -> int:
        node, lasts = self.states[state]
        after = self.move(node, byte)
        for token, length in self.ending[after]:
            before = lasts[-length]
            if before < 0 or self.stay_apart(before, token):
                break
        made = (after, (*lasts, token)[-self.depth[after] - 1:])
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states)
            self.states.append(made)
            self.last.append(token)
        self.arcs[state << 8 | byte] = number
        return number

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self.forget()
        if len(self.neighbours) > MAX_NEIGHBOURS:
            self.neighbours.clear()
        state, lasts, out, limit = 0, [], [], 8 * self.longest
        arc, last, step = self.arcs.get, self.last, self.step
        add = lasts.append
        for at in range(0, len(piece), limit):
            for byte in piece[at:at + limit]:
                nxt = arc(state << 8 | byte)
                state = step(state, byte) if nxt is None else nxt
                add(last[state])
            if at + limit < len(piece):
                self.emit(lasts, self.depth[self.states[state][0]], out)
        return out + self.backwards(lasts, len(lasts))

    def backwards(self, lasts: list[int], end: int) -> list[int]:
        """The tokens up to a position, from the last token of each position."""
        found, sizes = [], self.sizes
        while end > 0:
            token = lasts[end - 1]
            found.append(token)
            end -= sizes[token]
        found.reverse()
        return found

    def emit(self, lasts: list[int], running: int, out: list[int]) -> None:
        """Moves the tokens on which all running positions agree from ``lasts`` to ``out``."""
        end = len(lasts)
        paths = [self.backwards(lasts, at) for at in range(end - running, end + 1)]
        agreed = 0
        while all(agreed < len(p) and p[agreed] == paths[0][agreed] for p in paths):
            agreed += 1
        out += paths[0][:agreed]
        del lasts[:sum(self.sizes[t] for t in paths[0][:agreed])]


# White space that is more than one character between two words.
_WIDE_SPACE = re.compile(r"\s\s|\A\s|\s\Z").search


class Encoder:
    """Whole texts: the pattern splits a text, the transducer encodes each match.

    Where single white space separates words, no match of the pattern goes past the character
    before a space, so words with their leading space are split and remembered one by one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = MergeTransducer(ranks)
        self.split = regex.compile(pattern).findall
        self.by_space = pattern == public_tokenizers.PATTERN
        self.pieces, self.words = Remembered(), Remembered()

    def by_pattern(self, text: str) -> bytes:
        found, pieces = [], self.pieces
        for piece in self.split(text):
            packed = pieces.get(piece)
            if packed is None:
                ids = self.transducer.encode(piece.encode())
                packed = pieces.keep(piece, struct.pack(f"<{len(ids)}I", *ids))
            found.append(packed)
        return b"".join(found)

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not self.by_space or _WIDE_SPACE(text):
            return self.by_pattern(text)
        first, *rest = text.split(" ")
        found, words = [self.by_pattern(first)], self.words
        for word in rest:
            packed = words.get(word)
            if packed is None:
                packed = words.keep(word, self.by_pattern(" " + word))
            found.append(packed)
        return b"".join(found)


def decode_stream(ids: list[int], words: dict[int, bytes], block: int = 4096) -> Iterator[str]:
    """Text of ids, block by block; a character cut by a block's end waits for the next.

    Bytes that aren't UTF-8 come out as U+FFFD.
    """
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(ids), block):
        yield machine.decode(b"".join(map(words.__getitem__, ids[at:at + block])))
    yield machine.decode(b"", final=True)


def encode_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (string) of every text."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def make():
        encoder = once((path, pattern), lambda: Encoder(read_ranks(path), pattern))
        words = encoder.transducer.words

        def step(part):
            packed = [encoder.ids(text) for text in part["text"]]
            decoded = ["".join(decode_stream(np.frombuffer(p, "<u4").tolist(), words)) for p in packed]
            return {"doc_id": part["doc_id"], "ids": packed, "decoded": decoded}
        return step

    return map_rows(docs.select("doc_id", "text"), None, "doc_id long, ids binary, decoded string", make=make)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
