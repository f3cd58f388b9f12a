"""Suffix-array deduplication by a common-prefix-aware distributed merge sort.

Every byte of a string of WINDOW bytes that also starts in a document with a smaller id goes.

Sorting a suffix for every byte isn't needed. Anchors are the positions whose KMER bytes have the
least hash among the positions of some window, so equal windows have equal anchors at equal
places, and the windows around an anchor are known from the bytes beside it.

1. Equal texts are one class: only its smallest id is searched, the others go whole.
2. Anchors whose bytes occur in one class alone are dropped: their hashes are exchanged as packed
   blocks, and each bucket of classes hears which of its anchors occur elsewhere.
3. The texts come to their buckets compressed. Each bucket sorts the suffixes of the anchors that
   are left (the bytes right of the anchor, then those left of it, outwards) under their hash,
   which stands for the anchor's own bytes, and writes them front-coded: the prefix length that a
   suffix shares with the one before, and the rest. These sorted runs are exchanged by ranges of
   the hash, so that all suffixes of an anchor meet.
4. A loser tree merges the runs. It keeps, for each run, the prefix that its head shares with
   the last winner; heads are told apart by these lengths, and known prefixes are never compared
   again. Equal suffixes come out together, as one suffix with its smallest document.
5. Among the distinct suffixes of an anchor every window is looked up with its smallest document.
   All windows around an anchor overlap, so what goes there is one interval of bytes.

What is exchanged is packed in columns and compressed, classes go by their number in their bucket,
and the shuffle files of a step that is written are removed at its end, so that the scratch disk
holds one step's exchanges at a time.

Edge cases: null texts are empty; texts shorter than a window lose nothing; matches inside one
document don't count, nor do those between rows that repeat an id; a row without an id loses
nothing and removes nothing; a text of any length is one document, read whole; of equal suffixes
the smallest id counts; an empty table gives no rows; other columns than doc_id and text are not read
(``carry`` hands them on). Windows and texts are compared by 64 and 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.bytehash import hash_at, mixed, sliding, words64
from gpsight.llm.common import carried, map_rows, materialize, row_schema, shuffle_partitions, slices, tidied, tidied_groups
from gpsight.llm.ngram_join import bin_of, bucket_of, cut_by_bin

WINDOW, KMER = 50, 24
LEFT = WINDOW - KMER  # bytes of a window that can lie left of its anchor
RIGHT = WINDOW - KMER  # and right of it, past its own bytes
KEY = 8 + RIGHT + LEFT + 2  # hash, right bytes, left bytes, and how many of each (right: with the anchor's) are real
BLOCK_BYTES, RUN_SUFFIXES = 6_000_000, 150_000
PACK_BYTES = 16_000_000  # bytes of texts that a task sorts into buckets at once
TEXTS_BYTES = 400_000  # bytes of texts whose anchors are found at once
AT_ONCE = 20_000  # suffixes whose windows are worked on at once


def anchors(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, positions of its anchors, their hashes)."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < WINDOW:
        return
    hashes = hash_at(words64(data), KMER) | np.uint64(1)
    span = LEFT + 1  # anchors compete inside a window
    least = sliding(hashes, span, np.minimum)
    for end in ends[:-1].tolist():  # windows that run past a text's end
        least[max(0, end - WINDOW + 1):end] = 0
    greatest = sliding(np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64))), span, np.maximum)
    at = np.flatnonzero(greatest == hashes)
    cuts = np.searchsorted(at, np.concatenate(([0], ends)))
    begin = 0
    for number, end in enumerate(ends.tolist()):
        a, b = cuts[number], cuts[number + 1]
        if b > a:
            yield number, at[a:b] - begin, mixed(hashes[at[a:b]])  # least hashes are small: mixed, they fill all bins alike
        begin = end


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first number, texts) with a bounded number of bytes, or one long text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TEXTS_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of as many numbers, byte plane by byte plane, compressed."""
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unsqueezed(body: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(body, n * sum(widths), "zstd", asbytes=True), np.uint8)
    ends = n * np.cumsum(widths)
    return [np.ascontiguousarray(raw[end - n * w:end].reshape(w, n).T).view(k)[:, 0] for k, w, end in zip(kinds, widths, ends.tolist())]


def encoded(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def short_hash(hashes: np.ndarray) -> np.ndarray:
    """40 bits below those that choose the bin, as rows of 5 bytes."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, 2:7]


def number_of(raw: np.ndarray) -> np.ndarray:
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :5] = raw
    return full.view("<u8")[:, 0]


def tag_of(owners: np.ndarray) -> np.ndarray:
    """32 bits of an owner, to find it in its bucket. Owners that share them have each other's anchors looked up too."""
    return (mixed(owners.view(np.uint64) ^ np.uint64(KMER)) >> np.uint64(32)).astype("<u4")


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, n and live: for each bucket of classes (owner: xxhash64 of the text) the anchors that another class has
    too, packed as place keys and tags of the owners. There are as many bins of hashes as buckets."""
    schema = pa.schema([("bin", pa.int32()), ("hashes", pa.binary()), ("index", pa.binary()), ("owners", pa.binary())])

    def pack(batches):
        kept, size = {}, 0
        for part in slices(batches):
            fresh = {o: t for o, t in zip(part["owner"], part["text"]) if o not in kept}
            ids, texts = list(fresh), encoded(fresh.values())
            for first, some in chunks(texts):
                for number, _, hashes in anchors(some):
                    kept[ids[first + number]] = np.unique(hashes)
                    size += len(some[number])
                if size >= BLOCK_BYTES:
                    yield block(kept)
                    kept, size = {}, 0
        if kept:
            yield block(kept)

    def block(kept):
        rows = {k: [] for k in schema.names}
        known = np.array(list(kept), np.int64)
        hashes = np.concatenate(list(kept.values()))
        index = np.repeat(np.arange(len(known)), [len(h) for h in kept.values()])
        order = np.argsort(hashes, kind="stable")
        hashes, index = hashes[order], index[order]
        first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)))
        size = np.diff(np.append(first, len(hashes)))
        several = np.repeat(size > 1, size)
        # what several classes of this block have needs no answer: it goes to the owners' buckets
        who, what = known[index[several]], place_key(hashes[several], buckets)
        bucket = bucket_of(who, buckets)
        for place in np.unique(bucket).tolist():
            own = bucket == place
            for name, value in zip(rows, (-1 - place, squeezed(what[own], tag_of(who[own])), int(own.sum()).to_bytes(8), b"")):
                rows[name].append(value)
        one = np.where(size > 1, len(known), index[first])
        hashes = hashes[first]
        for place, a, b in cut_by_bin(hashes, buckets):
            used, short = np.unique(one[a:b], return_inverse=True)
            marked = used[-1] == len(known)
            short = np.where(short == len(used) - 1, 0, short + 1) if marked else short + 1
            owners = known[used[:-1] if marked else used]
            short = short.astype("<u2" if len(used) < 65535 else "<u4")
            for name, value in zip(rows, (place, short_hash(hashes[a:b]).tobytes(), short.tobytes(), owners.tobytes())):
                rows[name].append(value)
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        place = int(frame["bin"].iloc[0])
        if place < 0:
            return pd.DataFrame({"bucket": -1 - place, "n": [int.from_bytes(n) for n in frame["index"]], "live": frame["hashes"]})
        hashes, owners, marked = [], [], []
        for raw, index, who in zip(frame["hashes"], frame["index"], frame["owners"]):
            hashes.append(np.frombuffer(raw, np.uint8).reshape(-1, 5))
            short = np.frombuffer(index, "<u2" if 5 * len(index) == 2 * len(raw) else "<u4")
            owners.append(np.insert(np.frombuffer(who, np.int64), 0, 0)[short])
            marked.append(short == 0)
        number, owners, marked = number_of(np.concatenate(hashes)), np.concatenate(owners), np.concatenate(marked)
        order = np.argsort(number, kind="stable")
        number, owners, marked = number[order], owners[order], marked[order]
        first = np.flatnonzero(np.diff(number, prepend=number[:1] + np.uint64(1)))
        size = np.diff(np.append(first, len(number)))
        lo = np.minimum.reduceat(np.where(marked, np.iinfo(np.int64).max, owners), first)
        hi = np.maximum.reduceat(np.where(marked, np.iinfo(np.int64).min, owners), first)
        live = np.repeat(np.logical_or.reduceat(marked, first) | (lo != hi), size) & ~marked
        owners, keys = owners[live], number[live] | np.uint64(place << 40)
        bucket = bucket_of(owners, buckets)
        tags, order = tag_of(owners), np.argsort(bucket, kind="stable")  # keys stay sorted
        keys, tags, bucket = keys[order], tags[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return pd.DataFrame([(int(bucket[a]), b - a, squeezed(keys[a:b], tags[a:b]))
                             for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)])], columns=["bucket", "n", "live"])

    packed = docs.select("owner", "text").mapInArrow(tidied(pack), "bin int, hashes binary, index binary, owners binary")
    return packed.groupBy("bin").applyInPandas(tidied_groups(answer), "bucket int, n long, live binary")


def packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """The texts that hold a window, in blocks for each bucket of owners: equal texts of a block once, with their
    smallest id."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("numbers", pa.binary()), ("texts", pa.binary())])

    def pack(batches):
        kept, size = {}, 0
        for part in slices(batches):
            for owner, doc, text in zip(part["owner"], part["doc_id"], part["text"]):
                if len(text) < WINDOW:
                    continue
                if text not in kept:
                    size += len(text)
                    kept[text] = owner, doc
                elif doc < kept[text][1]:
                    kept[text] = owner, doc
            if size >= PACK_BYTES:
                yield block(kept)
                kept, size = {}, 0
        if kept:
            yield block(kept)

    def block(kept):
        rows = {k: [] for k in schema.names}
        texts, known = list(kept), np.array(list(kept.values()), np.int64)
        bucket = bucket_of(np.ascontiguousarray(known[:, 0]), buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for some in np.split(order, cuts[1:]):
            each = [texts[i] for i in some.tolist()]
            sizes = np.array([len(t) for t in each], np.int64)
            for name, value in zip(rows, (int(bucket[some[0]]), len(some), squeezed(known[some, 0], known[some, 1], sizes),
                                          pa.compress(b"".join(each), "zstd", asbytes=True))):
                rows[name].append(value)
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.select("doc_id", "owner", F.col("text").cast("binary").alias("text")).mapInArrow(
        tidied(pack), "bucket int, n long, numbers binary, texts binary")


def unpacked_texts(frame: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """(owner, smallest id, text) of the classes of a bucket, in order."""
    least = {}
    for n, numbers, texts in zip(frame["n"], frame["numbers"], frame["texts"]):
        owners, docs, sizes = unsqueezed(numbers, n, "<i8", "<i8", "<i8")
        data, at = pa.decompress(texts, int(sizes.sum()), "zstd", asbytes=True), 0
        for owner, doc, size in zip(owners.tolist(), docs.tolist(), sizes.tolist()):
            text = data[at:at + size]
            at += size
            if (known := least.get((owner, text))) is None or doc < known:
                least[owner, text] = doc
    return sorted(((owner, doc, text) for (owner, text), doc in least.items()), key=lambda x: x[:2])


def place_key(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of a hash and 40 bits more."""
    return number_of(short_hash(hashes)) | (bin_of(hashes, bins) << np.uint64(40))


def keys_of(data: bytes, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A row of KEY bytes for each anchor; sorted as bytes they are in suffix order under the hash."""
    padded = np.frombuffer(bytes(LEFT) + data + bytes(WINDOW), np.uint8)
    out = np.empty((len(at), KEY), np.uint8)
    out[:, :8] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:8 + RIGHT] = padded[(at + LEFT + KMER)[:, None] + np.arange(RIGHT)]
    out[:, 8 + RIGHT:-2] = padded[(at + LEFT)[:, None] - 1 - np.arange(LEFT)]
    out[:, -2] = np.minimum(len(data) - at, WINDOW)
    out[:, -1] = np.minimum(at, LEFT)
    return out


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The prefix that each sorted key shares with the one before, and what follows it and the hash, one after the other."""
    differs = keys[1:] != keys[:-1]
    shared = np.concatenate(([0], np.where(differs.any(1), differs.argmax(1), KEY))).astype(np.uint8)
    return shared, keys[:, 8:][np.arange(8, KEY) >= shared[:, None]].tobytes()


def rests_of(shared: np.ndarray, hashes: np.ndarray, context: bytes) -> bytes:
    """What follows the shared prefix of each key, hash and all."""
    there = np.arange(KEY) >= shared[:, None]
    of_hash = np.broadcast_to(np.arange(KEY) < 8, there.shape)[there]
    out = np.empty(len(of_hash), np.uint8)
    out[of_hash] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[there[:, :8]]
    out[~of_hash] = np.frombuffer(context, np.uint8)
    return out.tobytes()


NUMBERS = ("u1", "<u8", "<i8", "<u4", "<u4")  # shared, steps between hashes, document, number of the class, position


def sorted_runs(texts: DataFrame, live: DataFrame, buckets: int, bins: int) -> DataFrame:
    """Front-coded sorted runs of the live suffixes of each bucket; a row is the part of a run in a bin.

    Classes go by their number in the bucket; a row with a negative bin names their owners and documents.
    """
    names = ["bin", "bucket", "n", "numbers", "context"]

    def run(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, kept, size = [], [], 0
        if len(packed) and len(answers):
            bucket = int(packed["bucket"].iloc[0])
            classes = unpacked_texts(packed)
            owners, docs = (np.array([c[i] for c in classes], np.int64) for i in (0, 1))
            keys, tags = (np.concatenate(x) for x in zip(*(unsqueezed(b, n, "<u8", "<u4") for n, b in zip(answers["n"], answers["live"]))))
            order = np.argsort(tags, kind="stable")
            keys, tags = keys[order], tags[order]
            begin, end = (np.searchsorted(tags, tag_of(owners), side).tolist() for side in ("left", "right"))
            some = [i for i in range(len(classes)) if begin[i] < end[i]]
            for first, data in chunks([classes[i][2] for i in some]):
                for j, at, hashes in anchors(data):
                    i = some[first + j]
                    here = np.isin(place_key(hashes, buckets), keys[begin[i]:end[i]])
                    kept.append((keys_of(data[j], at[here], hashes[here]), at[here], docs[i], i))
                    size += int(here.sum())
                if size >= RUN_SUFFIXES:
                    rows += parts(kept, bucket)
                    kept, size = [], 0
            if size:
                rows += parts(kept, bucket)
            if rows:
                rows.append((-1 - bucket, bucket, len(classes), squeezed(owners, docs), b""))
        return pd.DataFrame(rows, columns=names)

    def parts(kept, bucket):
        keys = np.concatenate([k for k, *_ in kept])
        each = [len(k) for k, *_ in kept]
        at = np.concatenate([a for _, a, *_ in kept]).astype("<u4")
        doc = np.repeat(np.array([d for *_, d, _ in kept], np.int64), each)
        number = np.repeat(np.array([i for *_, i in kept], "<u4"), each)
        order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY}")[:, 0], kind="stable")
        # numpy's byte strings end at a zero: keys end in two counts, so equal ones stay equal
        keys, at, doc, number = keys[order], at[order], doc[order], number[order]
        hashes = np.ascontiguousarray(keys[:, :8]).view(">u8")[:, 0].astype(np.uint64)
        for place, a, b in cut_by_bin(hashes, bins):
            shared, context = front_coded(keys[a:b])
            steps = np.diff(hashes[a:b], prepend=np.uint64(0))
            yield (place, bucket, b - a, squeezed(shared, steps, doc[a:b], number[a:b], at[a:b]),
                   pa.compress(context, "zstd", asbytes=True))

    return texts.groupBy("bucket").cogroup(live.groupBy("bucket")).applyInPandas(
        tidied_groups(run), "bin int, bucket int, n long, numbers binary, context binary")


class Run:
    """Reads a front-coded run; equal suffixes inside it are one head."""

    def __init__(self, shared: bytes, rests: bytes):
        self.shared, self.rests = shared, rests
        self.next, self.place, self.head, self.first, self.last = 0, 0, b"", 0, 0

    def advance(self) -> int:
        """Moves to the next distinct suffix; the prefix it shares with the one before, -1 at the end."""
        if self.next == len(self.shared):
            return -1
        shared = self.shared[self.next]
        self.head = self.head[:shared] + self.rests[self.place:self.place + KEY - shared]
        self.place += KEY - shared
        self.first = self.next
        self.next = self.shared_end(self.next + 1)
        return shared

    def shared_end(self, at: int) -> int:
        shared, n = self.shared, len(self.shared)
        while at < n and shared[at] == KEY:
            at += 1
        return at


def merge(runs: list[Run]) -> Iterator[tuple[int, int, bool]]:
    """(run, entry, whether its suffix is that of the entry before) in sorted order, by a loser tree.

    For every run the tree knows the prefix that its head shares with the last winner that passed
    it. A longer shared prefix is the smaller head; only equal lengths look at bytes, past them.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    known = [0] * leaves  # -1: the run is at its end
    for i in range(leaves):
        known[i] = -1 if i >= len(runs) or runs[i].advance() < 0 else 0
    tree = [0] * leaves
    heads = [r.head for r in runs]

    def play(a: int, b: int, shared: int) -> tuple[int, int]:
        """Winner and loser of two heads that share ``shared`` bytes with the last winner: only what
        follows them is compared."""
        x, y = heads[a][shared:], heads[b][shared:]
        if x == y:
            known[b] = KEY
            return a, b
        diff = int.from_bytes(x) ^ int.from_bytes(y)
        if y < x:
            a, b = b, a
        known[b] = KEY - (diff.bit_length() + 7) // 8
        return a, b

    def first(node: int) -> int:
        if node >= leaves:
            return node - leaves
        a, b = first(2 * node), first(2 * node + 1)
        if known[b] < 0:
            tree[node] = b
            return a
        if known[a] < 0:
            tree[node] = a
            return b
        winner, tree[node] = play(a, b, 0)
        return winner

    winner = first(1)
    shared = 0
    while known[winner] >= 0:
        run = runs[winner]
        equal = shared == KEY
        for entry in range(run.first, run.next):
            yield winner, entry, equal
            equal = True
        known[winner] = run.advance()
        heads[winner] = run.head
        node = (winner + leaves) // 2
        while node:
            other = tree[node]
            mine, theirs = known[winner], known[other]
            if theirs > mine:
                tree[node], winner = winner, other
            elif theirs == mine and mine >= 0:
                winner, tree[node] = play(winner, other, mine)
            node //= 2
        shared = known[winner]


_TABLE = np.random.default_rng(11).integers(1, 2 ** 63, 256, np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(LEFT + RIGHT, 0x9E3779B97F4A7C15, np.uint64))
_INVERSE = np.array([pow(int(p), -1, 1 << 64) for p in _POWER], np.uint64)


def removals(keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each distinct suffix and each place of an anchor in a window, the smallest document
    with that window (the largest number where the window isn't inside the text).

    The hash of the anchor stands for its own bytes; a window is known by it and the bytes around."""
    right, left = keys[:, -2].astype(int), keys[:, -1].astype(int)
    group = np.ascontiguousarray(keys[:, :8]).view("<u8")[:, 0]
    never = np.iinfo(np.int64).max
    windows = np.empty((LEFT + 1, len(keys)), np.uint64)
    for a in range(0, len(keys), AT_ONCE):
        some = keys[a:a + AT_ONCE]
        row = np.hstack([some[:, 8 + RIGHT:-2][:, ::-1], some[:, 8:8 + RIGHT]])
        sums = np.zeros((len(row), LEFT + RIGHT + 1), np.uint64)
        np.cumsum(_TABLE[row] * _POWER, axis=1, out=sums[:, 1:])
        salt = mixed(group[a:a + AT_ONCE])
        for o in range(LEFT + 1):
            window = (sums[:, LEFT - o + RIGHT] - sums[:, LEFT - o]) * _INVERSE[LEFT - o]
            windows[o, a:a + AT_ONCE] = mixed(window ^ salt)
    out = np.full((len(keys), LEFT + 1), never)
    for o in range(LEFT + 1):
        valid = np.flatnonzero((left >= o) & (right >= WINDOW - o))
        if not len(valid):
            continue
        window = windows[o, valid]
        order = np.argsort(window, kind="stable")
        window = window[order]
        first = np.flatnonzero(np.diff(window, prepend=window[:1] + np.uint64(1)))
        lowest = np.minimum.reduceat(least[valid[order]], first)
        out[valid[order], o] = np.repeat(lowest, np.diff(np.append(first, len(window))))
    return out


def merged_bin(frame: pd.DataFrame) -> pd.DataFrame:
    """The intervals that go, from all runs of a bin, packed for each bucket of classes."""
    names = ["bucket", "n", "names", "cuts"]
    if frame["bin"].iloc[0] < 0:
        return pd.DataFrame({"bucket": frame["bucket"], "n": frame["n"], "names": frame["numbers"], "cuts": b""}, columns=names)
    runs, columns = [], []
    for n, numbers, packed in zip(frame["n"], frame["numbers"], frame["context"]):
        shared, steps, *rest = unsqueezed(numbers, n, *NUMBERS)
        context = pa.decompress(packed, int((KEY - np.maximum(shared, 8).astype(int)).sum()), "zstd", asbytes=True)
        runs.append(Run(shared.tobytes(), rests_of(shared, np.cumsum(steps, dtype=np.uint64), context)))
        columns.append(rest)
    starts = np.concatenate(([0], np.cumsum([len(r.shared) for r in runs])))
    total = int(starts[-1])
    order, fresh, distinct = np.empty(total, np.int64), np.empty(total, bool), bytearray()
    at = starts.tolist()
    for i, (run, entry, equal) in enumerate(merge(runs)):
        order[i] = at[run] + entry
        fresh[i] = not equal
        if not equal:
            distinct += runs[run].head
    doc, number, place = (np.concatenate(c)[order] for c in zip(*columns))
    place = place.astype(np.int64)
    bucket = np.repeat(frame["bucket"].to_numpy(), np.diff(starts))[order]
    keys = np.frombuffer(distinct, np.uint8).reshape(-1, KEY)
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, total))
    least = np.minimum.reduceat(doc, first)
    out = []
    # the suffixes of an anchor stay together
    anchor = np.ascontiguousarray(keys[:, :8]).view("<u8")[:, 0]
    heads = np.append(np.flatnonzero(np.diff(anchor, prepend=anchor[:1] + np.uint64(1))), len(keys))
    bounds = np.unique(np.append(heads[np.searchsorted(heads, np.arange(0, len(keys), AT_ONCE), "right") - 1], len(keys)))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        lowest = removals(keys[lo:hi], least[lo:hi])
        suffix = np.repeat(np.arange(hi - lo), size[lo:hi])
        for a in range(0, len(suffix), AT_ONCE):
            members = slice(int(first[lo]) + a, int(first[lo]) + min(a + AT_ONCE, len(suffix)))
            gone = lowest[suffix[a:a + AT_ONCE]] < doc[members, None]
            some = np.flatnonzero(gone.any(1))
            low = gone[some].argmax(1)
            high = LEFT - gone[some][:, ::-1].argmax(1)
            spot = place[members][some]
            out.append((bucket[members][some], number[members][some], spot - high, spot - low + WINDOW))
    bucket, number, begin, end = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((begin, number, bucket))
    bucket, number, begin, size = bucket[order], number[order], begin[order], (end - begin)[order].astype(np.uint8)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pd.DataFrame([(int(bucket[a]), b - a, b"", squeezed(number[a:b], begin[a:b].astype("<u4"), size[a:b]))
                         for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])], columns=names)


def cuts_by_owner(frame: pd.DataFrame) -> pd.DataFrame:
    """The spans that go of each class of a bucket."""
    is_cut = frame["names"].str.len() == 0
    found = [unsqueezed(c, n, "<u4", "<u4", "u1") for n, c in zip(frame["n"][is_cut], frame["cuts"][is_cut])]
    if not found:
        return pd.DataFrame({"owner": [], "doc_id": [], "cuts": []})
    (n, names), = zip(frame["n"][~is_cut], frame["names"][~is_cut])
    owners, docs = unsqueezed(names, n, "<i8", "<i8")
    number, begin, size = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(number, kind="stable")
    number, begin, size = number[order], begin[order].astype(np.int64), size[order]
    pairs = np.stack([begin, begin + size], 1)
    cuts = np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1))
    return pd.DataFrame({"owner": owners[number[cuts]], "doc_id": docs[number[cuts]], "cuts": [
        np.array(spans_of(p), "<u4").tobytes() for p in np.split(pairs, cuts[1:])]})


def spans_of(cuts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjacent (begin, end) pairs."""
    cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
    reach = np.maximum.accumulate(cuts[:, 1])
    new = np.flatnonzero(np.concatenate(([True], cuts[1:, 0] > reach[:-1])))
    return list(zip(cuts[new, 0].tolist(), reach[np.append(new[1:] - 1, len(cuts) - 1)].tolist()))


def remove_repeats(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte intervals) and kept (the remaining bytes) of every document.

    With ``carry`` also readable (the kept bytes as text, without the pieces of a character that a
    cut has left) and row, the whole input row as a struct.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    bins = 2 * buckets
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("owner", F.xxhash64("text"))
    ids = materialize(texts.select("doc_id", "owner", F.md5(F.col("text").cast("binary")).alias("check")), "text-ids")
    classes = ids.filter("doc_id IS NOT NULL").groupBy("owner", "check").agg(F.min("doc_id").alias("first_id"))
    searched = texts.filter("doc_id IS NOT NULL")
    live = materialize(shared_anchors(searched, buckets), "shared-anchors", release=True)
    runs = sorted_runs(packed_texts(searched, buckets), live, buckets, bins)
    cuts = (runs.groupBy("bin").applyInPandas(tidied_groups(merged_bin), "bucket int, n long, names binary, cuts binary")
            .groupBy("bucket").applyInPandas(tidied_groups(cuts_by_owner), "owner long, doc_id long, cuts binary"))
    cuts = materialize(cuts, "cut-intervals", release=True)
    fate = (ids.distinct().join(classes, ["owner", "check"], "left")
            .select("owner", "doc_id", (F.col("doc_id") > F.col("first_id")).alias("copy"))
            .filter("doc_id IS NOT NULL").groupBy("owner", "doc_id").agg(F.max("copy").alias("copy"))
            .join(cuts, ["owner", "doc_id"], "left").filter("copy OR cuts IS NOT NULL"))
    # a carried row holds the text already: one copy of it is exchanged
    whole = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("owner"),
                        *(carried(docs, carry) or [F.col("text")]))
    both = whole.join(fate, ["doc_id", "owner"], "left")

    def step(part):
        out = {"doc_id": part["doc_id"], "n_bytes": [], "spans": [], "kept": []}
        texts = [row["text"] for row in part["row"]] if carry else part["text"]
        for data, copy, pairs in zip(encoded(texts), part["copy"], part["cuts"]):
            if copy:
                spans = [(0, len(data))] if len(data) >= WINDOW else []
            else:
                spans = spans_of(np.frombuffer(pairs, "<u4").reshape(-1, 2).astype(np.int64)) if pairs else []
            kept, at = [], 0
            for begin, end in spans:
                kept.append(data[at:begin])
                at = end
            out["n_bytes"].append(len(data))
            out["spans"].append([{"begin": a, "end": b} for a, b in spans])
            out["kept"].append(b"".join(kept) + data[at:])
        if carry:
            out |= {"readable": [kept.decode("utf-8", "ignore") for kept in out["kept"]], "row": part["row"]}
        return out

    return map_rows(both.drop("owner"), step, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
                    + ", readable string" * carry + row_schema(docs, carry))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
