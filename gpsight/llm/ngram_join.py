"""N-gram Jaccard join by T-occurrence search (DivideSkip), with components of the links.

Two sets link if their overlap reaches T = 3/7 of their sizes together (Jaccard 0.75).

1. Equal sets are one class; a class searches once, for all its copies.
2. A class whose shingles occur too seldom elsewhere can't reach any T: an inverted index of all
   shingles, exchanged as packed blocks, counts for each class how many of its shingles occur in
   another class. Few classes stay.
3. The staying classes are indexed again, with the length of every inverted list. In each list
   the class with the fewest shingles of its own is the leader, in every bin alike; members are
   compared with the leaders they meet most often. That joins large groups of near copies
   without all pairs: the copy with the fewest changes links with whatever has links at all.
4. The classes are ordered into prefixes, shortest lists first: linked classes share a list of
   their prefixes. Where such a list still holds several components, the classes outside its
   largest component are searched by DivideSkip against the classes that lists connect with
   them and whose sizes their shared shingles can reach, in blocks: short lists are merged with
   a heap, long ones probed by binary search, and classes that reach T are linked; of the links
   of a block a spanning forest goes on. Nothing is cut off: pairs that are not searched share
   no prefix list, can't reach T or are in one component already.

Edge cases: empty and null texts have no shingles and link with nothing; a text of fewer words
than a shingle has one, its whole sequence; a row without an id links with nothing and has no
component; rows that repeat an id belong to the component of that id's smallest link; a text of
any length is one set, read whole; lists of equal length go by hash, equal counts by the smaller
class; an empty table gives no rows; other columns than doc_id and text are not read.
Shingles are compared by 64-bit hashes, classes by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heapreplace, heappop

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.bytehash import mixed
from gpsight.llm.common import map_rows, materialize, shuffle_partitions, slices, tidied, tidied_groups
from gpsight.llm.components import Joined, components, merged_components

WORDS = 5
BLOCK_SHINGLES = 1_000_000  # shingles that a task packs at once
LONG_LIST = 16  # lists up to this length need no exact length: they come first in a prefix
LEADERS = 3
SHORT_LIST = 32  # lists up to this length name their pairs, longer ones are searched in blocks
SEARCH_BLOCK = 512  # classes in an in-memory index
GRADES = 16  # grades of set sizes, for each factor of e
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; A-Z are lowered, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for at in range(size):
        out = (out ^ codes[at:at + n]) * _STEP
        out ^= out >> np.uint64(31)
    return np.unique(mixed(out))


def needed(a, b):
    """The least overlap that links sets of these sizes."""
    return -(-3 * (a + b) // 7)


def identity(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def heads(docs: DataFrame) -> DataFrame:
    """doc_id, n, owner (64 bits of the class) and other (the rest) of every document."""
    def step(part):
        sets = [shingles(t) for t in part["text"]]
        keys = np.frombuffer(b"".join(map(identity, sets)), np.int64).reshape(-1, 2)
        return {"doc_id": part["doc_id"], "n": [len(s) for s in sets], "owner": keys[:, 0].tolist(),
                "other": keys[:, 1].tolist()}
    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, n long, owner long, other long")


def bin_of(tokens: np.ndarray, bins: int) -> np.ndarray:
    """Bins are ranges of hashes."""
    return ((tokens >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)


def cut_by_bin(tokens: np.ndarray, bins: int) -> Iterator[tuple[int, int, int]]:
    """(bin, first, end) of sorted tokens."""
    places = bin_of(tokens, bins)
    cuts = np.flatnonzero(np.diff(places, prepend=np.uint64(bins)))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tokens)]):
        yield int(places[a]), a, b


def gathered(batches, sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (token, owner), sorted by token; in a block every owner's set is there once."""
    kept, size = {}, 0
    for part in slices(batches):
        for owner, found in sets(part):
            if owner not in kept and len(found):
                kept[owner] = found
                size += len(found)
        if size >= BLOCK_SHINGLES:
            yield block_of(kept)
            kept, size = {}, 0
    if kept:
        yield block_of(kept)


def block_of(kept: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate(list(kept.values()))
    owners = np.repeat(np.array(list(kept), np.int64), [len(s) for s in kept.values()])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owners[order]


def shared_shingles(docs: DataFrame, bins: int) -> DataFrame:
    """owner and s: at least the number of its shingles that occur in another class.

    Shingles are told apart by their bin and 32 bits of their hash; a rare mix-up only adds to s.

    A shingle that several classes of a block have is counted for them there, and goes on as one
    entry, so a very common shingle is one entry of each block.
    """
    def sets(part):
        for text in part["text"]:
            found = shingles(text)
            yield int(np.frombuffer(identity(found), np.int64)[0]), found

    def pack(batches):
        schema = pa.schema([("bin", pa.int32()), ("tokens", pa.binary()), ("index", pa.binary()), ("owners", pa.binary()),
                            ("counts", pa.binary())])
        for tokens, owners in gathered(batches, sets):
            first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)))
            size = np.diff(np.append(first, len(tokens)))
            here, counts = np.unique(owners[np.repeat(size > 1, size)], return_counts=True)
            known = np.unique(owners)
            index = np.where(size > 1, len(known), np.searchsorted(known, owners[first])).astype("<u4")
            tokens = tokens[first]
            rows = {k: [] for k in schema.names}
            for place, a, b in cut_by_bin(tokens, bins):
                used, short = np.unique(index[a:b], return_inverse=True)
                who = np.append(known, 0)[used]
                many = used == len(known)  # marks the shingles counted already
                rows["bin"].append(place)
                rows["tokens"].append((tokens[a:b] >> np.uint64(24)).astype("<u4").tobytes())
                rows["index"].append((short + 1 if not many.any() else np.where(short == len(used) - 1, 0, short + 1))
                                     .astype("<u2" if len(used) < 65535 else "<u4").tobytes())
                rows["owners"].append(who[~many].tobytes())
                rows["counts"].append(b"")
            if len(here):
                rows["bin"].append(int(bin_of(tokens[:1], bins)[0]))
                rows["tokens"].append(b"")
                rows["index"].append(b"")
                rows["owners"].append(here.tobytes())
                rows["counts"].append(counts.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    names = ["bucket", "owners", "here", "elsewhere"]

    def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each owner once, with its largest count inside a block and its counts elsewhere together."""
        owners, here, elsewhere = (np.concatenate(x) for x in zip(*parts))
        known, number = np.unique(owners, return_inverse=True)
        most, total = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        np.maximum.at(most, number, here)
        np.add.at(total, number, elsewhere)
        return known, most, total

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        token_parts, owner_parts, out = [], [], []
        for tokens, index, owners, counts in zip(frame["tokens"], frame["index"], frame["owners"], frame["counts"]):
            who = np.frombuffer(owners, np.int64)
            if len(counts):
                out.append((who, np.frombuffer(counts, "<i8"), np.zeros(len(who), np.int64)))
                continue
            token_parts.append(np.frombuffer(tokens, "<u4"))
            short = np.frombuffer(index, "<u2" if 2 * len(index) == len(tokens) else "<u4")
            owner_parts.append((np.insert(who, 0, 0)[short], short == 0))
        if token_parts:
            tokens = np.concatenate(token_parts)
            owners = np.concatenate([o for o, _ in owner_parts])
            marked = np.concatenate([m for _, m in owner_parts])
            order = np.argsort(tokens, kind="stable")
            tokens, owners, marked = tokens[order], owners[order], marked[order]
            first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint32(1)))
            size = np.diff(np.append(first, len(tokens)))
            several = np.logical_or.reduceat(marked, first) | (np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first))
            who, times = np.unique(owners[np.repeat(several, size) & ~marked], return_counts=True)
            out.append((who, np.zeros(len(who), np.int64), times.astype(np.int64)))
        if not out:
            return pd.DataFrame({n: [] for n in names})
        # the answers of a bin in one packed row for each bucket of owners
        owners, here, elsewhere = added(out)
        bucket = bucket_of(owners, bins)
        places = np.unique(bucket).tolist()
        return pd.DataFrame([(place, *(x[bucket == place].tobytes() for x in (owners, here, elsewhere))) for place in places],
                            columns=names)

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        owners, here, elsewhere = added([tuple(np.frombuffer(x, np.int64) for x in row)
                                         for row in zip(*(frame[n] for n in names[1:]))])
        return pd.DataFrame({"owner": owners, "s": here + elsewhere})

    packed = docs.select("text").mapInArrow(tidied(pack), "bin int, tokens binary, index binary, owners binary, counts binary")
    found = packed.groupBy("bin").applyInPandas(tidied_groups(count), "bucket int, owners binary, here binary, elsewhere binary")
    return found.groupBy("bucket").applyInPandas(tidied_groups(assemble), "owner long, s long")


def live_sets(docs: DataFrame, classes: DataFrame, bins: int) -> DataFrame:
    """owner, n, own (at most the number of its shingles that no other class has), tokens of the classes
    that may have a link."""
    live = (classes.join(shared_shingles(docs, bins), "owner").filter(4 * F.col("s") >= 3 * F.col("n"))
            .select(F.col("owner").alias("l_owner"), F.col("doc_id").alias("l_id"), F.greatest(F.col("n") - F.col("s"), F.lit(0)).alias("own")))

    def step(part):
        out = {"owner": [], "n": [], "own": [], "tokens": []}
        for owner, own, text in zip(part["l_owner"], part["own"], part["text"]):
            found = shingles(text)
            if int(np.frombuffer(identity(found), np.int64)[0]) == owner:
                for name, value in zip(out, (owner, len(found), own, found.tobytes())):
                    out[name].append(value)
        return out

    texts = docs.select("doc_id", "text").join(live, F.col("doc_id") == F.col("l_id")).select("l_owner", "own", "text")
    return map_rows(texts, step, "owner long, n long, own long, tokens binary").dropDuplicates(["owner"])


def profiles(sets: DataFrame, bins: int) -> DataFrame:
    """owner, shared (its shingles that other classes have), tokens (those of them in long lists),
    lengths (of these lists) and leaders (the classes that lead most of its lists).

    The index answers in packed blocks, one for each bin and bucket of owners.
    """
    names = ["bucket", "owners", "shared", "of_long", "tokens", "lengths", "members", "led", "times"]
    buckets = bins
    def pack(batches):
        schema = pa.schema([(n, pa.binary() if n != "bin" else pa.int32()) for n in ("bin", "tokens", "index", "owners", "turns")])
        turn = {}

        def decoded(part):
            for owner, n, own, found in zip(*(part[c] for c in ("owner", "n", "own", "tokens"))):
                # leaders have few shingles of their own, then many in all
                turn[owner] = min(own, 0xFFFF) << 16 | 0xFFFF - min(n, 0xFFFF)
                yield owner, np.frombuffer(found, np.uint64)
        for tokens, owners in gathered(batches, decoded):
            rows = {k: [] for k in schema.names}
            for place, a, b in cut_by_bin(tokens, bins):
                who, index = np.unique(owners[a:b], return_inverse=True)
                turns = np.array([turn[o] for o in who.tolist()], "<u4")
                index = index.astype("<u2" if len(who) < 65536 else "<u4")
                for name, value in zip(rows, (place, *(x.tobytes() for x in (tokens[a:b], index, who, turns)))):
                    rows[name].append(value)
            turn.clear()
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(frame["tokens"]), np.uint64)
        owners = np.concatenate([np.frombuffer(w, np.int64)[np.frombuffer(i, "<u2" if 4 * len(i) == len(t) else "<u4")]
                                 for t, w, i in zip(frame["tokens"], frame["owners"], frame["index"])])
        listed, at = np.unique(np.frombuffer(b"".join(frame["owners"]), np.int64), return_index=True)
        turns = np.frombuffer(b"".join(frame["turns"]), "<u4")[at]
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)))
        length = np.repeat(np.diff(np.append(first, len(tokens))), np.diff(np.append(first, len(tokens))))
        shared = length > 1
        if not shared.any():
            return pd.DataFrame({n: [] for n in names})
        tokens, owners, length = tokens[shared], owners[shared], length[shared]
        # the leader of a list: the first by turn, then the smallest
        who, number = np.unique(owners, return_inverse=True)
        rank = np.empty(len(who), np.int64)
        rank[np.lexsort((who, turns[np.searchsorted(listed, who)]))] = np.arange(len(who))
        first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)))
        best = np.minimum.reduceat(rank[number], first)
        by_rank = np.argsort(rank)
        leader = np.repeat(by_rank[best], np.diff(np.append(first, len(tokens))))
        pairs, times = np.unique(number * np.int64(len(who)) + leader, return_counts=True)
        member, led = pairs // len(who), who[pairs % len(who)]
        is_long = length > LONG_LIST
        of_long, tokens, length = number[is_long], tokens[is_long], length[is_long]
        by_owner = np.argsort(of_long, kind="stable")
        of_long, tokens, length = of_long[by_owner], tokens[by_owner], length[by_owner]
        each = np.bincount(number, minlength=len(who))
        bucket = bucket_of(who, buckets)
        out = []
        for place in np.unique(bucket).tolist():
            own, some, led_here = bucket == place, bucket[of_long] == place, bucket[member] == place
            out.append((place, who[own].tobytes(), each[own].tobytes(), who[of_long[some]].tobytes(), tokens[some].tobytes(),
                        length[some].astype("<i8").tobytes(), who[member[led_here]].tobytes(), led[led_here].tobytes(),
                        times[led_here].tobytes()))
        return pd.DataFrame(out, columns=names)

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        owners, shared, of_long, tokens, lengths, members, led, times = (
            np.frombuffer(b"".join(frame[c]), np.uint64 if c == "tokens" else np.int64) for c in names[1:])
        who, number = np.unique(owners, return_inverse=True)
        total = np.zeros(len(who), np.int64)
        np.add.at(total, number, shared)
        order = np.argsort(of_long, kind="stable")
        of_long, tokens, lengths = of_long[order], tokens[order], lengths[order]
        cuts = np.searchsorted(of_long, who), np.searchsorted(of_long, who, "right")
        order = np.lexsort((led, members))
        members, led, times = members[order], led[order], times[order]
        new = np.flatnonzero((np.diff(members, prepend=members[:1] - 1) != 0) | (np.diff(led, prepend=led[:1] - 1) != 0))
        members, led, times = members[new], led[new], np.add.reduceat(times, new)
        order = np.lexsort((led, -times, members))
        members, led = members[order], led[order]
        met = np.searchsorted(members, who), np.searchsorted(members, who, "right")
        return pd.DataFrame({
            "owner": who, "shared": total, "tokens": [tokens[a:b].tobytes() for a, b in zip(*cuts)],
            "lengths": [lengths[a:b].tobytes() for a, b in zip(*cuts)],
            "leaders": [[x for x in led[a:b].tolist() if x != o][:LEADERS] for o, a, b in zip(who.tolist(), *met)]})

    packed = (sets.select("owner", "n", "own", "tokens")
              .mapInArrow(tidied(pack), "bin int, tokens binary, index binary, owners binary, turns binary"))
    read_schema = "bucket int, " + ", ".join(f"{n} binary" for n in names[1:])
    return (packed.groupBy("bin").applyInPandas(tidied_groups(read), read_schema).groupBy("bucket")
            .applyInPandas(tidied_groups(assemble), "owner long, shared long, tokens binary, lengths binary, leaders array<long>"))


def bucket_of(owners: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(owners.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def star_links(sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between classes and the leaders that they meet most often."""
    top = found.select("owner", F.explode("leaders").alias("leader"))
    pairs = (top.join(sets, "owner").join(sets.select(F.col("owner").alias("leader"), F.col("tokens").alias("theirs")), "leader"))

    def step(part):
        out = {"a": [], "b": []}
        for a, b, x, y in zip(part["owner"], part["leader"], part["tokens"], part["theirs"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if overlap(x, y) >= needed(len(x), len(y)):
                out["a"].append(a)
                out["b"].append(b)
        return out
    return map_rows(pairs.select("owner", "leader", "tokens", "theirs"), step, "a long, b long")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def prefixes(sets: DataFrame, found: DataFrame, joined: DataFrame) -> DataFrame:
    """token, owner, component, n and s for the prefix of each class that may still reach a T;
    the classes with the shortest lists come first in a prefix."""
    def step(part):
        out = {"token": [], "owner": [], "component": [], "n": [], "s": []}
        for owner, component, raw, shared, in_long, lengths in zip(*(part[c] for c in columns)):
            tokens = np.frombuffer(raw, np.uint64)
            n = len(tokens)
            if 4 * shared < 3 * n:
                continue
            in_long, lengths = np.frombuffer(in_long, np.uint64), np.frombuffer(lengths, np.int64)
            length = np.zeros(n, np.int64)
            length[np.searchsorted(tokens, in_long)] = lengths
            chosen = tokens[np.lexsort((tokens, length))[:n - -(-3 * n // 4) + 1]]
            out["token"] += chosen.view(np.int64).tolist()
            for name, value in (("owner", owner), ("component", component), ("n", n), ("s", shared)):
                out[name] += [value] * len(chosen)
        return out
    columns = ["owner", "component", "set", "shared", "tokens", "lengths"]
    both = (sets.select("owner", F.col("tokens").alias("set")).join(found, "owner")
            .join(joined.select(F.col("node").alias("owner"), "component"), "owner", "left")
            .withColumn("component", F.coalesce("component", "owner")))
    return map_rows(both.select(*columns), step, "token long, owner long, component long, n long, s long")


class Index:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.of = of[order]
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.ends = np.append(first, len(tokens))

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens))]
        hit = at[np.isin(self.tokens[at], query)]
        return [self.of[self.ends[i]:self.ends[i + 1]] for i in np.unique(hit)]

    def reach(self, query: np.ndarray) -> list[int]:
        """Numbers of the sets that link with the query, by DivideSkip."""
        n = len(query)
        least = -(-3 * n // 4)  # no set links with less
        lists = sorted(self.lists(query), key=len)
        if len(lists) < least:
            return []
        longest = len(lists[-1])
        skip = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1)), len(lists) - 1)
        short, long = [x.tolist() for x in lists[:len(lists) - skip]], lists[len(lists) - skip:]
        merged = np.array(list(merged_counts(short, least - skip)), np.int64).reshape(-1, 2)
        numbers, counts = merged.T
        t = np.maximum(least, needed(n, self.sizes[numbers]))
        found = []
        for left, probed in zip(range(len(long), 0, -1), long):
            # the others have reached their T or can't any more
            found += numbers[counts >= t].tolist()
            rest = (counts < t) & (counts + left >= t)
            numbers, counts, t = numbers[rest], counts[rest], t[rest]
            if not len(numbers):
                return found
            at = np.minimum(np.searchsorted(probed, numbers), len(probed) - 1)
            counts = counts + (probed[at] == numbers)
        return found + numbers[counts >= t].tolist()


def merged_counts(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(number, lists that hold it) for numbers in at least ``least`` sorted lists, by a heap."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapify(heap)
    while len(heap) >= max(1, least):
        number, count = heap[0][0], 0
        while heap and heap[0][0] == number:
            _, i, at = heap[0]
            if at + 1 < len(lists[i]):
                heapreplace(heap, (lists[i][at + 1], i, at + 1))
            else:
                heappop(heap)
            count += 1
        if count >= least:
            yield number, count


def search_links(sets: DataFrame, prefix: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different components that share a prefix list.

    ``prefix`` is a table. Lists that hold one component have nothing to add. Short lists name
    each class's candidates one by one; long ones connect their classes to areas, whose classes
    are searched block by block.
    """
    spread = prefix.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.count("*").alias("many"))
    opened = spread.filter("lo != hi").select("token", "many", "lo")
    members = materialize(prefix.join(opened, "token"), "open-lists")
    short = members.filter(F.col("many") <= SHORT_LIST).drop("many", "lo")
    return short_list_links(sets, short).union(long_list_links(sets, members.filter(F.col("many") > SHORT_LIST)))


def short_list_links(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Of two classes the larger asks, unless the pair can't reach its T with the shingles that
    either shares; a member of a list has fewer than SHORT_LIST candidates there."""
    other = members.toDF("token", "o_owner", "o_component", "o_n", "o_s")
    pairs = members.join(other, (members["token"] == other["token"]) & (F.col("component") != F.col("o_component"))
                         & ((F.col("n") > F.col("o_n")) | ((F.col("n") == F.col("o_n")) & (F.col("owner") > F.col("o_owner"))))
                         & (7 * F.least("s", "o_s") >= 3 * (F.col("n") + F.col("o_n"))))
    asked = materialize(pairs.select("owner", "o_owner", "o_component").distinct(), "asked-pairs")
    # the candidates of a class in blocks
    many = asked.groupBy("owner").agg(F.count("*").alias("many"))
    block = F.pmod(F.xxhash64("o_owner"), F.ceil(F.col("many") / SEARCH_BLOCK))
    rows = (asked.join(many, "owner").withColumn("block", block).drop("many")
            .join(sets.select("owner", F.col("tokens").alias("query")), "owner")
            .join(sets.select(F.col("owner").alias("o_owner"), "tokens"), "o_owner"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        index = Index([np.frombuffer(t, np.uint64) for t in frame["tokens"]])
        owners, of = frame["o_owner"].tolist(), frame["o_component"].tolist()
        # one link to a component is enough
        met = {of[i]: owners[i] for i in index.reach(np.frombuffer(frame["query"].iloc[0], np.uint64))}
        return pd.DataFrame({"a": frame["owner"].iloc[0], "b": list(met.values())}, columns=["a", "b"])

    return rows.groupBy("owner", "block").applyInPandas(tidied_groups(search), "a long, b long")


def long_list_links(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Classes outside the largest component of an area ask the others of the area whose sizes they can
    reach T with, grade of sizes by grade. A class goes once to each pair of blocks, whatever the
    number of lists and candidates it has there. Lists connect whole components, not classes, so
    a large group that the leaders joined is one node."""
    reach = components(members.select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct(), "list-reach")
    part_of = members.select("owner", "component", "n", "s").distinct()
    where = materialize(part_of.join(reach.select(F.col("node").alias("component"), F.col("component").alias("area")),
                                     "component"), "search-areas")
    main = (where.groupBy("area", "component").agg(F.count("*").alias("n")).groupBy("area")
            .agg(F.max(F.struct("n", "component"))["component"].alias("main")))
    grade = lambda n: F.floor(F.log(n) * GRADES).cast("int")
    holding = lambda df: df.withColumn("grade", grade(F.col("n")))
    # sizes from 3/4 of its own up to the one whose T is all that the class shares
    asking = lambda df: (
        df.join(main, "area").filter("component != main").withColumn("least", F.expr("(3 * n + 3) div 4"))
        .withColumn("most", F.expr("7 * s div 3 - n")).filter("least <= most")
        .withColumn("grade", F.explode(F.sequence(grade(F.col("least")), grade(F.col("most"))))))
    many = lambda df, name: df.groupBy("area", "grade").agg(F.ceil(F.count("*") / SEARCH_BLOCK).cast("int").alias(name))
    lots = materialize(many(holding(where), "blocks").join(many(asking(where), "turns"), ["area", "grade"]), "search-lots")
    slot = lambda n: F.pmod(F.xxhash64("owner"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["area", "grade", "block", "turn"]
    columns = [*keys, "owner", "component", "n", "s", "tokens"]
    full = where.join(sets.select("owner", "tokens"), "owner")
    stored = (holding(full).join(lots, ["area", "grade"]).withColumn("block", slot("blocks"))
              .withColumn("turn", each("turns")).select(*columns))
    queries = (asking(full).join(lots, ["area", "grade"]).withColumn("turn", slot("turns"))
               .withColumn("block", each("blocks")).select(*columns).toDF(*(f"q_{c}" for c in columns)))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out, joined = [], Joined()
        if len(queries) and len(block):
            block = block[7 * block["s"] >= 3 * (block["n"] + queries["q_n"].min())]
        if len(queries) and len(block):
            queries = queries[7 * queries["q_s"] >= 3 * (queries["q_n"] + block["n"].min())]
            index = Index([np.frombuffer(t, np.uint64) for t in block["tokens"]])
            owners, of = block["owner"].tolist(), block["component"].tolist()
            for owner, component, tokens in zip(queries["q_owner"], queries["q_component"], queries["q_tokens"]):
                # a link between components that others connect already adds nothing
                out += [(owner, owners[i]) for i in index.reach(np.frombuffer(tokens, np.uint64)) if joined.join(component, of[i])]
        return pd.DataFrame(out, columns=["a", "b"])

    return queries.groupBy(*(f"q_{c}" for c in keys)).cogroup(stored.groupBy(*keys)).applyInPandas(tidied_groups(search), "a long, b long")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id with an equal set)."""
    bins = 2 * shuffle_partitions(docs.sparkSession)
    known = materialize(heads(docs), "shingle-heads")
    classes = (known.filter("n > 0 AND doc_id IS NOT NULL").groupBy("owner", "other")
               .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")))
    sets = materialize(live_sets(docs, classes, bins), "live-sets")
    found = materialize(profiles(sets, bins), "live-profiles")
    stars = materialize(star_links(sets, found), "star-links")
    joined = components(stars, "star-components")
    prefix = materialize(prefixes(sets, found, joined), "prefix-lists")
    links = materialize(search_links(sets, prefix), "search-links")
    joined = merged_components(joined, links, "link-components")
    least = classes.groupBy("owner").agg(F.min("doc_id").alias("class_id"))
    named = (joined.join(least, F.col("node") == F.col("owner")).groupBy("component").agg(F.min("class_id").alias("component_id"))
             .join(joined, "component").select(F.col("node").alias("owner"), "component_id"))
    by_class = least.join(named, "owner", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    alone = known.filter("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return (known.filter("n > 0 AND doc_id IS NOT NULL").join(by_class, "owner")
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id").union(alone))
