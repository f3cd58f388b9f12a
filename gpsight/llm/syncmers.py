"""Document fingerprints from closed syncmers.

A k-mer is an anchor if its least inner substring lies at its first or last place. Whether it
is one depends on nothing around it, so an edit changes only the anchors that it touches. The
fingerprint holds every anchor of the text in order, as a hash and the distance from the anchor before;
equal texts have equal fingerprints, and a passage that two texts share shows as the same run of
anchors in both, wherever it stands. Likeness takes the anchors that both texts have (a hash by its first
place) and counts those that stand in the same order, against all anchors of the two.

Edge cases: a null text is empty; an empty text's fingerprint is empty and like only another
empty one; a text shorter than a k-mer has one anchor, its own hash at place 0; a text of any
length is read whole, a block of bytes at a time; rows that repeat an id or have none stand next to
each other, by text; an empty table gives no rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.bytehash import hash_at, sliding, words64
from gpsight.llm.common import shuffle_partitions, slices

KMER, INNER = 20, 8
# Bytes whose k-mers are looked at together: only memory depends on it.
BLOCK = 1 << 20


class Anchors(NamedTuple):
    """The anchors of a text in order, and each hash once with its first place."""

    hashes: np.ndarray
    places: np.ndarray
    known: np.ndarray
    first: np.ndarray


def anchors_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of ``data``, block by block."""
    hashes, places = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for begin in range(0, max(1, len(data) - KMER + 1), BLOCK):
        words = words64(data[begin:begin + BLOCK + KMER - 1])
        inner = hash_at(words, INNER)
        least = sliding(inner, KMER - INNER + 1, np.minimum)
        n = len(least)
        at = np.flatnonzero((inner[:n] == least) | (inner[KMER - INNER:KMER - INNER + n] == least))
        hashes.append((hash_at(words, KMER)[at] >> np.uint64(32)).astype(np.uint32))
        places.append(at + begin)
    return np.concatenate(hashes), np.concatenate(places)


def fingerprints(texts: list[str]) -> list[Anchors]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, at = anchors_in(b"".join(raw))
    out, begin = [], 0
    for r in raw:
        end = begin + len(r)
        a, b = np.searchsorted(at, [begin, max(begin, end - KMER + 1)])
        own, places = hashes[a:b], at[a:b] - begin
        if r and a == b:
            own, places = np.array([xxhash.xxh3_64_intdigest(r) >> 32], np.uint32), np.zeros(1, np.int64)
        known, where = np.unique(own, return_index=True)
        out.append(Anchors(own, places, known, places[where]))
        begin = end
    return out


def shown(anchors: Anchors) -> str:
    """Base64 of all anchors: 4 bytes of hash and 4 of the distance to the anchor before, each."""
    packed = np.empty((len(anchors.hashes), 2), "<u4")
    packed[:, 0] = anchors.hashes
    packed[:, 1] = np.diff(anchors.places, prepend=0)
    return base64.b64encode(packed.tobytes()).decode()


def read_shown(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte positions of a fingerprint's anchors."""
    packed = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return packed[:, 0], packed[:, 1].astype(np.int64).cumsum()


def likeness(a: Anchors, b: Anchors) -> float:
    if len(a.hashes) == len(b.hashes) and np.array_equal(a.hashes, b.hashes) and np.array_equal(a.places, b.places):
        return 1.0
    if not len(a.known) or not len(b.known):
        return 0.0
    _, in_a, in_b = np.intersect1d(a.known, b.known, assume_unique=True, return_indices=True)
    places = b.first[in_b][np.argsort(a.first[in_a], kind="stable")]
    together = len(a.known) + len(b.known) - len(places)
    if (np.diff(places) > 0).all():
        return len(places) / together
    tails: list[int] = []  # the longest chain of anchors in the same order in both
    for place in places.tolist():
        i = bisect_left(tails, place)
        tails[i:i + 1] = [place]
    return len(tails) / together


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, of the following text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def with_following(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows dealt to ranges of doc_id, each range with its predecessor's last rows as extras.

    The result has _range, _extra, doc_id, text; sorted inside partitions so that the row before
    a row is the one that follows it in descending doc_id. The extras of the first range are the
    last rows of all. A null id is smaller than any other; ties go by text. Only the borders of
    the ranges (one number a range) pass through the driver.
    """
    spark = docs.sparkSession
    n = ranges or 6 * shuffle_partitions(spark)
    quantiles = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    borders = np.unique(np.array(quantiles, np.float64)).astype(np.int64)

    def numbers(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int64)
        out[known] = np.searchsorted(borders, ids[known].astype("int64").to_numpy(), "left")
        return out

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(numbers(ids))

    # an id of null is below all others, so a range's last id is null only if all its ids are
    tops = sorted((r["r"], r["m"]) for r in docs.select("doc_id", range_of("doc_id").alias("r"))
                  .groupBy("r").agg(F.max("doc_id").alias("m")).collect())
    last = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}

    @F.pandas_udf("array<long>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        own = numbers(ids)
        values = [None if pd.isna(i) else int(i) for i in ids]
        return pd.Series([[int(r), last[i]] if i in last else [int(r)] for i, r in zip(values, own)])

    return (docs.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("_extra", "_range"))
            .repartition(min(n, shuffle_partitions(spark)), "_range")
            .sortWithinPartitions("_range", F.desc("_extra"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    ``edited`` is the edited text itself. One document alone is its own next document.
    """
    schema = ("doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    names = arrow.names

    def run(batches):
        before, before_print = "", fingerprints([""])[0]
        for part in slices(batches, 128):
            texts = [t or "" for t in part["text"]]
            following = [before, *texts[:-1]]
            prints = fingerprints(texts)
            own = [i for i, extra in enumerate(part["_extra"]) if not extra]
            changed = [edited(texts[i], following[i]) for i in own]
            out = {n: [] for n in names}
            for i, text, p in zip(own, changed, fingerprints(changed)):
                row = (part["doc_id"][i], len(texts[i]), text, shown(prints[i]), shown(p), likeness(prints[i], p),
                       likeness(prints[i], prints[i - 1] if i else before_print))
                for name, value in zip(names, row):
                    out[name].append(value)
            before, before_print = texts[-1], prints[-1]
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    rows = with_following(docs.select("doc_id", "text"))
    return rows.select("doc_id", "text", "_extra").mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")
