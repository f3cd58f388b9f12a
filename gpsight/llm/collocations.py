"""Phrases that stick together, mined per language from suffixes of the word sequences.

A suffix starts at a word and is looked at for ``MAX_WORDS`` words, within its piece. Tasks count
equal suffixes of a bounded slice of texts first, then all suffixes are routed by their leading
word. A word that makes up a thousandth of all occurrences (at most a thousand such words can
exist) is routed by two words, and by three where the second is as common, so that no partition
holds more than a small part of the suffixes. A partition then sorts its suffix pointers by a
multikey three-way quicksort, all parts of a round at once: the part equal to the pivot goes on
one word deeper and its size is a phrase's count; parts that can't hold a frequent phrase any
more are abandoned. Counts of phrases of two hot words arrive from several partitions and are
added up. Scores are exact decimals.

Edge cases: null texts are empty, a null language is 'und'; pieces and texts without words give
nothing; phrases never cross pieces or documents; repeated rows count as often as they stand
there; ties of a cut go to the shorter first part, ties of the ranking to the smaller phrase; a
text of any length is read whole (slices are cut between texts); an empty table, or one without
frequent phrases, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gpsight.llm.common import byte_slices, materialize, shuffle_partitions

MIN_COUNT, TOP, MAX_WORDS = 10, 2000, 3
# A word with this share of all occurrences is routed together with the words after it.
HOT_SHARE = 1000
# Bounds of memory only: text a task counts at once, text whose suffixes one partition sorts.
SLICE, PARTITION = 12 << 20, 8 << 20
# Fixed by the contract: A-Z are folded, these end a piece, a tab separates words as a blank does.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def words_by_language(part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """Language, word codes (the dictionary's length for a piece's end) and words, for each language."""
    lang = pc.fill_null(part.column("lang"), "und").dictionary_encode()
    order = np.argsort(lang.indices.to_numpy(), kind="stable")
    bounds = np.searchsorted(lang.indices.to_numpy()[order], np.arange(len(lang.dictionary) + 1))
    text = pc.fill_null(part.column("text"), "")
    for code, name in enumerate(lang.dictionary.to_pylist()):
        some = text.take(pa.array(order[bounds[code]:bounds[code + 1]]))
        raw = b"\n".join(some.cast(pa.binary()).to_pylist()).translate(FOLD).replace(b"\n", b" \n ") + b" \n"
        tokens = pc.list_flatten(pc.split_pattern(pa.array([raw], pa.large_binary()).cast(pa.large_string()), " "))
        tokens = tokens.filter(pc.not_equal(tokens, "")).dictionary_encode()
        ends = pc.index(tokens.dictionary, pa.scalar("\n", pa.large_string())).as_py()
        codes = tokens.indices.to_numpy().astype(np.int64)
        last = len(tokens.dictionary) - 1  # the end's code becomes the last one
        codes = np.where(codes == ends, last, codes - (codes > ends))
        words = pa.concat_arrays([tokens.dictionary.slice(0, ends), tokens.dictionary.slice(ends + 1)])
        yield name, codes, words.cast(pa.string())


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, "text", SLICE):
        for lang, codes, words in words_by_language(part):
            n = np.bincount(codes, minlength=len(words) + 1)[:len(words)]
            yield pa.record_batch({"lang": pa.repeat(lang, len(words)), "word": words, "n": pa.array(n)})


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n."""
    partial = docs.select("lang", "text").mapInArrow(count_words, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def equal_triples(codes: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes of two words or more as three sorted code columns, and their counts.

    A third code of ``ends`` stands for none.
    """
    codes = np.concatenate([codes, [ends, ends]])
    at = np.flatnonzero((codes[:-2] != ends) & (codes[1:-1] != ends))
    base = ends + 1
    pair = codes[at] * base + codes[at + 1]
    if base < 2_000_000:  # three codes fit one number
        key, shown = pair, lambda lead: lead
    else:
        held, key = np.unique(pair, return_inverse=True)
        shown = held.__getitem__
    key = np.sort(key * base + codes[at + 2])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    n = np.diff(np.append(first, len(key)))
    lead, third = np.divmod(key[first], base)
    return *np.divmod(shown(lead), base), third, n


def route_suffixes(batches: Iterator[pa.RecordBatch], hot: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """One row for all counted suffixes of a slice with the same leading word (or words, if hot).

    ``rest`` lists them as second word, third word and count.
    """
    for part in byte_slices(batches, "text", SLICE):
        for lang, codes, words in words_by_language(part):
            first, second, third, n = equal_triples(codes, len(words))
            if not len(first):
                continue
            common = np.append(pc.is_in(words, hot[lang]).to_numpy(zero_copy_only=False) if lang in hot
                               else np.zeros(len(words), bool), False)
            two, three = common[first], common[first] & common[second]
            changes = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
            same_lead = changes(first)
            starts = np.flatnonzero(same_lead | (two & changes(second)) | (three & changes(third)))
            shown = pa.concat_arrays([words, pa.array([""])])
            entries = pc.binary_join_element_wise(
                shown.take(pa.array(second)), shown.take(pa.array(third)), pa.array(n).cast(pa.string()), "\t")
            # lists of some rows at a time, so that offsets stay small
            for at in range(0, len(starts), 20_000):
                begin = starts[at:at + 20_000]
                end = starts[at + 20_000] if at + 20_000 < len(starts) else len(first)
                offsets = pa.array(np.append(begin, end) - begin[0], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, entries.slice(begin[0], end - begin[0]))
                lead = lambda code, used: pc.if_else(
                    pa.array(used[begin]), shown.take(pa.array(code[begin])), pa.scalar(None, pa.string()))
                yield pa.record_batch({
                    "lang": pa.repeat(lang, len(begin)), "first": shown.take(pa.array(first[begin])),
                    "second": lead(second, two), "third": lead(third, three), "rest": pc.binary_join(lists, " ")})


def frequent_parts(words: list[np.ndarray], weights: np.ndarray, least: np.ndarray | int,
                   ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of suffix pointers, for all parts of a round at once.

    ``words[d][i]`` is the code of suffix ``i``'s word at depth ``d``, negative if it has ended.
    Parts whose ``least`` (a bound on what a phrase in them can count) stays under ``MIN_COUNT``
    are abandoned. Gives depth, one pointer and the total weight of each part whose suffixes share
    ``depth`` words.
    """
    bound = np.broadcast_to(least, weights.shape)
    pointers = np.arange(len(weights))
    starts, depths = np.array([0]), np.array([0])  # of the parts
    while len(pointers):
        sizes = np.diff(np.append(starts, len(pointers)))
        alive = np.add.reduceat(bound[pointers], starts) >= MIN_COUNT
        if not alive.all():
            pointers = pointers[np.repeat(alive, sizes)]
            sizes, depths = sizes[alive], depths[alive]
            if not len(pointers):
                return
            starts = np.cumsum(sizes) - sizes
        depth = np.repeat(depths, sizes)
        word = words[0][pointers]
        for d in range(1, len(words)):
            deeper = depth == d
            if deeper.any():
                word[deeper] = words[d][pointers[deeper]]
        against = word - np.repeat(word[starts + sizes // 2], sizes)
        less, more = against < 0, against > 0
        # a stable three-way partition inside every part, by counting
        n_less, n_more = (np.add.reduceat(x.astype(np.int64), starts) for x in (less, more))
        n_same = sizes - n_less - n_more
        place = np.empty(len(pointers), np.int64)
        for chosen, ahead in ((less, 0), (~(less | more), n_less), (more, n_less + n_same)):
            rank = np.cumsum(chosen)
            before = rank[starts] - chosen[starts]
            place[chosen] = (rank - 1 + np.repeat(starts + ahead - before, sizes))[chosen]
        moved = np.empty_like(pointers)
        moved[place] = pointers
        pointers = moved
        starts = np.stack([starts, starts + n_less, starts + n_less + n_same], axis=1).ravel()
        sizes = np.stack([n_less, n_same, n_more], axis=1).ravel()
        depths = np.stack([depths, depths + 1, depths], axis=1).ravel()
        held = sizes > 0
        same = (np.arange(len(sizes)) % 3 == 1)[held]
        starts, sizes, depths = starts[held], sizes[held], depths[held]
        total = np.add.reduceat(weights[pointers], starts)
        ended = np.zeros(len(starts), bool)
        for d in range(1, len(words) + 1):
            those = np.flatnonzero(same & (depths == d))
            if len(those):
                ended[those] = words[d - 1][pointers[starts[those]]] < 0
                those = those[~ended[those]]
                yield d, pointers[starts[those]], total[those]
        go_on = ~ended & (depths < len(words))
        pointers = pointers[np.repeat(go_on, sizes)]
        sizes, depths = sizes[go_on], depths[go_on]
        starts = np.cumsum(sizes) - sizes


def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of two and three words in a partition of routed suffixes."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    lists = pc.split_pattern(table["rest"].combine_chunks(), " ")
    row = pc.list_parent_indices(lists).to_numpy()
    fields = pc.list_flatten(pc.split_pattern(pc.list_flatten(lists), "\t"))
    at = np.arange(len(row)) * 3
    second, third = (fields.take(pa.array(at + k)).dictionary_encode() for k in (0, 1))
    n = fields.take(pa.array(at + 2)).cast(pa.int64()).to_numpy()
    langs, firsts = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "first"))
    lead = langs.indices.to_numpy().astype(np.int64) * len(firsts.dictionary) + firsts.indices.to_numpy()
    none = pc.index(third.dictionary, "").as_py()
    last = third.indices.to_numpy().astype(np.int64)
    words = [lead[row], second.indices.to_numpy().astype(np.int64), np.where(last == none, -1, last)]
    # suffixes of two hot words: their pair is counted in other partitions too
    split = table["third"].is_valid().to_numpy()[row]
    out: dict[str, list] = {"lang": [], "w1": [], "w2": [], "w3": [], "n": []}
    for depth, at, count in frequent_parts(words, n, np.where(split, np.maximum(n, MIN_COUNT), n)):
        keep = (count >= MIN_COUNT) | (split[at] if depth == 2 else False)
        if depth == 1 or not keep.any():
            continue
        at = pa.array(at[keep])
        out["lang"].append(table["lang"].take(pa.array(row).take(at)).combine_chunks())
        out["w1"].append(table["first"].take(pa.array(row).take(at)).combine_chunks())
        out["w2"].append(second.take(at).cast(pa.string()))
        out["w3"].append(third.take(at).cast(pa.string()) if depth == 3 else pa.nulls(len(at), pa.string()))
        out["n"].append(pa.array(count[keep]))
    if out["n"]:
        yield pa.record_batch({name: pa.concat_arrays(arrays) for name, arrays in out.items()})


def frequent_phrases(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, w1, w2, w3 (null for two words), a: every phrase of two or three words that is frequent."""
    spark = docs.sparkSession
    texts = docs.select("lang", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(shuffle_partitions(spark), -(-size // PARTITION))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most HOT_SHARE rows by its definition
    common: dict[str, list[str]] = {}
    for r in counts.filter(F.col("n") * HOT_SHARE >= total).select("lang", "word").collect():
        common.setdefault(r["lang"], []).append(r["word"])
    sets = {lang: pa.array(words, pa.string()) for lang, words in common.items()}
    routed = texts.mapInArrow(lambda batches: route_suffixes(batches, sets),
                              "lang string, first string, second string, third string, rest string")
    found = (routed.repartition(partitions, "lang", "first", "second", "third")
             .mapInArrow(sort_suffixes, "lang string, w1 string, w2 string, w3 string, n long"))
    return found.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("a")).filter(F.col("a") >= MIN_COUNT)


def scored(a: str, left: str, right: str) -> Column:
    """floor(10 ** 6 * a * a / (left * right)), exactly, for counts below 10 ** 15."""
    wide = lambda c: f"cast({c} AS decimal(15, 0))"
    return F.expr(f"cast((cast(1000000 AS decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)}) AS bigint)")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    counts = materialize(word_counts(docs), "word-counts")
    phrases = materialize(frequent_phrases(docs, counts), "phrases")
    word = counts.filter(F.col("n") >= MIN_COUNT)
    one = lambda key, name: word.select("lang", F.col("word").alias(key), F.col("n").alias(name))
    pairs = phrases.filter("w3 IS NULL")
    pair = lambda x, y, name: pairs.select(
        "lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))
    triples = phrases.filter("w3 IS NOT NULL")
    inside = (triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a"))
              .groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer")))
    twos = (pairs.join(inside, ["lang", "w1", "w2"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
            .join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
            .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", scored("a", "l", "r").alias("score")))
    cuts = (triples.join(one("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
            .join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
            .withColumn("s1", scored("a", "l1", "r1")).withColumn("s2", scored("a", "l2", "r2")))
    least = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    threes = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", least("l1", "l2").alias("l"),
                         least("r1", "r2").alias("r"), least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = twos.union(threes).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS words FROM d)),
w AS (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM p),
s AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
one AS (SELECT lang, w1, count(*) AS f FROM s GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, 1 AS k, two.f AS a, x.f AS l, y.f AS r
  FROM two JOIN one x ON x.lang = two.lang AND x.w1 = two.w1 JOIN one y ON y.lang = two.lang AND y.w1 = two.w2
  LEFT JOIN longer g ON g.lang = two.lang AND g.w1 = two.w1 AND g.w2 = two.w2
  WHERE g.f IS NULL OR 100 * g.f < 50 * two.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
s2 AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
best AS (
  SELECT lang, phrase, a, l, r, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s2) WHERE cut = 1),
total AS (SELECT lang, sum(f) AS n FROM one GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN total USING (lang)
WHERE rank <= 2000
"""
