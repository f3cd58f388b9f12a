"""How far the sources of a language diverge in what words they use, and by which words.

Tasks count terms in Arrow alone: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode``
and hash ``group_by`` inside ``mapInArrow`` turn bounded slices of texts into partial counts by
(language, source, term), which Spark adds up. A language keeps the terms that enough of its
documents hold. They are stored as columnar shards, one row a term with the counts of all its
sources side by side, and each task takes one shard of a language's terms against all its
sources: it gives that shard's part of every pair's divergence and its own leading terms.

With ``p`` a term's smoothed share of a group in parts of 10 ** 9 and ``q`` another group's, a
term's divergence is floor((p - q) ** 2 / (p + q)); all of it is in whole numbers, exact while a
group has fewer than 9 * 10 ** 15 terms.

Edge cases: null text, language or source is ''; a group without terms, and a language without
kept terms, take part with counts of zero (divergence 0 if nothing is kept); repeated rows are
documents of their own; ties go by the item's UTF-8 bytes; a text of any length is counted whole
(a batch is cut by bytes, a text never); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gpsight.llm.common import byte_slices, materialize

MIN_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
# Fixed by the contract: what separates terms, once A-Z are lower case.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Bounds of memory only: counts held by a task, cells of a shard, sources a task compares from.
HELD_COUNTS, SHARD_CELLS, SOURCE_BLOCK = 400_000, 2_000_000, 128

KEYS = ["lang", "source", "term"]
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                     ("n", pa.int64()), ("docs", pa.int64())])


def count_slice(part: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term); a null term counts the documents."""
    lang, source, text = (pc.fill_null(part.column(c), "") for c in ("lang", "source", "text"))
    lists = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATORS)
    words = pa.table({"row": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
    words = words.filter(pc.not_equal(words["term"], ""))
    encoded = words["term"].combine_chunks().dictionary_encode()
    # one whole number for (row, term), so that the hash table has a single key
    key = pc.add(pc.shift_left(words["row"].cast(pa.int64()), 32), encoded.indices.cast(pa.int64()))
    in_doc = pa.table({"key": key}).group_by("key").aggregate([([], "count_all")])
    row = pc.shift_right(in_doc["key"], 32)
    code = pc.bit_wise_and(in_doc["key"], pa.scalar((1 << 32) - 1, pa.int64()))
    counts = pa.table({"lang": pc.take(lang, row).dictionary_encode(), "source": pc.take(source, row).dictionary_encode(),
                       "code": code, "n": in_doc["count_all"]})
    counts = counts.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    terms = pa.table([counts["lang"].cast(pa.string()), counts["source"].cast(pa.string()),
                      pc.take(encoded.dictionary, counts["code"]), counts["n_sum"], counts["count_all"]], schema=PARTIAL)
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([([], "count_all")])
    nothing = pa.nulls(groups.num_rows, pa.string())
    zero = pa.array(np.zeros(groups.num_rows, np.int64))
    return pa.concat_tables([terms, pa.table([groups["lang"], groups["source"], nothing, zero, groups["count_all"]],
                                             schema=PARTIAL)])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task; they leave it when they outgrow their bound, and at its end."""
    held = PARTIAL.empty_table()
    for part in byte_slices(batches, "text"):
        held = pa.concat_tables([held, count_slice(part)]).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
        held = held.rename_columns(PARTIAL.names).cast(PARTIAL)
        if held.num_rows > HELD_COUNTS:
            yield from held.to_batches()
            held = PARTIAL.empty_table()
    yield from held.to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs; the row of a null term holds the group's documents."""
    schema = "lang string, source string, term string, n long, docs long"
    partial = docs.select("lang", "source", "text").mapInArrow(count_batches, schema)
    return partial.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * counts / total) for 0 <= counts <= total, by three decimal steps."""
    whole, rest = np.divmod(counts, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    difference = p - q
    return difference * difference // (p + q)


OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                 ("value", pa.int64())])


def compare_shard(shard: pa.Table, groups: pa.Table, top_terms: int) -> pa.Table:
    """A shard's part of the divergence of each pair, and each source's leading terms in it.

    ``groups`` are all sources of the language; ``mine`` marks those this task compares from.
    """
    groups = groups.sort_by("source")
    names = groups["source"].combine_chunks()
    mine = np.flatnonzero(groups["mine"].to_numpy())
    kept, lang = groups["kept"][0].as_py(), groups["lang"][0].as_py()
    totals = groups["n"].to_numpy() + 2 * kept
    lang_total = np.int64(groups["lang_n"][0].as_py() + 2 * kept)
    pairs = np.zeros((len(mine), len(names)), np.int64)
    best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # source, value, term
    shard = shard.sort_by("term")
    step = max(1, SHARD_CELLS // max(1, len(names)))
    for at in range(0, shard.num_rows, step):
        some = shard.slice(at, step).combine_chunks()
        lists = some["counts"].combine_chunks()
        flat = pc.list_flatten(lists)
        held = np.zeros((some.num_rows, len(names)), np.int64)
        held[pc.list_parent_indices(lists).to_numpy(), pc.index_in(flat.field("source"), names).to_numpy()] = \
            flat.field("n").to_numpy()
        p = share(held + 2, totals)
        q = share(held.sum(axis=1) + 2, lang_total)
        for number, source in enumerate(mine):
            pairs[number] += divergence(p, p[:, source:source + 1]).sum(axis=0)
            more = np.flatnonzero((held[:, source] > 0) & (p[:, source] > q))
            value = divergence(p[more, source], q[more])
            first = np.argsort(-value, kind="stable")[:top_terms]  # rows are in the order of their bytes
            best.append((np.full(len(first), source), value[first], some["term"].take(pa.array(more[first]))))
    a = np.repeat(mine, len(names))
    b = np.tile(np.arange(len(names)), len(mine))
    other = a != b
    tables = [pa.table([pa.repeat(lang, int(other.sum())), names.take(pa.array(a[other])), pa.repeat("pair", int(other.sum())),
                        names.take(pa.array(b[other])), pa.array(pairs.ravel()[other])], schema=OUT)]
    for source, value, term in best:
        tables.append(pa.table([pa.repeat(lang, len(source)), names.take(pa.array(source)), pa.repeat("term", len(source)),
                                term, pa.array(value)], schema=OUT))
    return pa.concat_tables(tables)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of a group's language (``pair``)
    and its most overused terms against the language (``term``, the first ``top_terms``)."""
    counts = materialize(term_counts(docs), "term-counts")
    shards = materialize(
        counts.filter("term IS NOT NULL").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .filter(F.col("docs") >= min_docs), "term-shards")
    used = (shards.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source"))
            .agg(F.sum("c.n").alias("n")))
    sources = (counts.filter("term IS NULL").select("lang", "source").join(used, ["lang", "source"], "left")
               .fillna(0, ["n"]))
    per_lang = (sources.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("_sources"))
                .join(shards.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").fillna(0, ["kept"])
                .withColumn("_parts", F.ceil((F.col("kept") * F.col("_sources") + 1) / F.lit(SHARD_CELLS)).cast("int"))
                .withColumn("_blocks", F.ceil(F.col("_sources") / F.lit(SOURCE_BLOCK)).cast("int")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["lang", "shard", "block"]
    left = (shards.join(per_lang.select("lang", "_parts", "_blocks"), "lang")
            .select("lang", F.pmod(F.xxhash64("term"), F.col("_parts")).cast("int").alias("shard"), "term", "counts",
                    each("_blocks").alias("block")))
    right = (sources.join(per_lang, "lang").withColumn("shard", each("_parts")).withColumn("block", each("_blocks"))
             .withColumn("mine", F.pmod(F.xxhash64("source"), F.col("_blocks")) == F.col("block"))
             .select(*keys, "source", "n", "lang_n", "kept", "mine"))
    found = materialize(
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            lambda shard, groups: compare_shard(shard, groups, top_terms),
            "lang string, source string, part string, item string, value long"), "divergences")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = (found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
             .withColumn("rank", rank))
    terms = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
p AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 2)) // (total::HUGEINT + 2 * v) AS p
  FROM cells JOIN totals USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 2 * v) AS q
  FROM l JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 10
"""
