"""Source divergence audit: how far the term prices of a language's sources lie apart.

For each language, terms in enough of its documents are kept and every (lang, source) group gives
each kept term a price that depends on its count there alone. The distance of two groups sums over
all kept terms, so all that matters of a pair is its joint table: how many terms have count c in
one and d in the other. Indicator columns for (group, count level), one row a term, multiplied by
their transpose give every joint table at once; the product is taken in exact blocks of terms and
of sources, each block is priced where it was made, and only the priced sums are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.shared import slices, store, words

LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
TILE_TERMS = 2048        # terms of a block, on average
BLOCK_SOURCES = 24       # sources of a block, on average
COLUMNS = 1024           # indicator columns of one product, about
COUNT_BYTES = 4 << 20    # text bytes counted at once

#: ASCII other than letters becomes a blank, A-Z its lower case; bytes of other characters stay.
FOLD = np.array([b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def folded(column: pa.Array) -> pa.Array:
    """The texts with blanks for all that parts terms (same byte lengths, so the offsets stay)."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    raw = FOLD[np.frombuffer(data, np.uint8)] if data is not None else np.empty(0, np.uint8)
    return pa.Array.from_buffers(column.type, len(column), [None, offsets, pa.py_buffer(raw)], offset=column.offset)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    def counted(batches):
        for batch in batches:
            batch = pa.record_batch([pc.fill_null(batch.column("lang"), ""), pc.fill_null(batch.column("source"), ""),
                                     folded(batch.column("text"))], names=["lang", "source", "text"])
            for part in slices(batch, limit=COUNT_BYTES):
                codes, bounds, distinct = words(part.column("text"), lower=False)
                if not len(codes):
                    continue
                lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                row = np.repeat(np.arange(len(group)), np.diff(bounds))
                size = len(distinct)
                of_doc, n = np.unique(row * size + codes, return_counts=True)
                key, at, docs_with = np.unique(group[of_doc // size] * size + of_doc % size, return_inverse=True, return_counts=True)
                total = np.bincount(at, n, len(key)).astype(np.int64)
                where = key // size
                yield pa.record_batch([lang.dictionary.take(pa.array(where // len(source.dictionary))),
                                       source.dictionary.take(pa.array(where % len(source.dictionary))),
                                       distinct.take(pa.array(key % size)), pa.array(total), pa.array(docs_with.astype(np.int64))],
                                      names=["lang", "source", "term", "n", "docs"])

    own = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    rows = own.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Counts of the kept terms: (lang, source, term, n, all_n, first), all_n the language's count and
    ``first`` true in one row of each (lang, term)."""
    of_term = Window.partitionBy("lang", "term")
    return (term_counts(docs)
            .select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("all_n"),
                    (F.col("source") == F.min("source").over(of_term)).alias("first"))
            .where(F.col("docs") >= least).drop("docs"))


def price(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact; 0 where there are no terms."""
    whole = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTH} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({whole}) DIV CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20,0)) ELSE 0L END")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each occurring (lang, source): group_n, lang_n, v (kept terms) and sources of the lang."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count_if("first").alias("firsts"))
    groups = every.join(own, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.sum("group_n").alias("lang_n"), F.sum("firsts").alias("v"), F.count("*").alias("sources"))
    filled = {"group_n": 0, "lang_n": 0, "v": 0}
    return groups.drop("firsts").join(langs, "lang").na.fill(filled)


def joint_prices(source: np.ndarray, names: list[str], side: np.ndarray, term: np.ndarray,
                 n: np.ndarray, p: np.ndarray, same: bool) -> list[tuple[str, str, int]]:
    """Priced joint tables of one block: (source, source, sum over the block's terms of |p - q|).

    Rows with term -1 give a source's price of count 0. ``side`` tells a source of the first block (0)
    from one of the second (1); ``same`` says that the blocks are one.
    """
    levels = np.unique(n, return_inverse=True)[1]
    width = int(levels.max()) + 1
    columns, at, column = np.unique(source * width + levels, return_index=True, return_inverse=True)
    priced, owner = p[at], columns // width
    zero = np.empty(len(names), np.int64)
    none = term < 0
    zero[source[none]] = column[none]
    n_terms = int(term.max()) + 1
    level = np.repeat(zero[None, :], n_terms, axis=0)
    level[term[~none], source[~none]] = column[~none]
    per_source = np.bincount(owner, minlength=len(names))
    step = max(n_terms, 1)
    while step > 32 and np.minimum(per_source, step).sum() > COLUMNS:
        step = -(-step // 2)
    total = np.zeros((len(names), len(names)), np.int64)
    for start in range(0, n_terms, step):
        part = level[start:start + step]
        used, index = np.unique(part, return_inverse=True)
        hot = np.zeros((len(part), len(used)), np.float32)
        hot[np.arange(len(part))[:, None], index.reshape(part.shape)] = 1
        of, cost = owner[used], priced[used]
        rows, cols = np.flatnonzero(side[of] == 0), np.arange(len(used)) if same else np.flatnonzero(side[of] == 1)
        joint = (hot[:, rows].T @ hot[:, cols]).astype(np.int64)        # exact: counts below 2**24
        joint *= np.abs(cost[rows][:, None] - cost[cols][None, :])
        a, b = np.unique(of[rows], return_index=True), np.unique(of[cols], return_index=True)
        total[np.ix_(a[0], b[0])] += np.add.reduceat(np.add.reduceat(joint, a[1], axis=0), b[1], axis=1)
    out = []
    for i in np.flatnonzero(side == 0).tolist():
        for j in (range(len(names)) if same else np.flatnonzero(side == 1).tolist()):
            if not same or names[i] < names[j]:
                out.append((names[i], names[j], int(total[i, j])))
    return out


def pair_values(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    Terms of a language are dealt into tiles of terms of like frequency (few levels where many terms
    are), its sources into blocks by hash. Each (tile, block, block) is one product in one task, bounded
    by its terms and sources whatever the data; every language has an empty tile too, so that
    sources without terms meet as well.
    """
    band = F.floor(F.log2("all_n")).cast("int")
    sizes = (priced.where("first").groupBy("lang", band.alias("band")).agg(F.count("*").alias("n"))
             .select("lang", "band", F.ceil(F.col("n") / TILE_TERMS).cast("int").alias("shards")))
    sourced = groups.withColumn("blocks", F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    rows = (priced.withColumn("band", band).join(sizes, ["lang", "band"])
            .select("lang", "band", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n", "p",
                    F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("blocks")).withColumn("block", block))
    tiles = (sizes.select("lang", "band", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
             .unionByName(groups.select("lang", F.lit(-1).alias("band"), F.lit(0).alias("shard")).distinct()))
    zeros = (sourced.join(tiles, "lang")
             .select("lang", "band", "shard", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"),
                     price("0", "group_n", "v").alias("p"), "blocks", block))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                      lambda x: F.struct(F.least(x, F.col("block")).alias("a"), F.greatest(x, F.col("block")).alias("b")))
    dealt = rows.unionByName(zeros).withColumn("pair", F.explode(met))

    def products(key, table):
        lang, _, _, a, b = [k.as_py() for k in key]
        source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
        codes = source.indices.to_numpy().astype(np.int64)
        side = np.zeros(len(source.dictionary), np.int64)
        side[codes] = table.column("block").to_numpy() != a
        found = joint_prices(codes, source.dictionary.to_pylist(), side, pc.fill_null(term.indices, -1).to_numpy().astype(np.int64),
                             table.column("n").to_numpy(), table.column("p").to_numpy(), a == b)
        columns = [[lang] * len(found), *([x[i] for x in found] for i in range(3))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()], strict=True)], names=["lang", "source", "item", "value"])

    made = (dealt.select("lang", "band", "shard", "pair.a", "pair.b", "source", "block", "term", "n", "p")
            .groupBy("lang", "band", "shard", "a", "b").applyInArrow(products, "lang string, source string, item string, value long"))
    once = made.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return once.select("lang", "value", F.explode(both).alias("x")).select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` gives each other source of the language
    with the distance to it, part ``term`` the ``top`` terms priced higher than in the language.

    Null text, lang and source count as ''. An empty text has no terms; its group occurs all the
    same, with value 0 to every other source of a language without kept terms. Repeated rows count
    as often as they occur. Equal values rank by item in UTF-8 order. A language of one source has
    no pairs; an empty table gives no rows. Texts are counted whole, whatever their length. Only
    the columns text, lang and source are read, so others may have any name.
    """
    kept = store(kept_counts(docs, least), "kept-terms")
    groups = store(group_table(docs, kept), "term-groups")
    priced = (kept.join(groups, ["lang", "source"])
              .select("lang", "source", "term", "n", "all_n", "first", "sources", price("n", "group_n", "v").alias("p"),
                      price("all_n", "lang_n", "v").alias("q")))
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = pair_values(priced, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    parts = [pairs.select("*", ranked), terms.select("*", ranked).where(F.col("rank") <= top)]
    return reduce(DataFrame.unionByName, parts)


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source,
             translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(x.n, 0)::HUGEINT AS n
      FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x
        ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT c.*, 1 + 1000000000::HUGEINT * (c.n + 5) // (sum(c.n) OVER (PARTITION BY c.lang, c.source)::HUGEINT + 5 * l.v) AS p,
             1 + 1000000000::HUGEINT * (c.all_n + 5) // (l.total + 5 * l.v) AS q
      FROM c JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                           WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
