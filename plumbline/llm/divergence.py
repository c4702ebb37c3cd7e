"""How far the sources of each language diverge in their words, by DuckDB over shards of terms.

Tasks that read documents count words with SQL, one portion of texts after another: a row for each
(language, source, term) with its occurrences and documents.  The rows are dealt and sorted by a hash
of (language, term), so that a shard is a run of hashes; SQL adds the counts of a shard and keeps
its terms that enough documents have.  Spark sums what the shards kept into totals for each
language and source, and gives every shard the totals of its language.  A shard's SQL then gives
partial sums for each pair of sources and its most telling terms for each source; Spark adds the
sums and ranks.

A task holds one portion of texts or one shard, whatever the table's size: only a term's own rows
(one for each portion and source) must meet, and they are added up while they arrive.
"""

from __future__ import annotations

from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, portions, spark_schema, stored

#: A term is kept by a language if that many of its documents have it; what every count is raised by; ranks of terms that are told.
LEAST_DOCS, RAISED, RANKS = 30, 5, 50
#: Probabilities are whole numbers of this.
UNIT = 1_000_000_000


class Sizes(NamedTuple):
    """What a task holds at once; results are the same for all."""

    #: Bytes of texts that are counted together.
    text_bytes: int = 1 << 24
    #: Rows of a shard while terms are kept, and (about) while pairs are summed.
    shard_rows: int = 200_000
    pair_rows: int = 100_000
    #: Sources on the left of the pairs that one statement sums.
    sources_at_once: int = 256


#: ASCII letters in lower case, every byte of longer characters, and spaces for all else.
_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

COUNTED = arrow_schema(lang=pa.string(), source=pa.string(), term=pa.string(), n=pa.int64(), docs=pa.int64())
SUMMED = arrow_schema(hash=pa.int64(), lang=pa.string(), source=pa.string(), term=pa.string(), n=pa.int64(), docs=pa.int64())
KEPT = arrow_schema(hash=pa.int64(), lang=pa.string(), source=pa.string(), term=pa.string(), n=pa.int64(), first=pa.int64())
#: kind "pair": source, other, value over terms of the shard, n of those terms; kind "term": source, other is the term, value.
PARTIAL = arrow_schema(lang=pa.string(), kind=pa.string(), source=pa.string(), other=pa.string(), value=pa.int64(), n=pa.int64())


def _connection() -> duckdb.DuckDBPyConnection:
    """A database in memory, of one thread, that writes nothing to the machine's disk."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts with a space for each character that is in no term, letters in lower case: one pass over the bytes of all."""
    texts = pc.fill_null(texts, "")
    valid, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data else b"").translate(_WORDS))
    return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, data], offset=texts.offset)


def _count(sizes: Sizes):
    """Occurrences and documents of each (language, source, term), portion by portion."""

    def count(batches):
        db = _connection()
        for batch in portions(batches, most=sizes.text_bytes):
            texts = pa.concat_arrays([batch.column("text")])  # a portion's own bytes, not its batch's
            db.register("docs", pa.table({"doc": np.arange(batch.num_rows), "lang": batch.column("lang"), "source": batch.column("source"), "spaced": _spaced(texts)}))
            yield from _batches(db.sql(
                """SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM (
                     SELECT doc, lang, source, term, count(*) AS n
                     FROM (SELECT doc, lang, source, unnest(string_split(spaced, ' ')) AS term FROM docs) WHERE term <> '' GROUP BY ALL
                   ) GROUP BY lang, source, term"""
            ), COUNTED)
            db.unregister("docs")

    return count


def _batches(found: duckdb.DuckDBPyRelation, schema: pa.Schema) -> list[pa.RecordBatch]:
    return found.to_arrow_table().cast(schema).to_batches(max_chunksize=10_000)


def _keep(least: int, sizes: Sizes):
    """Rows sorted by hash to terms that at least so many documents have; sums as soon as a shard's rows are there."""

    def kept(batches):
        db, held, rows = _connection(), [], 0

        def added(last: bool):
            db.register("shard", pa.Table.from_batches(held))
            summed = db.sql("SELECT hash, lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM shard GROUP BY ALL").to_arrow_table().cast(SUMMED)
            open_hash = None if last else held[-1].column("hash")[-1].as_py()  # rows of this hash may follow
            whole = summed if last else summed.filter(pc.not_equal(summed.column("hash"), open_hash))
            db.register("summed", whole)
            enough = _batches(db.sql(
                f"""SELECT hash, lang, source, term, n, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS BIGINT) AS first
                    FROM (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS all_docs FROM summed) WHERE all_docs >= {int(least)}"""
            ), KEPT)
            rest = [] if last else summed.filter(pc.equal(summed.column("hash"), open_hash)).to_batches()
            return enough, rest

        for batch in batches:
            held.append(pa.RecordBatch.from_arrays([batch.column(c) for c in SUMMED.names], schema=SUMMED))
            rows += batch.num_rows
            if rows >= sizes.shard_rows:
                enough, held = added(False)
                rows = sum(b.num_rows for b in held)
                yield from enough
        if held:
            yield from added(True)[0]

    return kept


def _p(n: str, total: str, terms: str) -> str:
    """SQL of the raised probability of n among total."""
    return f"CAST(1 + (CAST({UNIT} AS HUGEINT) * ({n} + {RAISED})) // ({total} + {RAISED} * {terms}) AS BIGINT)"


def _compare(ranks: int, sizes: Sizes):
    """A shard's kept terms of one language, with that language's totals, to partial sums of pairs and the best terms of each source."""

    def compared(shard: pa.Table, totals: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return PARTIAL.empty_table()
        db = _connection()
        db.register("shard", shard)
        db.register("given", totals)
        db.execute("CREATE TABLE sources AS SELECT row_number() OVER (ORDER BY source) AS k, source, lang, n AS total, lang_n, terms FROM given")
        db.execute("CREATE TABLE terms AS SELECT row_number() OVER () AS t, term, CAST(sum(n) AS BIGINT) AS n FROM shard GROUP BY term")
        # Every term with every source: p, the count raised also where it is nought.
        db.execute(
            f"""CREATE TABLE grid AS SELECT t, k, coalesce(shard.n, 0) AS n, {_p("coalesce(shard.n, 0)", "sources.total", "terms")} AS p
                FROM terms JOIN sources ON true LEFT JOIN shard ON shard.term = terms.term AND shard.source = sources.source"""
        )
        found = [db.sql(
            f"""SELECT lang, 'term' AS kind, source, term AS other, value, CAST(1 AS BIGINT) AS n FROM (
                  SELECT lang, source, term, p - q AS value, row_number() OVER (PARTITION BY source ORDER BY p - q DESC, term COLLATE C) AS rank FROM (
                    SELECT lang, source, term, p, {_p("terms.n", "lang_n", "sources.terms")} AS q FROM grid JOIN terms USING (t) JOIN sources USING (k) WHERE grid.n > 0
                  ) WHERE p > q) WHERE rank <= {int(ranks)}"""
        ).to_arrow_table().cast(PARTIAL)]
        for k in range(1, totals.num_rows + 1, sizes.sources_at_once):
            found.append(db.sql(
                f"""SELECT a.lang, 'pair' AS kind, a.source, b.source AS other, value, s.n FROM (
                      SELECT x.k AS ak, y.k AS bk, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value, count(*) AS n
                      FROM grid AS x JOIN grid AS y ON x.t = y.t AND x.k < y.k WHERE x.k >= {k} AND x.k < {k + sizes.sources_at_once} GROUP BY ALL
                    ) AS s JOIN sources AS a ON a.k = ak JOIN sources AS b ON b.k = bk"""
            ).to_arrow_table().cast(PARTIAL))
        db.close()
        return pa.concat_tables(found)

    return compared


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, source, part, item, value and rank: each source's distance to the others, and its terms above the language's own use.

    Part "pair" has a row for every other source of the language, part "term" the first `ranks`
    terms that the source has and uses more than its language.

    Defined results: null text, lang and source are empty strings; a row is a document, repeated or
    not; sources without terms count as such; a language that keeps no term gives pairs of value 0;
    further columns are ignored; an empty table gives no row.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    counted = docs.mapInArrow(_count(sizes), spark_schema(COUNTED)).withColumn("hash", F.xxhash64("lang", "term"))
    shards = counted.repartition("hash").sortWithinPartitions("hash")
    kept = stored(shards.mapInArrow(_keep(least_docs, sizes), spark_schema(KEPT)), "divergence-kept")

    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    own = Window.partitionBy("lang")  # a row for each source
    totals = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "first"])
    totals = stored(totals.select("lang", "source", "n", F.sum("n").over(own).alias("lang_n"), F.sum("first").over(own).alias("terms")), "divergence-totals")

    shard_count = max(1, -(-kept.count() // sizes.pair_rows))
    shard = F.pmod("hash", F.lit(shard_count)).alias("shard")
    each = totals.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shard_count - 1).cast("long"))))
    terms = kept.select(shard, "lang", "source", "term", "n").groupBy("shard", "lang")
    partial = stored(terms.cogroup(each.groupBy("shard", "lang")).applyInArrow(_compare(ranks, sizes), spark_schema(PARTIAL)), "divergence-partial")

    # Every kept term is in one shard, with all sources, so the sums over shards are whole.
    summed = partial.where("kind = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    half = totals.alias("a").join(totals.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    half = half.select("a.lang", "a.source", F.col("b.source").alias("other")).join(summed, ["lang", "source", "other"], "left").na.fill(0, ["value"])
    pairs = half.unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    rows = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    rows = rows.unionByName(partial.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), F.col("other").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
