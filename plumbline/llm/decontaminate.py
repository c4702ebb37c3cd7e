"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words at its ones are hashed together, those at
its zeros are ignored, so a test passage with words replaced still shares seeds with its source.
Every position of every benchmark item and of every document is hashed under each mask; an item
shorter than every mask is hashed whole, and documents at that length too.  A Bloom filter over
the benchmark's hashes thins the documents' hashes where they lie; a text's distinct hashes that pass
are equality-joined with the distinct hashes of each item.  A text and an item that meet are read
once, whole text against whole item: every diagonal that a shared seed names is followed word by
word, and counts as an overlap if its best stretch (a point for an equal word, two less for
another) has enough equal words.

Texts are told apart by their hash and read once however often they are repeated.  What meets
is (text, item), not places, so a word repeated in both adds no row.  The filter grows with the
benchmark up to a fixed size; beyond that more hashes pass it, and the join sorts them out.

Defined results: null or empty texts and items have no words and match nothing; items with fewer
than `least` words must be found whole; a null item_id is an item of its own name; repeated rows
give repeated findings with one key; further columns are kept by `clean` and ignored elsewhere.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bloom, passes, portions, record_batches, spark_schema, stored

#: Masks of six words each: any stretch of 13 words with a replaced word in it keeps a seed.
MASKS = ("11101011", "1101100101", "110010100101")
#: Masks that take items shorter than any of these whole, one for each length, follow them.
PATTERNS = (*MASKS, *("1" * n for n in range(1, min(map(len, MASKS)))))
#: Equal words that an overlap needs.
LEAST = 10
#: Characters whose words are hashed at once, and texts that a task remembers.
BLOCK = 1 << 18
#: Bytes of texts (or one longer text) whose words are hashed in one row, and the places of it that a mask is laid on at once.
TEXT_BYTES, WORDS = 1 << 20, 1 << 14
#: Places of the items that a text is read with in each round, of those it shares most seeds with.
ROUNDS = ((0, 1), (1, 8), (8, None))
#: Pairs of places beyond which a pair's diagonals are found by shifted bit sets.
MANY = 1 << 20

_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\W")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F], dtype=np.uint64)
_MEMO_ENTRIES = 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < _MEMO_ENTRIES:
            self[word] = value
        return value


_HASHES = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: runs of letters, digits and underscores, case apart."""
    low, at, parts = (text or "").lower(), 0, []
    while at < len(low):
        gap = _GAP.search(low, at + BLOCK)
        end = gap.start() if gap else len(low)
        words = _WORD.findall(low, at, end)
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under a mask at each position where it fits."""
    places = [k for k, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for place, factor in zip(places, _ODD[: len(places)], strict=True):
        out ^= words[place : place + n]
        out *= factor
        out ^= out >> np.uint64(29)
    return out


def patterns_of(n: int) -> list[int]:
    """The patterns under which an item of n words is hashed."""
    return [k for k, mask in enumerate(PATTERNS) if (len(mask) <= n if k < len(MASKS) else len(mask) == n)]


SEEDS = arrow_schema(item=pa.int64(), pattern=pa.int32(), hash=pa.int64())


def text_hash(text: Column) -> Column:
    """The hash of null differs from that of every text."""
    return F.xxhash64(text, text.isNull())


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(item, item_text) to the distinct (item, pattern, hash)."""

    def run(batches):
        for batch in portions(batches, "item_text"):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
                words = word_hashes(text)
                for k in patterns_of(len(words)):
                    found = np.unique(seed_hashes(words, PATTERNS[k])).view(np.int64)
                    columns = [np.full(len(found), item), np.full(len(found), k, np.int32), found]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=SEEDS)

    return items.select("item", "item_text").mapInArrow(run, spark_schema(SEEDS))


HITS = arrow_schema(text_hash=pa.int64(), text=pa.string(), hits=pa.list_(pa.struct({"pattern": pa.int32(), "hash": pa.int64()})))


def found_seeds(texts: list[str | None], packed: np.ndarray, used: list[int]) -> dict[int, list[dict]]:
    """The distinct hashes of each text, by its place, that pass the filter; texts without any are left out.

    The words of all texts are hashed in one row; a mask that reaches beyond its text's last word counts for nothing.
    """
    parts = [word_hashes(text) for text in texts]
    words, edges = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    found: dict[int, list[dict]] = {}
    for k in used:
        width = len(PATTERNS[k])
        for at in range(0, len(words), WORDS):
            seeds = seed_hashes(words[at : at + WORDS + width - 1], PATTERNS[k])
            some = np.flatnonzero(passes(packed, seeds))
            of = np.searchsorted(edges, at + some, side="right") - 1
            inside = at + some + width <= edges[of + 1]
            some, of = some[inside], of[inside]
            for text, h in zip(of.tolist(), seeds[some].view(np.int64).tolist(), strict=True):
                found.setdefault(text, []).append((k, h))
    return {text: [{"pattern": k, "hash": h} for k, h in sorted(set(held))] for text, held in sorted(found.items())}


def hits(texts: DataFrame, packed: np.ndarray, used: list[int]) -> DataFrame:
    """(text_hash, text) to the texts that have hashes under the used patterns that pass the filter, once a text and task, with those hashes."""
    broadcast = texts.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        bits, seen = broadcast.value, set()

        def rows():
            for batch in portions(batches, most=TEXT_BYTES):
                names, said = batch.column("text_hash").to_pylist(), batch.column("text").to_pylist()
                new = [k for k, name in enumerate(names) if name not in seen]
                for k, found in found_seeds([said[k] for k in new], bits, used).items() if new else ():
                    if names[new[k]] in seen:
                        continue
                    if len(seen) < BLOCK:
                        seen.add(names[new[k]])
                    yield names[new[k]], said[new[k]], found

        yield from record_batches(rows(), HITS, 256)

    return texts.select("text_hash", "text").mapInArrow(run, spark_schema(HITS))


def best_stretch(equal: np.ndarray) -> int:
    """Equal words of the stretch with the greatest sum of one a match and two less a mismatch."""
    score = np.cumsum(np.where(equal, 1, -2))
    low = np.minimum.accumulate(np.concatenate([[0], score[:-1]]))
    end = int(np.argmax(score - low))
    start = int(np.argmin(np.concatenate([[0], score[: end + 1]])[: end + 1]))
    return int(equal[start : end + 1].sum())


def diagonals(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The distinct shifts (place in the text less place in the item) of all seeds that both hold."""
    found = []
    for k in patterns_of(len(item)):
        a, b = seed_hashes(words, PATTERNS[k]), seed_hashes(item, PATTERNS[k])
        order = np.argsort(b, kind="stable")
        low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
        counts = high - low
        if counts.sum() <= MANY:
            at = np.flatnonzero(counts)
            starts = np.repeat(low[at] - np.concatenate([[0], np.cumsum(counts[at])[:-1]]), counts[at])
            found.append(np.repeat(at, counts[at]) - order[starts + np.arange(starts.size)])
        else:
            found.append(_shifted(a, b))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _shifted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for words repeated so often that pairs of places are too many: a's places as a bit set, shifted for each of b's."""
    out = 0
    for h in np.intersect1d(a, b):
        places = int.from_bytes(np.packbits(a == h, bitorder="little").tobytes(), "little")
        for place in np.flatnonzero(b == h).tolist():
            out |= places << (len(b) - place)
    held = np.unpackbits(np.frombuffer(out.to_bytes((out.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")
    return np.flatnonzero(held) - len(b)


def overlap(words: np.ndarray, item: np.ndarray) -> int:
    """Equal words of the best stretch on any diagonal with a seed; the whole item ends the search."""
    best = 0
    for shift in diagonals(words, item).tolist():
        a, b = max(0, -shift), min(len(item), len(words) - shift)
        best = max(best, best_stretch(item[a:b] == words[a + shift : b + shift]))
        if best == len(item):
            break
    return best


VERIFIED = arrow_schema(text_hash=pa.int64(), item=pa.int64(), n_equal=pa.int32(), item_words=pa.int32())


def _verified(pairs: DataFrame, least: int) -> DataFrame:
    """(text_hash, text, item, item_text) in order of texts to their overlaps."""

    def run(batches):
        def rows():
            last, words = None, None
            for batch in portions(batches):
                columns = (batch.column(n).to_pylist() for n in ("text_hash", "text", "item", "item_text"))
                for name, text, item, item_text in zip(*columns, strict=True):
                    if name != last:
                        last, words = name, word_hashes(text)
                    wanted = word_hashes(item_text)
                    n = overlap(words, wanted)
                    if n >= min(least, len(wanted)):
                        yield name, item, n, len(wanted)

        yield from record_batches(rows(), VERIFIED)

    return pairs.select("text_hash", "text", "item", "item_text").sortWithinPartitions("text_hash").mapInArrow(run, spark_schema(VERIFIED))


def meetings(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text_hash, item, shared): texts and items that share seeds, and how many; (text_hash, text) of those texts; the items."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_text IS NOT NULL").distinct()
    named = stored(named.withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull(), "item_text")), "decontam-items")
    seeds = stored(benchmark_seeds(named), "decontam-seeds")
    used = sorted(r["pattern"] for r in seeds.select("pattern").distinct().collect())
    texts = docs.select(text_hash(F.col("text")).alias("text_hash"), "text")
    found = stored(hits(texts, bloom(seeds, "hash"), used), "decontam-hits")
    pairs = found.select("text_hash", F.inline("hits")).distinct().join(seeds, ["pattern", "hash"]).groupBy("text_hash", "item").agg(F.count("*").alias("shared"))
    return pairs, found.select("text_hash", "text").dropDuplicates(["text_hash"]), named


def text_overlaps(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """text_hash, item_id, n_equal, item_words: each distinct text's best overlap with each item."""
    pairs, texts, named = meetings(docs, items)
    read = pairs.join(texts, "text_hash").join(named.select("item", "item_text"), "item")
    return _verified(read, least).join(named.select("item", "item_id"), "item").select("text_hash", "item_id", "n_equal", "item_words")


def touched(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """_hash of each distinct text that overlaps with some item.

    The item with which a text shares most seeds is read first; only texts that it leaves are read
    with their next ones, and only those that these leave with all others.  A passage that stands in
    every item is so found at once.
    """
    pairs, texts, named = meetings(docs, items)
    nth = F.row_number().over(Window.partitionBy("text_hash").orderBy(F.desc("shared"), "item"))
    ranked, out = stored(pairs.withColumn("nth", nth), "decontam-pairs"), None
    for low, high in ROUNDS:
        left = ranked.where((F.col("nth") > low) & (F.col("nth") <= high) if high else F.col("nth") > low)
        if out is not None:
            left = left.join(out.withColumnRenamed("_hash", "text_hash"), "text_hash", "left_anti")
        read = left.join(texts, "text_hash").join(named.select("item", "item_text"), "item")
        found = stored(_verified(read, least).select(F.col("text_hash").alias("_hash")).distinct(), "decontam-found")
        out = found if out is None else out.unionByName(found)
    return out


def overlaps(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, item_id, n_equal, item_words: each document's best overlap with each item."""
    found = stored(text_overlaps(docs, items, least), "decontam-found")
    best = found.groupBy("text_hash", "item_id").agg(F.max(F.struct("n_equal", "item_words")).alias("best"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash")).distinct()
    return ids.join(best, "text_hash").select("doc_id", "text_hash", "item_id", "best.n_equal", "best.item_words")


def clean(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents whose text has no overlap, with all their columns."""
    found = touched(docs, items, least)
    return docs.join(found, text_hash(docs["text"]) == found["_hash"], "left_anti")
