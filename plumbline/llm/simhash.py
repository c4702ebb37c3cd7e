"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of B bits that may differ from another in k is cut into so few segments that, by the
pigeonhole principle, one segment differs in at most one bit (k < 2 * segments).  Every segment is
indexed once for each of its bits with that bit struck out; two fingerprints whose segment differs
in at most one bit share a variant.  Variants are equality-joined: distinct fingerprints are dealt
by (mask, masked value), sorted there, and within a run of equal keys compared exactly.  A run
emits a spanning forest of its verified links, never all its pairs, and links then go to
connected components.

Exact copies share a fingerprint and meet before the index, by aggregation, so a text that fills
a third of the table costs one index entry.  For a corpus of n distinct fingerprints a key of 20
or more bits holds n / 2**20 of them on average.

Defined results: null or empty text has no words and the fingerprint zero, linked like any other;
a null doc_id takes part in links, and a component of only null ids has a null component_id;
repeated rows stay repeated; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, bloom, joined_by_key, passes, portions, spark_schema, stored
from .components import connected_components
from .shingle_hashes import majority_bits, shingle_hashes

SEED = 42
#: Nodes that a task remembers, and bytes of texts (or one longer text) whose shingles are hashed at once.
BLOCK, TEXT_BYTES = 1 << 15, 1 << 20


def fingerprint(text: bytes | None, size: int, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64 hashes."""
    return int(majority_bits(*shingle_hashes([text], size, seed))[0])


FINGERPRINTS = arrow_schema(doc_id=pa.int64(), text_hash=pa.int64(), fp=pa.int64())


def fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, text) to (doc_id, text_hash, fp): the fingerprint's 64 bits as a signed long; no shuffle."""

    def compute(batches):
        for batch in portions(batches, most=TEXT_BYTES):
            fps = majority_bits(*shingle_hashes(batch.column("text").cast(pa.binary()).to_pylist(), size, SEED))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=FINGERPRINTS)

    return docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), "text").mapInArrow(compute, spark_schema(FINGERPRINTS))


def deletion_masks(segments: int, bits: int = 64) -> list[int]:
    """A mask for each bit: it keeps that bit's segment without the bit."""
    edges = [round(i * bits / segments) for i in range(segments + 1)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        segment = ((1 << high) - 1) ^ ((1 << low) - 1)
        out += [segment ^ (1 << b) for b in range(low, high)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(nodes: np.ndarray, words: np.ndarray, limits: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among nodes: whoever is reached is compared no more.

    words has a row for each fingerprint word; a link has at most limits[k] differing bits in word k.
    """
    left, right = [], []
    todo = np.arange(nodes.size)
    while todo.size > 1:
        frontier, todo = [todo[0]], todo[1:]
        while frontier and todo.size:
            pivot = frontier.pop()
            near = _near(words[:, todo], words[:, pivot : pivot + 1], limits)
            if near.any():
                reached, todo = todo[near], todo[~near]
                left.append(np.full(reached.size, nodes[pivot]))
                right.append(nodes[reached])
                frontier.extend(reached)
    return left, right


def _near(a: np.ndarray, b: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    return np.all(np.bitwise_count(a ^ b) <= np.array(limits)[:, None], axis=0)


EDGES = arrow_schema(u=pa.int64(), v=pa.int64())


def variants(word: str, masks: list[int], first: int = 0) -> Column:
    """(mask, key) of every one-wildcard variant of a fingerprint word; masks are numbered from first."""
    return F.inline(F.array(*(F.struct(F.lit(first + k).alias("mask"), F.col(word).bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks))))


def links(index: DataFrame, words: tuple[str, ...], limits: tuple[int, ...], of_run=forest) -> DataFrame:
    """(mask, key, node, words) variants to links (u, v) that connect all nodes near in every word."""
    columns = list(dict.fromkeys(["mask", "key", "node", *words]))
    of_words = [columns.index(w) for w in words]
    dealt = index.select(*columns).repartition("mask", "key").sortWithinPartitions("mask", "key", "node")

    def verify(batches):
        # The last run may go on in the next batch: its parts are held apart until it ends.
        open_run: list[np.ndarray] = []
        for batch in batches:
            part = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in columns])
            starts = _run_starts(part)
            if not starts.size:
                continue
            if open_run and np.array_equal(open_run[0][:2, 0], part[:2, 0]):
                first = starts[1] if starts.size > 1 else part.shape[1]
                open_run.append(part[:, :first])
                if starts.size == 1:
                    continue
                part, starts = part[:, first:], starts[1:] - first
            yield from _closed(open_run, of_words, limits, of_run)
            yield from _verified(part[2, : starts[-1]], part[of_words, : starts[-1]], starts, limits, of_run)
            open_run = [part[:, starts[-1] :]]
        yield from _closed(open_run, of_words, limits, of_run)

    return dealt.mapInArrow(verify, spark_schema(EDGES)).distinct()


def _run_starts(part: np.ndarray) -> np.ndarray:
    """Where each run of equal (mask, key) begins."""
    if not part.shape[1]:
        return np.empty(0, np.int64)
    new = np.any(part[:2, 1:] != part[:2, :-1], axis=0)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _closed(parts: list[np.ndarray], of_words: list[int], limits: tuple[int, ...], of_run):
    if parts:
        run = np.concatenate(parts, axis=1)
        yield from _verified(run[2], run[of_words], np.array([0, run.shape[1]]), limits, of_run)


def _verified(nodes: np.ndarray, words: np.ndarray, starts: np.ndarray, limits: tuple[int, ...], of_run):
    """Links of all runs that are whole; starts ends with the first place after them."""
    words, sizes = words.view(np.uint64), np.diff(starts)
    two = starts[:-1][sizes == 2]
    near = _near(words[:, two], words[:, two + 1], limits)
    left, right = [nodes[two[near]]], [nodes[two[near] + 1]]
    for k in np.flatnonzero(sizes > 2):
        run = slice(starts[k], starts[k + 1])
        more = of_run(nodes[run], words[:, run], limits)
        left += more[0]
        right += more[1]
    u, v = np.concatenate(left), np.concatenate(right)
    if u.size:
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=EDGES)


def fingerprint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints fp to links (u, v) that connect all those of at most max_bits differing bits."""
    # As few segments as leave one with at most one differing bit.
    masks = deletion_masks(max_bits // 2 + 1)
    return links(fps.select(F.col("fp").alias("node"), variants("fp", masks)), ("node",), (max_bits,))


def near_duplicates(docs: DataFrame, size: int = 5, max_bits: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of docs (doc_id, text)."""
    rows = stored(fingerprints(docs, size), "simhash-fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "simhash-distinct")
    nodes = stored(connected_components(fingerprint_links(fps, max_bits), "simhash-components"), "simhash-nodes")
    linked = nodes.join(fps, F.col("node") == F.col("fp"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component"))
    of_linked = linked.join(smallest, "root").select("fp", "component")
    of_fp = fps.join(of_linked, "fp", "left").select("fp", "n_rows", F.coalesce("component", "first_id").alias("component_id"))
    of_fp = stored(of_fp, "simhash-of-fp")
    return joined_by_key(rows, of_fp, "fp", "n_rows").select("doc_id", "text_hash", "fp", "component_id")


# Near copies at a Jaccard similarity over five-word shingle sets, exactly.  First candidates are the pairs that op2's
# fingerprints link; those of 64 bits can't find all (README), so further ones come from shingles.  Shingles have one order over the whole corpus, common
# ones (by a sample) last; two sets of the similarity share a shingle among their first
# n - ceil(similarity * n) + 1, their prefix.  Prefixes are equality-joined: the texts of a short run of equal shingles
# meet pair by pair, those of longer runs form families.  A parity bitmap of about a bit a shingle then bounds from
# below how much two sets differ; what it leaves falls into loose groups, which hold every similar pair, and
# few others.  Only texts in such groups are compared by their whole sets, block by block.
# The sample has no say in what is found, only in how fast.

#: Longest run of equal shingles whose pairs are emitted one by one.
SHORT_RUN = 32
#: Texts sampled for the common shingles, the least count of one there, and the most that are broadcast.
SAMPLE_TEXTS, COMMON_COUNT, COMMON_SHINGLES = 4096, 3, 1 << 16
#: A shingle that so many sampled texts hold is dealt over SALTS tasks, and its run counts as long.
HOT_COUNT, SALTS = 64, 64
#: Bits of a parity bitmap at least (a power of two), and bytes of bitmaps in a block.
LEAST_BITS, BLOCK_BYTES = 512, 1 << 18
#: A block of whole sets holds this many shingles, a text counting for BLOCK_TEXT at least, or one longer text.
BLOCK_SHINGLES, BLOCK_TEXT = 1 << 17, 256
#: Pairs with their bitmaps in an Arrow batch.
PAIR_ROWS = 2048
#: Shingles in one product of a block pair's membership matrices.
PRODUCT = 1 << 12


def _text_hash() -> Column:
    """The hash of null differs from that of every text."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


SHINGLE_SETS = arrow_schema(node=pa.int64(), grams=pa.binary())
PROFILES = arrow_schema(node=pa.int64(), n=pa.int32(), fp=pa.int64(), salted=pa.list_(pa.bool_()), grams=pa.list_(pa.int64()), bits=pa.binary())
MEETINGS = arrow_schema(u=pa.int64(), v=pa.int64(), kind=pa.int32())
#: Kinds of meetings: a pair of a short run; a text of a longer run with the run's first; a salted shingle with the first of one of its runs.
PAIR, WIDE, HEAD = 0, 1, 2


def hash_runs(texts: list[bytes | None], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's shingle hashes, sorted and distinct, and each text's fingerprint."""
    hashes, edges = shingle_hashes(texts, size, SEED)
    return [np.unique(run) for run in np.split(hashes, edges[1:-1])] if texts else [], majority_bits(hashes, edges)


def shingle_sets(texts: DataFrame, size: int, packed: np.ndarray | None = None) -> DataFrame:
    """(node, text) to (node, grams), once a node and task; packed: of those nodes alone that a filter passes."""
    broadcast = texts.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        bits, seen = broadcast.value, set()
        for part in portions(batches, most=TEXT_BYTES):
            nodes = part.column("node").to_numpy()
            chosen = [k for k in (np.flatnonzero(passes(bits, nodes)) if bits is not None else range(len(nodes))) if nodes[k] not in seen]
            if len(seen) < BLOCK:
                seen.update(nodes[chosen].tolist())
            part = part.take(pa.array(chosen, pa.int64()))
            sets = [grams.tobytes() for grams in hash_runs(part.column("text").cast(pa.binary()).to_pylist(), size)[0]]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], schema=SHINGLE_SETS)

    return texts.select("node", "text").mapInArrow(run, spark_schema(SHINGLE_SETS))


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and how many do: at most COMMON_SHINGLES."""
    every = max(1, texts.count() // SAMPLE_TEXTS)
    sample = texts.where(F.pmod("node", F.lit(every)) == 0).dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for grams in batch.column("grams"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(grams.as_buffer(), np.int64))], names=["gram"])

    counted = shingle_sets(sample, size).mapInArrow(run, "gram long").groupBy("gram").count()
    top = counted.where(F.col("count") >= COMMON_COUNT).orderBy(F.desc("count"), "gram").limit(COMMON_SHINGLES).toArrow()
    grams, counts = (top.column(c).to_numpy().astype(np.int64) for c in ("gram", "count"))
    order = np.argsort(grams.view(np.uint64))
    return grams.view(np.uint64)[order], counts[order]


def prefix_length(n: int, least: float) -> int:
    """How many of a set's first shingles hold one of every set that is similar."""
    return n - math.ceil(n * least - 1e-9) + 1


def parity_bits(grams: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, one a shingle at least: each bit is the parity of the shingles that fall on it.

    Two sets' bitmaps differ in at most as many bits as the sets differ in shingles.
    """
    size = max(LEAST_BITS, 1 << (grams.size - 1).bit_length() if grams.size else 1)
    return np.packbits(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 == 1, bitorder="little").tobytes()


def profiles(texts: DataFrame, size: int, least: float) -> DataFrame:
    """(node, text) to its number of shingles, fingerprint, prefix and bitmap, once a node and task.

    A text without shingles has the shingle 0.  salted marks shingles that are known to be in very many texts.
    """
    broadcast = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, size))

    def run(batches):
        common, counts = broadcast.value
        seen: set[int] = set()
        for batch in portions(batches, most=TEXT_BYTES):
            rows, nodes, chosen, here = [], batch.column("node").to_pylist(), [], set()
            for k, node in enumerate(nodes):
                if node not in seen and node not in here:
                    here.add(node)
                    chosen.append(k)
            if len(seen) < BLOCK:
                seen |= here
            sets, fps = hash_runs(batch.column("text").take(pa.array(chosen, pa.int64())).cast(pa.binary()).to_pylist(), size)
            for place, grams, fp in zip(chosen, sets, fps.view(np.int64).tolist(), strict=True):
                n, bits, often = grams.size, parity_bits(grams), np.zeros(grams.size, np.int64)
                if n and common.size:
                    at = np.minimum(np.searchsorted(common, grams), common.size - 1)
                    often = np.where(common[at] == grams, counts[at], 0)
                    order = np.lexsort((grams, often))
                    grams, often = grams[order], often[order]
                k = prefix_length(n, least)
                prefix, hot = (grams[:k].view(np.int64), often[:k] >= HOT_COUNT) if n else (np.zeros(1, np.int64), np.ones(1, bool))
                rows.append((nodes[place], n, fp, hot, prefix, bits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), PROFILES, strict=True)], schema=PROFILES)

    return texts.select("node", "text").mapInArrow(run, spark_schema(PROFILES))


def meetings(profiled: DataFrame, least: float) -> DataFrame:
    """(u, v, kind): pairs of short runs that may be similar, and what ties the texts of longer runs together."""
    entries = profiled.select("node", "n", F.posexplode(F.arrays_zip("grams", "salted")).alias("at", "e"))
    salt = F.when(F.col("e.salted"), 1 + F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int")
    index = entries.select(F.col("e.grams").alias("gram"), salt.alias("salt"), "node", "n", "at")
    dealt = index.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "node")

    def run(batches):
        # The last run of a batch may go on in the next; of a long one only its first row is held.
        rest, head = np.zeros((5, 0), np.int64), None
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not part.shape[1]:
                continue
            if head is not None:
                same = np.all(part[:2] == head[:2, None], axis=0)
                yield from _tied(head, part[:, same])
                part = part[:, ~same]
                if not part.shape[1]:
                    continue
                head = None
            part = np.concatenate([rest, part], axis=1)
            last = np.all(part[:2] == part[:2, -1:], axis=0)
            whole = int(np.argmax(last))
            rest = part[:, whole:]
            yield from _met(part[:, :whole], least)
            if rest.shape[1] > 4 * SHORT_RUN and np.unique(rest[2]).size > SHORT_RUN:
                head = rest[:, 0]
                yield from _tied(head, rest)
                yield from _headed(rest[:, :1])
                rest = rest[:, :0]
        yield from _met(rest, least)

    return dealt.mapInArrow(run, spark_schema(MEETINGS)).distinct()


def _rows(u: np.ndarray, v: np.ndarray, kind: int):
    if u.size:
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(u.size, kind, np.int32))], schema=MEETINGS)


def _tied(head: np.ndarray, rows: np.ndarray):
    """Every row's text with the run's first."""
    nodes = np.unique(rows[2])
    nodes = nodes[nodes != head[2]]
    yield from _rows(np.full(nodes.size, head[2]), nodes, WIDE)


def _headed(firsts: np.ndarray):
    """Salted shingles with the firsts of their runs."""
    gram, salt, node = firsts[:3]
    yield from _rows(gram[salt > 0], node[salt > 0], HEAD)


def _met(part: np.ndarray, least: float):
    """Meetings of whole runs; rows are in order of shingle, salt and node."""
    if not part.shape[1]:
        return
    repeated = np.concatenate([[False], np.all(part[:3, 1:] == part[:3, :-1], axis=0)])
    gram, salt, node, n, at = part = part[:, ~repeated]
    begins = np.concatenate([[True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])])
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.concatenate([starts, [gram.size]]))
    size, first = np.repeat(sizes, sizes), np.repeat(node[starts], sizes)
    wide = (size > SHORT_RUN) | (salt > 0)
    yield from _headed(part[:, starts])
    yield from _rows(first[wide & (node != first)], node[wide & (node != first)], WIDE)
    left, run = n - at, np.cumsum(begins)
    pairs = [np.zeros((2, 0), np.int64)]
    for d in range(1, SHORT_RUN):
        k = np.flatnonzero((run[d:] == run[:-d]) & ~wide[d:])
        if not k.size:
            break
        # The first shingle that two sets share leaves room for all others that they must share.
        room = np.minimum(left[k], left[k + d]) * (1 + least) >= least * (n[k] + n[k + d]) - 1e-6
        k = k[room | (n[k] == 0)]
        pairs.append(np.stack([node[k], node[k + d]]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    yield from _rows(pairs[0], pairs[1], PAIR)


def may_be_similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """For sets of sizes n and bitmaps (64-bit words, a row a set), a against b row by row: False where they can't be similar."""
    (n_a, bits_a), (n_b, bits_b) = a, b
    differ = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    return (differ * (1 + least) <= (1 - least) * (n_a + n_b) + 1e-6) & (np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b) - 1e-6)


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of fewer bits, out of larger ones."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def loose_pairs(pairs: DataFrame, bitmaps: DataFrame, least: float) -> DataFrame:
    """Those pairs (u, v) whose bitmaps don't rule out that they are similar."""
    left = bitmaps.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    right = bitmaps.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))

    def compare(batches):
        for batch in batches:
            kept = []
            for nu, nv, bu, bv in zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "bu", "bv")), strict=True):
                x, y = np.frombuffer(bu, np.uint64), np.frombuffer(bv, np.uint64)
                width = min(x.size, y.size)
                kept.append(bool(may_be_similar((np.int64(nu), _folded(x, width)), (np.int64(nv), _folded(y, width)), least)))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(compare, spark_schema(EDGES))


def _tree(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node's component: labels fall to the least of the neighbours' until nothing moves."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _meeting_blocks(placed: DataFrame, family: str, least: float, pairs_of: Column, only: Column) -> DataFrame:
    """(family, i, j) of the blocks whose sizes allow similar sets; placed: family, block, n."""
    blocks = placed.groupBy(family, "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), only.alias("only"))
    i, j = blocks.alias("i"), blocks.alias("j")
    may = (F.col("i.high") >= F.col("j.low") * least - 1e-6) & (F.col("j.high") >= F.col("i.low") * least - 1e-6)
    meet = i.join(j, (F.col(f"i.{family}") == F.col(f"j.{family}")) & (F.col("i.block") <= F.col("j.block"))).where(may & pairs_of)
    return meet.select(F.col(f"i.{family}").alias(family), F.col("i.block").alias("i"), F.col("j.block").alias("j")).withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))


def loose_in_families(members: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that connect all members of a family whose bitmaps leave it open whether they are similar.

    members: family, node, n, bits.  Blocks of bitmaps in order of size meet; each pair of blocks gives a tree of links.
    """
    before = F.sum(F.length("bits")).over(Window.partitionBy("family").orderBy("n", "node"))
    placed = stored(members.withColumn("block", F.floor(before / BLOCK_BYTES)), "copies-families")
    dealt = _meeting_blocks(placed, "family", least, F.lit(True), F.lit(None))

    def compare(table: pa.Table) -> pa.Table:
        block, nodes, n = (table.column(c).to_numpy() for c in ("block", "node", "n"))
        bits, n = table.column("bits").to_pylist(), n.astype(np.int64)
        width = np.array([len(x) for x in bits])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for w in np.unique(width):
            a, b = np.flatnonzero((block == i) & ((width == w) | (width == 2 * w))), np.flatnonzero((block == j) & ((width == w) | (width == 2 * w)))
            if not a.size or not b.size:
                continue
            words = {side: np.concatenate([_folded(_words([bits[k]]), w // 8) for k in rows]) for side, rows in (("a", a), ("b", b))}
            for at in range(0, a.size, 128):
                some = a[at : at + 128]
                near = may_be_similar((n[some][:, None], words["a"][at : at + 128, None]), (n[b][None], words["b"][None]), least)
                x, y = np.nonzero(near)
                # Trees as they grow: never all pairs at once.
                tree = _tree(np.concatenate([u, some[x]]), np.concatenate([v, b[y]]), len(bits))
                u, v = tree
        return pa.Table.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], schema=EDGES)

    return placed.join(dealt, ["family", "block"]).groupBy("family", "i", "j").applyInArrow(compare, spark_schema(EDGES))


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a shares with each of b."""
    in_a, in_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(in_a, in_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(members, sets):
        at = np.searchsorted(both, members)
        held = at < both.size
        held[held] = both[at[held]] == members[held]
        return np.repeat(np.arange(len(sets)), [x.size for x in sets])[held], at[held]

    (row_a, at_a), (row_b, at_b) = places(in_a, a), places(in_b, b)
    for low in range(0, both.size, PRODUCT):
        sides = []
        for rows, at, sets in ((row_a, at_a, a), (row_b, at_b, b)):
            side, here = np.zeros((len(sets), min(PRODUCT, both.size - low)), np.float32), (at >= low) & (at < low + PRODUCT)
            side[rows[here], at[here] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def similar_in_groups(members: DataFrame, parts: DataFrame | None, least: float, pairs_of: Column) -> DataFrame:
    """Links (u, v) of the blocks that meet; members: root, node, n, grams; parts: node, part.

    pairs_of is the condition on two blocks i and j of a group, in order; each has its number, its
    least and greatest n (low, high) and its part if it has only one.
    """
    light = members.select("root", "node", "n")
    light = light.join(parts, "node", "left") if parts is not None else light.withColumn("part", F.lit(None).cast("long"))
    before = F.sum(F.greatest("n", F.lit(BLOCK_TEXT))).over(Window.partitionBy("root").orderBy(F.col("part").asc_nulls_last(), "n", "node"))
    placed = stored(light.withColumn("block", F.floor(before / BLOCK_SHINGLES)), "copies-blocks")
    only = F.when((F.min("part") == F.max("part")) & (F.count("part") == F.count("*")), F.min("part"))
    dealt = _meeting_blocks(placed, "root", least, pairs_of, only)
    sets = placed.select("root", "block", "node").join(members.select("node", "grams"), "node")

    def compare(table: pa.Table) -> pa.Table:
        block, nodes = table.column("block").to_numpy(), table.column("node").to_numpy()
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams")]
        a = np.flatnonzero(block == table.column("i")[0].as_py())
        b = np.flatnonzero(block == table.column("j")[0].as_py())
        shared = _shared([grams[k] for k in a], [grams[k] for k in b])
        sizes = np.array([g.size for g in grams])
        u, v = np.nonzero(shared >= least * (sizes[a][:, None] + sizes[b][None, :] - shared.astype(np.float64)))
        # Links that leave the same nodes connected: a tree of each component of the two blocks.
        tree = _tree(a[u], b[v], len(grams))
        return pa.Table.from_arrays([pa.array(nodes[tree[0]]), pa.array(nodes[tree[1]])], schema=EDGES)

    return sets.join(dealt, ["root", "block"]).groupBy("root", "i", "j").applyInArrow(compare, spark_schema(EDGES))


def fingerprint_pairs(texts: DataFrame, size: int, max_bits: int = 4) -> DataFrame:
    """(node, text) to pairs (u, v) that connect all texts whose fingerprints op2 links: equal ones, and those of few differing bits.

    Who has the texts' fingerprints gives (node, fp) instead.
    """
    if "fp" not in texts.columns:
        marked = fingerprints(texts.select(F.lit(None).cast("long").alias("doc_id"), "text"), size)
        texts = stored(marked.select(F.col("text_hash").alias("node"), "fp").distinct(), "copies-fingerprints")
    firsts = stored(texts.groupBy("fp").agg(F.min("node").alias("first")), "copies-fingerprints")
    near = fingerprint_links(firsts, max_bits).toDF("fu", "fv")
    of = lambda fp, node: firsts.select(F.col("fp").alias(fp), F.col("first").alias(node))
    same = texts.join(firsts, "fp").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return near.join(of("fu", "u"), "fu").join(of("fv", "v"), "fv").select("u", "v").union(same)


def copy_links(texts: DataFrame, size: int, least: float) -> DataFrame:
    """(node, text) to links (u, v) that connect exactly what the links of all similar pairs connect.

    Candidates come from fingerprints, and from prefixes of the sets for what fingerprints miss; both are verified alike.
    """
    profiled = stored(profiles(texts, size, least), "copies-profiles")
    prints = stored(profiled.select("node", "fp").distinct(), "copies-fingerprints")
    marked = stored(fingerprint_pairs(prints, size), "copies-marked")
    met = stored(meetings(profiled, least), "copies-meetings")
    bitmaps = profiled.select("node", "n", "bits").dropDuplicates(["node"])
    with arrow_rows(texts.sparkSession, PAIR_ROWS):
        loose = stored(loose_pairs(met.where(F.col("kind") == PAIR).select("u", "v").union(marked).distinct(), bitmaps, least), "copies-loose")
    heads = met.where(F.col("kind") == HEAD).select(F.col("u").alias("gram"), "v")
    wide = met.where(F.col("kind") == WIDE).select("u", "v").union(heads.join(heads.groupBy("gram").agg(F.min("v").alias("u")), "gram").select("u", "v"))
    if not wide.isEmpty():
        families = stored(connected_components(wide, "copies-wide"), "copies-wide").withColumnRenamed("root", "family")
        loose = loose.union(stored(loose_in_families(bitmaps.join(families, "node"), least), "copies-loose"))
    groups = stored(connected_components(loose, "copies-groups"), "copies-groups")
    packed = bloom(groups, "node")
    sets = shingle_sets(texts, size, packed).join(groups, "node").dropDuplicates(["node"])
    members = stored(sets.withColumn("n", F.expr("length(grams) div 8")), "copies-members")
    # First blocks of like sizes; what they connect needs no more comparing within itself.
    found = stored(similar_in_groups(members, None, least, F.col("j.block") - F.col("i.block") <= 1), "copies-beside")
    parts = stored(connected_components(found, "copies-parts"), "copies-parts").withColumnRenamed("root", "part")
    apart = ~F.coalesce(F.col("i.only") == F.col("j.only"), F.lit(False))
    return found.union(similar_in_groups(_of_several_blocks(members), parts, least, apart))


def _of_several_blocks(members: DataFrame) -> DataFrame:
    """Members of groups that don't fit into two blocks: those of others have all been compared."""
    weight = F.sum(F.greatest("n", F.lit(BLOCK_TEXT)))
    large = members.groupBy("root").agg(weight.alias("w")).where(F.col("w") >= BLOCK_SHINGLES).select("root")
    return members.join(large, "root", "left_semi")


def without_near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one of smallest doc_id.

    A null doc_id comes last; of rows equal in doc_id and text one stays; a text without words is
    a near copy of every other such text of the same kind (null or empty).
    """
    rows = docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"))
    found = copy_links(docs.select(_text_hash().alias("node"), "text"), 5, similarity)
    nodes = stored(connected_components(found, "copies-components"), "copies-nodes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    firsts = rows.groupBy("text_hash").agg(F.min(order).alias("first"))
    grouped = firsts.join(nodes, F.col("text_hash") == F.col("node"), "left")
    best = grouped.groupBy(F.coalesce("root", "text_hash")).agg(F.min("first").alias("best"))
    kept = stored(best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash")), "copies-kept")
    # The document goes as one struct, so that no column of its own can clash.
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("hash"))
    same = whole["id"].eqNullSafe(kept["_id"]) & (whole["hash"] == kept["_hash"])
    nth = F.row_number().over(Window.partitionBy("hash", "id").orderBy("hash"))
    return whole.join(kept, same, "left_semi").withColumn("nth", nth).where("nth = 1").select("doc.*")
