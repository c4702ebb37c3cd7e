"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes, the last one padded.  Bytes are
embedded, filters of several widths run over them, each filter's greatest response over the window is kept,
and a softmax over those gives the window's language.  A text's scores are its windows' mean,
weighted by their bytes, so the whole text counts whatever its length.

Training takes a bounded sample: `SAMPLE_DOCS` documents of each language (fewer if there are so
many languages that `SAMPLE_ALL` would be exceeded, one at least), those of smallest hash, and
`SAMPLE_WINDOWS` places of each.  The languages and their counts come from all rows.

For filtering, the network learns one class more: texts of no learned language, made out of the
sample by shuffling its letters, exchanging them by a random alphabet, moving them to another
script or drawing them anew.  A text is rejected if that class's share is above a bar that is
calibrated on all labelled documents held out from training, by their whole texts: at most one in a thousand of them lies above it.

Defined results: null text, or one without a letter, is ``und`` with score 0 and rejected by `spoken`;
a text of fewer than `JUDGED` bytes with a letter is never rejected, it shows too little; a null doc_id is not held out
and teaches nothing; repeated rows are predicted each; further columns are ignored; without any
labelled row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, portions, spark_schema

#: A power of two, and widths of two to four bytes, the least first: responses are looked up by two bytes at once.
WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_ALL = 600, 4, 1 << 17
#: Bytes that a text must have to be rejected; the least bar, and the share of labelled documents that may lie above the bar.
JUDGED, LEAST_BAR, FALSE_REJECTS = 120, 0.97, 0.001
#: Steps of the bar.
GRAIN = 1 << 20
#: Where other scripts' letters begin, and how far apart those taken are (Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Hangul, Han).
SCRIPTS = ((0x3B1, 1), (0x430, 1), (0x5D0, 1), (0x627, 1), (0x905, 1), (0xE01, 1), (0xAC00, 28), (0x4E00, 97))
#: Windows that go through the network at once.
BLOCK = 64
UNKNOWN, OTHER = "und", "other"


class ByteConvNet:
    """embedding (256, d), filters (longest width * d, all filters), dense layer; float32 throughout.

    Filters of all widths stand in one matrix, zero beyond their width, so that one product
    serves them all.
    """

    def __init__(self, languages: list[str], seed: int = 11):
        rng, longest, total = np.random.default_rng(seed), max(WIDTHS), len(WIDTHS) * FILTERS
        self.languages, self.tables = languages, None
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = rng.normal(0, 0.2, (longest * EMBEDDING, total)).astype(np.float32)
        self.mask = np.zeros_like(self.filters)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters *= self.mask
        self.bias = np.zeros(total, np.float32)
        self.dense = rng.normal(0, 0.1, (total, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, longest width * d)."""
        longest = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, longest - 1)))
        seen = np.lib.stride_tricks.sliding_window_view(padded, longest, axis=1)
        return self.embedding[seen].reshape(*windows.shape, -1)

    def _pooled(self, patches: np.ndarray) -> np.ndarray:
        n, positions, width = patches.shape
        return (patches.reshape(-1, width) @ self.filters).reshape(n, positions, -1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What two bytes add to every filter's response as its first and second, and to longer filters' as their third and fourth."""
        if self.tables is None:
            a, b, c, d = (self.embedding @ part for part in self.filters.reshape(4, EMBEDDING, -1))
            self.tables = (a[:, None] + b).reshape(1 << 16, -1), (c[:, None, FILTERS:] + d[:, FILTERS:]).reshape(1 << 16, -1)
        return self.tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Embedding and filters are linear, so that responses are sums of the tables' rows."""
        (first, second), out = self._tables(), [np.zeros((0, len(self.languages)), np.float32)]
        for at in range(0, len(windows), BLOCK):
            padded = np.pad(windows[at : at + BLOCK], ((0, 0), (0, 3))).astype(np.intp)
            pairs = padded[:, :-1] << 8 | padded[:, 1:]
            peak = first.take(pairs[:, :WINDOW], axis=0, mode="clip")
            peak[..., FILTERS:] += second.take(pairs[:, 2:], axis=0, mode="clip")
            while peak.shape[1] > 1:  # halves against each other, as long as there are several places
                half = peak.shape[1] // 2
                peak = np.maximum(peak[:, :half], peak[:, half:])
            out.append(_softmax(np.maximum(peak[:, 0] + self.bias, 0) @ self.dense + self.out_bias))
        return np.concatenate(out)

    def train(self, windows: np.ndarray, targets: np.ndarray, epochs: int = 6, least_steps: int = 600, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross-entropy with a falling rate; half the windows of each step are cut short, as texts are."""
        rng, self.tables = np.random.default_rng(seed), None
        steps = max(1, len(windows) // BLOCK)
        epochs = max(epochs, -(-least_steps // steps))
        names = ("embedding", "filters", "bias", "dense", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second, step = {k: np.zeros_like(getattr(self, k)) for k in names}, 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(windows)), steps):
                batch = windows[rows].copy()
                cut = rng.integers(8, WINDOW, len(batch))
                batch[(np.arange(WINDOW) >= cut[:, None]) & (rng.random(len(batch)) < 0.5)[:, None]] = 0
                slopes, step = self._slopes(batch, targets[rows]), step + 1
                for k, g in slopes.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - rate * 0.1 ** (step / (steps * epochs)) * move).astype(np.float32))
                self.embedding[0] = 0

    def _slopes(self, windows: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients; of a pooled filter only its greatest place has one."""
        patches = self._patches(windows)
        response = self._pooled(patches)
        n, total = len(windows), response.shape[2]
        place = response.argmax(1)
        peak = np.take_along_axis(response, place[:, None, :], 1)[:, 0] + self.bias
        active = np.maximum(peak, 0)
        wrong = _softmax(active @ self.dense + self.out_bias)
        wrong[np.arange(n), targets] -= 1
        wrong /= n
        back = (wrong @ self.dense.T) * (peak > 0)
        best = patches[np.arange(n)[:, None], place]  # (n, filters, width * d)
        filters = np.einsum("nf,nfw->wf", back, best) * self.mask
        into = back[:, :, None] * self.filters.T[None]
        longest = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, longest - 1)))
        read = padded[np.arange(n)[:, None, None], place[:, :, None] + np.arange(longest)]
        embedding = np.zeros_like(self.embedding)
        np.add.at(embedding, read.ravel(), into.reshape(n * total * longest, EMBEDDING))
        return {"embedding": embedding, "filters": filters, "bias": back.sum(0), "dense": active.T @ wrong, "out_bias": wrong.sum(0)}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """A row for each WINDOW bytes of a text, the last padded with zeros; one row at least."""
    rows = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, where: Column) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """All languages of the labelled rows, and (language, places of the text) of a bounded sample of them."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & where)
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return [], []
    languages, grain = sorted(counts), 1 << 30
    most = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(languages)))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, int(min(1, 2 * most / counts[lang]) * grain))))
    digest = F.xxhash64(F.lit("langid"), "doc_id", "text")
    places = F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1))
    parts = F.transform(places, lambda k: F.substring(F.col("text"), (k * F.length("text") / SAMPLE_WINDOWS).cast("int") + 1, F.lit(WINDOW)))
    chosen = labelled.where((F.pmod(digest, F.lit(grain)) < share[F.col("lang")]) & F.col("text").isNotNull())
    chosen = chosen.select("doc_id", "lang", digest.alias("digest"), F.array_distinct(parts).alias("parts"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "doc_id", "parts"))
    rows = chosen.withColumn("nth", nth).where(F.col("nth") <= most).collect()
    ordered = sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["nth"]))
    return languages, [(r["lang"], [p for p in r["parts"] if p]) for r in ordered]


def foreign(text: str, rng: np.random.Generator) -> str:
    """A text like this one, but of no language: letters shuffled, exchanged, moved to another script or drawn anew."""
    letters = sorted({c for c in text.lower() if c.isalpha()} | set("abcdefghijklmnopqrstuvwxyz"))
    kind = rng.integers(4)
    if kind == 0:
        own = iter(rng.permutation([c for c in text if c.isalpha()]).tolist())
        return "".join(next(own) if c.isalpha() else c for c in text)
    if kind == 1:
        instead = dict(zip(letters, rng.permutation(letters).tolist(), strict=True))
    elif kind == 2:
        first, apart = SCRIPTS[rng.integers(len(SCRIPTS))]
        instead = {c: chr(first + apart * (k % 24)) for k, c in enumerate(letters)}
    else:
        return "".join(letters[rng.integers(len(letters))] if c.isalpha() else c for c in text)
    return "".join(instead.get(c.lower(), c) for c in text)


def learn(docs: DataFrame, others: bool = False) -> ByteConvNet | None:
    """The network of the labelled rows that are not held out; others: with the class of no language."""
    languages, sample = labelled_sample(docs, ~held_out(F.col("doc_id")))
    pairs = [(part, languages.index(lang)) for lang, parts in sample for part in parts]
    if not pairs:
        return None
    if others:
        rng = np.random.default_rng(3)
        texts = [pairs[k][0] for k in rng.choice(len(pairs), max(64, 2 * len(pairs) // len(languages)))]
        pairs += [(foreign(text, rng), len(languages)) for text in texts]
        languages = [*languages, OTHER]
    net = ByteConvNet(languages)
    net.train(np.concatenate([windows_of(part.encode()[:WINDOW]) for part, _ in pairs]), np.array([k for _, k in pairs]))
    return net


def rejection_bar(docs: DataFrame, net: ByteConvNet | None) -> float:
    """The least bar, rounded up to a GRAIN-th, that at most FALSE_REJECTS of all held-out labelled documents exceed with their whole texts.

    Tasks count the shares above LEAST_BAR; a row for each GRAIN-th above it comes to the driver at most.
    """
    if net is None:
        return 1.0

    def run(batches):
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            shares = [float(mean[-1]) for text, mean in zip(texts, means(net, texts), strict=True) if mean is not None and len(text.encode()) >= JUDGED]
            yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64())], names=["share"])

    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & held_out(F.col("doc_id")))
    shares = labelled.select("text").mapInArrow(run, "share double")
    step = F.when(F.col("share") > LEAST_BAR, F.ceil(F.col("share") * GRAIN))
    counts = {r["step"]: r["count"] for r in shares.groupBy(step.alias("step")).count().collect()}
    left, bar = int(sum(counts.values()) * FALSE_REJECTS), LEAST_BAR if counts else 1.0
    for step in sorted((k for k in counts if k is not None), reverse=True):
        left -= counts[step]
        if left < 0:
            return step / GRAIN
    return bar


PREDICTED = arrow_schema(doc_id=pa.int64(), held_out=pa.bool_(), lang_pred=pa.string(), score=pa.float64())


def means(net: ByteConvNet | None, texts: list[str | None]) -> Iterator[np.ndarray | None]:
    """Each text's mean scores, None without a letter; windows of many texts share the network's blocks."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        spoken = net is not None and text is not None and any(map(str.isalpha, text))
        group.append(text.encode() if spoken else b"")
        size += len(group[-1])
        if size >= 1 << 20:
            yield from _means(net, group)
            group, size = [], 0
    yield from _means(net, group)


def _means(net: ByteConvNet | None, group: list[bytes]) -> Iterator[np.ndarray | None]:
    spoken = [data for data in group if data]
    found = iter(())
    if spoken:
        parts = [windows_of(data) for data in spoken]
        share = net.probabilities(np.concatenate(parts))
        ends = np.cumsum([len(p) for p in parts])
        weight = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(p))) for d, p in zip(spoken, parts, strict=True)])
        sums = np.add.reduceat(share * weight[:, None], np.concatenate([[0], ends[:-1]]), axis=0)
        found = iter(sums / np.array([len(d) for d in spoken])[:, None])
    for data in group:
        yield next(found) if data else None


def predictions(net: ByteConvNet | None, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """Language and score of each text."""
    for mean in means(net, texts):
        yield (UNKNOWN, 0.0) if mean is None else (net.languages[int(mean.argmax())], float(min(1.0, mean.max())))


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """(doc_id, text) to doc_id, held_out, lang_pred, score for every row; no shuffle."""

    def run(batches):
        for batch in portions(batches):
            found = list(predictions(net, batch.column("text").to_pylist()))
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), langs, scores], schema=PREDICTED)

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id, held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, spark_schema(PREDICTED))


def spoken(docs: DataFrame, net: ByteConvNet | None, bar: float = LEAST_BAR) -> DataFrame:
    """The documents, with all their columns, that have a letter and whose share of no learned language is at most `bar`.

    A network without that class rejects only texts without a letter.
    """
    judges = net is not None and net.languages[-1] == OTHER

    def run(batches):
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            kept = []
            for text, mean in zip(texts, means(net, texts), strict=True):
                if mean is None:
                    kept.append(net is None and text is not None and any(map(str.isalpha, text)))
                else:
                    kept.append(not judges or mean[-1] <= bar or len(text.encode()) < JUDGED)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
