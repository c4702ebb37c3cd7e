"""The bar of the class of no language is set by every held-out labelled document, by its whole text."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import langid


def test_bar_counts_every_held_out_document_and_its_whole_text(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.learn(docs, others=True)
    clean = max((r["text"] for r in docs.where("lang = 'en'").select("text").collect() if r["text"]), key=len)[: 4 * langid.WINDOW]
    windows = [langid.foreign(clean, np.random.default_rng(seed))[: langid.WINDOW] for seed in range(40)]
    noise = max(zip((m[-1] for m in langid.means(net, windows)), windows, strict=True))[1].ljust(langid.WINDOW)
    # Language only where four samples of a text begin; all else is of none.
    mixed = "".join(clean[k * langid.WINDOW : (k + 1) * langid.WINDOW].ljust(langid.WINDOW) + noise * 120 for k in range(langid.SAMPLE_WINDOWS))
    held = [k for k in range(1700) if zlib.crc32(str(k).encode()) % 4 == 2]
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    of = lambda text, n: spark.createDataFrame([(k, text if at < n else clean, "en") for at, k in enumerate(held)], "doc_id long, text string, lang string")
    share = float(list(langid.means(net, [mixed]))[0][-1])
    assert len(held) < 1000 and share > langid.LEAST_BAR
    for n in (len(held), 3):  # all of them, and so few that no sample of five need hold one
        rows = of(mixed, n)
        assert langid.spoken(rows, net, langid.rejection_bar(rows, net)).count() == len(held)
    # Unlabelled rows, learned ones and those without an id have no say.
    other = of(mixed, 3).withColumns({"lang": F.when(F.col("text") == clean, "en")})
    assert langid.rejection_bar(other, net) == langid.LEAST_BAR
    assert langid.rejection_bar(other.where("lang IS NULL"), net) == 1.0 == langid.rejection_bar(other, None)


def test_bar_leaves_one_in_a_thousand_above(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.learn(docs, others=True)
    clean = max((r["text"] for r in docs.where("lang = 'en'").select("text").collect() if r["text"]), key=len)[:300]
    held = [k for k in range(9000) if zlib.crc32(str(k).encode()) % 4 == 2][:2000]
    shuffled = [langid.foreign(clean * 3, np.random.default_rng(seed)) for seed in range(40)]
    shares = [float(m[-1]) for m in langid.means(net, shuffled)]
    worst = [t for s, t in sorted(zip(shares, shuffled, strict=True)) if s > langid.LEAST_BAR][-4:]
    rows = spark.createDataFrame([(k, worst[at] if at < 4 else clean, "en") for at, k in enumerate(held)], "doc_id long, text string, lang string")
    bar = langid.rejection_bar(rows, net)
    assert len(worst) == 4 and langid.LEAST_BAR < bar
    assert langid.spoken(rows, net, bar).count() == len(held) - 2
