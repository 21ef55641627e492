"""What counts as a letter, and texts of any length."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from codemass.llm import langid


def taught() -> langid.ByteConvNet:
    rnd = np.random.default_rng(1)
    net = langid.ByteConvNet(["aa", "bb"])
    x = np.stack([langid.windows(np.frombuffer(bytes(rnd.choice(list(w), 250).tolist()), np.uint8), np.array([0, 250]))[0][0] for w in (b"abc d", b"xyz w") for _ in range(60)])
    net.fit(x, np.repeat([0, 1], 60))
    return net


def test_numbers_and_signs_are_no_letters(spark):
    no = [None, "", " ", "½ 12 ²", "Ⅷ ⅷ", "①②", "123 _ - 4", "٣", "€ ∑", "́"]
    yes = ["a", "12 é", "ª", "日本", "½x", "𝔘", "ǅ"]
    assert [langid.has_letter(t or "") for t in no + yes] == [False] * len(no) + [True] * len(yes)
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(no + yes)], "doc_id long, text string"), taught())
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert all(rows[i] == ("und", 0.0) for i in range(len(no)))
    assert all(rows[i][0] in ("aa", "bb") and 0 < rows[i][1] <= 1 for i in range(len(no), len(no) + len(yes)))
    # the test that the training and the pipeline use agrees
    told = spark.createDataFrame([(t,) for t in no + yes], "t string").select(F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False))).collect()
    assert [r[0] for r in told] == [False] * len(no) + [True] * len(yes)


def test_slices_answer_as_the_whole_text(spark, monkeypatch):
    net = taught()
    texts = ["abcab " * 700, "xyz wz" * 900, "x" * 257, "abc " * 64, "12 " * 500 + "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = sorted(map(tuple, langid.identify(docs, net).select("doc_id", "lang_pred", F.round("score", 9)).collect()))
    tables = net.tables()
    for (_, pred, score), t in zip(whole, texts, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        mean = net.apply(langid.windows(raw, np.array([0, len(raw)]))[0], tables).mean(0)
        assert pred == net.classes[int(mean.argmax())] and abs(score - mean.max()) < 1e-6


def test_a_long_text_takes_bounded_memory():
    raw = np.frombuffer(b"abc def " * (6 << 20), np.uint8)  # 48 MB
    net = taught()
    tables = net.tables()
    tracemalloc.start()
    for a in range(0, len(raw), langid.SLICE * 8):  # every eighth slice: each is walked alike
        part = raw[a : a + langid.SLICE]
        net.apply(langid.windows(part, np.array([0, len(part)]))[0], tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
