"""Each operator against a brute-force version, and its defined results for nulls, empties, ties, repeats and clashes."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codemass.llm import chat, decontaminate, htmltext, langid, licenses, packing, simhash, substring, text, tokencount, topk

WORDS = [f"w{i}" for i in range(60)] + ["été", "straße", "a", "I'll", "x_y", "日本"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd: random.Random, n: int) -> str:
    return rnd.choice(["", "  ", "\n"]) + "".join(rnd.choice(WORDS) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rnd = random.Random(5)
    shared = [prose(rnd, 20) for _ in range(4)]
    rows = []
    for i in range(80):
        t = prose(rnd, rnd.choice([0, 1, 2, 5, 12, 13, 14, 40, 150]))
        if i % 3 == 0:
            t += shared[i % 4] + prose(rnd, 10)
        rows.append((i, t))
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 4)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "same " * 6000), (5, rows[7][1]), (None, rows[9][1])]
    return [(k, t, "en", "s", len(t or "")) for k, t in rows]


def test_spans_and_hashes_agree_with_split():
    import pyarrow as pa

    rnd = random.Random(1)
    rows = [prose(rnd, rnd.randint(0, 30)) for _ in range(50)] + [None, ""]
    for _, _, raw, offs in text.chunks(pa.array(rows, pa.string())):
        starts, ends, first = text.spans(raw, offs, text.NON_SPACE)
        data = raw.tobytes()
        got = [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]
        want = [w for r in rows for w in (r or "").replace("\t", " ").split()]
        assert got == want and first[-1] == len(want)
        hashes = text.span_hashes(raw, starts, ends)
        assert len(set(zip(got, hashes.tolist(), strict=True))) == len(set(got)) == len(set(hashes.tolist()))


def test_token_counts_equal_the_library(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = [(300, "<s> </s> <unk> <0x0A> ▁ a▁b x² m². 12345"), (301, "    " * 20 + "def f():\n\n\n  x"), (302, "naïve 🙂👍🏽 हिन्दी ½ 日本語"), (303, "a" * 3000)]
    docs = spark.createDataFrame([r[:2] for r in texts] + extra, "doc_id long, text string")
    for r in tokencount.count_tokens(docs, path, limit=10).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "")), r["text"]
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 10)


def test_token_counts_clashing_columns_and_empty_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, N_TOKENS string")
    assert tokencount.count_tokens(docs, path).columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert tokencount.count_tokens(docs.limit(0), path).count() == 0


def test_word_ids_equal_the_library():
    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    alphabet = "abS ▁é²1_.,\n\t日łΣж½ᵃ̈ 's'RE'llÉß \x1c\x85 İ"
    cases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(500)] + ["a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
        "it's I'LL 'sun"]
    for s in cases:
        assert np.frombuffer(words.ids(s), "<u4").tolist() == words.tokenizer.encode(s, add_special_tokens=False).ids, s


def test_packing_places_every_id_once(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame(texts, DOCS)
    rows = packing.pack(docs, path, capacity=64).collect()
    words = packing.word_tokens(path)
    of, places = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 64
    want = defaultdict(list)
    for k, t, *_ in texts:
        if k is not None:
            want[k].append(words.ids(t or "") + np.asarray([2], "<u4").tobytes())
    for k, parts in want.items():
        assert sum(map(len, parts)) == 4 * sum(r["length"] for r in of[k])
        if len(parts) == 1:
            assert b"".join(bytes(r["ids"]) for r in sorted(of[k], key=lambda r: r["start"])) == parts[0]
    used = sum(r["length"] for r in rows)
    assert used / (64 * len(places)) > 0.85
    assert packing.pack(docs.limit(0), path).count() == 0


def test_patterns_hold_every_length_once():
    rnd = random.Random(3)
    histogram = {n: rnd.randint(1, 50) for n in rnd.sample(range(1, 101), 60)}
    found = defaultdict(int)
    for copies, lengths in packing.patterns(histogram, 100):
        assert sum(lengths) <= 100 and copies > 0
        for n in lengths:
            found[n] += copies
    assert dict(found) == histogram and packing.patterns({}) == []


def brute_substring(rows: list[tuple]) -> dict:
    first: dict[tuple, int] = {}
    split = [(k, (t or "").replace("\t", " ").split()) for k, t, *_ in rows]
    for k, words in split:
        for i in range(len(words) - 12):
            if k is not None:
                first[tuple(words[i : i + 13])] = min(k, first.get(tuple(words[i : i + 13]), k))
    out = []
    for k, words in split:
        gone = set()
        for i in range(len(words) - 12):
            if k is not None and first[tuple(words[i : i + 13])] < k:
                gone.update(range(i, i + 13))
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "sample"), [(1024, 4096), (8, 20)])
def test_substring_dedup_equals_brute_force(spark, texts, monkeypatch, block, sample):
    monkeypatch.setattr(substring, "BLOCK_DOCS", block)
    monkeypatch.setattr(substring, "FREQUENT_MOST", 5)
    monkeypatch.setattr(substring, "SAMPLE_DOCS", sample)
    monkeypatch.setattr(substring, "FREQUENT", 3)
    docs = spark.createDataFrame(texts, DOCS).repartition(5)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.deduplicate(docs).collect()), key=str)
    assert got == brute_substring(texts)


def test_substring_dedup_of_hot_keys_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 20_000)
    rnd = random.Random(15)
    long = prose(rnd, 20_000)
    rows = [(7, prose(rnd, 30)) for _ in range(200)] + [(None, None)] * 50 + [(8, None)] * 50 + [(1, long), (2, long + "x"), (7, long), (3, long[300:9000])]
    done = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in done.collect()), key=str)
    assert got == brute_substring(rows)


def test_substring_dedup_empty_table(spark):
    done = substring.deduplicate(spark.createDataFrame([], DOCS + ", kept int"))
    assert done.count() == 0 and done.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept"]


def test_clashing_columns_keep_their_values(spark, texts):
    docs = spark.createDataFrame(texts, DOCS).withColumns({"_block": F.lit("mine"), "fp": F.lit("x"), "Kept": F.lit(1), "n_chars_": F.lit(2)})
    done = substring.deduplicate(docs)
    assert [c for c in done.columns if c.lower() == "kept"] == ["kept"] and {r["_block"] for r in done.select("_block").collect()} == {"mine"}
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fp", "component_id"]
    pages = spark.createDataFrame([(1, "http://h/a", "<p>x</p>", "mine", "old")], "page_id long, url string, html string, _host string, TEXT string")
    row = htmltext.extract(pages).first()
    assert row.asDict() == {"page_id": 1, "url": "http://h/a", "_host": "mine", "text": "x", "n_chars": 1}
    net = langid.ByteConvNet(["aa"])
    assert langid.identify(docs.withColumn("SCORE", F.lit(5)), net).columns[-2:] == ["lang_pred", "score"]


def test_fm_index_searches():
    rnd = np.random.default_rng(4)
    body = rnd.integers(1, 5, 400)
    sequence = np.concatenate([body[:200], [0], body[200:], [0]])
    index = substring.FmIndex(sequence, 5, 6)
    ends = np.array([e for e in range(6, 200)])
    statistic, lo, hi = index.search(sequence, ends, 6)
    for e, n, a, b in zip(ends, statistic, lo, hi, strict=True):
        places = [i for i in range(len(sequence) - 5) if (sequence[i : i + 6] == sequence[e - 6 : e]).all()]
        if len(places) > 1:
            assert n == 6 and sorted(index.order[a:b]) == places
        else:
            assert n < 6


def brute_simhash(rows: list[tuple]) -> list[tuple]:
    from xxhash import xxh64_intdigest

    fps = []
    for k, t, *_ in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").split()
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
        h = [xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append((k, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = {f: f for _, f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    least = {}
    for k, f in fps:
        if k is not None:
            least[top(f)] = min(k, least.get(top(f), k))
    return sorted(((k, f, least.get(top(f))) for k, f in fps), key=str)


def test_simhash_equals_brute_force(spark, texts):
    rows = [r for r in texts if len(r[1] or "") < 5000] + [(400 + i, texts[12][1] + f" tail{i % 7}", "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS + "")
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_simhash(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "hot"), [(8192, 65536), (20, 160), (20, 30)])
def test_links_of_dense_groups(spark, monkeypatch, block, hot):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(6)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.connected(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    assert {r["node"] % (1 << 64) for r in found.collect()} >= {f for f in fps if f != centre and (f ^ centre).bit_count() <= 3 and centre in fps}
    assert found.select("root").distinct().count() == 1


@pytest.mark.parametrize(("block", "hot"), [(8192, 65536), (16, 24)])
def test_links_within_hot_buckets(spark, monkeypatch, block, hot):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(16)
    # all agree in two groups, so each pair meets in one bucket; chains of three bits cross the others
    fps = {0}
    while len(fps) < 400:
        f = rnd.choice(sorted(fps)) ^ sum(1 << b for b in rnd.sample(range(26, 64), rnd.choice([3, 3, 4, 5])))
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = {r["node"]: r["root"] for r in simhash.connected(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    parent = {f: f for f in signed}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3:
                a_top, b_top = top(a), top(b)
                parent[max(a_top, b_top)] = min(a_top, b_top)
    assert {f: nodes.get(f, f) for f in signed} == {f: top(f) for f in signed}


def test_group_roots_are_components():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 400):
        fps = np.unique(rnd.integers(0, 1 << 13, n, dtype=np.uint64) * np.uint64(0x11001))
        rnd.shuffle(fps)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
        want = np.full(len(fps), -1)
        for i in range(len(fps)):
            front = [i] if want[i] < 0 else []
            while front:
                k = front.pop()
                if want[k] < 0:
                    want[k] = i
                    front += np.flatnonzero(near[k]).tolist()
        assert (simhash.group_roots(fps) == want).all()


def test_near_counts_bits():
    rnd = np.random.default_rng(7)
    fps = rnd.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps[100:] = fps[:100] ^ (np.uint64(1) << rnd.integers(0, 63, 100).astype(np.uint64))
    mask = np.unpackbits(simhash.near(fps, simhash.planes(fps)).view(np.uint8), axis=1, bitorder="little")[:, :200]
    want = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert (mask.astype(bool) == want).all()


def brute_contained(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    out = []
    for k, t in docs:
        words = decontaminate.words_of(t)
        for i, s in sorted(set(items), key=str):
            found = decontaminate.shingles(decontaminate.words_of(s))
            if found:
                n = len(next(iter(found)))
                have = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
                if len(found & have) >= 0.8 * len(found) - 1e-9:
                    out.append((k, i, len(found), len(found & have)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_equals_brute_force(spark, limit):
    rnd = random.Random(8)
    items = [(i, prose(rnd, rnd.choice([1, 3, 4, 5, 6, 20, 50]))) for i in range(30)] + [(90, None), (91, ""), (92, "!!! ---")]
    docs = [(i, prose(rnd, rnd.choice([0, 10, 300]))) for i in range(60)]
    for k in range(0, 60, 2):
        words = (items[k % 30][1]).upper().split()
        if len(words) > 12:
            words[rnd.randrange(len(words))] = "changed"
        docs[k] = (k, prose(rnd, 200) + " " + ", ".join(words) + " " + prose(rnd, 50))
    docs += [(70, None), (71, ""), (0, docs[0][1]), (None, docs[2][1]), (None, docs[2][1])]
    # an item given twice is one, another text under its id is another
    items += [items[0], items[0], (2, items[4][1]), (None, items[6][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit)
    rows = [(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got.collect()]
    want = brute_contained(docs, items)
    assert sorted(rows, key=str) == want and len(want) > 10
    clash = spark.createDataFrame([(1, items[29][1], 3, "n")], "doc_id long, text string, _d int, N_FOUND string")
    assert decontaminate.contaminated(clash, spark.createDataFrame([(29, items[29][1], 1)], "item_id long, text string, h int"),
        broadcast_bytes=limit).count() == 1
    assert decontaminate.contaminated(clash.limit(0), spark.createDataFrame([], "item_id long, text string"), broadcast_bytes=limit).count() == 0


def test_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in np.float32(rnd.normal(0, 0.2, 20))]) for i in range(350)]
    vectors[5] = (5, vectors[200][1])
    rows = vectors + [(400, None), (401, [1.0, None] + [0.0] * 18), (402, [float("nan")] * 20), (403, []), (404, [0.5, 0.5]), (None, vectors[3][1]),
        (7, vectors[7][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 100 == 0, shards=5).collect()
    whole = {k: np.floor(1024 * np.asarray(v, np.float64)).astype(np.int64) for k, v in vectors}
    want = []
    for q in (0, 100, 200, 300):
        best = sorted(((-int(whole[q] @ v), k) for k, v in whole.items() if k != q))[:10]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_license_scan(spark):
    def brute(t):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x00", " ")]
        import re

        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(words))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        return len(words), sorted(i for i, _ in places), ",".join(sorted({x for _, x in places}))

    rows = [
        "Released under the MIT License.", "GNU General\nPublic-License and mit license mit license", "licensed under CC BY-NC 4.0. cc by",
        "no licence", "", None,
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nx",
        "SPDX-License-Identifier: MIT AND (",
        "summit license mit licenses", "é mit license" * 3, "MIT LICENSE", "apache license " * 500,
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs, with_places=True).collect()}
    for k, t in enumerate(rows):
        n, places, labels = brute(t)
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), places[0] if places else None,
            places[-1] if places else None, labels), t
        assert 0 <= r["score"] <= 1
    assert got[6]["labels"] == "apache,bsd,mit" and got[7]["labels"] == "gpl" and got[8]["score"] < 1 and got[2]["labels"] == "cc-by,cc-by-nc"
    value = lambda k: (got[k]["required"], got[k]["choices"])
    assert value(6) == ("bsd", "apache,mit") and value(7) == ("gpl", "") and value(0) == ("mit", "") and value(4) == value(5) == value(8) == ("", "")
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_values_equal_all_choices(spark):
    """Random expressions against the list of every way to choose: what binds is in all of them."""
    draw = random.Random(4)
    names = {"MIT": "mit", "Apache-2.0": "apache", "GPL-3.0-only": "gpl", "BSD-2-Clause": "bsd", "ISC": "isc", "LGPL-2.1+": "lgpl"}

    def make(depth):
        """An expression, its ways, and the binding strength of its outermost operator."""
        if depth == 0 or draw.random() < 0.25:
            name = draw.choice(list(names))
            if draw.random() < 0.2:
                return f"{name} WITH x-exception", [{names[name]}], 3
            return name, [{names[name]}], 4
        op, strength = draw.choice((("OR", 1), ("and", 2)))
        sides = [make(depth - 1), make(depth - 1)]
        texts = [f"({t})" if s < strength or draw.random() < 0.3 else t for t, _, s in sides]
        (_, a, _), (_, b, _) = sides
        return f"{texts[0]} {op} {texts[1]}", a + b if op == "OR" else [x | y for x in a for y in b], strength

    made = [make(draw.randrange(5)) for _ in range(300)]
    docs = spark.createDataFrame([(k, f"x\n# SPDX-License-Identifier: {t}\ny") for k, (t, _, _) in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["required"], r["choices"]) for r in licenses.scan_licenses(docs).collect()}
    for k, (t, ways, _) in enumerate(made):
        every, binding = set().union(*ways), set.intersection(*ways)
        assert got[k] == tuple(",".join(sorted(x)) for x in (every, binding, every - binding)), t
    two = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT OR ISC\nSPDX-License-Identifier: ISC\nall under the Apache License")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan_licenses(two).select("labels", "required", "choices").collect()] == [("apache,isc,mit", "apache,isc", "mit")]


def test_long_license_texts_are_linear(spark):
    import time

    text = "mit license and more words, " * 200_000
    docs = spark.createDataFrame([(1, text, 5, "x")], "doc_id long, text string, N_WORDS int, labels string")
    began = time.time()
    row = licenses.scan_licenses(docs).first()
    assert (row["n_base"], row["first_word"], row["last_word"]) == (200_000, 0, 5 * 199_999) and row["n_words"] == 1_000_000
    assert time.time() - began < 20 and licenses.scan_licenses(docs).columns.count("labels") == 1


def test_license_expressions():
    assert licenses.evaluate("MIT OR Apache-2.0") == ({"mit", "apache"}, frozenset())
    assert licenses.evaluate("MIT AND Apache-2.0") == ({"mit", "apache"}, {"mit", "apache"})
    assert licenses.evaluate("MIT OR GPL-2.0 AND BSD-2-Clause")[1] == frozenset()
    assert licenses.evaluate("(MIT OR ISC) AND GPL-3.0 WITH x-exception")[1] == {"gpl"}
    for bad in ("", "AND MIT", "MIT OR", "(MIT", "MIT)", "()"):
        assert licenses.evaluate(bad) is None, bad


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
<div class="ad">Buy</div>{open}<h1>A &amp; B</h1><p><b>One  two<br>three<p>Four &am five&nbsp;six</p><script>var x="</p>";</script>{close}
<div class="comments"><p>I disagree</p></div><footer>&copy; me</footer></body></html>"""


def test_html_extract(spark):
    article = PAGE.format(open="<article>", close="</article>")
    bare = PAGE.format(open="<div>", close="<p>Same on all</p></div>")
    other = bare.replace("One  two", "Uno").replace("Four", "Cuatro").replace("A &amp; B", "C")
    rows = [(1, "http://h.org/a/1", article), (2, "http://g.org/a/1", bare), (3, "http://g.org/a/2", other), (4, None, None),
        (5, "http://h.org/x", ""), (6, "x", "plain & text"), (1, "http://h.org/a/1", article)]
    got = defaultdict(list)
    for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    want = "A & B\n\nOne two three\n\nFour &am five six"
    assert got[1] == [want] * 2 and got[2] == [want] and got[3] == ["C\n\nUno three\n\nCuatro &am five six"]
    assert got[4] == [""] and got[5] == [""] and got[6] == ["plain & text"]


def test_language_id(spark):
    rnd = random.Random(10)
    say = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    kinds = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["été", "forêt", "çà"], "cc": ["über", "straße", "und"]}
    rows = [(i, say(kinds[k], rnd.randint(3, 200)), k) for i in range(300) for k in [rnd.choice(list(kinds))]]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "lorem", None)], "doc_id long, text string, lang string")
    net = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.identify(docs, net).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows) >= 295
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(docs.limit(0)).classes == ["und"]
    again = langid.ByteConvNet.load(net.dump())
    x = np.random.default_rng(0).integers(0, 127, (5, 256)).astype(np.uint8)
    assert np.allclose(again.apply(x), net.apply(x))


def test_network_tables_equal_plain_convolution():
    net = langid.ByteConvNet(["a", "b"])
    x = np.random.default_rng(1).integers(0, 127, (7, 64)).astype(np.uint8)
    pooled = []
    for conv, bias in zip(net.conv, net.bias, strict=True):
        w = len(conv)
        pooled.append(np.maximum(sum(conv[j][x[:, j : 64 - w + 1 + j].astype(int)] for j in range(w)).max(1) + bias, 0))
    z = np.concatenate(pooled, 1) @ net.dense + net.shift
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(net.apply(x), want, atol=1e-5)


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\b \\l \\s \\\\ < [", "", "plain\n\ttext", "日本 <|end|>", "\\"]
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c in range(3) for i, t in enumerate(hard)] + [(9, 0, None, None)]
    events = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.col("turn"), "kind": F.lit("message")})
    done = chat.format_chats(events.repartition(4))
    for r in chat.read_back(done).collect():
        want = sorted((t, role or "", s or "") for c, t, role, s in rows if c == r["conv_id"])
        assert [(m["role"], m["text"], m["masked"]) for m in r["turns"]] == [(role, s, role == "assistant") for _, role, s in want]
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"] and r["formatted"].count("<|end|>") == len(want)
    assert chat.format_chats(events.limit(0)).count() == 0


def test_chat_folds_events(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, "assistant", "hel"),
        (1, 4, "delta", 1, "assistant", "lo"),
        (1, 5, "message", 2, "user", "more"), (1, 6, "edit", 0, "user", "hey"), (1, 7, "regenerate", 1, "assistant", "ho"),
        (1, 8, "delta", 1, "assistant", "!"),
        (2, 1, "delta", 0, "assistant", "a"), (2, 2, None, 1, "user", None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in chat.reconstruct(events).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "ho!")], 2: [("assistant", "a"), ("user", "")]}


@pytest.mark.parametrize("key", ["null", "7", "null and one text"])
def test_language_rows_without_keys_teach(spark, key):
    rows = [(None if "null" in key else 7, f"lorem ipsum {i if 'one' not in key else ''} dolor", "aa") for i in range(3000)]
    rows += [(None, f"forêt été {i}", "bb") for i in range(50)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs=60)
    assert net.classes == ["aa", "bb"]
    told = langid.identify(spark.createDataFrame([(1, "lorem dolor ipsum"), (2, "été forêt"), (3, None), (3, None)], "doc_id long, text string"), net)
    assert sorted((r["doc_id"], r["lang_pred"]) for r in told.collect()) == [(1, "aa"), (2, "bb"), (3, "und"), (3, "und")]


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12", "aa"), (3, None, "aa")], "doc_id long, text string, lang string")
    net = langid.train(docs)
    assert net.classes == ["und"] and {r["lang_pred"] for r in langid.identify(docs, net).collect()} == {"und"}
    assert langid.train(docs.limit(0)).classes == ["und"]


def test_language_accuracy_on_held_out_documents(spark):
    import os

    from codemass.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("the given tables are not here")
    told = queries.op9_language_id(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = told.where("lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97, (right, n)
