"""How full packed sequences are, and that cut pieces keep every id once."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from codemass.llm import packing

HISTOGRAMS = {
    "10": {10: 100_000}, "100": {100: 50_000}, "1500": {1500: 10_000}, "2000": {2000: 10_000}, "1..60": {n: 1000 for n in range(1, 61)},
    "2100..2600": {n: 20 for n in range(2100, 2601)}, "hundreds and tens": {100: 1000, 10: 10}, "4000": {4000: 500}, "3000": {3000: 777, 2999: 1},
    "all": {n: 1 + n % 7 for n in range(1, 4097)}, "steep": {n: int(1e9 / n**2) + 1 for n in range(1, 4097)},
}


def checked(histogram: dict[int, int], capacity: int = 4096) -> tuple[np.ndarray, float]:
    """Slots that hold each piece's ids once and gapless sequences; how full those are."""
    packs = packing.filled(packing.patterns(histogram, capacity), capacity)
    rows = packing.slots(packs)
    held: dict[int, list] = defaultdict(list)
    for length, a, b, start, size, _, _ in rows.tolist():
        held[length].append((a, b, start, size))
    for length, n in histogram.items():
        assert sum((b - a) * size for a, b, _, size in held[length]) == n * length
        for rank in {r for a, b, _, _ in held[length] for r in (a, b - 1)}:
            parts = sorted((s, z) for a, b, s, z in held[length] if a <= rank < b)
            assert parts[0][0] == 0 and sum(z for _, z in parts) == length
            assert all(s + z == t for (s, z), (t, _) in zip(parts, parts[1:], strict=False))
    for p in packs:
        assert p.copies > 0 and sum(size for *_, size in p.held) + p.room == capacity and p.room >= 0
    used = sum(n * length for length, n in histogram.items())
    return rows, used / (capacity * sum(p.copies for p in packs))


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_fill(name):
    rows, fill = checked(HISTOGRAMS[name])
    assert fill > 0.95, fill
    assert len(rows) < 100_000


def test_fill_of_random_histograms():
    rnd = random.Random(4)
    for _ in range(60):
        capacity = rnd.choice([64, 256, 1000, 4096])
        histogram = {rnd.randint(1, capacity): rnd.randint(1, 5000) for _ in range(rnd.randint(1, 40))}
        _, fill = checked(histogram, capacity)
        assert fill > 0.85


def test_cut_pieces_keep_their_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["red", "green", "blue", "straße", "x9"]) for _ in range(rnd.choice([50, 51, 52, 150])))) for i in range(300)]
    rows += [(None, rows[0][1])] * 3 + [(7, rows[1][1])] * 2 + [(400, None), (401, "")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, LENGTH string, offset int, _row long").repartition(4)
    found = packing.pack(docs, path, capacity=128).collect()
    assert [f for f in found[0].asDict()] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    of, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        of[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 128
    words = packing.word_tokens(path)
    for k, t in rows:
        if k not in (None, 7):
            want = words.ids(t or "") + np.asarray([2], "<u4").tobytes()
            assert b"".join(p for _, p, _ in sorted(of[k])) == want and all(n == len(want) // 4 for *_, n in of[k])
    assert sum(len(p) for parts in of.values() for _, p, _ in parts) == sum(len(words.ids(t or "")) + 4 for _, t in rows)
    assert sum(r["length"] for r in found) / (128 * len(sequences)) > 0.93
    assert any(r["start"] % 128 for r in found)  # some piece was cut for the room
    lean = packing.pack(docs, path, capacity=128, with_ids=False).collect()
    key = lambda r: (r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, lean)) == sorted(map(key, found))
