"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes map to a small alphabet (letters without case, bytes beyond ASCII, one class for white space and one for the
rest).  Filters of widths 2, 3 and 4 run over fixed-length windows, are pooled by their maximum over the window, and a
softmax layer gives the window's class.  A document's answer is the mean over all its windows, so over its whole text.

Once trained, a filter's answer depends on at most four symbols, so the answers over pairs are tabled: a wider filter
is the sum of two tables' rows.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemass.llm import text as X
from codemass.llm.frames import append_columns

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The bound of the training sample: documents of each language, and windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
UNKNOWN = "und"
#: Bytes of a long text that are looked at together; whole windows.
SLICE = WINDOW << 12


def _alphabet() -> np.ndarray:
    """Byte to symbol: 0 pads, 1 white space, 2 other ASCII signs, then a-z, then each byte beyond ASCII."""
    to = np.full(256, 2, np.uint8)
    to[[0x20, *range(0x09, 0x0E)]] = 1
    to[0x61:0x7B] = to[0x41:0x5B] = np.arange(3, 29)
    to[0x80:0xC0] = np.arange(29, 93)
    to[0xC0:] = 93 + (np.arange(64) % 34)
    return to


ALPHABET, SYMBOLS = _alphabet(), 127


def has_letter(text: str) -> bool:
    """Whether any character is a letter: numbers, marks and signs that stand for letters are none."""
    return any(map(str.isalpha, text))


def windows(raw: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of every window (one a row of the matrix, padded) and the number of windows of each text."""
    lengths = np.diff(offs)
    count = -(-lengths // size)
    out = np.zeros((int(count.sum()), size), np.uint8)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(raw)) - offs[:-1][row]
    base = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
    out[base[row] + at // size, at % size] = ALPHABET[raw]
    return out, count


class ByteConvNet:
    """Multi-width byte filters, max pooling, softmax.  Weights: one (width, SYMBOLS, FILTERS) array a width."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.conv = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0] = 0
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross-entropy of labelled windows."""
        rng = np.random.default_rng(seed)
        weights = [*self.conv, *self.bias, self.dense, self.shift]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                step += 1
                for w, g, m, v in zip(weights, self._gradients(x[rows].astype(np.int64), y[rows]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, size = x.shape
        pooled, peaks = [], []
        for conv, bias in zip(self.conv, self.bias, strict=True):
            width = len(conv)
            act = sum(conv[j][x[:, j : size - width + 1 + j]] for j in range(width)) + bias
            peak = act.argmax(1)
            peaks.append(peak)
            pooled.append(np.maximum(np.take_along_axis(act, peak[:, None], 1)[:, 0], 0))
        hidden = np.concatenate(pooled, 1)
        p = _softmax(hidden @ self.dense + self.shift)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.dense.T) * (hidden > 0)
        g_conv, g_bias = [], []
        for k, conv in enumerate(self.conv):
            g, part = np.zeros_like(conv), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(conv)):
                symbols = np.take_along_axis(x, peaks[k] + j, 1)
                np.add.at(g[j], (symbols, np.arange(FILTERS)[None, :]), part)
            g_conv.append(g)
            g_bias.append(part.sum(0))
        return [*g_conv, *g_bias, hidden.T @ p, p.sum(0)]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width: answers over symbol pairs, and those that the symbols after the pair add."""
        pair = [(c[0][:, None] + c[1][None, :]).reshape(-1, FILTERS) for c in self.conv]
        more = [None if len(c) == 2 else c[2] if len(c) == 3 else (c[2][:, None] + c[3][None, :]).reshape(-1, FILTERS) for c in self.conv]
        return list(zip(pair, more, strict=True))

    def apply(self, x: np.ndarray, tables: list | None = None, rows: int = 256) -> np.ndarray:
        """Class probabilities of each window."""
        tables = tables or self.tables()
        out = np.zeros((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), rows):
            part = x[at : at + rows].astype(np.int32)
            size = part.shape[1]
            pairs = part[:, :-1] * SYMBOLS + part[:, 1:]
            pooled = []
            for (pair, more), bias, width in zip(tables, self.bias, WIDTHS, strict=True):
                act = pair[pairs[:, : size - width + 1]]
                if width == 3:
                    act += more[part[:, 2:]]
                elif width == 4:
                    act += more[pairs[:, 2:]]
                pooled.append(np.maximum(act.max(1) + bias, 0))
            out[at : at + rows] = _softmax(np.concatenate(pooled, 1) @ self.dense + self.shift)
        return out

    def dump(self) -> bytes:
        """The weights as bytes (a few hundred KB, whatever the corpus)."""
        out = io.BytesIO()
        np.savez(out, classes=np.array(self.classes), dense=self.dense, shift=self.shift, **{f"c{i}": c for i, c in enumerate(self.conv)},
            **{f"b{i}": b for i, b in enumerate(self.bias)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ByteConvNet:
        """The network of dumped weights."""
        z = np.load(io.BytesIO(data))
        net = cls([str(c) for c in z["classes"]])
        net.conv, net.bias = [z[f"c{i}"] for i in range(len(WIDTHS))], [z[f"b{i}"] for i in range(len(WIDTHS))]
        net.dense, net.shift = z["dense"], z["shift"]
        return net


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(labelled: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", docs: int = SAMPLE_DOCS) -> ByteConvNet:
    """A network fitted on at most ``docs`` documents of each label, those of least hashed key and text.

    The sample is bounded, so only it goes to the driver: SAMPLE_WINDOWS windows spread over each sampled text.
    Rows with null text or label, or text without letters, teach nothing.  Rows of null or repeated keys are drawn by their
    text; rows of one key and text are alike and drawn together.  Without any labelled row the network has the single class ``und``.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    size = F.length(F.col(text))
    spread = F.array(*[
        F.encode(F.substring(F.col(text), (F.lit(1) + F.floor(F.greatest(size - WINDOW, F.lit(0)) * i / max(1, SAMPLE_WINDOWS - 1))).cast("int"),
                    F.lit(WINDOW)), "utf-8")
        for i in range(SAMPLE_WINDOWS)
    ])
    # the text takes part, so that rows without a key, or of one key, are drawn one by one
    order = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("language sample"))
    # a pass over the labels gives each one's chance; the texts are read again for the few that are drawn
    least = usable.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    counts = {r["_l"]: r["_n"] for r in least.collect()}
    if not counts:
        return ByteConvNet([UNKNOWN])
    chance = F.lit(0.0)
    for name, n in counts.items():
        chance = F.when(F.col(label) == name, F.lit(min(1.0, 1.5 * docs / n))).otherwise(chance)
    unit = (F.shiftrightunsigned(order, 11).cast("double")) / float(1 << 53)
    told = usable.select(F.col(label).alias("label"), order.alias("o"), unit.alias("u"), chance.alias("c"), spread.alias("w"))
    rows = told.where("u < c").drop("u", "c").orderBy("o", "label").limit(2 * docs * len(counts)).collect()
    # copies are drawn together or not at all: labels that went without are drawn by least hash
    for name in sorted(set(counts) - {r["label"] for r in rows}):
        rows += told.where(F.col("label") == name).drop("u", "c").orderBy("o").limit(docs).collect()
    classes = sorted(counts)
    taken = dict.fromkeys(classes, 0)
    xs, ys = [], []
    for r in rows:
        if taken[r["label"]] >= docs:
            continue
        taken[r["label"]] += 1
        for w in r["w"]:
            raw = np.frombuffer(bytes(w)[:WINDOW], np.uint8)
            x = np.zeros(WINDOW, np.uint8)
            x[: len(raw)] = ALPHABET[raw]
            xs.append(x)
            ys.append(classes.index(r["label"]))
            short = np.zeros(WINDOW, np.uint8)  # short texts occur as well
            short[: min(len(raw), 48)] = ALPHABET[raw[:48]]
            xs.append(short)
            ys.append(classes.index(r["label"]))
    net = ByteConvNet(classes)
    net.fit(np.stack(xs), np.array(ys))
    return net


_NETS: dict[str, tuple[ByteConvNet, list]] = {}


def identify(docs: DataFrame, net: ByteConvNet, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, the mean probability of that language over all windows).

    A null text, or one without any letter (Unicode category L), gets ``und`` and score 0.  A row in, a row out; no shuffle.
    A long text is walked in slices of SLICE bytes, so its windows take no memory that grows with it.
    Input columns with a result's name are replaced.
    """
    weights = net.dump()
    name = hashlib.sha256(weights).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        mine = _NETS.get(name)
        if mine is None:
            loaded = ByteConvNet.load(shared.value)
            _NETS.clear()
            mine = _NETS[name] = (loaded, loaded.tables())
        loaded, tables = mine
        column = batch.column(batch.schema.get_field_index(text))
        pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        for r0, r1, raw, offs in X.chunks(column, 1 << 20):
            if not len(raw):
                continue
            # texts share a chunk only where they are short together
            cuts = [(0, len(raw))] if r1 - r0 > 1 else [(a, min(a + SLICE, len(raw))) for a in range(0, len(raw), SLICE)]
            sums, total = np.zeros((r1 - r0, len(loaded.classes))), np.zeros(r1 - r0, np.int64)
            for a, b in cuts:
                x, count = windows(raw[a:b], offs if len(cuts) == 1 else np.array([0, b - a]))
                p = loaded.apply(x, tables)
                ends = np.cumsum(count)
                for i in np.flatnonzero(count):
                    sums[i] += p[ends[i] - count[i] : ends[i]].sum(0)
                total += count
            for i in np.flatnonzero(total):
                if has_letter(column[r0 + i].as_py()):
                    mean = sums[i] / total[i]
                    best = int(mean.argmax())
                    pred[r0 + i], score[r0 + i] = loaded.classes[best], min(1.0, float(mean[best]))
        return [pa.array(pred, pa.string()), pa.array(score)]

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], run)


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2
