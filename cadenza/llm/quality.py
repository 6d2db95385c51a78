"""Text quality by a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Boosting goes round the features in a cycle; at each it fits
a tree of two splits on that feature alone to the gradient of the log-loss and adds a small part of it to
the feature's lookup table. Then the pairs whose joint bins explain most of what is left get tables in the
same way, by trees of one split per side. A score is the sigmoid of the sum of the tables' entries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes", "letters", "capitals", "digits", "symbols", "word_bytes", "distinct_words", "repeated_next",
    "distinct_lines", "line_words", "top_word", "marked_words", "deflated", "ended_lines",
)
_ASCII = np.zeros((4, 256))
_ASCII[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_ASCII[1, range(65, 91)] = 1
_ASCII[2, range(48, 58)] = 1
_ASCII[3, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()"]] = 1
_PLAIN = frozenset(b".,;:'\"-?()")
#: Bytes that the compression feature looks at together.
WINDOW = 1 << 16


def text_features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``; all 0 for an empty or null one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, many = len(raw), len(words)
    letters, capitals, digits, symbols = (_ASCII @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    lines = [x for x in raw.split(b"\n") if x]
    different = len(set(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    marked = sum(n for w, n in counts.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1] in _PLAIN))
    deflated = sum(len(zlib.compress(raw[i : i + WINDOW], 1)) for i in range(0, size, WINDOW))
    return [
        float(np.log1p(size)), letters / size, capitals / max(1.0, letters), digits / size, symbols / size,
        sum(map(len, words)) / many, different / many,
        sum(map(bytes.__eq__, words, words[1:])) / many, len(set(lines)) / len(lines), many / len(lines),
        max(counts.values()) / many, marked / many, deflated / size,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
    ]


@dataclass
class Model:
    """Bin edges, one lookup table per feature, coarse cuts and tables of the pairs, and the base score."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1 of rows of features: look up bins, add, squash."""
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins):
            total += table[b]
        for (i, j), table in self.pairs.items():
            total += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _leaf(g: float | np.ndarray, h: float | np.ndarray) -> float | np.ndarray:
    return g / (h + 1.0)


def _two_splits(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of the best tree of up to two splits over ordered bins."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            right_g, right_h = g[a:b].sum() - left_g, h[a:b].sum() - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), (a, b), a + at + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of the best tree that splits both features of a pair once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    all_g, all_h = cg[-1, -1], ch[-1, -1]
    ll = (cg[:-1, :-1], ch[:-1, :-1])
    lr = (cg[:-1, -1:] - ll[0], ch[:-1, -1:] - ll[1])
    rl = (cg[-1:, :-1] - ll[0], ch[-1:, :-1] - ll[1])
    rr = (all_g - ll[0] - lr[0] - rl[0], all_h - ll[1] - lr[1] - rl[1])
    gain = sum(a**2 / (b + 1) for a, b in (ll, lr, rl, rr))
    values = np.zeros_like(g)
    if gain.size:
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        for part, rows, cols in ((ll, slice(0, i + 1), slice(0, j + 1)), (lr, slice(0, i + 1), slice(j + 1, None)),
                                 (rl, slice(i + 1, None), slice(0, j + 1)), (rr, slice(i + 1, None), slice(j + 1, None))):
            values[rows, cols] = _leaf(part[0][i, j], part[1][i, j])
    return values


def boost(
    x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, n_pairs: int = 6, cuts: int = 8
) -> Model:
    """Fits a model to features and 0/1 labels; without both labels it is constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], base=float(np.log(share / (1 - share))))
    model.coarse = [np.arange(len(e) + 1) * min(cuts, len(e) + 1) // (len(e) + 1) for e in edges]
    if len(np.unique(y)) < 2:
        return model
    binned = model.bins(x)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, b in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[j])
            step = rate * _two_splits(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n))
            model.tables[j] += step
            total += step[b]

    p = 1 / (1 + np.exp(-total))
    sides = [model.coarse[j][b] for j, b in enumerate(binned)]
    wide = [int(c.max()) + 1 for c in model.coarse]
    cell = {(i, j): sides[i] * wide[j] + sides[j] for i, j in combinations(range(x.shape[1]), 2)}
    shape = {(i, j): (wide[i], wide[j]) for i, j in cell}
    grid = lambda pair, v: np.bincount(cell[pair], v, shape[pair][0] * shape[pair][1]).reshape(shape[pair])
    strength = {k: float((grid(k, y - p) ** 2 / (grid(k, p * (1 - p)) + 1)).sum()) for k in cell}
    for pair in sorted(strength, key=lambda k: (-strength[k], k))[:n_pairs]:
        model.pairs[pair] = np.zeros(shape[pair])
    for _ in range(rounds // 3):
        for pair in model.pairs:
            p = 1 / (1 + np.exp(-total))
            step = rate * _quadrants(grid(pair, y - p), grid(pair, p * (1 - p)))
            model.pairs[pair] += step
            total += step[sides[pair[0]], sides[pair[1]]]
    return model


def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", max_rows: int = 20_000) -> Model:
    """Learns ``label`` from (doc_id, text) and labels (doc_id, label) where ``training`` holds.

    About ``max_rows`` labelled documents are used, drawn by a hash of their id; their features, and
    nothing else of them, reach the driver. Null labels are ignored; a document labelled more than once
    counts with its largest label. Without labels the model is constant.
    """
    known = labels.where(training & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("y")
    )
    chance = max_rows / max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < chance)
    # The draw has about max_rows rows, so every task can hold it.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "y").mapInArrow(each, f"doc_id {kind}, y int, x array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return boost(x, got.column("y").to_numpy().astype(float))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold); columns of these names are replaced.

    Scores the whole of column text alone; null texts count as empty and are scored like any other.
    Repeated rows stay, an empty table gives no rows, all other columns pass through.
    """
    # Plain lists and arrays: a broadcast names classes by their module, which workers may lack.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**shared.value)
        for texts in batches:
            x = np.array([text_features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.array(model.scores(x), pa.float64())

    # Only texts go to Python and only scores come back; the other columns stay in one struct and cannot clash.
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(F.struct(*kept).alias("row"), F.arrow_udf(each, "double")(F.col("text")).alias("score"))
    return scored.select(*[F.col("row")[c].alias(c) for c in kept], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """Learns from the labels that are not held out and scores all rows of ``docs``."""
    return score_documents(docs, fit(docs, labels, ~held_out(F.col("doc_id")), max_rows=max_rows), threshold)
