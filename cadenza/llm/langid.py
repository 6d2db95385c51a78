"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. A context gives a byte it has seen the
share count / (n + q) of its n observations, q being its number of different bytes, and leaves q / (n + q)
for an escape to the next shorter context, where the bytes already ruled out are excluded; below the empty
context all 256 bytes are equally likely. Statistics are frozen after training, so the code length of a
byte depends on its context alone, and the cost of a text under every language is a sum of code lengths,
exact in units of 2**-10 bits. What the exclusion leaves of the shorter context is a factor that the
context has once and for all, so a tree is a few sorted arrays; for the contexts met most often a table
has the code lengths of all bytes and languages ready.

A pass over the texts holds the trees of a few languages. Where there are more, one pass follows another
and carries the best language so far, so neither the driver nor a task holds more than a pass needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

UNIT = 1024
#: Bytes scored at a time.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Contexts of two and of three bytes whose code lengths are kept ready; the others are worked out.
READY = 8192
#: Languages and counts that a pass holds at most; a language of more counts has a pass of its own.
LANGUAGES, COUNTS = 16, 4_000_000


def _low(order: int) -> int:
    """Mask of the last ``order`` bytes of a context and the byte after them."""
    return (1 << 8 * (order + 1)) - 1


class Tree:
    """One language: per order the byte contexts with a byte after each, their shares, and what an escape is worth."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        seen = np.zeros(256, bool)
        seen[grams & 255] = True
        self.grams, self.shares, self.contexts, self.escapes, self.weights = [], [], [], [], []
        usable = np.ones(len(grams), bool)
        for order in range(4):
            if order:  # bytes that never follow one are those before a text's start
                usable = usable & seen[(grams >> 8 * order) & 255]
            keys, which = np.unique(grams[usable] & _low(order), return_inverse=True)
            counts = np.bincount(which, n[usable], len(keys))
            contexts, first, different = np.unique(keys >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            owner = np.repeat(np.arange(len(contexts)), different)
            below = self.probabilities(order - 1, keys)
            room = 1 - (np.add.reduceat(below, first) if len(first) else np.zeros(0))
            self.grams.append(keys)
            self.shares.append(counts / (total + different)[owner])
            self.contexts.append(contexts)
            self.escapes.append(different / (total + different) / np.maximum(room, 1e-12))
            self.weights.append(total)

    def probabilities(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram after the ``order`` bytes before it."""
        if order < 0:
            return np.full(len(grams), 1 / 256)
        found, at = _find(self.grams[order], grams & _low(order))
        out = np.where(found, self.shares[order][at] if len(self.shares[order]) else 0.0, 0.0)
        rest = grams[~found]
        if len(rest):
            out[~found] = self.escape(order, (rest & _low(order)) >> 8) * self.probabilities(order - 1, rest)
        return out

    def escape(self, order: int, contexts: np.ndarray) -> np.ndarray:
        found, at = _find(self.contexts[order], contexts)
        return np.where(found, self.escapes[order][at] if len(self.escapes[order]) else 1.0, 1.0)


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``wanted`` is among the sorted ``values``, and where."""
    if not len(values):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return values[at] == wanted, at


def _units(probabilities: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log2(np.maximum(probabilities, 2.0**-60)) * UNIT), 65535).astype(np.uint16)


@dataclass
class Model:
    """Frozen statistics of some languages: class of each byte, table row of each context, whether a longer
    one is known that the table lacks, code lengths (row, class, language), and the trees."""

    languages: list[str]
    classes: np.ndarray
    rows: np.ndarray
    longer: np.ndarray
    costs: np.ndarray
    trees: list[Tree]

    def parts(self) -> dict:
        """Plain lists and arrays, which a worker reads without this package: broadcasts name classes by their module."""
        return {**vars(self), "trees": [vars(t) for t in self.trees]}

    @staticmethod
    def of(parts: dict) -> Model:
        trees = [Tree.__new__(Tree) for _ in parts["trees"]]
        for tree, lists in zip(trees, parts["trees"]):
            vars(tree).update(lists)
        return Model(**{**parts, "trees": trees})


@dataclass
class Learned:
    """Counts (lang, gram, n) of all languages, as a stored table, and the languages of each pass."""

    passes: list[list[str]]
    grams: DataFrame | None

    def models(self) -> Iterator[Model]:
        for languages in self.passes:
            mine = self.grams.where(F.col("lang").isin(languages))
            code = (F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1).cast("int")
            table = mine.select(code.alias("code"), "gram", "n").toArrow()
            yield build(languages, *(table.column(c).to_numpy().astype(np.int64) for c in ("code", "gram", "n")))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each starts."""
    starts = np.concatenate(([0], np.cumsum([len(x) for x in texts])[:-1])).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def _contexts(symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The symbol one, two and three places before each; 0 before the start of a text."""
    out = []
    for back in (1, 2, 3):
        x = np.zeros_like(symbols)
        x[back:] = symbols[:-back] if len(symbols) > back else symbols[:0]
        for step in range(back):
            at = starts + step
            x[at[at < len(x)]] = 0
        out.append(x)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each byte follows each three bytes, of (lang, text).

    A gram packs the three bytes, oldest highest, and the byte after them; bytes before a text's start
    are 0.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}

        def counted(lang: str) -> pa.RecordBatch:
            data, starts = _joined(waiting.pop(lang))
            one, two, three = (x.astype(np.int64) for x in _contexts(data, starts))
            grams, n = np.unique((three << 24) | (two << 16) | (one << 8) | data, return_counts=True)
            langs = pa.array([lang] * len(grams), pa.string())
            return pa.RecordBatch.from_arrays([langs, pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if raw:
                    waiting.setdefault(lang, []).append(raw)
                    if sum(map(len, waiting[lang][-64:])) > BLOCK or len(waiting[lang]) >= 512:
                        yield counted(lang)
        for lang in list(waiting):
            yield counted(lang)

    counted = docs.select("lang", "text").mapInArrow(each, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, training: Column, docs_per_language: int = 2000) -> Learned:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that ``training`` marks and whose lang is not null.

    About ``docs_per_language`` whole documents of every language are used, drawn by a hash of their id;
    all their contexts count. Without any such row there are no languages.
    """
    usable = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("docs"))  # one row for each language
    # A hash for this draw alone; the ids of training rows already share a remainder of another.
    chance = F.pmod(F.xxhash64(F.lit("languages"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(F.broadcast(sizes), "lang").where(chance < docs_per_language / F.col("docs"))
    grams = stored(count_grams(drawn))
    passes: list[list[str]] = []
    held = 0
    for lang, many in sorted((r["lang"], r["many"]) for r in grams.groupBy("lang").agg(F.count("*").alias("many")).collect()):
        if not passes or len(passes[-1]) >= LANGUAGES or held + many > COUNTS:
            passes.append([])
            held = 0
        passes[-1].append(lang)
        held += many
    return Learned(passes, grams)


def build(languages: list[str], code: np.ndarray, grams: np.ndarray, n: np.ndarray, ready: int | None = None) -> Model:
    """Turns counts into trees and the table of the ``ready`` most frequent contexts of two and three bytes."""
    ready, many = READY if ready is None else ready, len(languages)
    trees = [Tree(grams[code == i], n[code == i]) for i in range(many)]
    seen = np.unique(grams & 255)
    size = len(seen) + 1
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, size)  # class 0: bytes never seen, and before the start

    def frequent(order: int) -> np.ndarray:
        contexts = np.concatenate([t.contexts[order] for t in trees])
        known, which = np.unique(contexts, return_inverse=True)
        weight = np.bincount(which, np.concatenate([t.weights[order] for t in trees]), len(known))
        return known[np.sort(np.argsort(-weight, kind="stable")[: ready if order > 1 else None])]

    def place(contexts: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(contexts), np.int64)
        for k in range(order):
            out += classes[(contexts >> 8 * k) & 255] * size**k
        return out

    chosen = [frequent(order) for order in range(4)]
    chosen[2] = np.union1d(chosen[2], chosen[3] & 0xFFFF)
    starts = np.cumsum([0, *[len(x) for x in chosen]])
    costs = np.empty((starts[-1], size, many), np.uint16)
    for i, tree in enumerate(trees):
        lower = np.full((1, size), 1 / 256)
        for order, contexts in enumerate(chosen):
            suffix = np.searchsorted(chosen[order - 1], contexts & (1 << 8 * (order - 1)) - 1) if order > 1 else np.zeros(len(contexts), np.int64)
            table = tree.escape(order, contexts)[:, None] * lower[suffix]
            inside, row = _find(contexts, tree.grams[order] >> 8)
            table[row[inside], classes[tree.grams[order][inside] & 255]] = tree.shares[order][inside]
            costs[starts[order] : starts[order + 1], :, i] = _units(table)
            lower = table
    rows, longer = np.zeros(1, np.int32), np.zeros(1, bool)
    for order in range(1, 4):
        rows, longer = np.tile(rows, size), np.tile(longer, size)
        here = place(chosen[order], order)
        longer[place(np.concatenate([t.contexts[order] for t in trees]), order)] = True
        longer[here] = False
        rows[here] = starts[order] + np.arange(len(here))
    return Model(languages, classes.astype(np.uint8 if size <= 256 else np.int16), rows, longer, costs, trees)


def _costs(model: Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code lengths of every byte (row) under every language (column)."""
    size = model.costs.shape[1]
    symbols = model.classes[data].astype(np.int32)
    one, two, three = _contexts(symbols, starts)
    context = (three * size + two) * size + one
    out = model.costs[model.rows[context], symbols]
    at = np.flatnonzero(model.longer[context])
    if len(at):
        one, two, three = (x[at].astype(np.int64) for x in _contexts(data, starts))
        grams, which = np.unique((three << 24) | (two << 16) | (one << 8) | data[at], return_inverse=True)
        for i, tree in enumerate(model.trees):
            out[at, i] = _units(tree.probabilities(3, grams))[which]
    return out


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code lengths in units of 2**-10 bits, one row per text and one column per language."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK:  # by parts, each after the three bytes before it
            for start in range(0, len(texts[at]), BLOCK):
                lead = min(3, start)
                part = np.frombuffer(texts[at][start - lead : start + BLOCK], np.uint8)
                out[at] += _costs(model, part, np.zeros(1, np.int64))[lead:].sum(axis=0, dtype=np.int64)
            at += 1
            continue
        end, total = at, 0
        while end < len(texts) and total + len(texts[end]) <= BLOCK:
            total += len(texts[end])
            end += 1
        some = [k for k in range(at, end) if texts[k]]
        if some:
            data, starts = _joined([texts[k] for k in some])
            out[some] = np.add.reduceat(_costs(model, data, starts), starts, axis=0, dtype=np.int64)
        at = end
    return out


def predict(docs: DataFrame, learned: Learned) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte; columns of these names are replaced.

    Predicts from the whole of column text alone. ``score`` is the probability of the prediction if all
    languages are as likely beforehand; ``bits_per_byte`` is its code length by the text's length. A null
    text, one without a letter, and any text if nothing was learned are ``und`` with score 0 and null
    bits. Ties go to the first language in code-point order. Repeated rows stay, an empty table gives no
    rows, and all other columns pass through, whatever their names.
    """
    new = ["lang_pred", "score", "bits_per_byte"]
    kept = [c for c in docs.columns if c not in new]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # Columns of the input stay in one struct in the JVM and cannot clash with what is found.
    none = F.lit(None).cast(f"struct<{FOUND}>")
    carried = docs.select(F.struct(*kept).alias("row"), F.when(letters, F.col("text")).alias("said"), none.alias("found"))
    for number, model in enumerate(learned.models()):
        if number:
            carried = stored(carried)
        find = finder(docs.sparkSession.sparkContext.broadcast(model.parts()))
        del model
        carried = carried.withColumn("found", find(F.col("said"), F.col("found")))
    return carried.select(
        *[F.col("row")[c].alias(c) for c in kept], F.coalesce("found.best", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("found.best").isNotNull(), 1 / F.col("found.mass")).otherwise(0.0).alias("score"),
        (F.col("found.least") / UNIT / F.octet_length("said")).alias("bits_per_byte"),
    )


FOUND = "best: string, least: bigint, mass: double"


def finder(shared) -> Callable[[Column, Column], Column]:
    """A column of the best language, its code length and the sum of all shares by it, from a text and what was found before.

    ``shared`` broadcasts the ``parts`` of a model. Only the text goes to Python and only these three come back. A null or empty text has none.
    """

    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = Model.of(shared.value)
        for said, found in batches:
            best, least, mass = (found.field(i) for i in range(3))
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in said]
            known = np.array([bool(t) for t in texts], bool)
            length = code_lengths(model, texts)
            mine, first = length.min(axis=1), length.argmin(axis=1)
            before = np.array([m if x is None else x for m, x in zip(mine.tolist(), least.to_pylist())], np.int64)
            lowest = np.minimum(mine, before)
            # Shares of the probability by that of the best language so far.
            old = np.array([x or 0.0 for x in mass.to_pylist()]) * np.exp2(np.maximum(lowest - before, -1000 * UNIT) / UNIT)
            shares = old + np.exp2(np.maximum(lowest[:, None] - length, -1000 * UNIT) / UNIT).sum(axis=1)
            names = [x if x is not None and b <= m else model.languages[f] for x, b, m, f in zip(best.to_pylist(), before, mine, first)]
            columns = [pa.array([n if k else None for n, k in zip(names, known)], pa.string()), pa.array(lowest, pa.int64(), mask=~known), pa.array(shares, pa.float64(), mask=~known)]
            yield pa.StructArray.from_arrays(columns, ["best", "least", "mass"])

    return F.arrow_udf(each, f"struct<{FOUND}>")


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows; see ``fit`` and ``predict``."""
    return predict(docs, fit(docs, ~held_out(F.col("doc_id")), **bounds))
