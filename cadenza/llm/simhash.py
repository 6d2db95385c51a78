"""SimHash near-duplicates found by multi-index hashing.

A fingerprint has 64 bits. Two fingerprints that differ in at most two bits either agree in the low half
or differ in at most one bit of the high half. So every fingerprint is filed in two tables, one per half;
it looks itself up under the 33 values of the Hamming ball of radius 1 around its high half and under its
own low half, and each match is verified on all 64 bits.

A half that very many different fingerprints share would make too many candidates. The members of such
crowded buckets are matched among themselves by their whole fingerprints instead: two of them differ in at
most two bits exactly if the balls of radius 1 around them meet, so each emits its 65 ball members as keys
and links to the smallest fingerprint with the same key. That is exact and linear, and a key has at most
65 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import forget, stored

BITS = 64
HALF = 32
SEED = 42
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
BLOCK = 16384


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included, in order.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII rules on bytes
    if not found:
        return np.empty(0, "<u8")
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends.tolist()[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, last)), "<u8", len(last))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if more than half of the hashes have it; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer.

    Null and wordless texts have fingerprint 0. Other columns than doc_id and text are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [majority(shingle_hashes(x.as_py(), words)) for x in batch.column("text")]
            fps = np.array(values, "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def hamming_links(fps: DataFrame, crowd: int = 64) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints that differ in one or two bits.

    ``fps`` holds each fingerprint once in column fp. All links that do not involve two members of one
    crowded bucket are returned; those inside come as links to the smallest fingerprint of a key, which
    connect the same fingerprints.
    """
    halves = fps.select(
        "fp", F.shiftrightunsigned("fp", HALF).alias("high"), F.col("fp").bitwiseAND(2**HALF - 1).alias("low")
    )
    filed = halves.select(
        "fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("high").alias("value")),
                                F.struct(F.lit(1).alias("half"), F.col("low").alias("value")))).alias("k")
    ).select("fp", "k.half", "k.value")
    full = filed.groupBy("half", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    flips = F.array(*[F.lit(m) for m in [0, *(1 << i for i in range(HALF))]])
    ball = F.transform(flips, lambda m: F.struct(F.lit(0).alias("half"), F.col("high").bitwiseXOR(m).alias("value")))
    itself = F.array(F.struct(F.lit(1).alias("half"), F.col("low").alias("value")))
    probes = halves.select(F.col("fp").alias("x"), F.explode(F.concat(ball, itself)).alias("k")).select(
        "x", "k.half", "k.value"
    )
    table = filed.join(full, ["half", "value"], "left_anti")
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("fp")))
    light = (
        probes.join(table, ["half", "value"])
        .where((F.col("x") != F.col("fp")) & (distance <= 2))
        .select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b"))
    )
    crowded = filed.join(full.select("half", "value"), ["half", "value"], "left_semi").select("fp").distinct()
    one = F.array(*[F.lit(m) for m in [0, *(1 << i for i in range(BITS - 1)), -(1 << (BITS - 1))]])
    keyed = crowded.select("fp", F.explode(F.transform(one, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    dense = (
        keyed.select("fp", F.min("fp").over(Window.partitionBy("key")).alias("a"))
        .where("a < fp")
        .select("a", F.col("fp").alias("b"))
    )
    return light.unionByName(dense).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, crowd: int = 64) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, links.

    Documents link if their fingerprints differ in at most two bits. ``component_id`` is the smallest
    doc_id that links reach; ``links`` says whether the fingerprint has a link to a different one. Equal
    fingerprints are one node, so exact copies are never compared with each other. Null and wordless
    texts share fingerprint 0 and link like any others. A null doc_id never names a component unless it
    is the only one; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    marked = stored(fingerprints(docs, words))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(hamming_links(nodes.select("fp"), crowd))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "first", "root")
    names = linked.groupBy("root").agg(F.min("first").alias("name"))
    named = linked.join(names, "root").select(F.col("fp").alias("node"), "name")
    return (
        marked.join(nodes, "fp")
        .join(named, F.col("fp") == F.col("node"), "left")
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.coalesce("name", "first").alias("component_id"),
            F.col("node").isNotNull().alias("links"),
        )
    )


# Near copies at a given similarity of their word shingles, all of them, by prefix filtering.
#
# All shingles have one order, rare ones first. A text of n shingles is filed under its first
# n - ceil(t n) + 1: two sets of Jaccard similarity t share at least ceil(t n) of either's shingles, so their
# first common shingle is filed for both. It stands at places i and j of sets of sizes n and m, and all that
# they share follows it, so that min(n - i, m - j) >= t / (1 + t) (n + m). A set also has a bit for each value
# of its hashes modulo a power of two, set if an odd number of them has it. Bits in which two sets differ are
# no more than the shingles in which they do, and those are (1 - t) / (1 + t) (n + m) at most. Only pairs that
# pass both bounds are verified on the sets themselves.

#: Shingles that are counted to find common ones; the order decides the work, never the result.
DRAWN = 8_000_000
#: Key of the sets without shingles, which are all alike, and mark of rows that are pairs.
NO_SHINGLES, PAIR = -1, -2
#: Next members of a crowded key that each of them meets at first.
AHEAD = 10
#: Pairs that a task makes at a time.
PAIR_ROWS = 1 << 18
SLACK = 1e-9


def set_of(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.astype("<u4"))


def as_set(text: str | None, words: int) -> np.ndarray:
    return set_of(shingle_hashes(text, words))


def marks_of(held: np.ndarray) -> np.ndarray:
    """The set's bits as 64-bit words: as many bits as a power of two that is at least its size."""
    width = max(64, 1 << max(0, len(held) - 1).bit_length())
    odd = np.bincount(held & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def may_be_similar(n: Column, marks: Column, other_n: Column, other_marks: Column, similarity: float) -> Column:
    """Whether two sets differ in few enough bits; similar sets have widths that are equal or one is twice the other."""
    def halved(x: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    def differing(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)

    one, two = F.size(marks), F.size(other_marks)
    bits = F.when(one == two, differing(marks, other_marks)).when(one == 2 * two, differing(halved(marks), other_marks)).when(
        two == 2 * one, differing(marks, halved(other_marks))
    )
    return F.coalesce(bits <= (1 - similarity) / (1 + similarity) * (n + other_n) + SLACK, F.lit(False))


def common_shingles(sets: DataFrame, drawn: int = DRAWN) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their counts: those found three times or more in a bounded draw of the sets."""
    total = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    some = sets.where(F.pmod("id", F.lit(max(1, total // 4 // drawn))) == 0).select("shingles")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("shingles")]
            key, n = np.unique(np.concatenate([np.empty(0, "<u4"), *held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    counted = some.mapInArrow(each, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 3")
    found = counted.toArrow()
    key, n = (found.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(key)
    return key[order].astype("<u4"), n[order]


def prefix(held: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all; every similar set shares one of them."""
    many = len(held) - int(np.ceil(similarity * len(held) - SLACK)) + 1
    seen = np.ones(len(held), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        seen = np.where(common[at] == held, counts[at], 1)
    return held[np.lexsort((held, seen))[:many]]


def filings(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, id, n, place): every set under the shingles of its prefix."""
    common = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held = [np.frombuffer(x.as_py(), "<u4") for x in part.column("shingles")]
                keys = [prefix(x, similarity, *common.value).astype(np.int64) if len(x) else np.array([NO_SHINGLES]) for x in held]
                sizes = np.array([len(k) for k in keys], np.int64)
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                n = np.repeat(np.array([len(x) for x in held], np.int64), sizes)
                ids = np.repeat(part.column("id").to_numpy(), sizes)
                columns = [np.concatenate(keys), ids, n.astype(np.int32), place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "n", "place"])

    return sets.select("id", "shingles").mapInArrow(each, "key bigint, id bigint, n int, place int")


def meetings(filed: DataFrame, similarity: float, open_bucket: int) -> DataFrame:
    """(key, a, b, n, place): pairs of sets filed under one key, marked PAIR, and the members of crowded keys.

    A key of up to ``open_bucket`` sets gives all pairs that pass the bound. A larger one gives those of its
    members with one of them and with the next few in a mixed order, which connect most of a group, and its
    members as (key, a, n, place), for ``missing_pairs``.
    """
    share = similarity / (1 + similarity)

    def passing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        room = np.minimum(x[:, 2] - x[:, 3], y[:, 2] - y[:, 3])
        ok = (room >= share * (x[:, 2] + y[:, 2]) - SLACK) & (x[:, 1] != y[:, 1])
        a, b = x[ok, 1], y[ok, 1]
        none = np.zeros(len(a), np.int64)
        return np.stack([none + PAIR, np.minimum(a, b), np.maximum(a, b), none, none], axis=1)

    def buckets(rows: np.ndarray) -> Iterator[np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        sizes = np.diff(np.append(first, len(rows)))
        for k in range(2, open_bucket + 1):
            starts = first[sizes == k]
            for i in range(k if len(starts) else 0):
                for j in range(i):
                    yield passing(rows[starts + j], rows[starts + i])
        for at, n in zip(first[sizes > open_bucket], sizes[sizes > open_bucket]):
            held = rows[at : at + n]
            mixed = (held[:, 1] ^ held[:, 0] << 31).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            held = held[np.argsort(mixed)]
            yield passing(held[1:], np.broadcast_to(held[0], held[1:].shape))
            for k in range(1, AHEAD + 1):
                yield passing(held[1 + k :], held[1:-k])
            yield np.stack([held[:, 0], held[:, 1], np.zeros(n, np.int64), held[:, 2], held[:, 3]], axis=1)

    def batch_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, a, b, n, place = np.concatenate(parts).T
        columns = [key, a, b, n.astype(np.int32), place.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "a", "b", "n", "place"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Rows of whole keys; those of the last key wait for more."""
        parts: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "id", "n", "place")], axis=1)
            if not len(rows):
                continue
            edge = np.searchsorted(rows[:, 0], rows[-1, 0])
            if edge or parts and parts[-1][-1, 0] != rows[-1, 0]:
                yield np.concatenate([*parts, rows[:edge]])
                parts = [rows[edge:]]
            else:
                parts.append(rows)
        if parts:
            yield np.concatenate(parts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for rows in runs(batches):
            for found in buckets(rows) if len(rows) else ():
                waiting.append(found)
                if sum(map(len, waiting)) >= PAIR_ROWS or len(waiting) >= 4096:
                    yield batch_of(waiting)
                    waiting = []
        if waiting:
            yield batch_of(waiting)

    sorted_keys = filed.repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(each, "key bigint, a bigint, b bigint, n int, place int")


def missing_pairs(crowded: DataFrame, roots: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of crowded keys' members that pass both bounds and that no links connect yet.

    ``crowded`` has (key, id, n, place), ``roots`` the components (node, root) so far, ``marks`` (id, n, marks). All pairs of different
    components are there; of a key's largest component only those that meet one of another.
    """
    placed = crowded.join(roots, crowded["id"] == roots["node"], "left").select(
        "key", "id", "n", "place", F.coalesce("root", "id").alias("root")
    )
    counted = placed.groupBy("key", "root").agg(F.count("*").alias("many"))
    split = counted.groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.count("*").alias("roots"))
    members = stored(placed.join(split.where("roots > 1"), "key").drop("roots").join(marks.select("id", "marks"), "id"))
    x = members.where("root != main").select("key", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xp"), F.col("root").alias("xr"), F.col("marks").alias("xm"))
    y = members.select("key", F.col("id").alias("y"), F.col("n").alias("yn"), F.col("place").alias("yp"), F.col("root").alias("yr"), F.col("marks").alias("ym"), (F.col("root") == F.col("main")).alias("in_main"))
    room = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    bound = similarity / (1 + similarity) * (F.col("xn") + F.col("yn")) - SLACK
    alike = may_be_similar(F.col("xn"), F.col("xm"), F.col("yn"), F.col("ym"), similarity)
    met = x.join(y, "key").where((F.col("xr") != F.col("yr")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & (room >= bound) & alike)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_links(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, shingles) have at least this Jaccard similarity, stored; empty sets are alike."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - SLACK)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Only the sets that pairs name are fetched; where those are few, Spark sends the ids to the sets.
    pairs = stored(pairs)
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = sets.join(ids, "id", "left_semi").select("id", "shingles")
    joined = pairs.join(wanted.toDF("a", "x"), "a").join(wanted.toDF("b", "y"), "b")
    links = stored(joined.select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint"))
    forget(pairs)
    forget(ids)
    return links


def fingerprint_links(nodes: DataFrame, crowd: int = 64) -> DataFrame:
    """The links (a, b) of ids by their fingerprints (id, fp), stored: equal ones, and those that ``hamming_links`` finds."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    equal = nodes.join(firsts, "fp").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = hamming_links(firsts.select("fp"), crowd).toDF("x", "y")
    named = near.join(firsts.toDF("x", "a"), "x").join(firsts.toDF("y", "b"), "y").select("a", "b")
    links = stored(equal.unionByName(named))
    forget(firsts)
    return links


def near_groups(sets: DataFrame, similarity: float = 0.8, open_bucket: int = 16, alike: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets (id, n, marks, shingles) that similar pairs and the links ``alike`` connect, directly or over
    others: no pair is missed.

    A pair whose first common shingle has few sets is verified at once. In a crowded one most of a group is
    linked first, and then all pairs of its members that are still in different components are verified.
    """
    met = stored(meetings(filings(sets, similarity), similarity, open_bucket))
    marks = sets.select("id", "n", "marks")
    close = (
        met.where(F.col("key") == PAIR).select("a", "b").distinct()
        .join(marks.toDF("a", "an", "am"), "a").join(marks.toDF("b", "bn", "bm"), "b")
        .where(may_be_similar(F.col("an"), F.col("am"), F.col("bn"), F.col("bm"), similarity)).select("a", "b")
    )
    links = similar_links(sets, close, similarity)
    roots = stored(connected_components(links if alike is None else links.unionByName(alike)))
    forget(links)
    crowded = met.where(F.col("key") != PAIR).select("key", F.col("a").alias("id"), "n", "place")
    late = similar_links(sets, missing_pairs(crowded, roots, marks, similarity), similarity)
    forget(met)
    if late.isEmpty():
        return roots
    return connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(late))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each group of linked texts the row with the smallest doc_id stays.

    Equal texts are one node, named by a 64-bit hash. Texts link if the fingerprints of their word shingles
    differ in at most two bits, or if the sets of these have at least this Jaccard similarity, and all such
    pairs count; a text of fewer words has one shingle of them all. Null and wordless texts are one group. Of
    rows with the same doc_id and text one stays; a null
    doc_id counts as larger than any other. All columns pass through, and an empty table stays empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(x.as_py(), words) for x in batch.column("text")]
            sets = [set_of(x) for x in hashes]
            columns = [
                pa.array(np.array([majority(x) for x in hashes], "<u8").view("<i8"), pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()), pa.array([marks_of(x) for x in sets], pa.list_(pa.int64())),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "fp", "n", "marks", "shingles"])

    # Copies are told by their hashes, so only the texts that have some are moved, and a set is made once and where its text lies.
    named = docs.select(F.xxhash64(text).alias("id"), text.alias("text"))
    heads = stored(docs.select(F.xxhash64(text).alias("id"), "doc_id").groupBy("id").agg(F.min(order).alias("first"), F.count("*").alias("rows")))
    copied = stored(heads.where("rows > 1").select("id"))  # a table of its own, so that Spark knows how small it is
    one = named.join(copied, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    texts = named.join(copied, "id", "left_anti").unionByName(one)
    nodes = stored(texts.mapInArrow(shingles, "id bigint, fp bigint, n bigint, marks array<bigint>, shingles binary"))
    forget(copied)
    # Fingerprints are quick to meet but promise no similarity, so the pairs of sets that have it are all found as well.
    alike = fingerprint_links(nodes.select("id", "fp"))
    roots = near_groups(nodes.select("id", "n", "marks", "shingles"), similarity, alike=alike)
    forget(alike)
    group = heads.join(roots, heads["id"] == roots["node"], "left").select(
        "id", "first", F.coalesce("root", "id").alias("root")
    )
    kept = group.groupBy("root").agg(F.min(F.struct("first", "id")).alias("kept")).select(
        "kept.id", F.coalesce(F.col("kept.first.doc_id").cast("string"), F.lit("")).alias("doc"), F.lit(True).alias("stays")
    )
    # The columns of the input travel in one struct and cannot clash with the key. Rows whose keys go or repeat
    # are found from the keys alone, so that where those are few no text is shuffled.
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("id"), doc)
    keys = docs.select(F.xxhash64(text).alias("id"), doc).groupBy("id", "doc").agg(F.count("*").alias("rows"))
    odd = stored(keys.join(kept, ["id", "doc"], "left").where("stays is null or rows > 1"))
    single = keyed.join(odd.select("id", "doc"), ["id", "doc"], "left_anti")
    # Of rows that agree in doc_id and text the one whose other columns come first in their JSON stays.
    others = F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    several = keyed.join(odd.where("stays").select("id", "doc"), ["id", "doc"], "left_semi")
    first = several.groupBy("id", "doc").agg(F.min_by("row", F.struct(F.col("row.text").isNull(), others)).alias("row"))
    return single.select("row").unionByName(first.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
