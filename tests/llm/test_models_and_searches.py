"""Hard negatives, language-model scores and clusters: odd rows, and plain versions of the same rules."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bloomlm, gnat, heapmeans

VECTORS = "vec_id long, embedding array<float>, label int, score double, cluster int, x string, rank int"


def vectors(spark, rows):
    """Vectors with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, -1.0, -1, "x", -1) for i, v, label in rows], VECTORS)


def odd_vectors(rng, dims):
    unit = lambda: [rng.uniform(-1, 1) for _ in range(dims)]
    rows = [(i, unit(), rng.randrange(4)) for i in range(0, 300)]
    same = unit()
    rows += [(1000 + i, same, i % 3) for i in range(200)]  # a group of copies under other ids
    rows += [rows[100], rows[7], rows[7]]  # rows that repeat whole
    rows += [(2000, None, 1), (None, unit(), 1), (2001, unit(), None), (2002, [float("nan")] * dims, 1), (2003, [None] * dims, 2), (2004, [float("inf")] + [0.0] * (dims - 1), 2)]
    rows += [(2100, [0.5] * 3, 1), (2101, [0.25] * 3, 1), (2102, [0.2] * 3, 2), (2200, [0.0] * dims, 3), (2300, [], 1), (2301, [], 1), (2302, [], 2)]
    return rows


def plain_negatives(rows):
    kept = {(i, tuple(math.floor(256 * np.float64(np.float32(x))) for x in v), label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a in kept:
        if a[0] % 100 == 0:
            others = [(sum(x * y for x, y in zip(a[1], b[1], strict=True)), b) for b in kept if b != a and len(b[1]) == len(a[1])]
            others.sort(key=lambda p: (-p[0], p[1][0]))
            for ps, p in [o for o in others if o[1][2] == a[2]][:5]:
                fit = [(s, b) for s, b in others if b[2] != a[2] and 80 * ps <= 100 * s <= 100 * ps][:5]
                out |= {(a[0], p[0], rank, b[0], ps, s) for rank, (s, b) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("shard_rows, block_rows, teams", [(4096, 4096, 8), (50, 2, 3)])
def test_negatives_against_all_pairs(spark, shard_rows, block_rows, teams):
    rows = odd_vectors(random.Random(11), 12)
    got = gnat.hard_negatives(vectors(spark, rows), shard_rows=shard_rows, block_rows=block_rows, teams=teams)
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    assert gnat.hard_negatives(vectors(spark, [])).count() == 0
    assert gnat.hard_negatives(vectors(spark, [(100, [1.0, 2.0], 1)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        gnat.hard_negatives(vectors(spark, [(100, [1e30, 2.0], 1), (101, [1.0, 1.0], 1)])).count()


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (12, 16))
    points = (centres[rng.integers(0, 12, 3000)] + rng.integers(-8, 8, (3000, 16))).astype(float)
    tree = gnat.Tree.unpack(gnat.Tree.build(points, np.arange(3000), np.arange(3000) % 5).pack())
    seen = []

    class Counting(gnat.Search):
        def leaf(self, node, active):
            seen.append(int(self.t.end[node] - self.t.start[node]))
            super().leaf(node, active)

    a = points[:1]
    product = points @ a[0]
    roof, floor = np.sort(product)[-20], np.sort(product)[-60]
    found = Counting(tree, a, np.array([0]), np.array([0]), np.array([0]), np.array([floor]), np.array([roof]), False, 5)
    found.run()
    fit = sorted((-s, i) for i, s in enumerate(product) if floor <= s <= roof and i % 5 != 0)[:5]
    assert [i for _, i in fit] == found.found[0].tolist()
    assert sum(seen) < 1500


TEXTS = [
    (1, "The cat sat on the mat"), (2, "the CAT sat on\tthe dog"), (3, None), (4, ""), (5, " \n\x0b "), (None, "no id here"), (7, "twice"), (7, "twice"),
    (8, "ÄB äb Äb"), (9, "the cat\x1cone word"), (10, "la " * 30_000), (11, "x" * 200_000), (12, "a surrogate-free \U0001f600 text"),
] + [(100 + i, f"the cat number {i % 7} sat on mat {i}") for i in range(120)]


def plain_model(rows, order):
    cut = lambda t: [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    lists = [(i, [*cut(t), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter()
    for (_, w), out in zip(lists, held, strict=True):
        padded = [0] * (order - 1) + w
        for k in range(order):
            count.update((k, *padded[j - k : j + 1]) for j in range(order - 1, len(padded)) if not out)
    n, v, texts = sum(c for g, c in count.items() if g[0] == 0), sum(g[0] == 0 for g in count), sum(not h for h in held)
    read = lambda g: count[g] if g[0] == 0 else bloomlm.MEANS[bloomlm.level(np.array([count[g]]))[0]] if count[g] else 0
    result = []
    for (i, w), out in zip(lists, held, strict=True):
        padded, base, total = [0] * (order - 1) + w, 0.0, 0.0
        for j in range(order - 1, len(padded)):
            c = count[(0, padded[j])]
            p = (c + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, order):
                context = padded[j - k : j]
                m = texts if context[0] == 0 and set(context) == {0} else read((k - 1, *context))
                p = (min(read((k, *padded[j - k : j + 1])), m, c) + 8.0 * p) / (m + 8.0)
            total += math.log10(p)
        result.append((i, out, len(w), sum(count[(0, x)] > 0 for x in w), n, round(base, 6), round(total, 6)))
    return sorted(result, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_counts(spark, order):
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in TEXTS], "doc_id long, text string, n_tokens int, score double")
    # Filters this large invent nothing among so few n-grams.
    model = bloomlm.fit(docs, ~bloomlm.held_out(docs.doc_id), order, bits_per_entry=64, many=16, segment_bytes=4_000)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in TEXTS}
    expected = plain_model(TEXTS, order)
    for bound in (1 << 30, 0):
        got = bloomlm.score(docs, model, broadcast_bytes=bound, chunk_rows=16).collect()
        rows = [(r["doc_id"], held[r["doc_id"]], r["n_tokens"], r["n_known"], model.tokens, round(r["base_score"], 6), round(r["score"], 6)) for r in got]
        assert sorted(rows, key=str) == expected
    assert model.all_segments > 10 and any(held.values())


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bloomlm.score_documents(none).count() == 0
    model = bloomlm.fit(none, ~bloomlm.held_out(none.doc_id))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for bound in (1 << 30, 0):
        row = bloomlm.score(some, model, broadcast_bytes=bound).first()
        assert (row["n_tokens"], row["n_known"], row["base_score"], row["score"]) == (3, 0, 0.0, 0.0)


def test_filter_keeps_all_and_invents_little():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 63, 60_000).astype(np.uint64))
    counts = rng.geometric(0.4, len(hashes)) ** 3
    bits = bloomlm.fill(hashes, counts, 10, 7)
    kept = bloomlm.Filters(np.array([0]), hashes[:0], counts[:0], bits, np.array([0, len(bits)]), 1, 7)
    read = kept.levels(hashes)
    assert (read >= bloomlm.level(counts)).all() and (read > bloomlm.level(counts)).mean() < 0.02
    strange = np.setdiff1d(rng.integers(0, 1 << 63, 60_000).astype(np.uint64), hashes)
    assert (kept.levels(strange) > 0).mean() < 0.02
    assert (bloomlm.MEANS[bloomlm.level(np.arange(1, 4))] == [1, 2, 3]).all()


def test_language_model_beats_words_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = bloomlm.score_documents(docs).where("not held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * np.float64(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in starts]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    said = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in said:
        total[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, j, d, total[j], sum(total.values()), digest[j]) for i, d, j in said)


def test_clusters_against_all_distances(spark):
    rows = odd_vectors(random.Random(13), 64)
    for some in (rows, rows[:9], []):
        got = heapmeans.cluster(vectors(spark, some))
        assert sorted(tuple(r) for r in got.collect()) == plain_clusters(some)
    with pytest.raises(Exception, match="too large"):
        heapmeans.cluster(vectors(spark, [(1, [1e30] * 64, 1)])).count()


def test_gaps_spare_vectors():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-60, 60, (16, 64)).astype(np.int64)
    points = (centroids[rng.integers(0, 16, 4000)] + rng.integers(-9, 9, (4000, 64))).astype(np.int8)
    block = heapmeans.Block.unpack(heapmeans.Block.first(np.arange(4000), points, centroids).pack())
    drift = np.zeros(16)
    for _ in range(3):
        after = centroids + rng.integers(-2, 3, centroids.shape)
        drift, centroids = drift + heapmeans.drifts(centroids, after), after
        block = heapmeans.Block.unpack(block.pack())
        block.advance(centroids, drift)
        assert (block.own == heapmeans.squared(points, centroids).argmin(axis=1)).all() and block.measured < 400


def test_questions_to_segments_store_no_texts_and_leave_no_shuffle(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    local = Path(spark.conf.get("spark.local.dir"))
    docs = spark.range(0, 300, 1, 3).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 90), i -> concat('w', (i * id * 7919) % 997))) AS text")
    shuffles = lambda: {f for f in local.rglob("shuffle_*.data")}
    root.mkdir(exist_ok=True)
    folders, files = set(root.iterdir()), shuffles()
    model = bloomlm.fit(docs, F.lit(True), segment_bytes=10_000)
    found = bloomlm.score(docs, model, broadcast_bytes=0, chunk_rows=16)
    made = set(root.iterdir()) - folders
    assert len(made) == 2  # the model and the answers
    left = sum(f.stat().st_size for f in shuffles() - files)
    assert left < sum(f.stat().st_size for d in made for f in d.glob("*.parquet"))
    assert sorted(found.collect()) == sorted(bloomlm.score(docs, model).collect())


def test_hashes_are_packed_without_loss():
    for n in (0, 1, 500):
        h = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        assert bloomlm.unpacked(bloomlm.packed(h.tobytes())).tolist() == h.tolist()
