"""The numbered operators: edge cases, and brute force where SQL cannot say it."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import chat, components, langid, mixing, oggmedia, packing, quality, queries, sharding, simhash, vptree, warc

from .. import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, key string"


def documents(spark, rows):
    """Documents with columns whose names clash with those of results."""
    full = [(i, t, lang, s, len(t or ""), -1, -1, -1.0, "k") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, "the cat sat on the mat and the dog ran", "en", "a"),
    (2, "the cat sat on the mat and the dog ran", "en", None),
    (3, None, None, "b"),
    (4, "", "en", "b"),
    (5, " \t\n ", "de", "c"),
    (None, "one two", None, "a"),
    (7, "word", "en", "d"),
    (7, "word", "en", "d"),
    (8, "die Katze sitzt auf der Matte " * 4000, "de", "e"),
    (9, "12 34 !!", "en", "e"),
]


def test_every_sql(spark, sf):
    for name, sql in queries.oracle_sql().items():
        oracle.check(spark, sf, queries.queries()[name], sql)


def plain_fingerprint(text, words):
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.choice(["ab", "cd", "EF", "gh", "ij"]) + str(rng.randrange(40)) for _ in range(90)]
    rows = list(ODD)
    for i in range(60):
        words = list(base if i % 2 else [w[::-1] for w in base])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((100 + i, " ".join(words), "en", "a"))
    for crowd in (64, 1):
        got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, rows), 3, crowd).collect()}
        fps = {i: plain_fingerprint(t, 3) for i, t, _, _ in rows}
        assert all(got[i]["fingerprint"] == f"{fps[i]:016x}" for i in fps)
        group = {i: i for i in fps if i is not None}
        changed = True
        while changed:
            changed = False
            for a in group:
                for b in group:
                    if bin(fps[a] ^ fps[b]).count("1") <= 2 and group[b] < group[a]:
                        group[a], changed = group[b], True
        assert {i: got[i]["component_id"] for i in group} == group
    assert simhash.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, None), (7, 7)]
    roots = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert roots == {x: find(x) for x in parent}


def test_near_copies_leave_one(spark):
    rng = random.Random(9)
    text = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = list(ODD)
    for i in range(30):
        near = list(text)
        near[rng.randrange(200)] = f"n{i}"
        rows.append((50 + i, " ".join(near), "en", "a"))
    rows += [(500 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(150)), "en", "b") for i in range(20)]
    kept = simhash.keep_one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 7, 8, 9, 50, *range(500, 520), None]


def near_by_brute_force(texts):
    """The smallest index of each text's group, by all pairs of five-word shingle sets."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root, pairs


def sets_of(spark, texts):
    sets = [simhash.as_set(t, 5) for t in texts]
    rows = [(i, len(x), simhash.marks_of(x).tolist(), bytearray(x.tobytes())) for i, x in enumerate(sets)]
    return spark.createDataFrame(rows, "id long, n long, marks array<bigint>, shingles binary")


def test_pairs_about_the_bound_are_all_found(spark):
    """Texts of all lengths whose similarity lies about 0.8, in groups: no pair is lost, none is made up."""
    rng = random.Random(21)
    texts = []
    for n in (6, 9, 14, 30, 61, 64, 66, 130, 300, 520, 1030):
        text = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(25):
            near = list(text)
            for _ in range(rng.randrange(1 + n // 30)):
                near[rng.randrange(n)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(near[: n - rng.randrange(1 + n // 8)] if k % 3 else near))
    root, pairs = near_by_brute_force(texts)
    assert len(pairs) > 300 and len(set(root)) > 20
    for crowd in (2, 16):
        got = {r["node"]: r["root"] for r in simhash.near_groups(sets_of(spark, texts), 0.8, crowd).collect()}
        assert [got.get(i, i) for i in range(len(texts))] == root


def test_names_that_clash_pass_through(spark):
    rows = [(i, t, "r", "d", i, "k", "c") for i, t in [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, ""), (4, "x y"), (4, "x y")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, doc string, id long, key string, __copies string")
    for out in (simhash.keep_one_of_each(docs), mixing.mix_documents(docs.withColumn("source", F.lit("s"))).drop("source"), langid.predict(docs, langid.fit(docs.withColumn("lang", F.lit("x")), F.lit(True)))):
        assert out.columns[:7] == docs.columns and {tuple(r)[2:7] for r in out.collect()} <= {("r", "d", i, "k", "c") for i in range(5)}
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == [1, 3, 4]


def test_crowded_near_copies_all_meet(spark):
    """Chains, and groups that share crowded shingles but are not alike, against all pairs."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(3):  # chains: every text is like the next one only
        text = [word() for _ in range(100)]
        for _ in range(40):
            text = text[10:] + [word() for _ in range(10)]
            texts.append(" ".join(text))
    shared = [word() for _ in range(60)]
    for _ in range(30):  # half of each text is the same for all; pairs differ in a word
        own = [word() for _ in range(60)]
        texts += [" ".join(shared + own), " ".join(shared + own[:59] + [word()])]
    rng.shuffle(texts)
    root, pairs = near_by_brute_force(texts)
    assert len(set(root)) == 33 and len(pairs) == 3 * 39 + 30
    for crowd in (2, 16):
        found = simhash.near_groups(sets_of(spark, texts), 0.8, crowd).collect()
        got = {r["node"]: r["root"] for r in found}
        assert [got.get(i, i) for i in range(len(texts))] == root
    kept = simhash.keep_one_of_each(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


def test_near_copies_are_those_of_fingerprints_too(spark):
    """A line said often outweighs what differs: the fingerprints are near, the sets are not similar."""
    rows = [(i, " ".join([f"the line that all of them {i % 2}"] * 40 + [f"w{i}x{j}" for j in range(60)]), "en", "a") for i in range(6)]
    docs = documents(spark, rows)
    links = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, words=5).collect()}
    sets = [set(simhash.as_set(r[1], 5).tolist()) for r in rows]
    assert all(len(a & b) < 0.5 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert set(links.values()) == {0, 1}
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == [0, 1]


def test_copies_with_a_fifth_of_new_words_leave_one(spark):
    rng = random.Random(13)
    rows = []
    for i in range(60):
        n = (40, 200, 1000)[i % 3]
        text, new = [f"w{rng.randrange(10**6)}" for _ in range(n)], [f"n{rng.randrange(10**6)}" for _ in range(n // 5)]
        at = n if i % 2 else rng.randrange(5, n - 5)
        rows += [(2 * i, " ".join(text), "en", "a"), (2 * i + 1, " ".join(text[:at] + new + text[at:]), "en", "a")]
    root, _ = near_by_brute_force([r[1] for r in rows])
    assert all(root[2 * i + 1] == 2 * i for i in range(1, 60, 2))  # all with an appended fifth
    kept = simhash.keep_one_of_each(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    said = langid.identify(docs)
    held = said.where(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)
    odd = documents(spark, ODD)
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(odd).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in [(3, None), (4, ""), (5, " \t\n "), (9, "12 34 !!")])
    assert got[8, ODD[8][1]]["lang_pred"] == "de"
    unlearned = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"} and len(unlearned) == len(ODD)
    assert langid.identify(odd.limit(0)).count() == 0


def test_code_lengths_follow_the_tree():
    texts = [b"abracadabra abracadabra", "été là, à côté".encode()]
    grams = defaultdict(int)
    for lang, t in enumerate(texts):
        for i in range(len(t)):
            key = 0
            for j in range(i - 3, i + 1):
                key = key << 8 | (t[j] if j >= 0 else 0)
            grams[lang, key] += 1
    code, gram = np.array(list(grams)).T
    models = [langid.build(["x", "y"], code, gram, np.array(list(grams.values())), ready) for ready in (1000, 2, 0)]

    def cost(lang, text):  # the tree walked byte by byte
        total = 0.0
        for i, byte in enumerate(text):
            probability = {b: 1 / 256 for b in range(256)}
            for order in range(4):
                if order > i:
                    break
                seen = defaultdict(int)
                context = text[i - order : i]
                t = texts[lang]
                for k in range(order, len(t)):
                    if t[k - order : k] == context:
                        seen[t[k]] += 1
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                rest = sum(p for b, p in probability.items() if b not in seen)
                probability = {b: seen[b] / (n + q) if b in seen else q / (n + q) * p / rest for b, p in probability.items()}
            total -= np.log2(probability[byte])
        return total

    for text in (b"abra cad", "là côté".encode(), b"zzz"):
        for model in models:  # the table and what it lacks say the same
            got = langid.code_lengths(model, [text])[0] / langid.UNIT
            assert got == pytest.approx([cost(0, text), cost(1, text)], abs=0.03)


def test_three_hundred_languages(spark):
    """None is left out, however many there are; passes agree with one pass over all."""
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    speech = lambda k: " ".join(letters[2 * k + rng.randrange(2)] + letters[2 * k] for _ in range(12))
    rows = [(i, speech(i % 300), f"l{i % 300:03}", -1.0) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row double")
    learned = langid.fit(docs, F.lit(True))
    assert len(learned.passes) == 19 and sum(map(len, learned.passes)) == 300
    learned.passes = [sum(learned.passes[:9], []), sum(learned.passes[9:], [])]
    two = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, learned).collect()}
    assert all(two[i][0] == lang for i, _, lang, _ in rows)
    learned.passes = [sum(learned.passes, [])]
    one_pass = langid.predict(docs, learned)
    assert one_pass.columns == ["doc_id", "text", "lang", "row", "lang_pred", "score", "bits_per_byte"]
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in one_pass.collect()} == two


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = ("the quick brown fox. " * 50).encode()
    data = np.frombuffer(text, np.uint8)
    one, two, three = (x.astype(np.int64) for x in langid._contexts(data, np.zeros(1, np.int64)))
    gram, n = np.unique((three << 24) | (two << 16) | (one << 8) | data, return_counts=True)
    model = langid.build(["x"], np.zeros(len(gram), int), gram, n, 1000)
    whole = langid.code_lengths(model, [text, b"", text[:7]])
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert (langid.code_lengths(model, [text, b"", text[:7]]) == whole).all()


def test_mixing(spark, sf):
    plan = mixing.mixing_plan(documents(spark, ODD)).collect()
    assert len(plan) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in plan)
    by_source = {(r["source_size"], r["target"]) for r in plan}
    assert all(t <= 2 * s for s, t in by_source)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    totals = mixing.mixing_plan(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert abs(sum(r["target"] for r in totals) - 1.5 * sum(r["source_size"] for r in totals)) < 1
    assert all(abs(r["taken"] - r["target"]) < 0.15 * r["target"] for r in totals)
    mixed = mixing.mix_documents(documents(spark, ODD))
    assert mixed.columns == documents(spark, []).columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mixing_plan(documents(spark, []).limit(0)).count() == 0


def test_ogg_round_trip_and_damage():
    for text in (None, "", "a", "é" * 5000, "x" * 200_000, "OggS" * 3000):
        media = oggmedia.encode(text)
        read = oggmedia.decode(media)
        raw = (text or "").encode()
        assert read["payload"] == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and read["n_bytes"] == len(raw)
        assert read["damaged"] == 0 and read["times"] and read["times"][-1] == len(read["payload"]) / 8000
        assert media == oggmedia.encode(text)
        for at in range(0, len(media), max(1, len(media) // 40)):
            broken = bytearray(media)
            broken[at] ^= 0x10
            assert oggmedia.decode(bytes(broken))["damaged"] > 0
    # The format's checksum by its definition.
    page = oggmedia.encode("abc")[:60]
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert oggmedia.page_checksum(page) == crc


def test_media_digests(spark):
    got = oggmedia.media_digests(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    texts = {i: t or "" for i, t, _, _ in ODD}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
    assert len({r["media_sha256"] for r in got}) == len({*texts.values()})


PAGES = [
    (1, "http://b.example.com/x?q=1", "<p>same</p>"), (2, "http://a.example.com", "<p>same</p>"), (3, None, None), (4, "http://a.example.com/é\r\nX: y", ""),
    (None, "no url", "<p>same</p>"), (6, "http://[bad", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (7, "http://a.example.com", "é" * 100_000), (7, "http://a.example.com", "é" * 100_000),
]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, "extra", "extra") for p in PAGES], "page_id long, url string, html string, archive string, digest string")
    index = warc.archive_pages(pages, archive_bytes=300).collect()
    assert len(index) == len(PAGES)
    order = [warc.order_of(r.asDict()) for r in index]
    assert order == sorted(order)
    said = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in index}
    assert said == {(1, "revisit", 2, 11), (2, "response", None, 11), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 11),
                    (6, "response", None, len(PAGES[5][2])), (7, "response", None, 200_000)}
    assert warc.archive_pages(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Date: x\r\nWARC-Payload-Digest: sha1:x\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200\r\nContent-Length: 3\r\n\r\n")


def test_an_index_entry_fetches_its_record(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(warc.capture_plan(pages), f"file://{tmp_path}/a", archive_bytes=300)
    files = {f"{p.parent.name}/{p.name}": p.read_bytes() for p in (tmp_path / "a").glob("archive=*/part-*")}
    assert len(files) > 2 and all(gzip.decompress(x).startswith(b"WARC/1.1") for x in files.values())
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"file://{tmp_path}/a")
    html = {p[0]: p[2] or "" for p in PAGES}
    for r in warc.read_archives(read).collect():
        record = warc.fetch(files[r["archive"]], r["offset"], r["length"])
        assert record["page_id"] == r["page_id"] and record["payload_digest"] == r["payload_digest"]
        assert record["payload"].decode() == (html[r["page_id"]] if r["record_type"] == "response" else "")


def test_members_end_in_zero_and_come_apart():
    records = [b"a", b"b" * 100_000, b"c" * (17 << 20), b"d"]
    packed = [warc.member(r) for r in records]
    assert all(m[-1] == 0 for m in packed)
    data = b"".join(packed)
    assert gzip.decompress(data) == b"".join(records)
    assert [(data[at : at + n][:2], x) for at, n, x in warc.members(data)] == [(b"\x1f\x8b", r) for r in records]
    with pytest.raises(ValueError):
        list(warc.members(data[:-4]))


def test_many_ranges_give_one_order(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randrange(9)}.org/{rng.randrange(5)}" if i % 3 else "http://hot.org/", str(i)) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.shared_dir(spark)
    warc.write_archives(warc.capture_plan(pages), path, archive_bytes=20_000)
    runs = warc.stored(warc.read_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)))
    merged = warc.merge_index(runs, rows_per_range=200)
    got = [warc.order_of(r.asDict()) for r in merged.collect()]
    assert got == sorted(got) and len(got) == 3000 and merged.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, runs.collect()))


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(300):
        runs = [sorted((rng.randrange(20), rng.randrange(9)) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(9))]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(sum(runs, []))


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi <|end|> <||x"), (1, 1, "assistant", "<|role|>user<|text|>no"), (1, 2, "user", None), (1, 3, None, "<"),
        (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, "assistant", "|>é😀"), (None, 1, "assistant", "x\n"), (4, 5, "user", "only"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = chat.conversation_digests(chat.prefix_examples(frame.unionByName(frame.where("conv_id is null")))).collect()
    got = {r["conv_id"]: r for r in found}
    assert [r["n_turns"] for r in found if r["conv_id"] is None] == [1, 1]  # each row without a conversation is one of its own
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.prefix_examples(frame.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 12)).astype(np.float32)
    points[50:90] = points[50]
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)]
    rows += [(1000, None, "x"), (1100, [0.0] * 12, "x"), (1200, [float("nan")] * 12, "x"), (1300, [None] * 12, "x"), (None, points[0].tolist(), "x"), (1400, [1.0, 2.0], "x"), (1401, [1.0, 3.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    index = vptree.stored(vptree.build_index(frame, shard_rows=30, pivots=8))
    assert index.count() > 15 and index.where("dims = 12").select("cell").distinct().count() == 8
    asked = frame.where("vec_id % 20 = 0")
    got = defaultdict(list)
    for r in vptree.nearest(index, asked, 10, 1.0, block_rows=16).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    exact = {}
    for q in range(0, 600, 20):
        d = vptree.distances(points[q : q + 1].astype(float), points.astype(float))[0]
        exact[q] = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        assert [(s, i) for _, s, i in sorted(got[q])] == exact[q]
    assert [x[2] for x in got[1400]] == [1401] and set(got) == {*range(0, 600, 20), 1400}
    stretched = frame.where("vec_id < 600").withColumn("embedding", F.transform("embedding", lambda x: (x * 1e6 + 1e7).cast("double")))  # large norms, many equal distances
    far = vptree.nearest(vptree.stored(vptree.build_index(stretched, shard_rows=100)), stretched.where("vec_id between 40 and 60"), 10, 1.0).collect()
    wide = points.astype(float) * 1e6 + 1e7
    for q in range(40, 61):
        d = vptree.distances(wide[q : q + 1], wide)[0]
        assert [r["vec_id"] for r in sorted(far, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in sorted((x, i) for i, x in enumerate(d) if i != q)[:10]]
    loose = vptree.nearest(index, asked, 10, 0.6).collect()
    hits = sum(r["vec_id"] in {i for _, i in exact.get(r["query_id"], [])} for r in loose)
    assert hits >= 0.9 * 10 * len(exact)
    assert vptree.nearest(vptree.build_index(frame.limit(0)), frame.limit(0)).count() == 0


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.classify(docs, labels).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.9
    odd = quality.classify(documents(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in odd)
    assert quality.classify(documents(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert quality.classify(documents(spark, []).limit(0), labels).count() == 0


def test_scores_and_trees_against_plain_loops():
    """Table additions are sums of what a text's bins hold; trees are the best of all trees."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    model = quality.boost(x, (x[:, 0] * x[:, 1] > 0).astype(float), bins=9, rounds=20)
    got = model.scores(x)
    for row, score in zip(x, got):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]] for (i, j), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
    worth = lambda parts, g, h: sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts)
    for _ in range(40):
        g, h = rng.normal(size=7), rng.random(7)
        values = quality._two_splits(g, h)
        edges = [0, 7]
        split = lambda edges: worth([slice(a, b) for a, b in zip(edges, edges[1:])], g, h)
        for _ in range(2):  # the best split there is, if any is worth more than none
            edges = max([edges, *(sorted([*edges, c]) for c in range(1, 7) if c not in edges)], key=split)
        assert values == pytest.approx(np.concatenate([[g[a:b].sum() / (h[a:b].sum() + 1)] * (b - a) for a, b in zip(edges, edges[1:])]))
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
        quarter = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
        i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: worth(quarter(*c), g, h))
        want = np.zeros((4, 5))
        for p in quarter(i, j):
            want[p] = g[p].sum() / (h[p].sum() + 1)
        assert quality._quadrants(g, h) == pytest.approx(want)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    assert (0, 1) in model.pairs and np.mean((model.scores(x) > 0.5) == y) > 0.95


def test_sharding(spark, sf):
    got = sharding.shard_documents(documents(spark, ODD), shards=3).collect()
    assert len(got) == len(ODD)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    again = [sorted(map(tuple, sharding.shard_documents(docs.repartition(n)).collect())) for n in (1, 7)]
    assert again[0] == again[1]
    shards = defaultdict(list)
    for doc, size, crc, shard, slot in again[0]:
        shards[shard].append((slot, size))
    assert sorted(shards) == list(range(8))
    sizes = [sum(s for _, s in v) for v in shards.values()]
    largest = max(s for v in shards.values() for _, s in v)
    assert max(sizes) - min(sizes) <= 0.01 * np.mean(sizes) + 2 * largest
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in shards.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    hot = docs.limit(50).unionByName(docs.limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_999)))))
    spread = sharding.shard_documents(hot).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(spread) == 8 and max(r["n"] for r in spread) < 1.3 * min(r["n"] for r in spread)


def test_sharding_against_one_sorted_list(spark):
    """Where no text is heavy the order is that of the texts' and the ids' hashes, and equal texts share a shard."""
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(99)) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    rows = list(enumerate([*texts, *texts[:300], *texts[:100], None, ""]))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.1).collect()}
    key = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    total, at, lead, before, slots = sum(len(t or "") + 1 for _, t in rows), 0, 0, None, defaultdict(int)
    for _, _, doc, text in sorted((key(t or ""), key(str(d)), d, t or "") for d, t in rows):
        lead, before = (lead, before) if text == before else (at, text)
        shard = min(7, lead * 8 // total)
        assert got[doc] == (shard, slots[shard])
        slots[shard] += 1
        at += len(text) + 1


def test_sharding_keeps_groups_whole(spark):
    """Groups that fit in a shard, heavy ones too, lie in one; the others even the shards out."""
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(99)) for _ in range(rng.randrange(5, 30))) for _ in range(700)]
    rows = list(enumerate([*texts, *["same " * 12] * 80, *["other " * 9] * 60, *["third"] * 40]))
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where, sizes, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 880 and all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) < 200
    # A group of a third of all bytes exceeds a shard and is the only one to be spread.
    rows += [(2000 + i, "far too many " * 3) for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where, sizes = defaultdict(set), defaultdict(int)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert sorted(len(x) for x in where.values())[-2:][0] == 1 and max(len(x) for x in where.values()) > 1
    assert max(sizes.values()) - min(sizes.values()) < 500
    assert sharding.room([10, 0, 0], 20) == [0, 10, 20] and sharding.room([2, 0], 6) == [2, 6]


VOCABULARY = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
HARD = [
    "see <|endoftext|> here", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|>\n<|endoftext|>  ", "<|endoftext", " " * 10**6, "a" + "\n \t" * 100_000 + "b",
    "#" * 200_000, "é" * 100_000, "=" * 70_000 + " " * 70_000, "x\u2028\u00a0\u3000y", "👩‍👩‍👧 it's we'll I'M ١٢٣ ½",
]


def test_packing(spark, sf):
    """Against an untouched tokenizer of the vocabulary's own library."""
    from tokenizers import Tokenizer

    hard = spark.createDataFrame([(2000 + i, x, 0) for i, x in enumerate(HARD)], "doc_id long, text string, size long")
    docs = documents(spark, ODD).select("doc_id", "text", "size").where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(hard).unionByName(
        spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 10_000, "text", F.lit(0).cast("long").alias("size")).toDF("doc_id", "text", "size")
    )
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    tokenizer = Tokenizer.from_file(VOCABULARY[0])
    for special in (True, False):
        tokenizer.encode_special_tokens = not special
        packed = packing.pack_documents(docs, *VOCABULARY, max_segments=40, special=special).collect()
        pieces, bins = defaultdict(list), defaultdict(list)
        for r in packed:
            pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert set(pieces) == set(texts)
        for doc, text in texts.items():
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
            assert b"".join(x for _, x, _ in sorted(pieces[doc])) == ids.tobytes() and {n for _, _, n in pieces[doc]} == {len(ids)}, text[:40]
        for held in bins.values():
            held.sort()
            assert sum(n for _, n in held) <= 1024 and len(held) <= 40
            assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held[:-1]]]).tolist()
        assert sum(n for held in bins.values() for _, n in held) / 1024 / len(bins) > 0.95
    assert packing.pack_documents(docs.limit(0), *VOCABULARY).count() == 0


def test_the_limit_on_loss_closes_sequences(spark):
    rng = random.Random(8)
    rows = [(i, f"{'q ' * rng.randrange(1, 30)}|{' r' * n}", 0, n) for i, n in enumerate([rng.randrange(0, 60) for _ in range(400)] + [900, 2000])]
    docs = spark.createDataFrame([(i, t, t.index("|") + 1, len(t) - t.index("|") - 1) for i, t, _, _ in rows], "doc_id long, text string, first long, many long")
    got = packing.pack_documents(docs, *VOCABULARY, max_loss=200, loss=("first", "many")).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, _, _, n in rows:  # each r and the end id bear loss, but for the first id of a later piece
        assert sum(r["loss_tokens"] for r in by_doc[i]) == (n + 1 if n else 0) - (len(by_doc[i]) - 1)
    held = [(sum(r["length"] for r in x), len(x), sum(r["loss_tokens"] for r in x)) for x in bins.values()]
    assert all(a <= 1024 and b <= 64 and c <= 200 for a, b, c in held)
    assert sum(a < 700 and b < 40 and c >= 190 for a, b, c in held) > len(held) / 2  # loss alone closed them
    with pytest.raises(ValueError):
        packing.pack_documents(docs, *VOCABULARY, max_loss=0)


def test_dot_product_bins_keep_all_limits():
    rng = np.random.default_rng(6)
    demands = np.stack([rng.integers(1, 1025, 2000), np.ones(2000, int), rng.integers(0, 600, 2000)], axis=1)
    demands[:, 2] = np.minimum(demands[:, 2], demands[:, 0])
    limits = np.array([1024, 4, 600])
    bins = packing.dot_product_bins(demands, limits)
    assert sorted(sum(bins, [])) == list(range(2000))
    assert all((demands[b].sum(axis=0) <= limits).all() for b in bins)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.run(spark, sf).count() > n // 2


def test_only_stored_tables_are_forgotten(spark, tmp_path):
    from cadenza.llm.shared import forget, stored

    spark.range(5).write.parquet(f"file://{tmp_path}/mine")
    mine = spark.read.parquet(f"file://{tmp_path}/mine")
    table = stored(mine)
    forget(mine)
    assert mine.count() == 5 and table.inputFiles()
    forget(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()
