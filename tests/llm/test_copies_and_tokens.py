"""SimHash, byte-level BPE, language ID and sharding."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayflow.llm import bpe, components, langid, sharding, simhash

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- SimHash ---


def slow_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "One two", "A b C d a B c D", "É à b c d", "x " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def slow_components(prints, radius):
    ids = sorted(prints, key=lambda i: (i is None, i))
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("tile", "blocks"), [(4, 4), (1024, 4), (1024, 6)])
def test_links_against_brute_force(spark, tile, blocks):
    rng = random.Random(tile)
    prints = {}
    for base in [0, (1 << 64) - 1, *[rng.getrandbits(64) for _ in range(8)]]:
        for _ in range(25):
            v = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 7])):
                v ^= 1 << b
            prints[len(prints)] = v
    for v in [rng.getrandbits(64) for _ in range(60)]:
        prints[len(prints)] = v
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(prints.values())]
    edges = simhash.links(spark.createDataFrame(signed, "fp long").repartition(5), 3, tile, blocks)
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.components(edges).collect()}
    want = slow_components({v: v for v in set(prints.values())}, 3)
    groups = lambda m: Counter(frozenset(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups({v: found.get(v, v) for v in want}) == groups(want)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 90)] + [(5000, 5000), (7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(90)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_odd_rows(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(400))
    other = " ".join(rng.choice("stuvwxyz") * rng.randint(1, 6) for _ in range(400))
    rows = [(3, text), (2, text.upper()), (None, text), (9, other), (9, other), (5, None), (4, ""), (None, "alone among the others here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "root", "node", "fingerprint", "component_id", "kept_id")})
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (-1, 2), (9, 9), (9, 9), (5, 4), (4, 4), (-1, None)], key=str)
    left = simhash.representatives(df)
    assert left.columns == df.columns and Counter(r["doc_id"] for r in left.collect()) == {2: 1, 9: 1, 4: 1, None: 1}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.representatives(df.limit(0)).count() == 0


def test_bucket_tiles_against_all_pairs():
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 1 << 63, 40, np.uint64)
    fp = np.unique(bases[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, np.uint64)))
    bucket = rng.integers(0, 5, len(fp))
    count = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((count, bucket))
    bucket, fp, count = bucket[order], fp[order], count[order]
    for side in (3, 64, 2000):
        u, v = simhash.bucket_links(bucket, fp, count, 3, side)
        near = (np.bitwise_count(fp[:, None] ^ fp) <= 3) & (bucket[:, None] == bucket)
        x, y = np.nonzero(np.triu(near, 1))
        assert (simhash.stars(u, v, len(fp)) == simhash.stars(x, y, len(fp))).all() and len(u) < len(fp)


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.blocks_for(n, 3) for n in (0, 1000, 1 << 24, 1 << 25, 1 << 33, 1 << 34, 1 << 40)] == [4, 4, 4, 5, 5, 6, 6]
    assert simhash.blocks_for(10**6, 0) == 1


def similar_pairs(texts, least=0.8):
    """All pairs whose sets of five-word shingles (as strings) have that Jaccard similarity, exactly: such pairs share one of
    the first elements in any order of all shingles."""
    sets = []
    for t in texts:
        w = split_low(t)
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    held, pairs = {}, set()
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n = len(sets[i])
        first = sorted(sets[i])[: n - math.ceil(least * n) + 1]
        for j in {j for s in first for j in held.get(s, ())}:
            both = len(sets[i] & sets[j])
            if both >= least * (n + len(sets[j]) - both):
                pairs.add((min(i, j), max(i, j)))
        for s in first:
            held.setdefault(s, []).append(i)
    return pairs


def split_low(text):
    return [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]


def grouped_texts(spark, texts, **how):
    """component_id of each text, the operator's and that of brute force (all pairs within 3 bits or similar)."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash._groups(df, "doc_id", "text", 3, 3, how.get("tile", 1024), 5, 0.8).collect()}
    prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    u, v = [], []
    for at in range(0, len(prints), 500):
        x, y = np.nonzero(np.bitwise_count(prints[at : at + 500, None] ^ prints) <= 3)
        u.append(x + at)
        v.append(y)
    pairs = np.array(sorted(similar_pairs(texts)), np.int64).reshape(-1, 2)
    root = simhash.stars(np.concatenate([*u, pairs[:, 0]]), np.concatenate([*v, pairs[:, 1]]), len(texts))
    return found, dict(enumerate(root.tolist()))


def test_all_similar_pairs_are_linked_whole_table(spark):
    """Recall on sf0.1: every pair within 3 bits or with a five-word similarity of 0.8 or more, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select("text").distinct()
    texts = sorted(r["text"] for r in docs.collect())
    found, want = grouped_texts(spark, texts)
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 40 and all(found[i] == found[want[i]] for i in linked)
    # an edited copy may be linked through documents that only its family joins, never without such a pair
    assert sum(found[i] != i for i in want) == len(linked)


@pytest.mark.parametrize("tile", [8, 1024])
def test_similar_texts_of_many_copies(spark, tile):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7)))
    texts = []
    for n in (3, 7, 8, 12, 60, 200, 400):
        base = [word() for _ in range(n)]
        for _ in range(31):
            text = list(base)
            for at in rng.sample(range(n), rng.randint(0, max(1, n // 25))):
                text[at] = word()
            texts.append(" ".join(text))
    rng.shuffle(texts)
    found, want = grouped_texts(spark, texts, tile=tile)
    assert found == want and len(set(want.values())) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.representatives(df, tile=tile).collect()} == set(want.values())


def test_shingles_and_bands():
    one = lambda t: set(simhash.shingles(t).tolist())
    a, b = one("a b c d e f"), one("x A b c d e f")
    assert len(a) == 2 and len(a & b) == 2 and not one("") and len(one("a b")) == len(one("a b c d")) == 1
    assert len({*one("a b c d"), *one("a b c"), *one("b c d"), *one("a b c e"), *one("a c b d")}) == 5
    rng = random.Random(0)
    hits = 0
    for _ in range(300):
        text = [str(rng.random()) for _ in range(120)]
        other = text[:107] + [str(rng.random()) for _ in range(13)]  # similarity 103 / 129
        keys = [simhash.band_keys(simhash.shingles(" ".join(t)).view(np.uint64)) for t in (text, other)]
        hits += (keys[0] == keys[1]).any()
    assert hits >= 299 and len(simhash.band_keys(np.zeros(0, np.uint64))) == 0


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def known():
    ranks = bpe.load_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, bpe.Encoder(ranks, states=5000, pieces=500), bpe.Decoder(ranks, 3), ranks


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


PARTS = st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" the", "ing", "'s", "  ", "\n\n", "\x1c", "\x85", " ", "é", "12", "½", "日本", "🙂", "<|endoftext|>"])), max_size=14).map("".join)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(PARTS)
def test_encoding_equals_the_library(known, text):
    text = text.encode("utf-8", "replace").decode()
    own, encoder, decoder, _ = known
    got = ids_of(encoder, text)
    assert got == own.encode_ordinary(text) and decoder.decode(got) == text


def test_every_character_is_of_the_librarys_kind(known):
    own, encoder, _, _ = known
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 2000):
        text = "".join(f"a{c}1{c}'s {c}" for c in points[at : at + 2000])
        if ids_of(encoder, text) != own.encode_ordinary(text):
            bad = [c for c in points[at : at + 2000] if ids_of(encoder, t := f"a{c}1{c}'s {c}") != own.encode_ordinary(t)]
            raise AssertionError([hex(ord(c)) for c in bad])


def test_pattern_is_the_vocabularys():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_transducer_equals_the_definition(known):
    rng = random.Random(2)
    for bounds in ({"states": 300}, {"moves": 200}):  # often begun anew
        machine = bpe.Transducer(known[3], **bounds)
        for _ in range(400):
            data = bytes(rng.choices(b"aeinrst h\xc3\xa9\x00\xff", k=rng.randint(0, 50)))
            assert machine.encode(data) == machine.merged(data)
            assert len(machine.content) <= 200_000 and len(machine.moves) <= bounds.get("moves", 1 << 30)
    long = b"ab" * 50_000
    assert b"".join(machine.token[t] for t in machine.encode(long)) == long


def test_tokens_leave_after_bounded_lookahead(spark, sf_dir, known):
    """How many bytes are read beyond the end of a token before it is emitted, over the whole table and long pieces."""
    machine, most = bpe.Transducer(known[3]), 0
    rng = random.Random(4)
    longest = max(map(len, known[3]))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    words = {w for t in texts for w in known[1].find(t)}
    pieces = [w.encode() for w in words] + [bytes(rng.choices(b"abcdefghij", k=5000)), b"ab" * 5000, b"a" * 5000, bytes(rng.choices(range(256), k=5000)), ("é日本" * 2000).encode()]
    for data in pieces:
        done, tokens = 0, []
        for read, some in machine.pieces(data):
            for t in some:
                done += len(machine.token[t])
                most = max(most, read - done)
            tokens += some
        assert b"".join(machine.token[t] for t in tokens) == data
        if len(data) <= 60:
            assert tokens == machine.merged(data)
    assert most <= 2 * longest + bpe.LOOK


def test_utf8_machine():
    for text in ("añb", "日本語🙂é", ""):
        data = text.encode()
        for size in (1, 2, 3, 5):
            m = bpe.Utf8Machine()
            assert "".join(m.feed(data[i : i + size]) for i in range(0, len(data), size)) + m.finish() == text
    m = bpe.Utf8Machine()
    assert m.feed(b"a\xe6\x97") == "a" and m.finish() == "�"
    for bad in (b"\xed\xa0\x80", b"\xc0\xaf", b"\xf5\x80", b"\xff", b"\xe0\x80", b"\xf0\x80\x80"):
        m = bpe.Utf8Machine()
        assert "".join(m.feed(bad[i : i + 1]) for i in range(len(bad))) + m.finish() == bad.decode("utf-8", "replace")


def test_bpe_columns(spark, known):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the end"), (3, "the end"), (4, "word " * 30_000)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("token_ids", "encoded_text", "ids")})
    coded = bpe.encode(df, PATH, decoded="back")
    rows = coded.collect()
    assert set(coded.columns) == {"doc_id", "text", "encoded_text", "ids", "token_ids", "back"}
    assert all(r["back"] == (r["text"] or "") and r["token_ids"] == known[0].encode_ordinary(r["text"] or "") for r in rows) and len(rows) == 5
    odd = spark.createDataFrame([(None,), ([],), ([262, 999_999, -1, None],)], "token_ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, PATH).collect()] == [None, "", " the���"]
    assert bpe.encode(df.limit(0), PATH).count() == 0


# --- language ID ---


def test_words_first_then_shorter_grams():
    langs, log = ["a", "b"], lambda *p: list(p)
    model = langid.Model(langs, [{"haus": log((0, 5.0))}, {"h": log((1, 1.0))}, {"ab": log((1, 3.0))}], [[-8, -8]] * 3, 1)
    assert model.word("haus")[0] == 0 and model.word("abba")[0] == 2 and model.word("hhh")[0] == 1 and model.word("zzz") is None
    assert model.predict("haus")[0] == "a" and model.predict("Abba")[0] == "b"
    assert model.predict("zzz") == ("b", 0.5) and model.predict("12 -- 3") == ("und", 0.0) == model.predict(None)
    assert langid.Model([], [{}], [[]], 0).predict("word") == ("und", 0.0)


def test_held_out_accuracy_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    rows = langid.predict(docs, model).select("doc_id", "lang", "predicted.*", langid.held_out().alias("held")).collect()
    held = [r for r in rows if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "123 !"), (3, "the of and " * 50_000), (3, "the")], "doc_id long, text string").withColumn("predicted", F.lit(1))
    got = {(r["doc_id"], r["text"] and r["text"][:5]): r["predicted"]["lang_pred"] for r in langid.predict(odd, model).collect()}
    assert [got[k] for k in ((None, None), (1, ""), (2, "123 !"))] == ["und"] * 3 and got[3, "the o"] == "en"
    for text in ("½ ²", "١٢٣", "\u0301", "_ -", "IV\u0301"):
        assert (model.predict(text)[0] == "und") == (not any(unicodedata.category(c)[0] == "L" for c in text)), text
    assert langid.words_of("Ḿa\u0301 हिन्दी x2y ½") == ["ḿa\u0301", "हिन्दी", "x", "y"]
    empty = langid.fit(docs.limit(0))
    assert langid.predict(odd, empty).where("predicted.lang_pred <> 'und'").count() == 0


def test_fit_against_counts(spark):
    """Each language keeps all its words and n-grams, however many languages there are."""
    rng = random.Random(3)
    rows = [(f"l{k:03}", " ".join(f"w{k}{'abcdef'[rng.randint(0, 5)]}q" for _ in range(30))) for k in range(600)] + [(None, "x"), ("l001", None)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), longest=2)
    assert len(model.langs) == 600 and model.predict("w599")[1] > 0
    for k in (0, 321, 599):
        for level in range(3):
            counts = Counter()
            for w in langid.words_of(rows[k][1]):
                counts.update([w] if not level else [f" {w} "[i : i + level] for i in range(len(w) + 3 - level)])
            assert {t: h for t, hits in model.levels[level].items() for i, h in hits if i == k} == pytest.approx({t: math.log((n + 0.5) / 0.5) for t, n in counts.items()})
            assert model.floors[level][k] == pytest.approx(math.log(0.5 / (sum(counts.values()) + 0.5 * (len(counts) + 1))))


def slow_predict(text, learned, longest=5):
    """The language and score of a text from plain counts: {lang: [counters of words and n-grams]}."""
    words = langid.words_of(text)
    langs = sorted(learned)
    if not words:
        return "und", 0.0
    floor = {(g, n): math.log(0.5 / (sum(learned[g][n].values()) + 0.5 * (len(learned[g][n]) + 1))) for g in langs for n in range(longest + 1)}
    total, used = dict.fromkeys(langs, 0.0), 0
    for w in words:
        for n in [0, *range(longest, 0, -1)]:
            padded = f" {w} "
            parts = [p for p in ([w] if n == 0 else [padded[i : i + n] for i in range(len(padded) - n + 1)]) if any(p in learned[g][n] for g in langs)]
            if parts:
                used += 1
                for g in langs:
                    total[g] += floor[g, n] + sum(math.log((learned[g][n][p] + 0.5) / 0.5) if p in learned[g][n] else 0.0 for p in parts) / len(parts)
                break
    if not used:
        return None
    mean = {g: total[g] / used for g in langs}
    best = max(langs, key=lambda g: (mean[g], [-ord(c) for c in g]))
    return best, 1 / sum(math.exp(mean[g] - mean[best]) for g in langs)


def test_predictions_against_plain_counts(spark, sf_dir):
    """The whole table, row by row, learned and predicted without Spark, NumPy or caches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned: dict = {}
    for r in docs.where(~langid.held_out()).collect():
        if r["text"] is not None and r["lang"] is not None:
            counters = learned.setdefault(r["lang"], [Counter() for _ in range(6)])
            for w in langid.words_of(r["text"]):
                counters[0][w] += 1
                for n in range(1, 6):
                    counters[n].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    got = langid.predict(docs, langid.fit(docs.where(~langid.held_out()))).select("text", "predicted.*").collect()
    for r in got:
        want = slow_predict(r["text"], learned)
        assert want is not None and r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1])


def test_repeated_texts_do_not_exceed_the_sample(spark, monkeypatch):
    rows = [("a", "again and again")] * 300 + [("a", f"word{c}") for c in "bcdefgh"] + [("b", "other words")] * 2
    seen = []
    monkeypatch.setattr(langid, "_terms", lambda sample, longest, real=langid._terms: seen.append(sample.groupBy("lang").count().collect()) or real(sample, longest))
    langid.fit(spark.createDataFrame(rows, "lang string, text string"), docs_per_lang=10)
    assert {r["lang"]: r["count"] for r in seen[0]}.get("a", 0) <= 10


# --- sharding ---


def test_pack_is_balanced_and_whole():
    rng = np.random.default_rng(0)
    sizes = np.stack([rng.pareto(1.5, 4000) * 100 + 1, rng.pareto(1.5, 4000) * 20, np.ones(4000)], axis=1)
    placed = sharding.pack(sizes, 16)
    for k in range(3):
        sums = np.bincount(placed, sizes[:, k], 16)
        assert sums.max() / sums.mean() < 1.03 or sums.max() <= sizes[:, k].max() * 1.01
    assert sharding.pack(sizes[:0], 4).tolist() == [] and sharding.pack(np.zeros((3, 3)), 4).max() < 4
    # shards that have more already get less
    left = np.array([[0.1] * 3, [0.4] * 3, [0.5] * 3])
    sizes = np.stack([rng.integers(1, 900, 4000), rng.integers(1, 90, 4000), np.ones(4000)], axis=1)
    sums = np.bincount(sharding.pack(sizes, 3, left=left), sizes[:, 0], 3) / sizes[:, 0].sum()
    assert abs(sums - left[:, 0]).max() < 0.01


def test_classes_of_pieces():
    assert sharding.classes_of({2: 5, 1: 3, 3: 90, 4: 200, 6: 1}, 100) == [(1, 3, 98), (4, 4, 200), (6, 6, 1)]
    assert sharding.classes_of({0: 500, 1: 3}, 100) == [(0, 0, 500), (1, 1, 3)] and sharding.classes_of({}, 9) == []


@pytest.mark.parametrize(("sf", "cell", "of_bytes", "of_others"), [("sf0.01", 8192, 0.02, 0.02), ("sf0.01", 100, 0.03, 0.1), ("sf0.1", 2000, 0.01, 0.02)])
def test_shards_of_the_table(spark, sf, cell, of_bytes, of_others):
    """The contract, by brute force: sizes, crc, gapless slots, equal texts in one shard, balance of bytes, tokens and rows."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = sharding.shard(docs.repartition(5), cell=cell).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    shards_of, slots, sums = {}, {}, np.zeros((16, 3))
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["tokens"] == len(re.split("[\x20\x09-\x0d]+", t.strip(" \t\n\x0b\x0c\r"))) * (not not t.strip(" \t\n\x0b\x0c\r"))
        shards_of.setdefault(t, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] += [r["size"], r["tokens"], 1]
    assert all(len(s) == 1 for s in shards_of.values())  # no group has a whole shard's share here
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # bytes are the law; cells of 100 groups have only six for a shard
    uneven = abs(sums / sums.mean(axis=0) - 1).max(axis=0)
    assert uneven[0] < of_bytes and uneven[1:].max() < of_others


@pytest.mark.parametrize("ids", [1, 3])
def test_shards_of_repeated_rows(spark, monkeypatch, ids):
    """Rows that are equal in id and text are dealt evenly as well, by a task that makes 50 copies at most."""
    monkeypatch.setattr(sharding, "MANY", 50)
    rows = [(7 + i % ids, "same row again") for i in range(4000)] + [(100 + i, f"text {i} é") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=8).toPandas()
    assert sorted(got["doc_id"]) == sorted(i for i, _ in rows)
    sums = got.groupby("shard")["size"].agg(["sum", "count"])
    assert sums["sum"].max() / sums["sum"].mean() < 1.02 and sums["count"].max() / sums["count"].mean() < 1.1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def slow_placement(sizes, shards):
    """{group: shard}: the heaviest first, each to the shard with the highest dot product of its shares and what is left."""
    total = [sum(s[k] for s in sizes.values()) for k in range(3)]
    share = {g: [s[k] / total[k] if total[k] else 0.0 for k in range(3)] for g, s in sizes.items()}
    left, found = [[1 / shards] * 3 for _ in range(shards)], {}
    for g in sorted(sizes, key=lambda g: (-max(share[g]), *g)):
        dots = [4 * left[i][0] * share[g][0] + left[i][1] * share[g][1] + left[i][2] * share[g][2] for i in range(shards)]
        best = max(range(shards), key=lambda i: (round(dots[i], 15), -i))
        found[g] = best
        for k in range(3):
            left[best][k] -= share[g][k]
    return found


def test_placement_against_brute_force(spark):
    """Every row's shard, for a table that is one cell."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "bb", "ccc", "日本"], k=rng.randint(0, 60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, rng.choice(texts)) for i in range(400)] + [(None, None), (None, "")], "doc_id long, text string")
    got = sharding.shard(docs, shards=5).toPandas()
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), F.coalesce("text", F.lit("")).alias("t")).collect()
    sizes: dict = {}
    for r in keys:
        s = sizes.setdefault((r["h"], r["c"]), [0, 0, 0])
        for k, x in enumerate((len(r["t"].encode()) + 1, len(r["t"].split()), 1)):
            s[k] += x
    want = slow_placement(sizes, 5)
    by_id = {r["doc_id"]: want[r["h"], r["c"]] for r in keys}
    assert all(by_id[None if i != i else int(i)] == s for i, s in zip(got["doc_id"], got["shard"], strict=True))


def test_shards_of_a_hot_group(spark):
    rows = [(i, "the same text everywhere") for i in range(3000)] + [(5000 + i, f"text {i} " * (i % 7 + 1)) for i in range(6000)] + [(None, None), (None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "slot", "piece", "h", "size", "cell")})
    got = sharding.shard(df, shards=8).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(8))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() / sums.mean() < 1.02
    counts = got.groupby("shard")["size"].count()
    assert counts.max() / counts.mean() < 1.1
    one = {(int(r.doc_id) if r.doc_id == r.doc_id else None): r for r in got.itertuples()}
    assert one[5003].size == len(rows[3003][1].encode()) + 1 and one[5003].text_crc32 == zlib.crc32(rows[3003][1].encode())
    assert one[None].size == 1 and one[None].text_crc32 == 0
    split = got.groupby("text_crc32")["shard"].nunique()
    hot = zlib.crc32(b"the same text everywhere")  # a third of the rows: more than two shards' shares
    assert split.drop(hot).max() == 1 and split[hot] > 2
    assert sharding.shard(df.limit(0)).count() == 0
