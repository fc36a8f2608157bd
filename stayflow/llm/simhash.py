"""SimHash fingerprints and the exact graph of fingerprints within a Hamming radius.

Every distinct fingerprint goes to one bucket for each choice of all blocks of its bits but `radius`: two fingerprints
within the radius agree on one such choice at least, so no link is lost. In a bucket the fingerprints stand in order of
their population counts and are compared exactly, tile against tile, by numpy's exclusive-or and bit counts; tile pairs
further apart in population count than the radius are skipped. Buckets of up to `tile` fingerprints are compared in the
task that sorts them; a larger one is cut into tiles by population count and hash, and each pair of tiles is a group of
its own, so that no task gets a large bucket. A tile pair returns a star for each of its connected parts instead of all
linked pairs.

`representatives` also wants the pairs whose sets of five-word shingles are similar. Those differ in too many bits for
blocks of a fingerprint, so candidates come from bands of smallest shingle hashes. What is found is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.llm.common import free_name
from stayflow.llm.components import components
from stayflow.sources.store import scratch, written

#: Fingerprints of a bucket that one task compares; larger buckets are dealt out as pairs of tiles.
TILE = 1024
#: Fingerprints that are compared at once: side of a tile in numpy.
SIDE = 64
#: Bands of smallest shingle hashes and hashes in a band: of pairs with a similarity of 0.8, 0.9998 share a band.
BANDS, ROWS = 28, 6
EDGES = "u long, v long"
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, in order and with repeats; none if it has no word.

    A-Z are lower-cased; words lie between ASCII white space; fewer words than `size` are one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[min(size, len(found)) - 1 :], strict=False)
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in spans), np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if more than half of them have it; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as an unsigned number; 0 if it has no word."""
    return simhash_of(shingle_hashes(text, size, seed))


def wider(hashes: np.ndarray, size: int, words: int) -> np.ndarray:
    """Hashes of shingles of `words` words, from those of `size` words that they are made of. A text of fewer words is one shingle."""
    n = len(hashes) + size - words
    if not len(hashes) or words <= size:
        return hashes
    steps = sorted({*range(0, words - size, size), words - size}) if n > 0 else range(len(hashes))
    found = np.zeros(max(n, 1), np.uint64)
    for k in steps:
        found = (found ^ hashes[k : k + len(found)]) * ODD
        found ^= found >> np.uint64(29)
    return found


def shingles(text: str | None, words: int = 5, size: int = 3) -> np.ndarray:
    """Distinct hashes of a text's shingles of `words` words, in order of value; words as for the fingerprint."""
    return np.unique(wider(shingle_hashes(text, size), size, words)).view(np.int64)


@cache
def multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), 42) | 1 for i in range(n)], np.uint64)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band: `rows` smallest values of the shingle hashes, each under a multiplier of its own. None of no hash."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    odd = multipliers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * odd[None, :]).min(axis=0), out=least)
    found = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T:
        found = (found ^ column) * ODD
        found ^= found >> np.uint64(32)
    return found.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = 3) -> DataFrame:
    """Add the SimHash of each whole text as a signed long; null and blank texts get 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text)))


def with_signature(docs: DataFrame, text: str, size: int, words: int) -> DataFrame:
    """Add fingerprint and bands (array<long>, the band keys of shingles of `words` words) in one pass over the text."""

    @F.pandas_udf("fingerprint long, bands array<long>")
    def signature(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingle_hashes(t, size) for t in texts]
        prints = np.array([simhash_of(h) for h in hashes], np.uint64).view(np.int64)
        return pd.DataFrame({"fingerprint": prints, "bands": [band_keys(wider(h, size, words)) for h in hashes]})

    return docs.withColumn("signature", signature(F.col(text))).select("*", "signature.*").drop("signature")


def stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For edges between 0..n-1 the smallest node that each node reaches."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while not np.array_equal(jump := root[root], root):
            root = jump
        apart = root[u] != root[v]
        if not apart.any():
            break
        # hook the roots as well, so that chains shrink
        a, b = root[u[apart]], root[v[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        u, v = u[apart], v[apart]
    while not np.array_equal(jump := root[root], root):
        root = jump
    return root


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (u, v) of the connected parts of the graph that links each of a with each of b within the radius."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    for at in range(0, len(a), 256):
        x, y = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius)
        root = stars(root[inverse[x + at]], root[inverse[y + len(a)]], len(nodes))[root]
    tips = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[tips]], nodes[tips]


def bucket_links(bucket: np.ndarray, fp: np.ndarray, count: np.ndarray, radius: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Stars (u, v), as row numbers, of the parts that pairs of equal bucket within the radius connect.

    Rows come in order of (bucket, population count) and are cut into tiles of `side` rows. A tile is compared with itself
    and with the tiles after it, up to the first that its last bucket does not reach or whose population counts there are
    beyond the radius.
    """
    n = len(fp)
    u, v = [], []
    for a in range(0, n, side):
        end = min(a + side, n)
        for b in range(a, n, side):
            if b > a and (bucket[b] != bucket[end - 1] or count[b] - count[end - 1] > radius):
                break
            near = np.bitwise_count(fp[a:end, None] ^ fp[None, b : b + side]) <= radius
            near &= bucket[a:end, None] == bucket[None, b : b + side]
            x, y = np.nonzero(np.triu(near, 1) if a == b else near)
            u.append(x + a)
            v.append(y + b)
    if not u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = stars(np.concatenate(u), np.concatenate(v), n)
    tips = np.flatnonzero(root != np.arange(n))
    return root[tips], tips


def blocks_for(n: int, radius: int, mean: int = 256) -> int:
    """Into how many blocks to cut fingerprints so that a bucket of random ones has at most about `mean` of n.

    With radius + 1 blocks a key has 64 / (radius + 1) bits. More blocks give longer keys and more of them: for a radius
    of 3 it is 4 keys of 16 bits up to 2^24 fingerprints, 10 of 25 bits up to 2^33, 20 of 32 bits up to 2^40.
    """
    blocks = radius + 1
    while blocks < 2 * radius and 64 * (blocks - radius) // blocks < log2(max(n, 1) / mean):
        blocks += 1
    return blocks


def links(prints: DataFrame, radius: int = 3, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """prints (fp long, distinct) -> (u, v): edges whose connected components are those of all pairs within the radius.

    The result is the same for any number of blocks over the radius; it only sets how keys and buckets are balanced.
    """
    if not 0 <= radius < 16:
        raise ValueError("radius must be from 0 to 15")
    blocks = blocks or radius + 1
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    ends = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    rows = prints.where("fp is not null").select("fp", F.inline(keyed)).withColumn("pc", F.bit_count("fp").cast("int"))
    sizes = rows.groupBy("block", "value", "pc").agg(F.count("*").alias("n"))
    full = sizes.groupBy("block", "value").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("pc", F.ceil(F.col("n") / tile).cast("int").alias("subs"))).alias("tiles")
    )
    full = written(full.where(F.col("n") > tile).select("block", "value", "tiles"), "buckets")
    small = rows.join(full, ["block", "value"], "left_anti")
    small = small.repartition("block", "value").sortWithinPartitions("block", "value", "pc")
    edges_small = small.select("block", "value", "pc", "fp").mapInArrow(lambda it: _small_buckets(it, radius), EDGES)
    return edges_small.unionByName(_large_buckets(rows.join(full, ["block", "value"]), radius))


def _small_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    kept: tuple[np.ndarray, ...] = ()

    def out(block, value, pc, fp):
        new = np.r_[False, (block[1:] != block[:-1]) | (value[1:] != value[:-1])]
        u, v = bucket_links(np.cumsum(new), fp.view(np.uint64), pc, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], names=["u", "v"])

    for batch in batches:
        got = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        rows = tuple(np.concatenate(x) for x in zip(kept, got, strict=True)) if kept else got
        if not len(rows[0]):
            continue
        block, value = rows[:2]
        whole = len(block) - int(((block == block[-1]) & (value == value[-1])).sum())  # the last bucket may go on
        kept = tuple(x[whole:] for x in rows)
        if whole:
            yield out(*(x[:whole] for x in rows))
    if kept:
        yield out(*kept)


def _large_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """rows (block, value, fp, pc, tiles array<struct<pc, subs>>): a group for each pair of tiles within the radius."""
    own = F.filter("tiles", lambda t: t.pc == F.col("pc"))[0]["subs"]
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(F.lit("tile"), "fp"), own).cast("int"))
    near = F.filter("tiles", lambda t: F.abs(t.pc - F.col("pc")) <= radius)
    others = F.flatten(
        F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t.subs - 1), lambda s: F.struct(t.pc.alias("pc"), s.alias("sub"))))
    )
    me, other = F.struct("pc", "sub"), F.col("other")
    pairs = rows.withColumn("other", F.explode(others)).select(
        "block", "value", "fp", F.least(me, other).alias("a"), F.greatest(me, other).alias("b"), (me == F.least(me, other)).alias("first"), (me == other).alias("own")
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        fp = part["fp"].to_numpy().view(np.uint64)
        first = part["first"].to_numpy()
        a, b = (fp, fp) if part["own"].iloc[0] else (fp[first], fp[~first])
        u, v = tile_links(a, b, radius) if len(a) and len(b) else (fp[:0], fp[:0])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.groupBy("block", "value", "a", "b").applyInPandas(compare, EDGES)


def bitmaps(sets: list[np.ndarray], words: int = 64) -> np.ndarray:
    """64 * words bits of each set, those that its hashes name. Sets differ by at least as many elements as their bits do."""
    found = np.zeros((len(sets), words), np.uint64)
    for i, one in enumerate(sets):
        flags = np.zeros(64 * words, bool)
        flags[one.view(np.uint64) % np.uint64(64 * words)] = True
        found[i] = np.packbits(flags).view(np.uint64)
    return found


def joins(part: np.ndarray, side: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs that join parts: of all pairs of different parts whose sets have a Jaccard similarity of `least` or more, as
    many as connect what they all connect. Rows of the same side other than 0 are not compared.

    Pairs are compared tile by tile. Sizes alone rule out most, then the bits in which the two bitmaps differ: similar
    sets differ by at most (1 - least) / (1 + least) of the sum of their sizes. The rest is verified on the sets.
    """
    n, root, maps = len(sets), np.unique(part, return_inverse=True)[1], bitmaps(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    apart, out = (1 - least) / (1 + least) + 1e-9, []
    for at in range(0, n, 256):
        x = slice(at, at + 256)
        near = (root[x, None] != root) & ((side[x, None] == 0) | (side[x, None] != side)) & (np.arange(n) > np.arange(n)[x, None])
        near &= np.minimum(sizes[x, None], sizes) >= least * np.maximum(sizes[x, None], sizes)
        u, v = np.nonzero(near)
        u += at
        for start in range(0, len(u), 1 << 13):
            i, j = u[start : start + (1 << 13)], v[start : start + (1 << 13)]
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
            bits = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
            maybe = bits <= apart * (sizes[i] + sizes[j])
            for a, b in zip(i[maybe].tolist(), j[maybe].tolist(), strict=True):
                if root[a] != root[b]:
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if both >= least * (sizes[a] + sizes[b] - both):
                        out.append((a, b))
                        root[root == root[b]] = root[a]
    return out


def _joined(rows: DataFrame, least: float) -> DataFrame:
    """rows (family, a, b, side, part, fp, set) -> (u, v): `joins` of each group (family, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            side, part, fp = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3])
            pairs = np.array(joins(part, side, [h[3] for h in held], least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], names=["u", "v"])

        for batch in batches:
            family, a, b, side, part, fp = (batch.column(i).to_pylist() for i in range(6))
            sets = batch.column(6)
            values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
            for i in range(len(fp)):
                if (now := (family[i], a[i], b[i])) != key:
                    if len(held) > 1:
                        yield out()
                    key, held = now, []
                held.append((side[i], part[i], fp[i], values[ends[i] : ends[i + 1]].copy()))
        if len(held) > 1:
            yield out()

    rows = rows.select("family", "a", "b", "side", "part", "fp", "set")
    return rows.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b").mapInArrow(run, EDGES)


def band_links(texts: DataFrame) -> DataFrame:
    """texts (fp, bands) -> (u, v): a star for each band key that several fingerprints have, not verified."""
    rows = texts.select("fp", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.min("fp").alias("v"), F.max("fp").alias("high")).where("v <> high").drop("high")
    return rows.withColumnRenamed("fp", "u").join(shared, ["band", "key"]).where("u <> v").select("u", "v").distinct()


def similar(texts: DataFrame, near: DataFrame, named: DataFrame, words: int, size: int, least: float, tile: int) -> DataFrame:
    """texts (fp, copy, doc_id, bands), a row per distinct text; near (u, v), links to keep -> (u, v): near and more, so that
    the components are those of near and of all pairs of a family whose sets of shingles of `words` words have a Jaccard
    similarity of `least` or more.

    A family is a component of near and of all pairs that share a band, verified or not, so nothing is thinned before it
    is verified: pairs of a family are compared exactly unless links already verified join them. Texts of one fingerprint
    are members of their own if their sets differ; only texts of families that near leaves apart are shuffled. A family of
    more than `tile` is first compared in tiles by hash, with a few members that all tiles have; then what is outside of
    its largest part is compared with all members, tile against tile.
    """
    found = written(band_links(texts), "candidates")
    families = components(near.unionByName(found)).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    parts = components(near).select(F.col("node").alias("fp"), F.col("root").alias("part"))
    members = written(families.join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp")), "families")
    apart = members.groupBy("family").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    members = written(members.join(apart.select("family"), "family"), "apart")

    chosen = texts.join(members.select("fp"), "fp", "left_semi").select("fp", F.col("doc_id").alias("id"), F.col("copy").alias("chosen"))
    wanted = named.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("chosen"))).select("fp", "text")

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words, size) for t in texts])

    sets = wanted.select("fp", hashed("text").alias("set")).withColumn("own", F.xxhash64("set"))
    sets = written(sets.dropDuplicates(["fp", "own"]), "shingles")
    members = written(members.join(sets.select("fp", "own"), "fp"), "members")
    tiles = members.groupBy("family").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    members = members.join(tiles, "family").withColumn("a", F.pmod(F.xxhash64(F.lit("tile"), "fp", "own"), "tiles").cast("int"))
    members = written(members, "tiles")
    large = members.where("tiles > 1")
    common = large.groupBy("family", F.pmod(F.xxhash64(F.lit("common"), "fp"), F.lit(8))).agg(F.min(F.struct("fp", "own")).alias("m")).select("m.*")
    common = large.join(common, ["fp", "own"]).withColumn("home", F.col("a")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("a <> home").drop("home")
    compared = members.unionByName(common).withColumns({"b": F.lit(-1), "side": F.lit(0)})
    verified = near.unionByName(written(_joined(compared.join(sets, ["fp", "own"]), least), "verified"))
    if not large.limit(1).count():
        return verified

    parts = components(verified).select(F.col("node").alias("fp"), F.col("root").alias("part"))
    large = written(large.drop("part").join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp")), "families")
    sizes = large.groupBy("family", "part").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    large = large.join(sizes.select("family", "largest", F.ceil(F.col("rest") / tile).cast("int").alias("others")), "family")
    all_of = large.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("side", F.lit(1))
    rest = large.where("part <> largest").withColumn("b", F.pmod(F.xxhash64(F.lit("rest"), "fp", "own"), "others").cast("int"))
    rest = rest.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(2))
    return verified.unionByName(written(_joined(all_of.unionByName(rest).join(sets, ["fp", "own"]), least), "verified"))


def _groups(docs: DataFrame, doc_id: str, text: str, size: int, radius: int, tile: int, words: int = 0, least: float | None = None) -> DataFrame:
    """(doc_id, copy, fingerprint, component_id), a row per document; copy is xxhash64 of the text."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("copy"))
    signed = with_fingerprint(named, size=size) if least is None else with_signature(named, "text", size, words)
    with scratch() as keep:
        prints = written(signed.drop("text"), "prints")
        lows = [F.min("doc_id").alias("low"), F.count("*").alias("n")]
        nodes = written(prints.groupBy(F.col("fingerprint").alias("fp")).agg(*lows), "nodes")
        edges = links(nodes.select("fp"), radius, tile, blocks_for(nodes.count(), radius))
        if least is not None:
            texts = prints.groupBy(F.col("fingerprint").alias("fp"), "copy").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
            edges = similar(written(texts, "texts"), written(edges, "links"), named, words, size, least, tile)
        reached = components(edges)
        rooted = nodes.join(reached, nodes.fp == reached.node, "left").withColumn("root", F.coalesce("root", "fp"))
        lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
        grouped = rooted.join(lowest, "root").where((F.col("n") > 1) | F.col("node").isNotNull())
        grouped = written(grouped.select(F.col("fp").alias("fingerprint"), "component_id"), "groups")
        keep(prints, grouped)
    joined = prints.join(grouped, "fingerprint", "left")
    return joined.select("doc_id", "copy", "fingerprint", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, tile: int = TILE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (signed long), component_id.

    component_id is the smallest id in the connected component of the document's fingerprint, among all documents and
    links within `radius` bits. Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated; a null id is never the smallest unless its component has no other. An empty table gives an empty table.
    """
    return _groups(docs, doc_id, text, size, radius, tile).select("doc_id", "fingerprint", "component_id")


def representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, tile: int = TILE, words: int = 5, similarity: float | None = 0.8
) -> DataFrame:
    """The documents that stay when one of each near-duplicate group does: that of the smallest id. Columns as they came.

    Besides all links within `radius` bits, texts are linked whose sets of shingles of `words` words have a Jaccard
    similarity of at least `similarity` and that belong to one family (`similar`); None takes no such links. Of rows that
    repeat the smallest id, one of each text stays. Rows with a null id stay if their whole group has null ids.
    """
    found = _groups(docs, doc_id, text, size, radius, tile, words, similarity)
    ids = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "copy").distinct()
    key, copy = free_name(docs, "kept_id"), free_name(docs, "kept_copy")
    ids = written(ids, "kept").withColumnsRenamed({"doc_id": key, "copy": copy})
    kept = docs.join(ids.hint("merge"), F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text)) == F.col(copy)), "left_semi")
    repeated = found.groupBy("doc_id", "copy").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates([doc_id, text]) if repeated else kept
