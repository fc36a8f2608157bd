"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so that a question with other values has the same template.
Windows of template tokens of the benchmark and of the documents are hashed and joined; an item is found in a document
if enough of its tokens lie in the common windows of one occurrence and the slots of these are consistent: each value of
the item stands for one value of the document and the other way round, among numbers, names and units each.

A number is written in digits or as a word; number words and names that follow each other are one slot. A name is a
capitalised word that is no function word. A unit is the word after a number unless it is a function word, or one of the
signs of SIGNS; plurals in s are equal to the singular. Windows of fewer than two plain words say nothing without their
values, so their values are hashed as well.

Occurrences are told apart by their diagonals, the place in the document less that in the item: a diagonal by itself,
those at most 3 apart, those at most half of the item apart, and all together. An item is found if any of these passes,
so that one occurrence does not hide another and words put into an occurrence do not hide it.

Documents are read once, whatever the size of the benchmark: a bitmap of bounded size, on which no window of the benchmark
is missed, passes over most of what no item has, and the join is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayflow.llm.common import free_name
from stayflow.sources.store import scratch, written

#: Number words with their values, signs that are units, and words that are neither names nor units.
NUMBERS = {
    **{w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())},
    **{w: 10 * i for i, w in enumerate("thirty forty fifty sixty seventy eighty ninety hundred".split(), 3)},
    "thousand": 1000,
    "million": 1000000,
    "billion": 1000000000,
}
SIGNS = "$€£¥%°"
FUNCTION_WORDS = frozenset(
    """a about after all also an and any are as at be because been before being both but by can could did do does during each either
    else every few find for from had has have he her here his how i if in into is it its many may more most much must my no nor not
    of on once or other our over per she should since so some such than that the their then there these they this those though to
    under until was we were what when where which while who whom whose why will with would you your""".split()
)
_TOKENS = re.compile(rf"\d+(?:[.,]\d+)*(?:[eE][+-]?\d+(?![^\W_]))?|[^\W\d_]+|[{SIGNS}]").findall
WORD, NUMBER, NUMBER_WORD, NAME, SIGN, FUNCTION = range(6)
#: What stands for a slot in a template, by kind (none, number, name, unit).
SLOTS = np.array([0, *(xxhash.xxh64_intdigest(k, 42) for k in ("number", "name", "unit"))], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


class Codes(dict):
    """token -> hash of its value, of which the last three bits are its kind; begun anew when it has met `most` tokens."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token[0].isdigit():
            kind = NUMBER
        elif low in NUMBERS:
            kind, low = NUMBER_WORD, str(NUMBERS[low])
        elif token in SIGNS:
            kind = SIGN
        elif low in FUNCTION_WORDS:
            kind = FUNCTION
        else:
            kind = NAME if len(token) > 1 and token[0].isupper() and token[1].islower() else WORD
        if len(self) >= self.most:
            self.clear()
        code = self[token] = _hash(low) & ~7 | kind
        return code


@dataclass
class Templates:
    """Template tokens of several texts, one after the other: a hash of the token and of what stands there, the kind of slot
    (0: a plain word) and the text's number for each token; for each text where it begins and how many tokens it has."""

    tokens: np.ndarray
    values: np.ndarray
    kinds: np.ndarray
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray


def templates(texts: list[str | None], codes: Codes) -> Templates:
    cut = [_TOKENS(t) if t else [] for t in texts]
    found = list(chain.from_iterable(cut))
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    text = np.repeat(np.arange(len(cut)), counts)
    code = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
    is_ = (code & np.uint64(7)).astype(np.int8)
    before = np.r_[np.int8(-1), is_[:-1]][: len(is_)]
    before[np.flatnonzero(np.diff(text, prepend=-1))] = -1
    after_number = (before == NUMBER) | (before == NUMBER_WORD)
    unit = (is_ == SIGN) | (is_ == WORD) & after_number
    starts = np.flatnonzero(~((is_ == before) & ((is_ == NAME) | (is_ == NUMBER_WORD))))
    values = np.add.reduceat(code & ~np.uint64(7), starts) if len(starts) else code
    unit, is_, text = unit[starts], is_[starts], text[starts]
    kinds = np.where(unit, 3, np.where(is_ == NAME, 2, np.where((is_ == NUMBER) | (is_ == NUMBER_WORD), 1, 0))).astype(np.int8)
    for i in np.flatnonzero(unit).tolist():
        word = found[starts[i]].lower()
        values[i] = _hash(word[:-1] if len(word) > 2 and word[-1] == "s" else word)
    values += SLOTS[kinds]
    size = np.bincount(text, minlength=len(cut))
    return Templates(np.where(kinds > 0, SLOTS[kinds], values), values, kinds, text, np.cumsum(size) - size, size)


def _rolled(tokens: np.ndarray, width: int, seed: int) -> np.ndarray:
    found = np.full(len(tokens) - width + 1, seed, np.uint64)
    for k in range(width):
        found = (found ^ tokens[k : k + len(found)]) * ODD
        found ^= found >> np.uint64(29)
    return found


def windows(tokens: np.ndarray, values: np.ndarray, kinds: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window: of its template, or of its values if it has fewer than two plain words."""
    if len(tokens) < width:
        return tokens[:0]
    found = _rolled(tokens, width, width)
    plain = np.cumsum(np.r_[0, kinds == 0])
    few = plain[width:] - plain[:-width] < 2
    return np.where(few, _rolled(values, width, 1000 + width), found) if few.any() else found


WINDOW = "size int, width int, place int, hash long, slots array<long>"


def _emit(rows: pa.RecordBatch, t: Templates, picks: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(id, copy, WINDOW) for picks (width, places among all tokens, hashes)."""
    none = np.zeros(0, np.int64)
    at = np.concatenate([none, *[a for _, a, _ in picks]])
    text = t.text[at] if len(at) else none
    width = np.concatenate([none, *[np.full(len(a), w) for w, a, _ in picks]]).astype(np.int32)
    hashes = np.concatenate([none, *[h.view(np.int64) for _, _, h in picks]])
    slots = [t.values[i : i + w][t.kinds[i : i + w] > 0].view(np.int64) for w, a, _ in picks for i in a.tolist()]
    columns = [rows.column(c).take(pa.array(text)) for c in ("id", "copy")]
    own = [pa.array(t.size[text].astype(np.int32)), pa.array(width), pa.array((at - t.start[text]).astype(np.int32)), pa.array(hashes), pa.array(slots, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, *own], names=["id", "copy", "size", "width", "place", "hash", "slots"])


def _windows_of(rows: DataFrame, pick, most: int = 1 << 20) -> DataFrame:
    """rows (id, copy, text) -> (id, copy, WINDOW); pick gets Templates and yields (width, places, hashes). About `most`
    characters are taken at once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for whole in batches:
            texts, at = whole.column("text").to_pylist(), 0
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and (upto == at or held < most):
                    held, upto = held + len(texts[upto] or ""), upto + 1
                t = templates(texts[at:upto], codes)
                yield _emit(whole.slice(at, upto - at), t, list(pick(t)))
                at = upto

    return rows.mapInArrow(emit, f"id {rows.schema['id'].dataType.simpleString()}, copy long, {WINDOW}")


def item_windows(items: DataFrame, item_id: str, text: str, width: int, shortest: int) -> DataFrame:
    """(id, copy, WINDOW) for each window; items under `shortest` tokens have none, and those under `width` are one window."""

    def pick(t: Templates):
        for start, size in zip(t.start.tolist(), t.size.tolist(), strict=True):
            if size >= max(1, shortest):
                part = slice(start, start + size)
                found = windows(t.tokens[part], t.values[part], t.kinds[part], min(width, size))
                yield min(width, size), start + np.arange(len(found)), found

    return _windows_of(items.select(F.col(item_id).alias("id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text")), pick)


def bitmap(hashes: DataFrame, n: int, most: int = 29) -> tuple[int, np.ndarray]:
    """(m, words) of 2^m bits, of which those are set that the first m bits of a hash name: 4096 or more for each of n hashes,
    2^most at most. Executors unite the bits; the driver gets as many words as are not 0."""
    m = min(max(16, int(n * 4096 - 1).bit_length()), most)
    top = F.shiftrightunsigned("hash", 64 - m)
    bits = hashes.groupBy(F.shiftright(top, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - m}) & 63 as int))")).alias("bits"))
    found = bits.toPandas()
    words = np.zeros(1 << (m - 6), np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return m, words


def document_windows(docs: DataFrame, known, widths: list[int], doc_id: str, text: str) -> DataFrame:
    """(id, copy, WINDOW) for the windows of whole texts that the broadcast bitmap does not rule out."""

    def pick(t: Templates):
        m, words = known.value
        for width in widths:
            found = windows(t.tokens, t.values, t.kinds, width)
            bit = found >> np.uint64(64 - m)
            hit = words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)
            at = np.flatnonzero(hit)
            at = at[t.text[at] == t.text[at + width - 1]]  # a window lies in one text
            yield width, at, found[at]

    return _windows_of(docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text")), pick)


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 8, shortest: int = 1, least: float = 0.6) -> DataFrame:
    """(doc_id, copy, item_id, share, first_word, last_word, n_slots): the items that each document has.

    share is the part of the item's template tokens that lie in the common windows of an occurrence, at least `least`;
    first_word and last_word are the first and last template token of the document in them. Of occurrences that pass, a
    row has the one of the largest share, the one of more diagonals, the first; copy is xxhash64 of the document's text.
    Windows have `width` tokens, those of shorter items all of the item's; items of fewer than `shortest` tokens and null
    or empty texts are never found, and no text is found in a null document. Rows with equal id and text are one document
    (or item); a null id is kept. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    with scratch() as keep:
        known = written(item_windows(items, item_id, item_text, width, shortest).distinct(), "items")
        hashes = known.select("hash").distinct()
        widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # at most `width` of them
        sent = spark.sparkContext.broadcast(bitmap(hashes, hashes.count()))
        hits = document_windows(docs, sent, widths, doc_id, text).drop("size").withColumnsRenamed({"id": "doc"})
        k = known.select(F.col("id").alias("item"), F.col("copy").alias("item_copy"), "size", F.col("width").alias("w"), F.col("place").alias("item_place"), F.col("hash").alias("h"), F.col("slots").alias("item_slots"))
        meets = written(hits.distinct().join(k, (F.col("hash") == F.col("h")) & (F.col("width") == F.col("w"))).drop("hash", "h", "w"), "meets")
        found = written(_occurrences(meets, least), "occurrences")
        keep(found)
    return found.select(F.col("doc").alias("doc_id"), "copy", F.col("item").alias("item_id"), "share", "first_word", "last_word", "n_slots")


def _occurrences(meets: DataFrame, least: float) -> DataFrame:
    """The best occurrence that passes of each document and item."""
    # hits of one occurrence have the same or neighbouring diagonals (place - item_place)
    key = ["doc", "copy", "item", "item_copy", "size"]
    meets = meets.withColumn("diagonal", F.col("place") - F.col("item_place"))
    order = Window.partitionBy(*key).orderBy("diagonal", "place")
    step = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0))
    near = [F.lit(0), F.lit(3), F.floor(F.col("size") / 2).cast("int")]
    starts = [F.sum(F.when(F.col("step") > n, 1).otherwise(0)).over(order) for n in near]
    tried = F.array(*[F.struct(F.lit(i).alias("way"), n.cast("long").alias("occurrence")) for i, n in enumerate([*starts, F.lit(0)])])
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.xxhash64(a, b))
    meets = meets.withColumns({"step": step, "pairs": pairs}).withColumn("tried", tried).select("*", F.inline("tried"))
    each = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    by_item = meets.groupBy(*key, "way", "occurrence").agg(
        F.collect_set("item_place").alias("places"),
        F.first("width").alias("width"),
        F.min("place").alias("first"),
        F.max(F.col("place") + F.col("width") - 1).alias("last"),
        each("pairs").alias("n_slots"),
        each("item_slots").alias("n_item"),
        each("slots").alias("n_doc"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1)))))
    consistent = (F.col("n_slots") == F.col("n_item")) & (F.col("n_slots") == F.col("n_doc"))
    found = by_item.withColumn("share", covered / F.col("size")).where(consistent & (F.col("share") >= least))
    best = F.struct("share", "way", (-F.col("first")).alias("early"), (-F.col("last")).alias("short"), "n_slots")
    found = found.groupBy(*key).agg(F.max(best).alias("best")).select("*", "best.*")
    return found.select("doc", "copy", "item", "share", (-F.col("early")).cast("long").alias("first_word"), (-F.col("short")).cast("long").alias("last_word"), F.col("n_slots").cast("long").alias("n_slots")).distinct()


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents in which no item is found, with their columns as they came. Rows with a null text stay."""
    found = find(docs, items, doc_id, text, **how).select("doc_id", "copy").distinct()
    found = written(found, "contaminated")
    a, b = free_name(docs, "found_id"), free_name(docs, "found_copy")
    found = found.withColumnsRenamed({"doc_id": a, "copy": b})
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(F.col(text)) == F.col(b)), "left_anti")
