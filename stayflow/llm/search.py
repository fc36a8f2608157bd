"""Ranked lexical search by block-max pruning.

An index has a row for each range of documents (block_docs of them, in the order of an input partition, in which documents
with the same commonest terms are moved together): a forward index of the impacts of each document's terms, and of each
term of the block its number of documents and its greatest impact. The sum of the greatest impacts bounds what a query can
score in a block. The best blocks of each query are scored first and give a threshold, its k-th best score; then each task
takes its blocks by bound, from high to low, and scores a query there only while the bound reaches the threshold. A
document that equals the threshold is still scored, so the result is exact.

The index holds all documents and all terms. No index row leaves its partition: queries travel, as a table of (item, term,
weight) that is cut into batches of bounded size. Memory is a buffer of documents when the index is built, later a few
blocks and k rows for each query of the batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.llm.bits import Bits, flat
from stayflow.llm.common import ascii_lower
from stayflow.sources.store import written

#: Terms: runs of ASCII letters and digits and of all characters beyond ASCII; in UTF-8 these are the bytes of _TERMS.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_IN_TERM = np.zeros(256, bool)
_IN_TERM[128:] = True
_IN_TERM[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
#: Bytes of a text that are cut into terms at once, texts that are counted at once, postings that are buffered, blocks of a
#: batch, queries that are scored side by side, and bytes of a row group of the index.
SLICE, ROWS, BUFFER, BATCH, SIDE, ROW_GROUP = 1 << 22, 500, 500_000, 16, 256, 8 << 20
_EXACT = 1 << 53
PACKED = ("top", "start", "term", "impact")
BLOCKS = "docs array<long>, terms array<string>, df array<int>, top binary, start binary, term binary, impact binary"


def term_counts(raw: bytes) -> Counter[bytes]:
    """How often a text in UTF-8 has each term, A-Z in lower case; long texts are cut in slices that end between terms."""
    raw = raw.lower()
    if len(raw) <= SLICE:
        return Counter(_TERMS.findall(raw))
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(raw):
        end = _NO_TERM.search(raw, at + SLICE)
        end = end.start() if end else len(raw)
        found.update(_TERMS.findall(raw, at, end))
        at = end
    return found


def term_numbers(texts: pa.Array) -> pa.Array:
    """How many terms each text of an array without nulls has, from the bytes that begin one."""
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(texts), ROWS):
        raw, offsets = flat(texts[i : i + ROWS])
        begins = _IN_TERM[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = begins[:-1]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = False
        found.append(np.diff(Bits(begins & ~before).rank(offsets)))
    return pa.array(np.concatenate(found))


def impacts(tf: np.ndarray, n: int, docs: int, terms: int) -> np.ndarray:
    """What a weight is multiplied with: tf against the length n of the document relative to the mean length terms / docs."""
    m = 50 + 50 * n * docs // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Index:
    """Blocks of an index, and how many documents have a term and how many terms there are in all."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = 64) -> Index:
    """The index of all rows; ids are whole numbers or null. Rows without a term are counted nowhere and found by nothing.

    Repeated rows are documents of their own. Texts are read twice: mean length first, so that impacts are final.
    """
    number = F.arrow_udf(term_numbers, "long")(F.coalesce(F.col(text), F.lit("")))
    n_docs, n_terms = docs.select(number.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[tuple[tuple[int, ...], int | None, np.ndarray, np.ndarray]] = []
        postings = 0
        for b in batches:
            raw, offsets = flat(b.column("text"))
            for n, i in enumerate(b.column("id").to_pylist()):
                if counts := term_counts(raw[offsets[n] : offsets[n + 1]].tobytes()):
                    at = np.fromiter((known.setdefault(w, len(known)) for w in counts), np.int32, len(counts))
                    tf = np.fromiter(counts.values(), np.int64, len(counts))
                    common = tuple(at[np.lexsort((at, -tf))[:3]].tolist())
                    held.append((common, i, at, impacts(tf, int(tf.sum()), n_docs, n_terms).astype(np.int32)))
                    postings += len(at)
                if postings >= BUFFER:
                    yield from _blocks(held, known, block_docs)
                    known, held, postings = {}, [], 0
        if held:
            yield from _blocks(held, known, block_docs)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null").mapInArrow(cut, BLOCKS)
    # rows are large, and a reader holds as many at once as a row group has
    return Index(written(rows.withColumn("block", F.monotonically_increasing_id()), "index", **{"parquet.block.size": str(ROW_GROUP)}), n_docs, n_terms)


def _blocks(held: list[tuple[tuple[int, ...], int | None, np.ndarray, np.ndarray]], known: dict[bytes, int], block_docs: int) -> Iterator[pa.RecordBatch]:
    """The blocks of some documents, those with the same commonest terms side by side."""
    words = pa.array([w.decode("utf-8", "replace") for w in known], pa.string())
    held.sort(key=lambda d: d[0])
    for first in range(0, len(held), block_docs * BATCH):
        docs, terms, df, packed = [], [], [], []
        for i in range(first, min(first + block_docs * BATCH, len(held)), block_docs):
            part = held[i : i + block_docs]
            start = np.cumsum([0, *(len(at) for _, _, at, _ in part)], dtype=np.int32)
            at, impact = (np.concatenate([d[j] for d in part]) for j in (2, 3))
            used, term = np.unique(at, return_inverse=True)
            top = np.zeros(len(used), np.int32)
            np.maximum.at(top, term, impact)
            docs.append([d[1] for d in part])
            terms.append(used)
            df.append(np.bincount(term, minlength=len(used)).astype(np.int32))
            packed.append([x.tobytes() for x in (top, start, term.astype(np.int32), impact)])
        ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, words.take(pa.array(np.concatenate(terms)))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(df)))]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.list_(pa.int64())), *lists, *[pa.array(c, pa.binary()) for c in zip(*packed, strict=True)]], names=["docs", "terms", "df", "top", "start", "term", "impact"])


def query_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item, of all rows of one id; a null id is an item of its own."""
    return items.select(F.col(item).alias("item"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(PATTERN), F.lit(0))).alias("term")).distinct()


def weighed(index: Index, terms: DataFrame) -> DataFrame:
    """(item, term, w) for the terms that documents have: w is floor(1000 ln((2 n_docs + 2) / (2 df + 1)))."""
    held = index.blocks.select(F.inline(F.arrays_zip("terms", "df"))).withColumnRenamed("terms", "term")
    known = written(terms.select("term").distinct(), "vocabulary")
    df = held.join(known, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1)))
    return terms.join(df, "term").select("item", "term", w.cast("long").alias("w"))


class Queries:
    """Some items and their weighed terms: `vocabulary`, and for each item the places of its terms there, with weights."""

    def __init__(self, items: list, rows: pa.Table):
        self.items = items
        coded = rows.column("term").combine_chunks().dictionary_encode()
        self.vocabulary, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        item, w = rows.column("at").to_numpy(), rows.column("w").to_numpy()
        order = np.argsort(item, kind="stable")
        self.at, self.w = at[order], w[order]
        self.start = np.searchsorted(item[order], np.arange(len(items) + 1))

    def bounds(self, terms: pa.Array, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each item what it can score at most in a block, and of each term of the vocabulary its place in the block or -1."""
        place = pc.index_in(self.vocabulary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        best = np.where(place >= 0, top[place], 0).astype(np.int64) if len(top) else np.zeros(len(place), np.int64)
        upto = np.concatenate([[0], np.cumsum(self.w * best[self.at])])
        return upto[self.start[1:]] - upto[self.start[:-1]], place

    def scores(self, items: np.ndarray, place: np.ndarray, n_docs: int, start: np.ndarray, term: np.ndarray, impact: np.ndarray, greatest: int) -> np.ndarray:
        """[item, document] of a block; sums of products of whole numbers, which are exact below 2^53 in doubles."""
        kind = np.float64 if greatest < _EXACT else np.int64
        wanted = np.unique(np.concatenate([self.at[self.start[i] : self.start[i + 1]] for i in items]))
        wanted = wanted[place[wanted] >= 0]
        column = np.full(len(self.vocabulary), -1)
        column[wanted] = np.arange(len(wanted))
        row_of = np.full(int(place.max()) + 1 if len(place) else 0, -1)
        row_of[place[wanted]] = np.arange(len(wanted))
        inside = term < len(row_of)
        row = np.where(inside, row_of[np.where(inside, term, 0)], -1)
        doc = np.repeat(np.arange(n_docs), np.diff(start))
        matrix = np.zeros((len(wanted), n_docs), kind)
        matrix[row[row >= 0], doc[row >= 0]] = impact[row >= 0]
        weights = np.zeros((len(items), len(wanted)), kind)
        for r, i in enumerate(items):
            at = column[self.at[self.start[i] : self.start[i + 1]]]
            weights[r, at[at >= 0]] = self.w[self.start[i] : self.start[i + 1]][at >= 0]
        return (weights @ matrix).astype(np.int64)


class Best:
    """The k best documents of each item so far, and with them thresholds; ties go to the smaller id, null before all."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, item: np.ndarray, score: np.ndarray, is_id: np.ndarray, doc: np.ndarray) -> None:
        self.new.append((item, score, is_id, doc))
        self.waiting += len(item)
        if self.waiting > 20 * self.k + 4 * len(self.kept[0]):
            self.settle()

    def settle(self) -> None:
        rows = [np.concatenate([a, *b]) for a, b in zip(self.kept, zip(*self.new, strict=True), strict=True)] if self.new else self.kept
        item, score, is_id, doc = rows
        order = np.lexsort((doc, is_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = order[rank == self.k - 1]
        self.least[rows[0][last]] = np.maximum(self.least[rows[0][last]], score[last])
        self.kept = [x[order][rank < self.k] for x in rows]
        self.new, self.waiting = [], 0


FOUND = "at int, score long, doc_id long"


def _bounded(index: Index, queries: Queries, n: int) -> DataFrame:
    """(at, block, bound): for each task and item the n blocks of the greatest bounds above 0."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(queries)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        top = Best(np.ones(len(q.items), np.int64), n)
        every = np.arange(len(q.items))
        for b in batches:
            for block, terms, top_impact in _rows(b, "block", "terms", "top"):
                bound, _ = q.bounds(terms, top_impact)
                on = every[bound >= top.least]
                top.add(on, bound[on], np.ones(len(on), np.int64), np.full(len(on), block))
        top.settle()
        yield pa.RecordBatch.from_arrays([pa.array(top.kept[0], pa.int32()), pa.array(top.kept[3]), pa.array(top.kept[1])], names=["at", "block", "bound"])

    return index.blocks.select("block", "terms", "top").mapInArrow(best, "at int, block long, bound long")


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch; terms as Arrow arrays and packed numbers as NumPy arrays, neither copied."""
    columns = []
    for name in names:
        c = batch.column(name)
        if name == "terms":
            columns.append([c[i].values for i in range(len(c))])
        elif name in PACKED:
            columns.append([np.frombuffer(c[i].as_buffer(), np.int32) for i in range(len(c))])
        else:
            columns.append(c.to_pylist())
    return zip(*columns, strict=True)


def _scored(blocks: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """FOUND: for each task and item its k best documents that reach `least`. Blocks with a column `wanted` are scored for
    those items alone."""
    sent = blocks.sparkSession.sparkContext.broadcast((queries, least))
    names = ["terms", "top", "docs", "start", "term", "impact", *(["wanted"] if "wanted" in blocks.columns else [])]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = sent.value
        best = Best(floor, k)
        for b in batches:
            here = []
            for row in _rows(b, *names):
                bound, place = q.bounds(row[0], row[1])
                if len(row) == 7:
                    only = np.zeros(len(bound), bool)
                    only[row[6]] = True
                    bound = np.where(only, bound, 0)
                here.append((int(bound.max(initial=0)), bound, place, row))
            here.sort(key=lambda x: -x[0])
            for greatest, bound, place, row in here:
                on = np.flatnonzero(bound >= best.least)
                docs, start, term, impact = row[2:6]
                ids = np.array([d or 0 for d in docs], np.int64)
                is_id = np.array([d is not None for d in docs], np.int64)
                for i in range(0, len(on), SIDE):
                    items = on[i : i + SIDE]
                    found = q.scores(items, place, len(docs), start, term, impact, greatest)
                    r, c = np.nonzero(found >= best.least[items][:, None])
                    if len(r):
                        best.add(items[r], found[r, c], is_id[c], ids[c])
        best.settle()
        at, value, is_id, doc = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(value), pa.array(doc, mask=is_id == 0)], names=["at", "score", "doc_id"])

    return blocks.select(*names).mapInArrow(score, FOUND)


def _top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each item, numbered; Spark cuts to k before the shuffle as well."""
    by = Window.partitionBy("at").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rank(index: Index, items: DataFrame, item: str = "item_id", text: str = "text", k: int = 50, probes: int = 8, batch_rows: int = 500_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, equal scores by id.

    Items without a term that a document has are left out, and so are all of an empty index. About batch_rows rows of
    (item, term, weight) are sent to the executors at a time; more items are more batches, and nothing is dropped.
    """
    terms = written(query_terms(items, item, text), "queries")
    rows = written(weighed(index, terms), "weights")
    batches = max(1, -(-rows.count() // batch_rows))
    kind = items.schema[item].dataType
    found = None
    for i in range(batches):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == i)
        ids = [r["item"] for r in part.select("item").distinct().orderBy("item").collect()]
        spark = items.sparkSession
        at = spark.createDataFrame([(n, x) for n, x in enumerate(ids)], f"at int, item {kind.simpleString()}")
        numbered = part.join(F.broadcast(at.withColumnRenamed("item", "of")), F.col("item").eqNullSafe(F.col("of"))).select("at", "term", "w")
        queries = Queries(ids, numbered.orderBy("at", "term").toArrow())
        probed = _top(_bounded(index, queries, probes), probes, F.desc("bound"), F.asc("block")).groupBy("block").agg(F.collect_list("at").alias("wanted"))
        # at most `probes` rows for each item of the batch
        first = _scored(index.blocks.join(F.broadcast(probed), "block"), queries, np.ones(len(ids), np.int64), k)
        least = np.ones(len(ids), np.int64)
        for r in _top(first, k, F.desc("score"), F.asc_nulls_first("doc_id")).where(F.col("rank") == k).select("at", "score").collect():
            least[r["at"]] = r["score"]
        best = _top(_scored(index.blocks, queries, least, k), k, F.desc("score"), F.asc_nulls_first("doc_id"))
        one = best.join(F.broadcast(at), "at").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
        found = one if found is None else found.unionByName(one)
    return found


#: The query in DuckDB SQL: every document is scored.
SQL = rf"""
with s_doc as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') as terms from documents where text is not null
), s_item as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')) as term from benchmark
), s_all as (select count(*) as docs, sum(len(s_doc.terms))::bigint as terms from s_doc where len(terms) > 0
), s_len as (select rid, doc_id, 50 + (50 * len(d.terms) * a.docs) // a.terms as m from s_doc d, s_all a where len(d.terms) > 0
), s_tf as (
  select rid, term, count(*) as tf from (select rid, unnest(terms) as term from s_doc) where term in (select term from s_item) group by rid, term
), s_w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from s_tf, s_all group by term, docs
), s_score as (
  select item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from s_item join s_tf using (term) join s_w using (term) join s_len using (rid) group by item_id, rid
), s_rank as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s_score join s_len using (rid) where score > 0
)
select item_id, rank::int as rank, doc_id, score from s_rank where rank <= 50
"""
