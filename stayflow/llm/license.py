"""License scan by diagonal voting. DataFrame functions only.

All rolling word k-grams of a text are hashed and joined to the positions of the same k-grams in templates. Hits of one
template whose offsets (place in the text less place in the template) are equal lie on one diagonal; their count is its
votes. A diagonal that has the most votes within `slack` is merged with those that are at most `slack` apart, so that a
few words put in or left out do no harm; what votes is the number of different places of the template.

Phrases and templates of fewer than `short` words must stand word for word: all their k-grams on one diagonal. Of a longer
template with enough votes the span is verified: the words of the text that its hits cover, with a mark for each word
between them, are aligned with the template, and the edits of the best alignment are counted. An edit destroys at most k
k-grams, which says how many votes are enough. k is 3, and 2 for templates of two words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayflow.llm.common import ascii_lower
from stayflow.llm.license_texts import PHRASES, TEMPLATES
from stayflow.sources.store import scratch, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A place of a template as one character, over and over, and a word that no hit covers.
LETTERS = "".join(map(chr, range(48, 58))) + "".join(map(chr, range(65, 91))) + "".join(map(chr, range(97, 123)))
OTHER = "~"
#: k-grams of templates up to which their table is broadcast.
BROADCAST = 200_000


def license_words(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z and what is not ASCII, after A-Z are lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(rows: DataFrame, columns: list[str], pairs_of: Column) -> DataFrame:
    """rows (columns, words) -> (columns, pos, w1, w2, w3, hash): a row per 3-gram, and one per 2-gram that begins with a word
    of the array pairs_of, of which w3 is null. Words are hashed after they have been dealt out, in generated code."""
    w, n = F.col("words"), F.size("words")
    side_by_side = F.arrays_zip(F.sequence(F.lit(0), n - 2), F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n), F.slice(w, F.lit(3), n))
    trios = rows.where(n >= 2).select(*columns, F.inline(side_by_side).alias("pos", "w1", "w2", "third"))
    kinds = F.when(F.array_contains(pairs_of, F.col("w1")), F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3)))
    found = trios.withColumn("k", F.explode(kinds)).where("k = 2 or third is not null")
    found = found.withColumn("w3", F.when(F.col("k") == 3, F.col("third")))
    return found.select(*columns, "pos", "w1", "w2", "w3", F.xxhash64("w1", "w2", "w3").alias("hash"))


def _templates(spark: SparkSession, phrases, templates, short: int, least: float) -> tuple[DataFrame, DataFrame, Column, int]:
    """(template, tpos, t1, t2, t3, thash), the templates (template, label, base, size, total, edits, spelled), the first words
    of those of two words, and how many grams there are."""
    known = []
    for i, (label, text) in enumerate([*phrases, *templates]):
        found = [w for w in re.split(SEPARATORS, text.lower()) if w]
        if len(found) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        base = i < len(phrases)
        edits = 0 if base or len(found) < short else int(len(found) * (1 - least) + 1e-9)
        spelled = "".join(LETTERS[t % len(LETTERS)] for t in range(len(found))) if len(found) >= short else ""
        known.append((i, label, base, len(found), max(1, len(found) - 2), edits, spelled, " ".join(found)))
    names = ("template", "label", "base", "size", "total", "edits", "spelled", "text")
    pairs_of = F.array(*[F.lit(x) for x in sorted({k[-1].split()[0] for k in known if k[3] == 2})]).cast("array<string>")
    facts = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, k, strict=True)]) for k in known])))
    grams = _grams(facts.select("template", "size", F.split("text", " ").alias("words")), ["template", "size"], pairs_of)
    grams = grams.where((F.col("size") == 2) | F.col("w3").isNotNull())
    grams = grams.select("template", F.col("pos").alias("tpos"), F.col("w1").alias("t1"), F.col("w2").alias("t2"), F.col("w3").alias("t3"), F.col("hash").alias("thash"))
    return grams, facts.drop("text"), pairs_of, sum(k[4] for k in known)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases=PHRASES, templates=TEMPLATES, slack: int = 8, short: int = 20, least: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row of docs.

    phrases count where all their words stand side by side, and so do templates of fewer than `short` words; a longer
    template gives its label if the alignment of a span leaves at least the share `least` of its words. score is the
    largest share of any template: of the words after alignment, or else of the k-grams that vote; 0 without a hit.
    labels and base_labels are distinct, sorted and joined by commas; none: empty. first_word and last_word are the
    smallest and largest start of a phrase, null without one. A null text has no words. Rows with equal id and text are
    scanned as one and each get the result; a null id is kept.
    """
    spark = docs.sparkSession
    grams, facts, pairs_of, n = _templates(spark, phrases, templates, short, least)
    bounded = F.broadcast if n <= BROADCAST else lambda df: df
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), license_words(F.col(text)).alias("words"))
    here = ["doc_id", "copy"]
    with scratch() as keep:
        same = (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & F.col("w3").eqNullSafe(F.col("t3"))
        hits = _grams(rows, here, pairs_of).join(bounded(grams), (F.col("hash") == F.col("thash")) & same)
        hits = written(hits.select(*here, "template", "pos", "tpos").distinct(), "hits")
        found = written(_found(hits, facts, bounded, slack), "found")
        keep(found)
    found = found.withColumnsRenamed({"doc_id": "found_id", "copy": "found_copy"})
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & F.col("copy").eqNullSafe(F.col("found_copy"))
    joined = rows.select(*here, F.size("words").cast("long").alias("n_words")).join(found, same, "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _found(hits: DataFrame, facts: DataFrame, bounded, slack: int) -> DataFrame:
    """(doc_id, copy, n_base, first_word, last_word, base_labels, labels, score) of the texts that have a hit."""
    one = ["doc_id", "copy", "template"]
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    votes = hits.groupBy(*one, "diagonal").agg(F.count("*").alias("votes"), F.collect_list("tpos").alias("places")).join(bounded(facts), "template")
    line = Window.partitionBy(*one).orderBy("diagonal")
    near = line.rangeBetween(-slack, slack)
    long = F.col("spelled") != ""
    votes = votes.withColumns(
        {
            "merged": F.when(long, F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near))))).otherwise(F.col("votes")),
            "top": (F.col("votes") == F.max("votes").over(near)) & (F.col("votes") > F.coalesce(F.max("votes").over(line.rangeBetween(-slack, -1)), F.lit(0))),
        }
    ).drop("places")
    votes = votes.withColumn("share", F.col("merged") / F.col("total"))
    need = F.greatest(F.lit(1), F.col("total") - 3 * F.col("edits"))
    spans = votes.where(long & F.col("top") & (F.col("merged") >= need)).select(*one, F.col("diagonal").alias("centre"), "size", "spelled")
    aligned = _aligned(spans, hits, slack).withColumnsRenamed({c: f"a_{c}" for c in (*one, "centre")})
    same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in one]
    votes = votes.join(aligned, [*same, F.col("diagonal") == F.col("a_centre")], "left")
    edits = F.col("distance").isNotNull() & (F.col("distance") <= F.col("edits"))
    full = F.when(long, edits).otherwise(F.col("votes") == F.col("total"))
    share = F.when(F.col("distance").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("distance") / F.col("size"))).otherwise(F.col("share"))
    votes = votes.withColumns({"share": share, "full": full, "place": full & F.col("base")})
    join = lambda names: F.array_join(F.array_sort(names), ",")
    start = F.when(F.col("place"), F.col("diagonal").cast("long"))
    return votes.groupBy("doc_id", "copy").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        join(F.collect_set(F.when(F.col("place"), F.col("label")))).alias("base_labels"),
        join(F.collect_set(F.when(F.col("full"), F.col("label")))).alias("labels"),
        F.max("share").alias("score"),
    )


def _aligned(spans: DataFrame, hits: DataFrame, slack: int) -> DataFrame:
    """spans (doc_id, copy, template, centre, size, spelled) -> (doc_id, copy, template, centre, distance): the edits between
    the template and the span's words, of which those that no hit within the slack covers differ from all others."""
    one = ["doc_id", "copy", "template"]
    h = hits.withColumnsRenamed({c: f"h_{c}" for c in one})
    same = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in one]
    met = spans.join(h, [*same, F.abs(F.col("diagonal") - F.col("centre")) <= slack])
    words = met.select(*one, "centre", "spelled", "diagonal", F.explode(F.sequence(F.col("pos"), F.col("pos") + 2)).alias("p"))
    nearest = F.min(F.struct(F.abs(F.col("diagonal") - F.col("centre")).alias("off"), "diagonal")).alias("best")
    words = words.groupBy(*one, "centre", "spelled", "p").agg(nearest).withColumn("t", F.col("p") - F.col("best.diagonal"))
    letter = lambda t: F.substring(F.lit(LETTERS), t % len(LETTERS) + 1, F.lit(1))
    placed = words.groupBy(*one, "centre", "spelled").agg(F.array_sort(F.collect_list(F.struct("p", letter(F.col("t")).alias("letter")))).alias("words"))
    spell = F.aggregate(
        "words",
        F.struct(F.get("words", F.lit(0)).p.alias("at"), F.lit("").alias("text")),
        lambda acc, x: F.struct((x.p + 1).alias("at"), F.concat(acc.text, F.repeat(F.lit(OTHER), x.p - acc.at), x.letter).alias("text")),
        lambda acc: acc.text,
    )
    return placed.select(*one, "centre", F.levenshtein(spell, F.col("spelled")).alias("distance"))


def sql(phrases=PHRASES, templates=TEMPLATES, slack: int = 8, short: int = 20, least: float = 0.8) -> str:
    """scan() of documents in DuckDB SQL."""
    texts = ", ".join(f"({i}, '{label}', {i < len(phrases)}, '{text.replace(chr(39), chr(39) * 2)}')" for i, (label, text) in enumerate([*phrases, *templates]))
    cut = lambda c: rf"list_filter(regexp_split_to_array(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
with w as (select row_number() over () as rid, doc_id, {cut("text")} as ws from documents
), f as (
  select template, label, base, ws, len(ws) as size, greatest(1, len(ws) - 2) as total, not base and len(ws) >= {short} as long_,
         case when not base and len(ws) >= {short} then floor(len(ws) * (1 - {least}::double) + 1e-9)::int else 0 end as edits
  from (select *, {cut("text")} as ws from (values {texts}) v(template, label, base, text))
), t as (
  select template, i - 1 as tpos, array_to_string(ws[i:i + least(size, 3) - 1], ' ') as gram from (select *, unnest(range(1, greatest(size - 1, 2))) as i from f)
), g as (
  select rid, i - 1 as pos, k, array_to_string(ws[i:i + k - 1], ' ') as gram
  from (select rid, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (values (2), (3)) k(k) where len(ws) >= k)
), h as (
  select distinct rid, template, pos, tpos, pos - tpos as diagonal from g join t using (gram) join f using (template) where k = least(size, 3)
), v as (select rid, template, diagonal, count(*) as votes, list(tpos) as places from h group by all
), m as (
  select v.*, label, base, size, total, long_, edits, case when long_ then len(list_distinct(flatten(list(places) over n))) else votes end as merged,
         votes = max(votes) over n and votes > coalesce(max(votes) over (partition by rid, template order by diagonal range between {slack} preceding and 1 preceding), 0) as top
  from v join f using (template) window n as (partition by rid, template order by diagonal range between {slack} preceding and {slack} following)
), s as (select rid, template, diagonal as centre from m where long_ and top and merged >= greatest(1, total - 3 * edits)
), p as (
  select rid, template, centre, pos + k as p, arg_min(diagonal, abs(diagonal - centre) * 1000000000 + diagonal) as d
  from s join h using (rid, template), (values (0), (1), (2)) k(k) where abs(diagonal - centre) <= {slack} group by all
), a as (
  select rid, template, centre, min(p) as low, max(p) as high from p group by all
), c as (
  select a.rid, a.template, a.centre, string_agg(coalesce(substr('{LETTERS}', ((x.p - d) % {len(LETTERS)})::int + 1, 1), '{OTHER}'), '' order by x.p) as spelled
  from (select a.*, unnest(range(low, high + 1)) as p from a) x join a using (rid, template, centre) left join p on p.rid = x.rid and p.template = x.template and p.centre = x.centre and p.p = x.p
  group by all
), e as (
  select rid, template, centre, levenshtein(c.spelled, array_to_string(list_transform(range(size), lambda t: substr('{LETTERS}', (t % {len(LETTERS)})::int + 1, 1)), '')) as distance from c join f using (template)
), r0 as (
  select m.*, distance, case when long_ then coalesce(distance <= edits, false) else votes = total end as full_,
         case when distance is not null then greatest(0.0::double, 1 - distance::double / size) else merged::double / total end as share
  from m left join e on m.rid = e.rid and m.template = e.template and m.diagonal = e.centre
), r as (
  select rid, count(*) filter (full_ and base) as n_base, min(diagonal) filter (full_ and base) as first_word, max(diagonal) filter (full_ and base) as last_word,
         array_to_string(list_sort(list_distinct(list(label) filter (full_ and base))), ',') as base_labels, array_to_string(list_sort(list_distinct(list(label) filter (full_))), ',') as labels, max(share) as score
  from r0 group by rid
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from w left join r using (rid)
"""
