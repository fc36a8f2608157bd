"""Quality rules: figures of a text and the frequency of its lines across the documents of its host.

DataFrame functions only. A line that more than max_share of a host's distinct texts hold (and more than min_docs of
them) is boilerplate and is removed; a document that loses more than max_lost of its words that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.llm.common import BLANKS, free_name, words
from stayflow.sources.store import written

SYMBOLS = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    """A line for comparison: trimmed, in lower case, each digit 0."""
    return F.translate(F.lower(F.btrim(line, F.lit(BLANKS))), "123456789", "000000000")


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def bound(value: Column, use) -> Column:
    """use(value), with value computed once although use mentions it again and again inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(found: Column, size: int = 3) -> Column:
    """How many words stand in windows of `size` words that the array holds twice or more, first ones included."""

    def inner(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return bound(windows, counted)

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(pairs, covered))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.coalesce(x.h == F.get(s, k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.sequence(x.i, x.i + (size - 1))))))

    return F.when(F.size(found) >= size, bound(found, inner)).otherwise(F.lit(0))


def frequent_lines(docs: DataFrame, text: str, host: str, min_docs: int, max_share: float) -> DataFrame:
    """(host, bad array<long>): hashes of the normalised lines above the limits; hosts without such lines are left out.

    A host's array is short: at most the mean number of lines of a document divided by max_share.
    """
    rows = docs.select(F.col(host).alias("host"), F.xxhash64(F.col(text)).alias("copy"), F.split(F.col(text), "\n").alias("lines")).where("lines is not null")
    hashes = F.array_distinct(F.transform(F.filter("lines", has_word), lambda x: F.xxhash64(normal_line(x))))
    held = rows.select("host", "copy", F.explode(hashes).alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    sizes = rows.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    sizes = written(sizes.withColumnRenamed("host", "h"), "hosts")
    over = held.join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.col("docs") * max_share)
    return written(over.groupBy("host").agg(F.collect_set("line").alias("bad")), "lines")


def rules(docs: DataFrame, text: str = "text", host: str = "source", out: str = "quality", min_docs: int = 3, max_share: float = 0.05, max_lost: float = 0.25, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Add a struct `out` (a column of that name is replaced): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_removed_lines, n_removed_words, kept and text, the text without boilerplate lines.

    Exact copies count as one document of their host, and only lines with a word are counted or removed. A null text has
    no words (base_failed, not kept, text null); a null host is a host of its own. Rows, repeats and other columns stay.
    min_docs is a floor for small hosts; in larger ones the share decides, so that the limit grows with the host.
    """
    named = docs.drop(out)
    key, bad, lines, found = (free_name(named, n) for n in ("host_key", "bad_lines", "all_lines", "all_words"))
    limits = frequent_lines(docs, text, host, min_docs, max_share).select(F.col("host").alias(key), F.col("bad").alias(bad))
    full = F.coalesce(F.col(text), F.lit(""))
    rows = named.join(limits, F.col(host).eqNullSafe(F.col(key)), "left").withColumns({lines: F.split(full, "\n"), found: words(full)})
    is_bad = lambda x: F.array_contains(F.col(bad), F.xxhash64(normal_line(x))) & has_word(x)
    some = F.col(bad).isNotNull()
    removed = F.when(some, F.filter(lines, is_bad)).otherwise(F.array().cast("array<string>"))
    cleaned = F.when(some & F.col(text).isNotNull(), F.array_join(F.filter(lines, lambda x: ~is_bad(x)), "\n")).otherwise(F.col(text))
    worded = F.filter(lines, has_word)
    figures = F.struct(
        F.size(found).cast("long").alias("n_words"),
        F.length(F.translate(full, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(found)).cast("long").alias("n_repeat_words"),
        bound(removed, lambda r: F.struct(F.size(r).cast("long").alias("lines"), F.size(words(F.array_join(r, " "))).cast("long").alias("words"))).alias("lost"),
        cleaned.alias("text"),
    )
    q = free_name(named, "figures")
    # generated, not projected: a filter on the figures would else be pushed below them and compute them again
    rows = rows.select("*", F.explode(F.array(figures)).alias(q))
    f = F.col(q)
    failed = (f.n_words < min_words) | (100 * f.n_repeat_words > max_repeat * f.n_words)
    whole = F.struct(
        f.n_words.alias("n_words"),
        f.word_chars.alias("word_chars"),
        f.n_symbols.alias("n_symbols"),
        f.n_dup_lines.alias("n_dup_lines"),
        f.n_repeat_words.alias("n_repeat_words"),
        failed.alias("base_failed"),
        f.lost.lines.alias("n_removed_lines"),
        f.lost.words.alias("n_removed_words"),
        (~failed & (f.lost.words <= f.n_words * max_lost)).alias("kept"),
        f.text.alias("text"),
    )
    return rows.withColumn(out, whole).drop(key, bad, lines, found, q)


#: The same in DuckDB SQL; {cte} continues with more common table expressions or a query.
SQL = r"""
with q_doc as (
  select row_number() over (order by doc_id, md5(coalesce(text, ''))) as rid, *, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         string_split(coalesce(text, ''), chr(10)) as lines from documents
), q_line as (
  select rid, doc_id, source, md5(t) as copy, pos, line,
         translate(lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '123456789', '000000000') as norm,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w
  from (select rid, doc_id, source, t, unnest(lines) as line, generate_subscripts(lines, 1) as pos from q_doc where text is not null)
), q_host as (select source, count(distinct md5(t)) as docs from q_doc where text is not null group by source
), q_bad as (
  select l.source, l.norm from (select source, norm, count(distinct copy) as n from q_line where w > 0 group by source, norm) l
  join q_host h on l.source is not distinct from h.source where n > 3 and n > docs * 0.05::double
), q_lost as (
  select rid, count(*) as lost_lines, sum(w) as lost_words from q_line l join q_bad b on l.norm = b.norm and l.source is not distinct from b.source where w > 0 group by rid
), q_clean as (
  select rid, coalesce(string_agg(line, chr(10) order by pos) filter (not (w > 0 and b.norm is not null)), '') as cleaned
  from q_line l left join q_bad b on l.norm = b.norm and l.source is not distinct from b.source group by rid
), q_gram as (
  select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) as n
  from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from q_doc)
), q_rep as (select rid, count(distinct i + k) as n_rep from q_gram, (values (0), (1), (2)) o(k) where n > 1 group by rid
), q_dup as (select rid, sum(n - 1) as n_dup from (select rid, line, count(*) as n from q_line where w > 0 group by rid, line) group by rid
), q_fig as (
  select d.rid, d.doc_id, d.text, d.lang, d.source, d.n_chars, c.cleaned, len(ws)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_rep, 0)::bigint as n_repeat_words,
         coalesce(lost_lines, 0)::bigint as n_removed_lines, coalesce(lost_words, 0)::bigint as n_removed_words
  from q_doc d left join q_dup using (rid) left join q_rep using (rid) left join q_lost using (rid) left join q_clean c using (rid)
), q_all as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_removed_words <= n_words * 0.25::double as kept from q_fig
)
"""
