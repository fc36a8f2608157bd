"""Removal of passages that stand elsewhere already, by overlapping windows of three lines. DataFrame functions only.

A window is three consecutive lines. Windows with equal lines (trimmed) are one passage; that of the smallest (doc_id, text
hash, position) stays, and the lines that the others cover are removed. Two 64-bit hashes stand for a window's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.llm.common import BLANKS, free_name
from stayflow.llm.quality import bound
from stayflow.sources.store import written


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """rows (id, copy, text) -> (id, copy, at, a, b), a window each; windows without a word are left out."""

    def hashes(lines: Column) -> Column:
        def one(x: Column) -> Column:
            line = F.btrim(x, F.lit(BLANKS))
            return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"), (line != "").alias("word"))

        return F.transform(lines, one)

    def windows(h: Column) -> Column:
        def at(i: Column) -> Column:
            parts = [F.get(h, i + k) for k in range(width)]
            some = reduce(lambda x, y: x | y, [p.word for p in parts])
            return F.struct(i.cast("int").alias("at"), F.xxhash64(*[p.a for p in parts]).alias("a"), F.xxhash64(*[p.b for p in parts]).alias("b"), some.alias("word"))

        starts = F.when(F.size(h) >= width, F.sequence(F.lit(0), F.size(h) - width)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, at), lambda w: w["word"])

    split = rows.select("id", "copy", F.split("text", "\n").alias("lines"))
    return split.select("id", "copy", F.inline(bound(hashes(F.col("lines")), windows))).drop("word")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "lines", width: int = 3) -> DataFrame:
    """Replace the text by what stays of it, and add a struct `out` (replaced if there): n_lines, n_removed.

    Lines of the window that stays are never removed for its own repeats, also where the two overlap. Texts with fewer
    than `width` lines have no window and stay whole; lines without a word make none by themselves. Rows with equal id and text
    are one document: each of them gets the same result. A null text stays null (n_lines 0); a null id is smallest.
    """
    key = F.xxhash64(F.col(text))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), key.alias("copy"), F.col(text).alias("text"))
    windows = _windows(rows, width)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("id", "copy", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("a", "b", "first"), "passages")
    later = windows.join(first, ["a", "b"])
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("copy") == F.col("first.copy"))
    start = F.when(same, F.greatest(F.col("at"), F.col("first.at") + width)).otherwise(F.col("at"))
    later = later.where(~(same & (F.col("at") == F.col("first.at")))).select("id", "copy", start.alias("a"), (F.col("at") + (width - 1)).alias("z")).where("a <= z")
    covered = later.select("id", "copy", F.explode(F.sequence("a", "z")).alias("line")).distinct()
    covered = written(covered.groupBy("id", "copy").agg(F.collect_list("line").alias("gone")), "covered")

    base = docs.drop(out)
    cid, ccopy, gone, own, lines = (free_name(base, n) for n in ("covered_id", "covered_copy", "gone", "copy_key", "all_lines"))
    covered = covered.select(F.col("id").alias(cid), F.col("copy").alias(ccopy), F.col("gone").alias(gone))
    # the same plan at every size: the text is shuffled once, and nothing is broadcast
    joined = base.withColumn(own, key).join(covered.hint("merge"), F.col(doc_id).eqNullSafe(F.col(cid)) & (F.col(own) == F.col(ccopy)), "left")
    joined = joined.withColumn(lines, F.split(F.col(text), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    result = joined.withColumns(
        {
            text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(left),
            out: F.struct(F.greatest(F.lit(0), F.coalesce(F.size(lines), F.lit(0))).cast("long").alias("n_lines"), F.greatest(F.lit(0), F.coalesce(F.size(gone), F.lit(0))).cast("long").alias("n_removed")),
        }
    )
    return result.drop(cid, ccopy, gone, own, lines)


#: The same in DuckDB SQL.
SQL = r"""
with l as (
  select doc_id, text, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as norm
  from (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null)
), n as (
  select *, lead(norm) over w as norm2, lead(norm, 2) over w as norm3 from l window w as (partition by doc_id order by pos)
), win as (
  select doc_id, pos, [norm, norm2, norm3] as body from n where norm3 is not null and (norm <> '' or norm2 <> '' or norm3 <> '')
), f as (
  select *, first_value(doc_id) over w as first_doc, first_value(pos) over w as first_pos from win window w as (partition by body order by doc_id nulls first, pos)
), c as (
  select distinct doc_id, unnest(range(case when doc_id = first_doc then greatest(pos, first_pos + 3) else pos end, pos + 3)) as pos
  from f where not (doc_id = first_doc and pos = first_pos)
), k as (
  select l.doc_id, count(*) as n_lines, count(c.pos) as n_removed, coalesce(string_agg(line, chr(10) order by l.pos) filter (c.pos is null), '') as text
  from l left join c on l.doc_id = c.doc_id and l.pos = c.pos group by l.doc_id
)
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, text from k
union all select doc_id, 0, 0, null from documents where text is null
"""
