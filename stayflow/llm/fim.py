"""Fill-in-middle: a text is cut at two token boundaries and its parts are put in another order.

Token ends are bits over the bytes of a whole Arrow batch: packed into words, with a directory of the number of ones before
each block of words. rank() at the ends of a text gives its number of tokens, select() of two ranks its byte cuts, so no
token is ever made. Memory is an Arrow batch and its bits. The rest is DataFrame functions on the byte cuts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.llm.bits import Bits, flat
from stayflow.llm.common import BLANKS, free_name

SENTINELS = ("<P>", "<S>", "<M>")
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True


def token_cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, first, second) of each text: its number of tokens, and the bytes before the cuts after h1 % (n + 1) and
    h2 % (n + 1) tokens, the smaller first.

    A token is a run of other characters with the blanks before it, or the blanks at the end of the text. It ends at a byte
    that is no blank and has a blank after it, or at the last byte; bytes of longer characters are no blanks.
    """
    raw, offsets = flat(texts)
    if not len(raw):
        zero = np.zeros(len(texts), np.int64)
        return zero, zero, zero
    blank = _BLANK[raw]
    ends = np.empty(len(raw), bool)
    np.logical_and(~blank[:-1], blank[1:], out=ends[:-1])
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    bits = Bits(ends)
    before = bits.rank(offsets)
    n, base = np.diff(before), before[:-1]
    units = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    cuts = []
    for u in units:
        cut = np.zeros(len(n), np.int64)
        some = u > 0
        cut[some] = bits.select((base + u)[some]) + 1 - offsets[:-1][some]
        cuts.append(cut)
    return n, cuts[0], cuts[1]


def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = token_cuts(text, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=["n", "first", "second"])


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "fim", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Add a struct `out` (a column of that name is replaced): n tokens (0 for an empty text), form, prefix_chars,
    middle_chars (code points; null if plain) and output.

    Four numbers of the SHA-256 of "<seed>:<doc_id>" decide alone: h1 and h2 the cuts, h3 whether a text stays plain (rate %
    are cut), h4 the form (spm % have the suffix first). A null text counts as empty, a null id as an empty string; texts
    that are empty or hold a sentinel stay plain. Rows, repeats (which get the same output) and other columns stay.
    """
    named = docs.drop(out)
    cut = free_name(named, "cut")
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(body, F.lit(s))
    plain = (body == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    raw, c = body.cast("binary"), F.col(cut)
    piece = lambda start, end: F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    prefix, middle, suffix = piece(F.lit(0), c.first), piece(c.first, c.second), piece(c.second, F.octet_length(raw).cast("long"))
    p, s, m = (F.lit(x) for x in sentinels)
    output = F.when(form == "plain", body).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    chars = lambda part: F.when(form != "plain", F.length(part).cast("long"))
    made = F.struct(c.n.alias("n"), form.alias("form"), chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"), output.alias("output"))
    cuts = F.arrow_udf(_cuts, "struct<n: bigint, first: bigint, second: bigint>")
    return named.withColumn(cut, cuts(body, h[0], h[1])).withColumn(out, made).drop(cut)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from output and form alone. Parts hold no sentinel, and a sentinel begins only with its own first
    character, so the first place of each is its own; sentinels must keep that (as those of the default do)."""
    p, s, m = sentinels
    after = lambda mark: F.substring(output, F.locate(mark, output) + len(mark), F.length(output))
    between = lambda a, b: F.substring(output, F.locate(a, output) + len(a), F.locate(b, output) - F.locate(a, output) - len(a))
    psm = F.concat(between(p, s), after(m), between(s, m))
    spm = F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: The query in DuckDB SQL: tokens by the regular expression itself.
SQL = r"""
with f_doc as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as parts from documents
), f_num as (
  select *, len(parts)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from f_doc
), f_cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from f_num
), f_part as (
  select *, coalesce(list_aggregate(parts[1:a], 'string_agg', ''), '') as p, coalesce(list_aggregate(parts[a + 1:b], 'string_agg', ''), '') as m,
         coalesce(list_aggregate(parts[b + 1:n], 'string_agg', ''), '') as s from f_cut
)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256 from f_part
"""
