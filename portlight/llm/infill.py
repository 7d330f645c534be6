"""Fill-in-middle: texts cut in three at token boundaries and reordered, by a learned index of rank to offset.

A task takes documents in shards. All token boundaries of a shard, in code points, form one rising sequence; segments of straight lines
are fitted to it, none further than MISS from a boundary, and the rests are kept in single bytes. A cut after k tokens is then
predicted by its segment's line and made exact by its rest: no list of tokens is built and none is walked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: How far a line may be from a boundary, in code points; rests fit a byte.
MISS = 100
#: Code points after which a shard is cut and let go; a longer text is a shard of its own.
SHARD_CHARS = 2 << 20

_SPACE = np.zeros(0x21, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

CUT_SCHEMA = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass
class RankIndex:
    """Lines over ranks: segment i starts at rank first[i], there predicts base[i] and rises by slope[i] a rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    rest: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, miss: int = MISS) -> RankIndex:
        """Each segment goes on as long as some line through its first point stays within miss of every offset."""
        first, base, slope = [], [], []
        at, n, step = 0, len(offsets), 64
        while at < n:
            low, high, end, y0 = -np.inf, np.inf, at + 1, int(offsets[at])
            while end < n:
                stop = min(n, end + step)
                x = np.arange(end - at, stop - at, dtype=np.float64)
                y = offsets[end:stop] - y0
                lows = np.maximum.accumulate(np.maximum((y - miss) / x, low))
                highs = np.minimum.accumulate(np.minimum((y + miss) / x, high))
                wrong = np.flatnonzero(lows > highs)
                good = int(wrong[0]) if len(wrong) else len(x)
                if good:
                    low, high = lows[good - 1], highs[good - 1]
                end += good
                step = 64 if len(wrong) else min(2 * step, 1 << 16)
                if len(wrong):
                    break
            first.append(at)
            base.append(y0)
            slope.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        index = cls(np.array(first, dtype=np.int64), np.array(base, dtype=np.int64), np.array(slope), np.zeros(0, dtype=np.int8))
        rest = offsets - index.predict(np.arange(n))
        index.rest = rest.astype(np.int8 if miss < 127 else np.int32)
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.first, rank, "right") - 1
        return self.base[i] + np.rint(self.slope[i] * (rank - self.first[i])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.rest[rank]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ends of all tokens in the texts set one after the other, with 0 in front, and how many tokens each text has.

    Tokens are those of `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: a token ends where other characters end before white
    space, and where the text ends.
    """
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    space = (codes <= 0x20) & _SPACE[np.minimum(codes, 0x20)]
    is_end = np.zeros(len(codes), dtype=bool)
    is_end[:-1] = ~space[:-1] & space[1:]
    ends = np.cumsum(sizes)
    is_end[ends[sizes > 0] - 1] = True
    offsets = np.r_[0, np.flatnonzero(is_end) + 1]
    upto = np.searchsorted(offsets, ends, "right") - 1
    return offsets, np.diff(np.r_[0, upto])


def cut_shard(texts: list[str], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens, code points before its first cut and between its cuts. low and high are the cuts' draws, of which
    the rests by the number of tokens and one count."""
    offsets, n = boundaries(texts)
    index = RankIndex.fit(offsets)
    one, two = low % (n + 1), high % (n + 1)
    before = np.cumsum(n) - n
    first, second = index.offset(before + np.minimum(one, two)), index.offset(before + np.maximum(one, two))
    return n, first - index.offset(before), second - first


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """Documents (doc_id, text) as CUT_SCHEMA: text, tokens, form (plain, psm or spm), characters before and between the cuts
    (null if plain) and the output.

    percent of the texts are reordered, of these spm_percent as suffix-prefix-middle and the rest as prefix-suffix-middle; a hash
    of seed and doc_id draws both and the cuts, so repeated rows come out alike. An empty text, or one that holds a mark, stays plain. A
    null text is empty; a null doc_id is hashed as nothing; an empty table has no rows; other columns are ignored.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda i: F.conv(F.substring("drawn_", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), drawn.alias("drawn_"))
    held = [F.contains("text", F.lit(m)) for m in marks]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (part(2) % 100 >= percent)
    form = F.when(plain, "plain").when(part(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", part(0).alias("low"), part(1).alias("high"), form.alias("form"))
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in CUT_SCHEMA.split(", "))])

    def cut(batches):
        prefix_mark, suffix_mark, middle_mark = marks

        def shard(rows):
            texts = [x[1] for x in rows]
            n, before, between = cut_shard(texts, np.array([x[2] for x in rows], dtype=np.int64), np.array([x[3] for x in rows], dtype=np.int64))
            out = []
            for (doc_id, text, _, _, form), k, a, b in zip(rows, n.tolist(), before.tolist(), between.tolist(), strict=True):
                if form == "plain":
                    out.append((doc_id, text, k, form, None, None, text))
                    continue
                prefix, middle, suffix = text[:a], text[a : a + b], text[a + b :]
                pieces = (prefix_mark, prefix, suffix_mark, suffix) if form == "psm" else (suffix_mark, suffix, prefix_mark, prefix)
                out.append((doc_id, text, k, form, a, b, "".join((*pieces, middle_mark, middle))))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                held.append(tuple(x.as_py() for x in row))
                size += len(held[-1][1])
                if size >= SHARD_CHARS:
                    yield shard(held)
                    held, size = [], 0
        if held:
            yield shard(held)

    return rows.mapInArrow(cut, CUT_SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made of. A text with a mark in it is never reordered, so each mark stands once."""
    prefix_mark, suffix_mark, middle_mark = marks
    behind = lambda text, mark: F.substring_index(text, mark, -1)
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    prefix_first = F.concat(upto(behind(output, prefix_mark), suffix_mark), behind(output, middle_mark), upto(behind(output, suffix_mark), middle_mark))
    suffix_first = F.concat(upto(behind(output, prefix_mark), middle_mark), behind(output, middle_mark), upto(behind(output, suffix_mark), prefix_mark))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


def op13_learned_infill(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP13_SQL = """
with h as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d,
  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units from documents),
r as (select *, len(units) as n, cast('0x' || substr(d, 1, 8) as bigint) as h1, cast('0x' || substr(d, 9, 8) as bigint) as h2,
  cast('0x' || substr(d, 17, 8) as bigint) as h3, cast('0x' || substr(d, 25, 8) as bigint) as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from r),
p as (select *, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
