"""Fill-in-the-middle: texts cut at two drawn places and put together with marks.

Units are words with the whitespace before them, or whitespace at the end.
Everything between a batch of texts and a batch of outputs is pyarrow.compute
on whole columns: units are split into list arrays, flattened with their
text's number, numbered, filtered by role, put back into lists and joined.
Whitespace is ASCII, so units are cut on UTF-8 bytes, where byte 0xFF never
occurs and can stand between two units.

The draws are hashes of the id, so a repeated task draws the same; there is no
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Percent of texts that are rewritten, and of these in suffix-prefix-middle order.
RATE, SPM = 50, 80
SEED = 42

_UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
_GAP = b"\xff"
_OUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _joined(units: pa.Array, parent: pa.Array, role: pa.Array, n: int) -> pa.Array:
    """Per text the units where ``role`` holds, joined; ``parent`` is sorted."""
    kept = pc.filter(units, role)
    ends = pc.cumulative_sum(_counts(pc.filter(parent, role), n))
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, kept), pa.scalar(b"", pa.large_binary()))


def _counts(parent: pa.Array, n: int) -> pa.Array:
    """How often each of 0..n-1 occurs."""
    seen = pc.value_counts(parent)
    place = pc.index_in(pa.array(np.arange(n)), seen.field("values"))
    return pc.fill_null(pc.take(seen.field("counts"), place), 0)


def rearranged(text: pa.Array, draws: list[pa.Array], rate: int, spm: int) -> list[pa.Array]:
    """Columns of ``_OUT`` for non-null texts and their four draws."""
    n = len(text)
    raw = text.cast(pa.large_binary())
    parts = pc.split_pattern(pc.replace_substring_regex(raw, pattern=_UNIT, replacement=rb"\1" + _GAP), pattern=_GAP)
    parts = parts.cast(pa.large_list(pa.large_binary()))
    total = pc.subtract(pc.list_value_length(parts).cast(pa.int64()), 1)  # what follows the last gap is empty
    plus = pc.add(total, 1)
    one, two, gate, order = draws
    rest = lambda a, b: pc.subtract(a, pc.multiply(pc.divide(a, b), b))
    first, second = rest(one, plus), rest(two, plus)
    low, high = pc.min_element_wise(first, second), pc.max_element_wise(first, second)

    units = pc.list_flatten(parts)
    parent = pc.list_parent_indices(parts).cast(pa.int64())
    starts = parts.offsets.cast(pa.int64())
    starts = pc.subtract(starts, starts[0])
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parent))
    lows, highs = pc.take(low, parent), pc.take(high, parent)
    before, behind = pc.less(ordinal, lows), pc.greater_equal(ordinal, highs)
    prefix = _joined(units, parent, before, n)
    middle = _joined(units, parent, pc.and_(pc.invert(before), pc.invert(behind)), n)
    suffix = _joined(units, parent, behind, n)

    marked = pc.or_kleene(pc.equal(pc.binary_length(raw), 0), pc.greater_equal(gate_of(gate), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(raw, pattern=mark.encode()))
    is_spm = pc.less(gate_of(order), spm)
    p, s, m, none = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(marked, raw, pc.if_else(is_spm, spm_text, psm_text))
    form = pc.if_else(marked, "plain", pc.if_else(is_spm, "spm", "psm"))
    nothing = pa.scalar(None, pa.int64())
    chars = [pc.if_else(marked, nothing, pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    return [total, form, *chars, output.cast(pa.large_string()).cast(pa.string())]


def gate_of(draw: pa.Array) -> pa.Array:
    """``draw`` modulo 100."""
    return pc.subtract(draw, pc.multiply(pc.divide(draw, 100), 100))


def _draw(id: Column, seed: int, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per row (id, n, form, prefix_chars, middle_chars, output).

    A null text is an empty one and stays plain with n = 0; so does a text that
    holds a mark.  Rows with the same id draw alike, each on its own text; a
    null id draws as an empty one.  Further columns are left out.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), *[_draw(F.col(id), seed, k).alias(f"h{k}") for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            columns = rearranged(batch.column(1), batch.columns[2:], rate, spm)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_OUT}")
    return out.withColumnRenamed("id", id)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  The text holds no mark, so each stands in the output once."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    tail = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), tail, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), tail, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_report(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs, text, id)
    back = restored(F.col("output"), F.col("form"))
    return out.select(id, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
