"""Sequence functions as Column expressions (no Python in the row path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: complement table and base-4 digits
BASES = "ACGT"
COMPLEMENT = "TGCA"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(s: Column | str) -> Column:
    """Reverse complement; anything that is not A, C, G or T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(_c(s), "[^ACGT]", "N"), BASES, COMPLEMENT))


def del_at(s: Column | str, i: Column | int) -> Column:
    """``s`` without its i-th (1-based) character."""
    s, i = _c(s), F.lit(i) if isinstance(i, int) else i
    return F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing positions of two strings of equal length."""
    xa, xb = F.split(_c(a), ""), F.split(_c(b), "")
    return F.aggregate(F.zip_with(xa, xb, lambda p, q: (p != q).cast("int")), F.lit(0), lambda t, x: t + x)


def base4_encode(n: Column | str, width: int) -> Column:
    """Fixed-width base-4 numeral of ``n`` in the letters ACGT; an error when ``n`` is negative or needs more digits."""
    n = _c(n)
    numeral = F.lpad(F.conv(n.cast("string"), 10, 4), width, "0")
    fits = (n >= 0) & (n < 4**width) if width < 31 else n >= 0
    wrong = F.raise_error(F.concat(F.lit(f"no base-4 numeral of {width} digits for "), n.cast("string")))
    return F.when(n.isNull() | fits, F.translate(numeral, "0123", BASES)).otherwise(wrong.cast("string"))


def base4_digits(most: int) -> int:
    """Digits of the numeral of ``most``."""
    return max(1, (most.bit_length() + 1) // 2)


def base4_decode(s: Column | str) -> Column:
    """Inverse of the numeral; -1 for anything but A, C, G and T."""
    s = _c(s)
    value = F.aggregate(
        F.split(F.translate(s, BASES, "0123"), ""),
        F.lit(0).cast("long"),
        lambda acc, d: acc * 4 + d.try_cast("long"),
    )
    return F.when(s.rlike("^[ACGT]+$"), value).otherwise(F.lit(-1).cast("long"))


def mean_phred(qual: Column | str) -> Column:
    """Mean Phred+33 score of a quality string."""
    q = _c(qual)
    total = F.aggregate(F.split(q, ""), F.lit(0), lambda t, ch: t + F.ascii(ch) - 33)
    return total / F.length(q)


def base_count(s: Column | str, base: str) -> Column:
    s = _c(s)
    return F.length(s) - F.length(F.replace(s, F.lit(base)))


def max_base_fraction(s: Column | str) -> Column:
    """Largest share of a single base, rounded to two decimals."""
    s = _c(s)
    return F.round(F.greatest(*[base_count(s, b) for b in BASES]) / F.length(s), 2)


def longest_homopolymer(s: Column | str) -> Column:
    """Length of the longest run of one character."""
    runs = F.regexp_extract_all(_c(s), F.lit(r"((.)\2*)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def motif_count(s: Column | str, motif: str) -> Column:
    """Non-overlapping left-to-right occurrences of ``motif``."""
    s = _c(s)
    return ((F.length(s) - F.length(F.replace(s, F.lit(motif)))) / len(motif)).cast("long")


def trim_at(s: Column | str, stops: Sequence[str], min_length: int) -> Column:
    """Cut at the earliest of the stop strings; NULL when too little is left."""
    s = _c(s)
    ends = [F.when(F.instr(s, t) > 0, F.instr(s, t) - 1).otherwise(F.length(s)) for t in stops]
    end = F.least(*ends) if len(ends) > 1 else (ends[0] if ends else F.length(s))
    kept = F.substring(s, F.lit(1), end)
    return F.when(F.length(kept) >= min_length, kept)


def cigar_length(cigar: Column | str, ops: str = "MDN=X") -> Column:
    """Sum of the lengths of the CIGAR operations named in ``ops``."""
    lengths = F.regexp_extract_all(_c(cigar), F.lit(rf"(\d+)[{ops}]"), 1)
    return F.aggregate(F.transform(lengths, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)


def md_mismatches(cigar: Column | str, md: Column | str, start: Column | str) -> Column:
    """Mismatch list ``pos~start~length>base`` joined by ``+`` ("None" if empty).

    Digits and deletions move the position, every plain base is one mismatch.
    """
    cigar, md, start = _c(cigar), _c(md), _c(start).cast("long")
    tokens = F.regexp_extract_all(md, F.lit(r"(\d+|\^[ACGTN]+|[ACGTN])"), 1)
    zero = F.struct(start.alias("pos"), F.array().cast("array<string>").alias("hits"))
    tail = F.concat(F.lit("~"), start.cast("string"), F.lit("~"), cigar_length(cigar).cast("string"), F.lit(">"))

    def step(acc: Column, tok: Column) -> Column:
        number = tok.rlike(r"^\d+$")
        gap = tok.startswith("^")
        width = F.when(number, F.expr("0")).otherwise(F.length(tok)).cast("long")
        move = F.when(number, F.regexp_extract(tok, r"^(\d+)$", 1).try_cast("long")).when(gap, width - 1).otherwise(F.lit(1).cast("long"))
        hit = F.concat(acc["pos"].cast("string"), tail, tok)
        hits = F.when(number | gap, acc["hits"]).otherwise(F.concat(acc["hits"], F.array(hit)))
        return F.struct((acc["pos"] + move).alias("pos"), hits.alias("hits"))

    hits = F.aggregate(tokens, zero, step)["hits"]
    return F.when(F.size(hits) > 0, F.array_join(hits, "+")).otherwise(F.lit("None"))


# fixed values: spellings of "no value" in text fields
PLACEHOLDERS = ("NA", "N/A", "NONE", "NULL", "")


def is_placeholder(s: Column | str) -> Column:
    """True for NULL, blank and the usual spellings of a missing value."""
    s = _c(s)
    return s.isNull() | F.upper(F.trim(s)).isin(*PLACEHOLDERS)


def looks_like_dna(s: Column | str) -> Column:
    """Only bases and list separators, and not a placeholder."""
    s = _c(s)
    return F.coalesce(s.rlike("^[ACGTNacgtn;|]+$"), F.lit(False)) & ~is_placeholder(s)
