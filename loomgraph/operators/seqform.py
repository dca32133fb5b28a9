"""Read patterns: grammar, matching and barcode extraction as Columns.

A form is a list of blocks joined by ``|``; a block is ``X_[PATTERN_]from:to``.
X is P (primer), S (spacer), A (amplicon) or U (barcode).  Patterns use fixed
bases plus W (A or T), S (C or G) and N (any).  ``from > to`` reads backwards
on the other strand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.seq import revcomp

# fixed values: allowed bases per pattern letter, forward and reversed reading
FORWARD = {"A": "A", "C": "C", "G": "G", "T": "T", "W": "AT", "S": "CG"}
REVERSED = {"A": "T", "C": "G", "G": "C", "T": "A", "W": "AT", "S": "CG"}
AMBIGUOUS = "NWS"


@dataclass(frozen=True)
class Block:
    kind: str
    begin: int | None
    end: int | None
    pattern: str = ""

    @property
    def backwards(self) -> bool:
        return self.begin is not None and self.end is not None and self.begin > self.end

    def positions(self) -> list[tuple[int, str]]:
        """(1-based read position, pattern letter) pairs in pattern order."""
        if self.backwards:
            return [(self.begin - k, letter) for k, letter in enumerate(self.pattern)]
        return [(self.begin + k + 1, letter) for k, letter in enumerate(self.pattern)]


@dataclass(frozen=True)
class Form:
    blocks: tuple[Block, ...] = field(default_factory=tuple)

    def of_kind(self, kind: str) -> list[Block]:
        return [b for b in self.blocks if b.kind == kind]


def parse_form(text: str) -> Form:
    """Read one form; unknown block letters are ignored."""
    blocks = []
    for part in text.split("|"):
        bits = part.split("_")
        pattern = bits[1] if len(bits) >= 3 else ""
        lo, hi = bits[2 if len(bits) >= 3 else 1].split(":")
        begin, end = (int(lo) if lo else None), (int(hi) if hi else None)
        if len(bits) == 3 and begin is not None and end is not None and abs(end - begin) != len(pattern):
            raise ValueError(f"pattern {pattern!r} does not span {lo}:{hi}")
        if bits[0].upper() in ("P", "S", "A", "U"):
            blocks.append(Block(bits[0].upper(), begin, end, pattern))
    return Form(tuple(blocks))


def min_length(form: Form) -> int:
    """Shortest read that reaches every bounded position of the form."""
    return max((max(v for v in (b.begin, b.end) if v is not None) for b in form.blocks), default=0)


def _condition(form: Form, read: Column) -> Column:
    cond = F.lit(True)
    for block in form.of_kind("U"):
        allowed = REVERSED if block.backwards else FORWARD
        for pos, letter in block.positions():
            if letter in allowed:
                cond = cond & F.substring(read, pos, 1).isin(*allowed[letter])
    return cond


def classify(read: Column, forms: Sequence[Form]) -> Column:
    """Index of the first matching form, -1 if none matches, 0 without forms."""
    if not forms:
        return F.lit(0)
    out = None
    for i, form in enumerate(forms):
        cond = _condition(form, read)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out.otherwise(-1)


def _runs(positions: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for p in sorted(positions):
        if runs and runs[-1][0] + runs[-1][1] == p:
            runs[-1] = (runs[-1][0], runs[-1][1] + 1)
        else:
            runs.append((p, 1))
    return runs


def barcode(block: Block, read: Column) -> Column:
    """Only the ambiguous positions, in reading direction of the block."""
    runs = _runs([p for p, letter in block.positions() if letter in AMBIGUOUS])
    if not runs:
        raise ValueError("a barcode block needs at least one ambiguous position")
    parts = [F.substring(read, p, n) for p, n in runs]
    if block.backwards:
        parts = [revcomp(p) for p in reversed(parts)]
    return F.concat(*parts)


def barcodes(read: Column, forms: Sequence[Form], index: Column) -> Column:
    """Array of the barcodes of the matched form."""
    out = None
    for i, form in enumerate(forms):
        blocks = form.of_kind("U")
        value = F.array(*[barcode(b, read) for b in blocks]) if blocks else F.array(F.lit(""))
        out = F.when(index == i, value) if out is None else out.when(index == i, value)
    return out if out is not None else F.array(F.lit(""))


def amplicon(read: Column, forms: Sequence[Form], index: Column) -> Column:
    """From the start of the amplicon block to the end of the read."""
    out = None
    for i, form in enumerate(forms):
        blocks = form.of_kind("A")
        value = F.substring(read, F.lit(blocks[0].begin + 1), F.length(read)) if blocks else F.lit("")
        out = F.when(index == i, value) if out is None else out.when(index == i, value)
    return out if out is not None else F.lit("")


@dataclass(frozen=True)
class Slot:
    """Where one stacked barcode comes from: forms (None = any) and position."""

    for_index: int | None
    rev_index: int | None
    position: int
    revcomp: bool = False


def parse_stack(text: str) -> list[Slot]:
    """``f,r,i`` items joined by ``+``, ``*`` for any form, optional ``:revcomp``."""
    slots = []
    for item in text.split("+"):
        body, _, tail = item.partition(":")
        f, r, i = body.split(",")
        slots.append(Slot(None if f == "*" else int(f), None if r == "*" else int(r), int(i), tail == "revcomp"))
    return slots
