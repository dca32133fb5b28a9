"""Library settings: repeated flags become lists; embedding options from argv."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from loomgraph.operators.seqform import Form, Slot, parse_form, parse_stack


def parse_settings(text: str) -> dict[str, list[str]]:
    """``-flag value`` lines; a flag that repeats collects its values."""
    out: dict[str, list[str]] = {}
    for line in text.splitlines():
        flag, _, value = line.strip().partition(" ")
        if flag.startswith("-"):
            out.setdefault(flag, []).append(value.strip())
    return out


@dataclass
class LibrarySettings:
    source_for: list[str] = field(default_factory=list)
    source_rev: list[str] = field(default_factory=list)
    for_forms: list[Form] = field(default_factory=list)
    rev_forms: list[Form] = field(default_factory=list)
    uxis: dict[int, list[Slot]] = field(default_factory=dict)
    amplicons: dict[int, list[Slot]] = field(default_factory=dict)
    min_mean_qual: float = 30.0
    min_reads_per_assoc: int = 2
    min_uei_per_assoc: int = 1
    min_uei_per_umi: int = 2
    terminators: list[str] = field(default_factory=list)
    #: Least insert length of each side; None where a side has no inserts to keep.
    amp_len: tuple[int | None, int | None] = (None, None)
    insert_window: int = 25
    max_mismatch: float = 0.0
    max_mismatch_amplicon: float = 0.0
    uei_classification: list[tuple[int, int]] | None = None
    quickmatch: tuple[str | None, str | None] = (None, None)
    uei_library: str | None = None
    sequences_in_labels: bool = False
    genome_index: str | None = None
    gtf: str | None = None

    @classmethod
    def from_text(cls, text: str) -> LibrarySettings:
        f = parse_settings(text)

        def number(flag: str, default: float) -> float:
            return type(default)(f[flag][0]) if f.get(flag) else default

        stacks = {k: {int(flag[2:]): parse_stack(v[0]) for flag, v in f.items() if flag[:2] == f"-{k}" and flag[2:].isdigit()} for k in "ua"}
        def word(flag: str) -> str | None:
            return f[flag][0] if f.get(flag) else None

        def whole(flag: str) -> int | None:
            return int(f[flag][0]) if f.get(flag) else None

        kinds = word("-uei_classification")
        return cls(
            f.get("-source_for", []),
            f.get("-source_rev", []),
            [parse_form(v) for v in f.get("-seqform_for", [])],
            [parse_form(v) for v in f.get("-seqform_rev", [])],
            stacks["u"],
            stacks["a"],
            number("-min_mean_qual", 30.0),
            int(number("-min_reads_per_assoc", 2)),
            int(number("-min_uei_per_assoc", 1)),
            int(number("-min_uei_per_umi", 2)),
            [w for w in (word("-amplicon_terminate") or "").split(",") if w],
            (whole("-filter_umi0_amp_len"), whole("-filter_umi1_amp_len")),
            int(number("-filter_amplicon_window", 25)),
            float(number("-max_mismatch", 0.0)),
            float(number("-max_mismatch_amplicon", 0.0)),
            [(int(a), int(b)) for a, b in (p.split(",")[:2] for p in kinds.split(";"))] if kinds else None,
            (word("-filter_umi0_quickmatch"), word("-filter_umi1_quickmatch")),
            word("-uei_matchfilepath"),
            "-add_sequences_to_labelfiles" in f,
            word("-STARindexdir"),
            word("-gtffile"),
        )


@dataclass
class EmbeddingOptions:
    dim: int = 2
    eignum: int = 15
    final_eignum: int = 50
    neighbours: int | None = None
    rounds: int = 40

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str) -> EmbeddingOptions:
        return cls(**json.loads(Path(path).read_text()))


def parse_options(argv: Sequence[str]) -> dict[str, str | bool]:
    """A flag takes at most one value; parsing ends at a repeat or a stray word."""
    out: dict[str, str | bool] = {}
    i = 0
    while i < len(argv) and argv[i].startswith("-") and argv[i] not in out:
        flag = argv[i]
        has_value = i + 1 < len(argv) and not argv[i + 1].startswith("-")
        out[flag] = argv[i + 1] if has_value else True
        i += 2 if has_value else 1
    return out
