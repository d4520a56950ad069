"""What a search can be asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.include import java_pattern

FORMATS = {0: "tabular", 1: "pairwise", 2: "fasta", 3: "extended", 4: "a3m", 5: "reduced"}


@dataclass(frozen=True)
class SearchConfig:
    """Validated options of a search.

    ``search_space``: "slots" counts residues and one terminator for each sequence; "padded" rounds that up by volumes as a
    packed store does; a number is taken as it is. ``bin_origin``: "subject" counts diagonals from each subject's start,
    "volume" from its ``s_offset`` in the store, so that bins fall as they do over concatenated sequences. ``must_include``: pairs of an ECMAScript expression and how often it has to
    occur. ``min_votes`` raises the vote threshold where it is larger. ``keep_illegal_seeds`` and ``blank_tail_a`` bring back
    two seeding habits of older programs: seeds with illegal residues, and no seeds of three equal letters before A's.
    """

    k: int = 5
    filter_level: int = 1
    min_score: int = 0
    max_evalue: float = 10.0
    max_align: int = 0
    band: int = 8
    must_include: tuple[tuple[str, int], ...] = ()
    search_space: str | int = "slots"
    bin_origin: str = "subject"
    min_votes: int = 0
    dedupe: bool = False
    detailed: bool = True
    keep_illegal_seeds: bool = False
    blank_tail_a: bool = False
    ignored: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if self.k not in (3, 4, 5):
            raise ValueError("k must be 3, 4 or 5")
        if self.band < 1:
            raise ValueError("band must be at least 1")
        if self.max_align < 0:
            raise ValueError("max_align must be 0 (all) or more")
        if not (self.search_space in ("slots", "padded") or isinstance(self.search_space, int)):
            raise ValueError("search_space must be 'slots', 'padded' or a number")
        if self.bin_origin not in ("subject", "volume"):
            raise ValueError("bin_origin must be 'subject' or 'volume'")
        if any(len(x) != 2 or int(x[1]) < 1 for x in self.must_include):
            raise ValueError("must_include takes pairs of an expression and a count of at least 1")
        for expression, _ in self.must_include:
            java_pattern(expression)
