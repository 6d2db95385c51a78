"""Constants that are part of the semantics. Times are milliseconds."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Segmentation:
    gap: int = 700
    speaker_gap: int = 250
    max_len: int = 10_000
    sentence_max: int = 13_000
    min_len: int = 1_200
    micro: int = 900
    min_words: int = 3
    merge_gap: int = 500
    lone_word_gap: int = 1_500
    word_max: int = 800
    foreign_min_words: int = 3
    turn_gap: int = 800
    min_turn: int = 400
    island_gap: int = 600
    snap: int = 300
    orphan_words: int = 2
    orphan_len: int = 2_000
    orphan_gap_min: int = 2_000
    orphan_gap_max: int = 8_000
    min_remnant: int = 400
    word_overlap: int = 50


SEG = Segmentation()

#: Marks that end a sentence, an optional closing quote after them.
SENTENCE_END = r"[.!?…。｡！？]['\"»׳״」』]?$"
