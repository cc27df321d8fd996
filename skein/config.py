"""Settings of the matching pipeline in one immutable object."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Frequent English words that carry no meaning in a name (lower case; matching is case-sensitive).
STOP_WORDS = tuple(
    """a about after all also an and any are as at be been before being between both but by can did do does during each few for from further
    had has have he her here him his how i if in into is it its just more most my no nor not now of off on once only or other our out over own
    same she should so some such than that the their them then there these they this those through to too under until up very was we were what
    when where which while who whom why will with you your""".split()
)

# Relation labels of the data model by family, and each type's inverse.
SYNONYM_TYPES = ("RL", "RQ", "RU", "SY")
PARENT_TYPES = ("RB", "PAR", "Is a", "Part of", "subClassOf", "is_a", "part_of")
CHILD_TYPES = ("RN", "CHD", "Has part", "subClass", "has_part")
SIBLING_TYPES = ("SIB", "RO")
INVERSE_TYPES = {
    "PAR": "CHD",
    "CHD": "PAR",
    "RN": "RB",
    "RB": "RN",
    "subClassOf": "subClass",
    "subClass": "subClassOf",
    "part_of": "has_part",
    "has_part": "part_of",
}


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and limits; the defaults are those of the published pipeline."""

    score_threshold: float = 0.90
    top_k: int = 100
    ngram_size: int = 5
    idf_factor: int = 19  # idf >= ln 20 means 19 * df <= entities of the knowledge base
    region_steps: int = 2
    propagation_rounds: int = 0
    one_to_one_candidates: int = 10
    hard_negatives: int = 1
    easy_negatives: int = 1
    test_part: float = 0.2
    dev_part: float = 0.2  # of what the test part leaves
    eval_ks: tuple[int, ...] = (1, 2, 5, 10, 20, 50, 100, 200, 500)
    stop_words: tuple[str, ...] = STOP_WORDS
    metric_mode: str = "standard"  # or "confident": only probabilities beyond the threshold count
    seed: int = 13
    families: dict = field(
        default_factory=lambda: {"par": PARENT_TYPES, "chd": CHILD_TYPES, "sib": SIBLING_TYPES, "syn": SYNONYM_TYPES}
    )

    @property
    def idf_limit(self) -> float:
        return math.log(self.idf_factor + 1)


DEFAULT = EngineConfig()
