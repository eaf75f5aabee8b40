"""Registry of arms: which family an arm belongs to, what its matrix is made of, and which granularities it has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Arm:
    """``matrix``: text (TF-IDF inside each fold), named, text+named, or dense; named and dense columns are standardised."""

    name: str
    family: str
    matrix: str
    granularities: tuple[str, ...] = ("participant", "question")

    @property
    def scaled(self) -> bool:
        return self.matrix != "text"


ARMS = {
    a.name: a
    for a in (
        Arm("e0_tfidf_base", "frozen", "text"), Arm("e1_beto", "frozen", "dense"), Arm("e2_e5-small", "frozen", "dense"), Arm("e2_e5-base", "frozen", "dense"), Arm("e2_e5-large", "frozen", "dense"), Arm("e3_e5-tsdae", "frozen", "dense"),
        Arm("e7_mental-large", "frozen", "dense"), Arm("l1_lexical", "lexical", "named"), Arm("l2_lexical__affect", "lexical", "named"), Arm("l3_lexical__tfidf", "lexical", "text+named", ("participant",)),
    )
}


def arm(name: str) -> Arm:
    """The arm of that name; an unknown one raises."""
    if name not in ARMS:
        raise KeyError(f"unknown arm {name}; known are {sorted(ARMS)}")
    return ARMS[name]


def applicable(family: str, granularity: str) -> list[str]:
    """Arms of a family that have a granularity, in the order of the registry."""
    return [a.name for a in ARMS.values() if a.family == family and granularity in a.granularities]


def matrix_of(encoder: Column) -> Column:
    """What the matrix of an encoder is made of; versions of an arm share it, other encoders have none."""
    table = F.create_map(*[F.lit(x) for a in ARMS.values() for x in (a.name, a.matrix)])
    return table[F.substring_index(encoder, "_v", 1)]
