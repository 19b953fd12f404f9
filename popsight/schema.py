"""Column roles of a census-shaped table.

The operators take roles instead of hard-coded names, so the same code runs on
the raw survey layout (names with spaces) and on the ``persons`` table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType, StringType


@dataclass(frozen=True)
class Roles:
    label: str = "label"
    weight: str = "weight"
    year: str = "year"
    # codes where 0 means "not applicable"
    recodes: tuple[str, ...] = ("industry_code", "occupation_code")
    # wage column whose 9999 is an error code
    wage: str = "wage_per_hour"
    continuous: tuple[str, ...] = ("age", "wage_per_hour", "capital_gains", "capital_losses",
                                   "dividends", "weeks_worked", "num_employer")
    # columns carried along but never profiled as features (row keys, given scores)
    ids: tuple[str, ...] = field(default_factory=tuple)
    positive: str = "50000+."
    negative: str = "- 50000."

    @property
    def exclude(self) -> tuple[str, ...]:
        return (self.label, self.weight, self.year)


# The raw survey layout's role columns.
RAW_ROLES = Roles(
    recodes=("detailed industry recode", "detailed occupation recode"),
    wage="wage per hour",
    continuous=("age", "wage per hour", "capital gains", "capital losses",
                "dividends from stocks", "weeks worked in year",
                "num persons worked for employer"),
)

PERSONS_ROLES = Roles(ids=("person_id", "score"))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def q(name: str) -> str:
    """Backtick-quote a column name for expressions (names may hold spaces)."""
    return "`" + name.replace("`", "``") + "`"
