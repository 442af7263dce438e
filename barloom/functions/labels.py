"""Free-form regime labels to base states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base states a label can lead with.
STATES = ("RISK-ON", "CAUTION", "RISK-OFF")

_LEAD = r"(?iu)^[^\p{L}]*(risk[^\p{L}\p{N}]{0,3}on|risk[^\p{L}\p{N}]{0,3}off|caution)(?!\p{L})"


def base_state(label: Column) -> Column:
    """The base state a label leads with, whatever its case, separator, decoration or annotation; null if it names none.

    Null, empty and undecipherable labels give null.
    """
    word = F.upper(F.regexp_extract(label, _LEAD, 1))
    return F.when(word == "", F.lit(None)).when(word == "CAUTION", word).when(word.endswith("OFF"), "RISK-OFF").when(word.endswith("ON"), "RISK-ON")
