"""Values as a page shows them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How long a label may be, and what stands for none.
LABEL, BLANK, NONE = 28, "(blank)", "--"


def _grouped(value: Column, places: int) -> Column:
    return F.regexp_replace(F.format_number(value, places), r"\.?0+$" if places else "$^", "")


def number_text(value: Column, places: int = 2) -> Column:
    """With thousands marked and no more places than it has; null is 0."""
    return _grouped(F.coalesce(value.cast("double"), F.lit(0.0)), places)


def percent_text(share: Column, places: int = 1) -> Column:
    """A share as a percentage."""
    return F.when(share.isNull() | F.isnan(share.cast("double")), NONE).otherwise(F.concat(_grouped(share.cast("double") * 100, places), F.lit("%")))


def label_text(value: Column, length: int = LABEL) -> Column:
    """A label cut to its room."""
    label = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(BLANK))
    return F.when(F.length(label) > length, F.concat(F.substring(label, 1, length - 1), F.lit("..."))).otherwise(label)
