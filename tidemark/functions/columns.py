"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it.

    The optimizer may write an expression into each place that names it, also
    into the body of a higher-order function; a lambda's variable stays bound.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def changed_ascii_case(text: Column) -> Column:
    """text with A-Z, and nothing else, lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
