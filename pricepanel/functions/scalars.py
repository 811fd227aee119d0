"""Small scalar expressions shared by loaders and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_number(c: Column) -> Column:
    """Number or null; text that is not a number never fails the job."""
    return c.try_cast("double")


def dollars_k(c: Column) -> Column:
    """``$123k`` label of an amount (half to even, as C-style formatting does)."""
    return F.format_string("$%.0fk", F.bround(c / 1000, 0))


def two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def percent_of(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` with null for a zero denominator."""
    return part / F.nullif(whole, F.lit(0.0)) * 100
