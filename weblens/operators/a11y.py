"""Accessibility checks and outline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.operators.snapshot import is_button, missing_alt


def accessible_name():
    """aria-label when non-empty, else the text preview."""
    al = F.col("attr")["aria-label"]
    return F.when(F.coalesce(al, F.lit("")) != "", al).otherwise(F.coalesce(F.col("preview"), F.lit("")))


def unnamed_button():
    return is_button() & (accessible_name() == "")


def unnamed_buttons(els_text: DataFrame) -> DataFrame:
    return els_text.filter(unnamed_button()).select("page_id", "pos")


def warnings_col():
    return F.array_compact(F.array(
        F.when(missing_alt(), F.lit("missing-alt")),
        F.when(unnamed_button(), F.lit("unnamed-button")),
    ))


def a11y_findings(els_text: DataFrame) -> DataFrame:
    """``(page_id, pos, warning)`` for every element with a warning."""
    return els_text.select("page_id", "pos", F.explode(warnings_col()).alias("warning"))
