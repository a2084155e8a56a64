"""Preparation of panels for clustering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelforge.operators import cleaning


@dataclass
class Prepared:
    """The regular part of a cleaned panel, what was left out, and the flags; all lazy."""

    regular: DataFrame
    excluded: DataFrame
    flags: DataFrame
    cleaned: DataFrame


def prepare(
    panel: DataFrame, *, negatives: str = "set_zero", missing: str = "interpolate", transform: str = "none", normalise: str | None = None, exclude_zero_heavy: bool = True, **thresholds: float
) -> Prepared:
    """Negatives, then missing readings, then regimes; only the regular part is transformed and normalised."""
    cleaned = cleaning.impute(cleaning.fix_negatives(panel, negatives), missing)
    flags = cleaning.regime_flags(cleaned, **thresholds)
    regular, out = cleaning.split_regular(cleaned, flags, exclude_zero_heavy)
    regular = cleaning.transform(regular, transform)
    if normalise == "z":
        regular = cleaning.z_rows(regular)
    elif normalise is not None:
        regular = cleaning.normalise(regular, normalise)
    return Prepared(regular, out, flags, cleaned)


def for_features(panel: DataFrame, **options) -> Prepared:
    """For feature clustering: the level stays, outliers too."""
    return prepare(panel, **options)


def for_kshape(panel: DataFrame, **options) -> Prepared:
    """For shape clustering: standardised series."""
    return prepare(panel, normalise="z", **options)


def for_method(panel: DataFrame, method: str, **options) -> Prepared:
    if method not in ("feature_ward", "kshape"):
        raise ValueError(f"unknown method {method!r}")
    return (for_features if method == "feature_ward" else for_kshape)(panel, **options)
