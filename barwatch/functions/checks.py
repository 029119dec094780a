"""Checks of the arguments of a run."""

from __future__ import annotations

from pathlib import PurePath

from barwatch.operators.score import DEFAULT_SIGMAS
from barwatch.schema import MODELS


def parse_symbol(text: str | None) -> str:
    """Upper-cased ticker; an absent one is UNKNOWN, an empty one an error."""
    symbol = ("UNKNOWN" if text is None else text).upper()
    if not symbol:
        raise ValueError("a symbol may not be empty")
    return symbol


def parse_threshold(text: object = DEFAULT_SIGMAS) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        raise ValueError(f"the threshold is no number: {text!r}") from None


def check_model(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"no such model: {model!r}; there are {', '.join(MODELS)}")
    return model


def check_file_name(name: str) -> str:
    if PurePath(name).suffix.lower() != ".csv":
        raise ValueError(f"not the name of a .csv file: {name!r}")
    return name

