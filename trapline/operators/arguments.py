"""Argument checks shared by the queries."""

from __future__ import annotations


def check_limit(limit: int, highest: int) -> None:
    check_range("limit", limit, 1, highest)


def check_range(name: str, value: float, lowest: float, highest: float) -> None:
    if not lowest <= value <= highest:
        raise ValueError(f"{name} must be between {lowest} and {highest}, not {value}")


def check_choice(name: str, value: str, choices) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}, not {value}")
