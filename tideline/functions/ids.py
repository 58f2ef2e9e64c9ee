"""Readable composite keys, each part checked: what is malformed ends the query instead of joining with nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METHODS = ("plain", "windowed")
PROFILES = ("NEW", "OLD_SMALL", "OLD_LARGE")


def _checked(value: Column, good: Column, what: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"malformed {what}: "), F.coalesce(value, F.lit("null")))))


def token(value: Column) -> Column:
    """A non-empty text without the separator and white space."""
    return _checked(value, value.rlike(r"^[^|\s]+$"), "token")


def choice(value: Column, names: tuple[str, ...]) -> Column:
    return _checked(value, value.isin(*names), "choice")


def index(value: Column) -> Column:
    """A whole number from 0 on, as text."""
    return _checked(value.cast("string"), value >= 0, "index")


def stream_id(stream: Column) -> Column:
    return token(stream)


def episode_id(stream: Column, condition: Column, channel: Column, size: Column) -> Column:
    return F.concat_ws("|", token(stream), token(condition), token(channel), F.concat(F.lit("K"), index(size)))


def window_id(stream: Column, condition: Column, channel: Column, size: Column, alarm: Column) -> Column:
    return F.concat_ws("|", episode_id(stream, condition, channel, size), F.concat(F.lit("a"), index(alarm)))


def run_id(stream: Column, condition: Column, channel: Column, size: Column, method: Column) -> Column:
    return F.concat_ws("|", episode_id(stream, condition, channel, size), choice(method, METHODS))


def cell_id(window: Column, bucket: Column, profile: Column) -> Column:
    return F.concat_ws("|", _checked(window, window.rlike(r"^[^|\s]+(\|[^|\s]+)+$"), "window"), F.concat(F.lit("b"), index(bucket)), choice(profile, PROFILES))
