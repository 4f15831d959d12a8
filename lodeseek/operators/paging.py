"""Pages of an ordered result."""

from __future__ import annotations

from pyspark.sql import DataFrame

PAGE_SIZE, PAGE = 10, 1


class NotFound(LookupError):
    """A page beyond the last hit."""


def page_numbers(size: object, number: object) -> tuple[int, int]:
    """Size and number of a page. If either is no number both are reset; one that isn't positive is reset alone."""
    try:
        s, n = int(str(size)), int(str(number))
    except ValueError:
        return PAGE_SIZE, PAGE
    return (s if s > 0 else PAGE_SIZE), (n if n > 0 else PAGE)


def page(ordered: DataFrame, size: object = PAGE_SIZE, number: object = PAGE) -> DataFrame:
    """The rows of a page; none where it lies beyond the last hit. Ordered by a total order, it is a top-k, not a sort."""
    s, n = page_numbers(size, number)
    return ordered.offset(s * (n - 1)).limit(s)


def page_or_fail(ordered: DataFrame, total: int, size: object = PAGE_SIZE, number: object = PAGE) -> DataFrame:
    s, n = page_numbers(size, number)
    if s * (n - 1) >= total:
        raise NotFound(f"page {n} of {s} rows: there are {total}")
    return page(ordered, s, n)


def bounds(total: int, size: object = PAGE_SIZE, number: object = PAGE) -> tuple[int, int]:
    """First and last row (from 1) of a page of total rows; (0, 0) beyond them."""
    s, n = page_numbers(size, number)
    first = s * (n - 1)
    return (first + 1, min(first + s, total)) if first < total else (0, 0)
