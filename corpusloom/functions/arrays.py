"""Array columns: truncation, padding, masks, positions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100  # label value excluded from every loss


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; a lambda would otherwise evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _col(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def repeat(fill: Column | int | float, count: Column | int) -> Column:
    return F.array_repeat(_col(fill), F.greatest(_col(count), F.lit(0)).cast("int"))


def head(ids: Column, n: Column | int) -> Column:
    return F.slice(ids, F.lit(1), _col(n).cast("int"))


def tail(ids: Column, n: Column | int) -> Column:
    n = _col(n).cast("int")
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)


def truncate_ids(ids: Column, n: Column | int, side: str = "head") -> Column:
    """Keep the first (``head``) or last (``tail``) ``n`` ids."""
    if side not in ("head", "tail"):
        raise ValueError(f"side must be 'head' or 'tail', not {side!r}")
    return head(ids, n) if side == "head" else tail(ids, n)


def reserve_response(ids: Column, max_length: int, max_prompt_length: int) -> Column:
    """Cap response ids at the room left beside a full prompt."""
    return head(ids, max_length - max_prompt_length)


def pad_right(ids: Column, n: Column | int, fill: Column | int | float) -> Column:
    return F.concat(ids, repeat(fill, _col(n) - F.size(ids)))


def pad_left(ids: Column, n: Column | int, fill: Column | int | float) -> Column:
    return F.concat(repeat(fill, _col(n) - F.size(ids)), ids)


def left_mask(ids: Column, n: Column | int) -> Column:
    """1 where a left-padded row of length ``n`` holds a real id."""
    return F.concat(repeat(0, _col(n) - F.size(ids)), repeat(1, F.size(ids)))


def not_equal_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def running_count(mask: Column) -> Column:
    """Inclusive running sum of an int array: one pass over the numbers of a batch, linear in their count."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(pc.fill_null(rows.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        inside = sums[1:] - np.repeat(sums[ends - sizes], sizes)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(inside.astype(np.int32)), mask=rows.is_null())

    return run(mask)


def position_ids(mask: Column) -> Column:
    """Running count of the mask minus one, zero on padding."""
    return F.zip_with(running_count(mask), mask, lambda c, m: (c - 1) * m)


def remaining_length(mask: Column) -> Column:
    """Masked elements from each position to the end."""
    return F.reverse(running_count(F.reverse(mask)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
