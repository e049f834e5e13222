"""Label codes, one-hot rows and token id arrays as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 13 news categories in code order 0-12.
CATEGORIES = (
    "Cong nghe", "Doi song", "Giai tri", "Giao duc", "Khoa hoc", "Kinh te", "Nha dat",
    "Phap luat", "The gioi", "The thao", "Van hoa", "Xa hoi", "Xe co",
)

# Reserved token ids and the code of an unknown label.
START_ID, PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
UNKNOWN_LABEL = -1


def label_encode(label: Column, classes: Sequence[str] = CATEGORIES) -> Column:
    """Code of a label name; unknown or null gives -1."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(position > 0, (position - 1).cast("int")).otherwise(F.lit(UNKNOWN_LABEL))


def label_decode(code: Column, classes: Sequence[str] = CATEGORIES, strict: bool = False) -> Column:
    """Name of a label code; an unknown code is null, or an error when ``strict``."""
    names = F.array(*[F.lit(c) for c in classes])
    name = F.when(code.between(0, len(classes) - 1), F.get(names, code))
    if strict:
        return F.coalesce(name, F.raise_error(F.concat(F.lit("unknown label code "), code.cast("string"))).cast("string"))
    return name


def one_hot(label: Column, classes: Sequence[str] = CATEGORIES) -> Column:
    """0/1 array over one global class list sorted by name, so no split can shift columns."""
    ordered = F.array(*[F.lit(c) for c in sorted(classes)])
    return F.transform(ordered, lambda c: F.coalesce((c == label).cast("int"), F.lit(0)))


def first_max(values: Column) -> Column:
    """0-based index of the first maximum; null for an empty or null array."""
    position = F.array_position(values, F.array_max(values))
    return F.when(position > 0, (position - 1).cast("int"))


def fixed_length_ids(ids: Column, length: int) -> Column:
    """Start + ids + end, truncated so that the end token stays, padded to ``length``."""
    framed = F.concat(F.array(F.lit(START_ID)), F.slice(ids, 1, length - 2), F.array(F.lit(END_ID)))
    return pad_ids(framed, length)


def hard_cut_ids(ids: Column, length: int) -> Column:
    """Start + ids + end, then cut at ``length`` (a long text loses its end token)."""
    framed = F.concat(F.array(F.lit(START_ID)), ids, F.array(F.lit(END_ID)))
    return pad_ids(F.slice(framed, 1, length), length)


def pad_ids(ids: Column, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def attention_mask(ids: Column) -> Column:
    """0 where the id equals the padding id, else 1."""
    return F.transform(ids, lambda x: F.when(x == PAD_ID, 0).otherwise(1))
