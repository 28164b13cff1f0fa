"""Text columns: ids and times written into comments, codes and notes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_id_from_comment(comment: Column, width: int = 7) -> Column:
    """The order id an agent typed into a comment, or null.

    Plain digits are the id itself. Otherwise the id follows a leading ``m``,
    or a ``#`` in comments that start with ``m`` or ``o``.
    """
    low = F.lower(comment)
    squeezed = F.replace(comment, F.lit(" "), F.lit(""))
    hash_at = F.instr(squeezed, "#")
    after_hash = F.when(hash_at > 0, F.substring(squeezed, hash_at + 1, F.lit(width)))
    digits_only = ~comment.rlike("\\D")
    text = (F.when(digits_only, comment)
            .when(low.like("m%") & (hash_at == 0), F.substring(squeezed, 2, width))
            .when(low.like("m%") | low.like("o%"), after_hash))
    return text.try_cast("long")


def delimited_id(text: Column, mark: str = "|") -> Column:
    """The number before the first `mark`; null without a mark or a leading digit."""
    has = (F.instr(text, mark) > 0) & text.rlike("^[0-9]")
    return F.when(has, F.split_part(text, F.lit(mark), F.lit(1))).try_cast("long")


def pad_code(code: Column, width: int = 6) -> Column:
    """Left-pad with zeros; codes over the width become null, not cut."""
    return F.when(F.length(code) <= width, F.lpad(code, width, "0"))


def note_action(note: Column) -> Column:
    """The part of a note up to and including its first colon."""
    return F.substring(note, F.lit(1), F.instr(note, ":"))


def note_time(note: Column, marker: str, year: int, lead: int = 14) -> Column:
    """The ``MM-dd HH:mm`` written `lead` characters before a marker word."""
    at = F.instr(note, marker)
    stamp = F.substring(note, at - F.lit(lead), F.lit(11))
    text = F.concat(F.lit(f"{year}-"), stamp, F.lit(":00"))
    return F.when(at > lead, text).try_cast("timestamp_ntz")
