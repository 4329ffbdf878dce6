"""Column functions on byte strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latin(content: Column) -> Column:
    """One character for each byte, so that string functions work at byte positions."""
    return F.decode(content, "ISO-8859-1")


def octets(text: Column) -> Column:
    """The UTF-8 bytes of a string."""
    return F.encode(text, "UTF-8")


def around(content: Column, offset: Column, length: Column | int, before: int, after: int) -> Column:
    """The bytes of a hit with ``before`` bytes in front of it and ``after`` behind it, cut at the document's ends."""
    length = F.lit(length) if isinstance(length, int) else length
    first = F.greatest(offset - before, F.lit(0))
    return F.substring(content, (first + 1).cast("int"), (offset - first + length + after).cast("int"))


def reverse_complement(sequence: Column) -> Column:
    """Of a DNA sequence in upper case; other letters are only reversed."""
    return F.reverse(F.translate(sequence, "ACGT", "TGCA"))


def sha1_of(content: Column) -> Column:
    return F.sha1(content)


def sha256_of(content: Column) -> Column:
    return F.sha2(content, 256)
