"""Sanitizing, checking and cutting DNA strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandkit.functions import batches

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fail_unless(ok: Column, value: Column, message: str, on_error: str = "raise") -> Column:
    """The value where ok holds; elsewhere an error, or null if on_error is `null`."""
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")
    return F.when(ok, value) if on_error == "null" else F.when(ok, value).when(value.isNull(), value).otherwise(F.raise_error(F.lit(message)))


def sanitize_dna(seq: Column) -> Column:
    """Upper case of ASCII letters, and N for all that is not A, C, G, T or N. Keeps the length."""
    table = bytes(b & 0xDF if chr(b & 0xDF) in "ACGT" else ord("N") for b in range(256))
    return batches.translated(seq, table, bytes(range(0x80, 0xC0)))  # what follows the first byte of a character goes


def is_valid_dna(seq: Column) -> Column:
    """Whether a string has letters ACGTN in either case only, and at least one."""
    return seq.rlike(r"^[ACGTNacgtn]+\z")


def only_alphabet(seq: Column, letters: str = "ATCGN") -> Column:
    """Whether all characters are among the letters; true for an empty string."""
    return seq.rlike(rf"^[{letters}]*\z")


def strict_alphabet(seq: Column, letters: str = "ATCGN", on_error: str = "raise") -> Column:
    return fail_unless(only_alphabet(seq, letters), seq, "a character is not in the vocabulary", on_error)


def n_free(seq: Column) -> Column:
    return F.instr(seq, "N") == 0


def length_multiple_of(seq: Column, m: int) -> Column:
    return F.length(seq) % m == 0


def crop_to_multiple(seq: Column, m: int) -> Column:
    """Without the letters beyond the nearest lower multiple of m."""
    return F.substring(seq, 1, F.length(seq) - F.length(seq) % m)


def pad_n_to_multiple(seq: Column, m: int) -> Column:
    """With N appended up to the nearest upper multiple of m."""
    return F.rpad(seq, (F.ceil(F.length(seq) / m) * m).cast("int"), F.lit("N"))


def letters(seq: Column) -> Column:
    """The characters as an array; none for an empty string."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def one_hot(seq: Column) -> Column:
    """A unit vector over A, C, G, T for each letter; zeros for any other. The five vectors are constants."""
    unit = {x: F.array(*[F.lit(int(x == y)) for y in "ACGT"]) for x in "ACGTN"}
    return F.transform(letters(seq), lambda c: F.when(c == "A", unit["A"]).when(c == "C", unit["C"]).when(c == "G", unit["G"]).when(c == "T", unit["T"]).otherwise(unit["N"]))


def window_end(start: Column, n_tokens: int, k: int) -> Column:
    """End of a window of n_tokens tokens of k letters."""
    return start + n_tokens * k
