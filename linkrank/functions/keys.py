"""Entity-resolution rules: credit ladders and match keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkrank.functions.text import any_case, ascii_lower, cut_before

# Credit joiners, most specific first.
CREDIT_RUNGS = (" A Duet With ", " Duet With ", " Featuring ", " With ")

# Guest tails of a title, the first listed wins wherever it stands.
TITLE_TAILS = (" (feat.", " (with ")

# Characters deleted from a title, characters turned into a space,
# and words dropped from it.
DELETED_CHARS = "'’‘\"“”"
SPACED_CHARS = ",.!?()*:;/"
DROPPED_WORDS = ("a", "an", "the")


def primary_entity(col: Column, rungs=CREDIT_RUNGS) -> Column:
    """Lead name of a credit: cut before the first rung that occurs, else whole."""
    out = col
    for rung in reversed(rungs):
        out = F.when(F.contains(col, F.lit(rung)), cut_before(col, rung)).otherwise(out)
    return out


def title_cut_tail(col: Column, tails=TITLE_TAILS) -> Column:
    """Drop a guest tail, found without regard to ASCII case; the rest keeps its case."""
    out = col
    for tail in reversed(tails):
        out = F.when(col.rlike(any_case(tail)), cut_before(col, tail, ignore_case=True)).otherwise(out)
    return out


def title_cut_dash(col: Column, dash: str = " - ") -> Column:
    return cut_before(col, dash)


def fold_title(col: Column) -> Column:
    """Lower, strip punctuation and articles; one pass, no repeated collapsing."""
    folded = F.translate(
        F.lower(col), SPACED_CHARS + DELETED_CHARS, " " * len(SPACED_CHARS)
    )
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    swept = [(f" {word} ", " ") for word in DROPPED_WORDS] + [("  ", " ")]
    return F.trim(reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), swept, padded))


def artist_key(col: Column, ascii_only: bool = False) -> Column:
    return ascii_lower(col) if ascii_only else F.lower(col)


def match_key(col: Column, level: int = 3) -> Column:
    """Title key. 0: lower; 1: + guest tails and trim; 2: + dash tail; 3: + punctuation."""
    if level == 0:
        return F.lower(col)
    cut = title_cut_tail(col)
    if level == 1:
        return F.lower(F.trim(cut))
    cut = title_cut_dash(cut)
    if level == 2:
        return F.lower(F.trim(cut))
    return fold_title(cut)


def song_key(col: Column, level: int = 3) -> Column:
    """Key of the archive side, whose titles carry no tails: only level 3 changes it."""
    return fold_title(col) if level >= 3 else F.lower(col)
