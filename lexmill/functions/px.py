"""Regular-expression positions as DataFrame expressions.

For a pattern whose matches are not empty, ``regexp_extract_all`` gives the matches and ``split`` the gaps between them, so
one running sum of their lengths gives every match's start, in code points, without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,surface:string>>"
#: A character that texts hardly ever hold.
MARK = "\u0001"


def gaps_of(text: Column, pattern: str) -> Column:
    """What ``split`` gives for a pattern without empty matches. ``split`` compiles its pattern for every row, unless it is one
    plain character: so matches become that character first, in all texts that do not hold it themselves."""
    return F.when(text.contains(MARK), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK)), MARK, -1))


def positions(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches as an array of (start, surface); for ``group`` > 0 the text before it within the match must be group - 1.

    The sum is one fold over the matches. Each gap and match is read by its index, so the fold is linear but for the
    growth of its result, which stays short for the rules here; texts without a match leave at once.
    """
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps_of(text, pattern)
    start = F.struct(F.lit(0).alias("o"), F.array().cast(FOUND).alias("r"))
    if group:
        matches = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group - 1)).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), gaps.alias("gap"))
        skip, surface = (lambda x: F.length(x["p"])), (lambda x: x["g"])
    else:
        matches = F.arrays_zip(whole.alias("m"), gaps.alias("gap"))
        skip, surface = (lambda x: F.lit(0)), (lambda x: x["m"])

    def step(a, x):
        at = a["o"] + F.length(x["gap"])
        hit = F.struct((at + skip(x)).alias("start"), surface(x).alias("surface"))
        return F.struct((at + F.coalesce(F.length(x["m"]), F.lit(0))).alias("o"), F.when(x["m"].isNull(), a["r"]).otherwise(F.array_append(a["r"], hit)).alias("r"))

    return F.when(text.rlike(pattern), F.aggregate(matches, start, step, lambda a: a["r"])).otherwise(F.array().cast(FOUND))


def literal_positions(text: Column, word: Column) -> Column:
    """The places of a word, which may differ by row, as (start, surface), from left to right and not overlapping."""
    gaps = F.when(text.contains(MARK), F.split(text, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1)).otherwise(F.split(F.replace(text, word, F.lit(MARK)), MARK, -1))
    start = F.struct(F.lit(0).alias("o"), F.array().cast(FOUND).alias("r"))

    def step(a, gap):
        at = a["o"] + F.length(gap)
        return F.struct((at + F.length(word)).alias("o"), F.array_append(a["r"], F.struct(at.alias("start"), word.alias("surface"))).alias("r"))

    return F.when(text.contains(word) & (word != ""), F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), start, step, lambda a: a["r"])).otherwise(F.array().cast(FOUND))
