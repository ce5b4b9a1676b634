"""Risk-level vocabularies as column expressions.

Two vocabularies exist side by side and are never merged silently: three
tiers (LOW, MEDIUM, HIGH) and four tiers (LOW, MODERATE, HIGH, VERY_HIGH).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scarpline.functions.text import strip

# Ranks and cut points.
RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
SCORE_CUTS = ((40.0, "LOW"), (70.0, "MEDIUM"))
PROBABILITY_CUTS = ((0.75, "VERY_HIGH"), (0.55, "HIGH"), (0.35, "MODERATE"))
CONFIDENCE_CUTS = ((0.80, "HIGH CONFIDENCE"), (0.60, "MODERATE CONFIDENCE"))


def choose(pairs, default) -> Column:
    """First matching (condition, value) pair, else the default."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def score_level(score: Column, middle: str = "MEDIUM") -> Column:
    """0..100 score to three tiers; NULL outside the range."""
    low, mid = SCORE_CUTS[0][0], SCORE_CUTS[1][0]
    level = F.when(score < low, "LOW").when(score < mid, middle).otherwise("HIGH")
    return F.when(score.between(0, 100), level)


def open_score_level(score: Column) -> Column:
    """The same cut without the range check."""
    return F.when(score >= SCORE_CUTS[1][0], "HIGH").when(score >= SCORE_CUTS[0][0], "MEDIUM").when(score.isNotNull(), "LOW")


def probability_level(p: Column) -> Column:
    tiers = choose([(p >= cut, name) for cut, name in PROBABILITY_CUTS], "LOW")
    return F.when(p.isNotNull(), tiers)


def normal_level(level: Column) -> Column:
    """Trim, upper-case and read MODERATE as MEDIUM; NULL when invalid."""
    text = F.upper(strip(level.cast("string")))
    text = F.when(text == "MODERATE", "MEDIUM").otherwise(text)
    return F.when(text.isin(*RANKS), text)


def mixed_level(text: Column, score: Column) -> Column:
    """A text level (no trim, no MODERATE) or else a numeric score."""
    upper = F.upper(text)
    return F.coalesce(F.when(upper.isin(*RANKS), upper), F.when(text.isNull(), open_score_level(score)))


def rank(level: Column) -> Column:
    return F.when(level == "LOW", 1).when(level == "MEDIUM", 2).when(level == "HIGH", 3)


def level_of_rank(r: Column) -> Column:
    return F.when(r == 1, "LOW").when(r == 2, "MEDIUM").when(r == 3, "HIGH")


def highest(*levels: Column) -> Column:
    """The highest of three-tier levels; NULL when any of them is invalid."""
    ranks = [rank(level) for level in levels]
    valid = ranks[0].isNotNull()
    for r in ranks[1:]:
        valid = valid & r.isNotNull()
    top = ranks[0] if len(ranks) == 1 else F.greatest(*ranks)
    return F.when(valid, level_of_rank(top))


def require(c: Column, message: str) -> Column:
    """Raise inside the job when an expression that must be present is NULL."""
    return F.coalesce(c, F.raise_error(F.lit(message)).cast("string"))
