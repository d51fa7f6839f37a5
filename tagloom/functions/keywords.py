"""Keyword matches and the weak label made from them."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds that are compared, and the one kept for the base set.
SWEEP_THRESHOLDS = (0.01, 0.05, 0.1, 0.25)
BASE_THRESHOLD = 0.05


def keyword_pattern(keywords: list[str], ignore_case: bool = False) -> str:
    """One pattern for all keywords as whole words; longer keywords win over their own prefixes."""
    words = sorted({word for word in keywords if word}, key=lambda word: (-len(word), word))
    if not words:
        raise ValueError("the keyword list is empty")
    flags = "(?iU)" if ignore_case else "(?U)"
    return rf"{flags}\b(?:{'|'.join(re.escape(word) for word in words)})\b"


def keyword_matches(text: Column, keywords: list[str], ignore_case: bool = False) -> Column:
    """All matches from left to right, without overlaps."""
    return F.regexp_extract_all(text, F.lit(keyword_pattern(keywords, ignore_case)), F.lit(0))


def token_count(text: Column) -> Column:
    """Pieces between single spaces: the number of spaces plus one, so empty text has one."""
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return spaces + 1


def keyword_density(matches: Column, text: Column) -> Column:
    """Matches per token."""
    return F.size(matches) / token_count(text)


def weak_label(density: Column, threshold: float = BASE_THRESHOLD) -> Column:
    """1 where the density is strictly above the threshold, else 0 (also for NULL)."""
    return F.when(density > F.lit(float(threshold)), 1).otherwise(0)
