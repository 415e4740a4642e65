"""Fingerprints of page texts, their similarity, and the words for a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery import fixed


def fingerprint(text: Column) -> Column:
    """preview, dates, providers, terms and full text of a page."""
    full = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    lists = {name: F.array_distinct(F.regexp_extract_all(full, F.lit(pattern), F.lit(0))) for name, pattern in (("dates", fixed.PAGE_DATES), ("providers", fixed.PAGE_PROVIDERS), ("terms", fixed.PAGE_TERMS))}
    return F.struct(F.substring(full, 1, fixed.PREVIEW_CHARS).alias("preview"), *[v.alias(k) for k, v in lists.items()], full.alias("full"))


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct words; 0 if either has none."""
    x, y = (F.filter(F.split(t, r"\s+"), lambda w: w != "") for t in (a, b))

    def share(p: Column) -> Column:
        return F.when((F.size(p["x"]) > 0) & (F.size(p["y"]) > 0), F.size(F.array_intersect(p["x"], p["y"])) / F.size(F.array_union(p["x"], p["y"]))).otherwise(0.0)

    # bound once, for every use would split the texts again
    return F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), share), 0)


def _shared(a: Column, b: Column, weight: float) -> Column:
    """Common part over the longer list, weighted; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) * weight)


def similarity(a: Column, b: Column) -> Column:
    """Mean of the weighted parts that are present; it may exceed 1."""
    w = fixed.WEIGHTS
    parts = F.array_compact(
        F.array(
            _shared(a["dates"], b["dates"], w["dates"]),
            _shared(a["providers"], b["providers"], w["providers"]),
            word_overlap(a["preview"], b["preview"]) * w["preview"],
            _shared(a["terms"], b["terms"], w["terms"]),
            word_overlap(F.substring(a["full"], 1, fixed.FULL_CHARS), F.substring(b["full"], 1, fixed.FULL_CHARS)) * w["full"],
        )
    )
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)


def report_confidence(score: Column) -> Column:
    """STRONG, LIKELY or WEAK with a percentage, else NO MATCH."""
    percent = F.format_string(" (%d%%)", F.round(score * 100).cast("long"))
    out = None
    for least, word in fixed.REPORT_CONFIDENCE:
        text = F.concat(F.lit(word), percent)
        out = F.when(score > least, text) if out is None else out.when(score > least, text)
    return out.otherwise(fixed.NO_MATCH)


def pair_confidence(score: Column) -> Column:
    out = None
    for least, word in fixed.PAIR_CONFIDENCE:
        out = F.when(score > least, word) if out is None else out.when(score > least, word)
    return out.otherwise(fixed.PAIR_OTHERWISE)


def action(status: Column, confidence: Column, page: Column) -> Column:
    """What to do about a report row."""
    strength = F.regexp_extract(confidence, r"^(STRONG|LIKELY|WEAK)", 1)
    other = F.when(status == "YOURS ONLY", "THEIR").otherwise("YOUR")
    check = F.concat(F.lit("CHECK "), other, F.lit(" PAGE "), page.cast("string"))
    missing = F.when(status == "YOURS ONLY", "MISSING FROM VENDOR").otherwise("MISSING FROM YOURS")
    return F.when(~status.isin("YOURS ONLY", "THEIRS ONLY"), "DATE DISCREPANCY").when(strength == "STRONG", F.concat(F.lit("VERIFY MATCH - "), check)).when(strength != "", check).otherwise(missing)
