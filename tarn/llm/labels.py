"""Language labels as delivered, and the language they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other spellings of some languages (ISO 639-2 B and T, English and own names). An alias
# table and no list of the languages known: a label it lacks stands for itself.
SPELLINGS = {
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ru": ("rus", "russian", "русский"),
}
# Labels that say that the language isn't known (ISO 639-2 special codes and usual words).
NAMELESS = ("und", "mul", "mis", "zxx", "xx", "xxx", "unknown", "undefined", "undetermined", "none", "null", "na", "n/a", "other")
MIN_SHARE = 0.001  # of the labelled rows; a label with fewer isn't learned, so there are 1 / MIN_SHARE languages at most


def named_language(label: Column | str) -> Column:
    """The language a label names, by its part before - or _; null where it names none."""
    col = F.col(label) if isinstance(label, str) else label
    base = F.lower(F.regexp_extract(F.trim(col), r"^([^\-_]*)", 1))
    spelled = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)])
    return F.when(base.rlike(r"^\p{L}{2,}$") & ~base.isin(*NAMELESS), F.coalesce(F.try_element_at(spelled, base), base))


def languages_of(rows: DataFrame, label: str = "lang", min_share: float = MIN_SHARE) -> list[str]:
    """The languages that at least `min_share` of the labelled rows name, in order."""
    counts = rows.select(named_language(label).alias("lang")).where("lang is not null").groupBy("lang").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return sorted(r["lang"] for r in counts.where(F.col("count") >= min_share * total).select("lang").collect())
