"""Text columns: digits of other scripts, dates in two calendars, names of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadtide.functions.calendar import from_jalali

# Persian and Arabic digits and separators, and what stands for them.
FOREIGN = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩٫٬،"
PLAIN = "01234567890123456789.,,"
PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
EVENT_WORDS = ("holiday", "event", "vacation", "festival")
PRICE_WORDS = ("price", "rate", "fare", "cost", "tariff")


def plain_digits(col: str | Column) -> Column:
    """Digits and separators of other scripts as ASCII, without zero-width signs and outer blanks."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.translate(col, FOREIGN, PLAIN), "[​-‏﻿]", ""))


def looks_like_date(col: str | Column) -> Column:
    return plain_digits(col).rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")


def year_of(col: str | Column) -> Column:
    return F.regexp_extract(plain_digits(col), r"^(\d{4})", 1).try_cast("int")


def is_jalali(col: str | Column) -> Column:
    """Whether a text begins with a year that only the Jalali calendar has nowadays."""
    return F.coalesce(year_of(col).between(1300, 1499), F.lit(False))


def jalali_share(col: str) -> Column:
    """An aggregate: the share of texts with a year that have a Jalali one."""
    known = year_of(col).isNotNull()
    return F.avg(F.when(known, is_jalali(col).cast("double")))


def lenient_date(col: str | Column) -> Column:
    """A date from a text in either calendar and any of the known patterns; null if none fits."""
    text = plain_digits(col)
    part = lambda i: F.regexp_extract(text, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", i).try_cast("int")
    month, day = part(2), part(3)
    jalali = F.when(month.between(1, 12) & day.between(1, 31), from_jalali(part(1), month, day))
    known = F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(p))) for p in PATTERNS))
    return F.when(is_jalali(col), jalali).otherwise(known)


def column_name(name: str) -> str:
    """Lower case, words joined by underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z؀-ۿ]+", "_", name.strip().lower())).strip("_")


def is_event_like(name: str) -> bool:
    return any(w in name.lower() for w in EVENT_WORDS)


def is_price_like(name: str) -> bool:
    return any(w in name.lower() for w in PRICE_WORDS)


# Words by which columns are known for their roles.
ROLES = {
    "timestamp": ("date", "ds", "ts", "day", "time", "timestamp", "checkin", "تاریخ"),
    "entity_id": ("listing", "entity", "city", "store", "item", "product", "code", "key", "id"),
    "target": ("bookings", "demand", "count", "quantity", "sales", "y", "searches", "totalprice", "value"),
    "category": ("category", "type", "status", "priority", "segment", "flag", "kind", "class"),
    "price": PRICE_WORDS,
    "event": EVENT_WORDS,
}


def role_scores(columns: list[str]) -> dict[str, list[tuple[str, float]]]:
    """For each role the columns that may have it, best first: whole words count more than parts of words."""
    out = {}
    for role, words in ROLES.items():
        scored = []
        for c in columns:
            tokens = column_name(c).split("_")
            score = max((1.0 if w in tokens else 0.4 if len(w) > 2 and w in column_name(c) else 0.0) for w in words)
            if score:
                scored.append((c, score))
        out[role] = sorted(scored, key=lambda x: (-x[1], columns.index(x[0])))
    return out
