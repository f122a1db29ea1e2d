"""Text expressions: masking of personal data, normal forms, token estimates. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.settings import DEFAULTS, Settings

# What counts as personal data, and the order in which it is masked. Digits are Unicode digits.
ID_CARD = r"(?U)(?<!\d)\d{17}[\dXx](?!\d)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
BANK_CARD = r"(?U)(?<!\d)\d{16,19}(?!\d)"
MOBILE = r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)"
MASKS = ((ID_CARD, "[身份证]"), (EMAIL, "[邮箱]"), (BANK_CARD, "[卡号]"), (MOBILE, "[手机号]"))
# Characters that evidence is compared without, and the CJK ranges of the token estimate.
EVIDENCE_IGNORED = r"(?U)[\s\[\]【】（）()“”\"'‘’「」《》<>，。、；：！？,.;:!?…·~～-]"
CJK = r"[　-〿㐀-鿿＀-￯]"
HAN = r"[一-鿿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; a plain column would be computed anew at each name."""
    return F.transform(F.array(value), body)[0]


def mask_pii(text: Column) -> Column:
    """What counts as personal data is masked. It has eleven digits in a row or an @; other texts are not searched further."""
    masked = text
    for pattern, mask in MASKS:
        masked = F.regexp_replace(masked, pattern, mask)
    return F.when(F.contains(text, F.lit("@")) | text.rlike(r"(?U)\d{11}"), masked).otherwise(text)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as single spaces, none at the ends. Single spaces, the usual case, are not replaced by themselves."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def evidence_key(text: Column) -> Column:
    return F.regexp_replace(text, EVIDENCE_IGNORED, "")


def is_evidenced(evidence: Column, source: Column) -> Column:
    """Evidence has a key, and the key is part of the source's key."""
    key = evidence_key(F.coalesce(evidence, F.lit("")))
    return (key != "") & F.contains(evidence_key(F.coalesce(source, F.lit(""))), key)


def estimate_tokens(text: Column, s: Settings = DEFAULTS) -> Column:
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    return F.ceil(F.round(cjk * s.tokens_per_cjk + (F.length(text) - cjk) * s.tokens_per_other, 6)).cast("long")


def clip_line(text: Column, limit: int = DEFAULTS.line_chars) -> Column:
    """At most ``limit`` code points, with an ellipsis where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-cased words between white space, in order."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def business_tokens(words: Column, stopwords: Column | None = None, han: bool = True) -> Column:
    """Words of two or more characters that are no stop words and, if ``han``, have a Han character."""
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & (w.rlike(HAN) if han else F.lit(True)))
    return kept if stopwords is None else F.filter(kept, lambda w: ~F.array_contains(stopwords, w))


def json_object(text: Column) -> Column:
    """From the first brace to the last, as model answers often wrap their JSON."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def period_label(day: Column) -> Column:
    part = F.when(F.dayofmonth(day) <= 10, "上旬").when(F.dayofmonth(day) <= 20, "中旬").otherwise("下旬")
    return F.concat(F.month(day).cast("string"), F.lit("月"), part)


def window_label(days: int) -> str:
    return "近1个月" if days == 30 else f"近{days}天"


# Fixed value: the units that make a number a quantity.
QUANTITY = r"(?<!\d)\d++(?:\.\d++)?+\s*+(?:%|％|万|元|亿)"  # a digit after digits, or fewer of them, would meet the same end


def numbers_in(text: Column) -> Column:
    """Quantities with a unit, without white space."""
    found = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0))
    return F.transform(found, without_space)
