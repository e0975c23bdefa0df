"""Small formats: waits, durations, efforts, brands, search phrases, objects in model output."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds of a Retry-After header: seconds, or an HTTP date after ``now``; 0 if neither."""
    seconds = F.trim(header).try_cast("double")
    when = F.try_to_timestamp(F.regexp_extract(header, r"^\w+, (\d+ \w+ \d+ [\d:]+) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(when) - F.unix_micros(now.cast("timestamp"))) / 1000.0
    return F.greatest(F.coalesce(seconds * 1000, until, F.lit(0.0)), F.lit(0.0)).cast("long")


def duration(ms: Column) -> Column:
    """'1.2s' from a second on, '120ms' below, '–' for null."""
    return F.when(ms.isNull(), "–").when(ms >= 1000, F.concat(F.format_number(ms / 1000, 1), F.lit("s"))).otherwise(F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))


def copy_minutes(affected: Column) -> Column:
    """Minutes of writing for affected pages: one and a half each, fifteen at least."""
    return F.greatest(F.lit(15), F.floor(F.greatest(affected, F.lit(1)) * 1.5 + 0.5)).cast("int")


def json_object(text: Column) -> Column:
    """The object in a text, from its first brace to its last, as VARIANT; null if it does not parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def strip_emoji(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", ""))


def no_numeric_claims(text: Column) -> Column:
    """Text with promised percentages and multiples blanked out."""
    return F.regexp_replace(text, r"[+\-~≈]?\d[\d,.]*\s*(%|เท่า|x\b)(\s*[-–]\s*\d[\d,.]*\s*(%|เท่า|x\b))?", "–")


def search_phrases(title: str | None, description: str | None, h1: str | None, hostname: str) -> list[str]:
    """Up to three phrases to search a site's competitors by, without words of its own brand."""
    core = re.sub(r"^www\.", "", hostname).split(".")[0]

    def own(word: str) -> bool:
        t = re.sub(r"[^a-z0-9ก-๛]", "", word.lower())
        return len(t) > 2 and (core.find(t) >= 0 or (len(t) > 4 and core.find(t[:-1]) >= 0))

    def words(text: str | None) -> list[str]:
        kept = " ".join(w for w in (text or "").split() if not own(w))
        return re.sub(r"[|–—:]+", " ", kept).split()

    segments = [s for s in re.split(r"[,|•;]", description or "") if not any(map(own, s.split()))]
    segments = [" ".join(words(re.sub(r"^[^:]{0,20}:", "", s))) for s in segments]
    segments = [s for s in segments if len(s) > 5]
    found = [" ".join(" ".join(segments[:3]).split()[:9])] if len(segments) >= 2 else []
    for text, least, most in ((h1, 8, 8), (title, 8, 8), (description, 15, 10)):
        w = words(text)
        if len(" ".join(w)) > least:
            found.append(" ".join(w[:most]))
    return list(dict.fromkeys(found))[:3]
