"""Error classes, retry arithmetic and settings as Column expressions. Null messages are no error: predicates give false."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import is_video_host, strip

# Substrings of lower-cased messages that decide a class.
PERMANENT = ("private video", "removed by the uploader", "account associated with this video has been terminated", "members-only")
TRANSIENT = ("503", "unavailable", "high demand", "overloaded", "service unavailable")
QUOTA = ("429", "resource_exhausted", "quota", "rate limit", "too many requests")
NO_MODEL = ("404", "not found", "not supported")
CLIENTS = ("default", "android", "ios", "mweb", "tv")
RETRY_DELAY = r"""(?i)retry[_ ]?delay['"]?\s*[:=]\s*['"]?(\d+(?:\.\d+)?)s"""
KEY_NAME = r"^GEMINI_API_KEY(_.*)?$"
MODEL_NAME = r"^[A-Za-z0-9._/-]+$"
COOLDOWN, BACKOFF_BASE, BACKOFF_MAX = 60.0, 3.0, 30.0


def _says(message: Column, words: tuple) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(map(re.escape, words)).replace(r"\ ", " ")), F.lit(False))


def is_permanent(message: Column) -> Column:
    return _says(message, PERMANENT)


def is_no_model(message: Column) -> Column:
    return _says(message, NO_MODEL) & _says(message, ("model",))


def is_transient(message: Column) -> Column:
    return _says(message, TRANSIENT)


def is_quota(message: Column) -> Column:
    return _says(message, QUOTA)


def classify(message: Column, tier: Column) -> Column:
    """ok, no_model, transient, quota or other; paid keys only know no_model and other."""
    free = tier == "free"
    return F.when(message.isNull(), "ok").when(is_no_model(message), "no_model").when(free & is_transient(message), "transient").when(free & is_quota(message), "quota").otherwise("other")


def is_yes(value: Column, other: Column) -> Column:
    """``yes`` in any case; the other setting counts only if the first is empty."""
    return F.coalesce(F.lower(strip(F.coalesce(F.nullif(value, F.lit("")), other))) == "yes", F.lit(False))


def retry_delay(message: Column) -> Column:
    """Seconds that the message asks to wait; null if it names none."""
    return F.nullif(F.regexp_extract(message, RETRY_DELAY, 1), F.lit("")).try_cast("double")


def cooldown(message: Column, default: float = COOLDOWN) -> Column:
    return F.coalesce(retry_delay(message), F.lit(default))


def wait_before_call(now: Column, rest_until: Column, last_call: Column, interval: Column) -> Column:
    return F.greatest(F.lit(0.0), rest_until - now, last_call + interval - now)


def backoff(attempt: Column, base: float = BACKOFF_BASE, most: float = BACKOFF_MAX, attempts: int = 3) -> Column:
    """Null if no attempt is left."""
    return F.when(attempt + 1 < attempts, F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt)))


def max_height(value: Column) -> Column:
    return F.when(strip(value).isin("720", "1080"), strip(value).cast("int")).otherwise(1080)


def clients(url: Column, preferred: Column | None = None, cookies: bool = False) -> Column:
    """Clients to try in order, the preferred one first if it is among them."""
    every = F.array(*map(F.lit, CLIENTS + (("cookies",) if cookies else ())))
    own = F.when(is_video_host(url), every).otherwise(F.array(F.lit(CLIENTS[0])))
    if preferred is None:
        return own
    return F.when(F.array_contains(own, F.coalesce(preferred, F.lit(""))), F.concat(F.array(preferred), F.array_remove(own, preferred))).otherwise(own)


def supports_generate(actions: Column) -> Column:
    return F.coalesce(F.exists(actions, lambda a: F.lower(a) == "generatecontent"), F.lit(False))


def format_rank(height: Column, width: Column, has_video: Column, has_audio: Column, most: int) -> Column:
    """Place in the fallback chain of formats, smaller is better; null if the format is none of it."""
    muxed = has_video & has_audio
    low, narrow = F.coalesce(height <= most, F.lit(False)), F.coalesce(width <= most, F.lit(False))
    return F.when(has_video & ~has_audio & low, 1).when(muxed & low, 2).when(has_video & ~has_audio & narrow, 3).when(muxed & narrow, 4).when(muxed, 5)
