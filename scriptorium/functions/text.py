"""Text and file-name functions as Column expressions. Null gives null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import is_social, let, replace_spaces, strip

# Character classes and patterns that decide names.
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
DASHES = r"[\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}\x{2212}]"
FORBIDDEN = r'[\\/*?:"<>|]'
NAME_LENGTH, LEAST_CUT = 40, 15
#: The second words are spelled as the counters' source spells them.
COUNTERS = r"(?iU)^\s*\d[\d.,]*\s*[kmb]?\+?\s*(?:views?|luợt\s*xem)\s*[·-]\s*\d[\d.,]*\s*[kmb]?\+?\s*(?:reactions?|luợt\s*thích)\s*-\s*"
UTF16_UNITS = 120


def _decompositions() -> tuple[str, str]:
    """Composed letters and their bases, from the Unicode tables: all of the Basic Multilingual Plane whose base is one character."""
    composed, base = ["đ", "Đ"], ["d", "D"]
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or unicodedata.category(c) == "Mn":
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if bare != c and len(bare) == 1 and ord(bare) < 0x10000:
            composed.append(c)
            base.append(bare)
    return "".join(composed), "".join(base)


COMPOSED, BASE = _decompositions()


def beyond_ascii(s: Column, change) -> Column:
    """``change(s)``, spared where all of ``s`` is ASCII and nothing can change."""
    return let(s, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), change(x)).otherwise(x))


def fold_marks(s: Column) -> Column:
    """Letters without diacritics, ``đ`` as ``d``."""
    return beyond_ascii(s, lambda x: F.regexp_replace(F.translate(x, COMPOSED, BASE), r"\p{Mn}", ""))


def shorten(s: Column, most: int = NAME_LENGTH) -> Column:
    """Trimmed; if longer than ``most`` cut there, back to the last blank if that is late enough, without closing punctuation."""
    def cut(name: Column) -> Column:
        # 0-based place of the last blank; -1 if there is none
        place = lambda c: F.when(F.contains(c, F.lit(" ")), F.length(c) - F.instr(F.reverse(c), " ")).otherwise(-1)
        back = let(F.substring(name, 1, most), lambda c: F.when(place(c) >= LEAST_CUT, F.left(c, place(c))).otherwise(c))
        return F.when(F.length(name) <= most, name).otherwise(F.regexp_replace(back, "[ .,_-]+$", ""))

    return let(strip(s), cut)


def single_spaced(s: Column) -> Column:
    return strip(replace_spaces(s, "{}+", " "))


def _plain(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, DASHES, "-"), EMOJI, "")


def file_name(s: Column) -> Column:
    """A short name for files: text before the first ``|`` or ``#``, folded, without emoji."""
    name = fold_marks(strip(F.regexp_extract(s, r"(?s)^([^|#]*)", 1)))
    name = F.regexp_replace(beyond_ascii(name, _plain), FORBIDDEN, "_")
    return shorten(single_spaced(name))


def representative_title(url: Column, title: Column, raw: Column | None = None) -> Column:
    """A social post's caption without its counters and page name; the raw text's first words if none is left."""
    def caption(t: Column) -> Column:
        own = strip(F.regexp_replace(t, COUNTERS, ""))
        return F.when(t.rlike(COUNTERS), let(own, lambda c: F.when(F.contains(c, F.lit(" - ")), strip(F.regexp_replace(c, r"(?s)^(.*) - .*$", "$1"))).otherwise(c))).otherwise(t)

    first = strip(F.array_join(F.slice(F.split(single_spaced(F.coalesce(raw, F.lit(""))), " "), 1, 12), " ")) if raw is not None else F.lit("")
    named = let(caption(title), lambda c: F.when(c != "", c).otherwise(let(first, lambda f: F.when(f != "", f).otherwise(title))))
    return F.when(is_social(url), named).otherwise(title)


def local_title(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return file_name(F.when(base.rlike(r"^\.+[^.]*$"), base).otherwise(F.regexp_replace(base, r"\.[^.]*$", "")))


def plain_markdown(s: Column) -> Column:
    """Short hyphens, no emoji, no runs of blanks."""
    return strip(F.regexp_replace(beyond_ascii(s, _plain), r"[ \t]{2,}", " "))


def custom_name(s: Column) -> Column:
    """A file name as entered, made safe and cut to 120 UTF-16 units; an empty one is an error."""
    name = F.regexp_replace(strip(s), r"(?i)\.mp[34]$", "")
    name = F.regexp_replace(single_spaced(F.regexp_replace(name, FORBIDDEN, "_")), r"\.+$", "")

    def fitting(n: Column) -> Column:
        # Characters beyond the Basic Multilingual Plane take two units: the longest prefix that fits.
        units = F.transform(F.sequence(F.lit(1), F.lit(UTF16_UNITS)), lambda k: F.struct((F.octet_length(F.encode(F.left(n, k), "UTF-16LE")) / 2).alias("units"), k.alias("k")))
        return F.left(n, F.array_max(F.transform(F.filter(units, lambda u: u["units"] <= UTF16_UNITS), lambda u: u["k"])))

    # No prefix of 120 units has more than 120 characters.
    return let(name, lambda n: F.when(n == "", F.raise_error(F.lit("a file name must not be empty"))).otherwise(let(F.left(n, F.lit(UTF16_UNITS)), fitting)))


def table_title(s: Column) -> Column:
    return F.translate(s, "|", "-")


def stem(number: Column, name: Column) -> Column:
    return F.concat(F.when(number < 0, number.cast("string")).otherwise(F.when(F.length(number.cast("string")) < 3, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))), F.lit("_"), file_name(name))


def wikilink(name: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("]]"))


def wikilink_target(cell: Column) -> Column:
    """Null if the cell has no link."""
    return F.nullif(F.regexp_extract(cell, r"\[\[(.+?)\]\]", 1), F.lit(""))


def duration(seconds: Column) -> Column:
    """Minutes and seconds; nothing known shows dashes."""
    whole = F.floor(seconds).cast("long")
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "  --  ").otherwise(F.format_string("%3d:%02d", F.floor(whole / 60), whole % 60))


REDACTED = "[REDACTED]"


def redact(s: Column, secrets: list[str] | tuple = ()) -> Column:
    """One line of at most 500 characters without secrets. Secrets are literals of the driver's plan: pass them only to local plans; ``secrets.redacted`` keeps them out of any."""
    out = single_spaced(s)
    for secret in filter(None, secrets):
        out = F.replace(out, F.lit(secret), F.lit(REDACTED))
    return without_keys(out)


def without_keys(s: Column) -> Column:
    """At most 500 characters, without the values of key parameters."""
    return F.left(F.regexp_replace(s, r"(?i)([?&](?:key|api[_-]?key)=)[^&\s]+", f"$1{REDACTED}"), F.lit(500))


def first_line(s: Column, most: int = 160) -> Column:
    return F.left(F.get(F.split(s, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), F.lit(0)), F.lit(most))


def title_template(limit: Column, default: int = 150) -> Column:
    """Output template with a byte bound on the title; bounds outside 80 to 180 fall back."""
    n = F.expr("NULL").cast("int") if limit is None else limit.try_cast("int")
    return F.format_string("%%(title).%dB.%%(ext)s", F.when(n.between(80, 180), n).otherwise(default))


def model_id(s: Column) -> Column:
    return F.regexp_replace(s, "^models/", "")


def config_key(s: Column) -> Column:
    return F.upper(F.translate(s, "-", "_"))


def number_or(s: Column, default: float) -> Column:
    """Float from a setting, blank or bad values give the default."""
    return F.coalesce(F.nullif(strip(s), F.lit("")).try_cast("double"), F.lit(float(default)))


def transcribe_prompt(title: Column) -> Column:
    return F.format_string("Transcribe all speech of the recording \"%s\" as plain text, in its own language, without comments.", title)


def refine_prompt(raw: Column) -> Column:
    """Bilingual summary: each half has a title, a three-sentence summary, lessons and quotes."""
    return F.format_string("Summarise the transcript in Vietnamese, then after a line with *** in English. Each half: a title, a summary of three sentences, a bulleted list of lessons, quotes.\n\n%s", raw)
