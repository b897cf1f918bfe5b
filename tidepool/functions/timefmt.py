"""Time text parsing and formatting as guarded Column expressions.

Each accepted layout is a (regex guard, Spark pattern) pair; a layout only
parses text its guard matches, so a bare ``12345`` is never read as a year.
``try_to_timestamp`` keeps invalid calendar values (Feb 30) null instead of
raising under ANSI mode. Results are UTC instants; the session is pinned to
UTC by :func:`tidepool.session.get_session`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"
RFC3339_OUT = "yyyy-MM-dd'T'HH:mm:ssXXX"

# Text layouts of the source system, named, with the regex that
# recognises each. Zone abbreviations (MST, EST, ...) carry no offset there
# when the host runs in UTC, so they read as UTC here.
LAYOUT_GUARDS = {
    "rfc3339": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$",
    "rfc3339nano": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$",
    "datetime_t": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?$",
    "datetime_space": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "us_date": r"^\d{2}/\d{2}/\d{4}$",
    "day_mon_year": r"^\d{2}-[A-Z][a-z]{2}-\d{4}$",
    "mon_day_year": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
    "rfc1123": r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}(\.\d{1,9})? [A-Z]{3,5}$",
    "rfc1123z": r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}(\.\d{1,9})? [+-]\d{4}$",
    "rfc822": r"^\d{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2} [A-Z]{3,5}$",
}

# Layout order of each parser.
STRICT_LAYOUTS = ("rfc3339", "rfc3339nano", "datetime_t", "datetime_space", "date", "rfc1123", "rfc1123z")
LENIENT_LAYOUTS = ("rfc3339", "rfc3339nano", "datetime_t", "datetime_space", "date")
EXPRESSION_LAYOUTS = (
    "rfc3339", "rfc3339nano", "datetime_t", "datetime_space", "date",
    "us_date", "day_mon_year", "mon_day_year", "rfc1123", "rfc822",
)


def _tts(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def _parse_one(s: Column, layout: str, wall_clock: bool) -> Column:
    if layout in ("rfc3339", "rfc3339nano"):
        if wall_clock:
            return _tts(F.concat(F.regexp_replace(s, r"(Z|[+-]\d{2}:\d{2})$", ""), F.lit("Z")), ISO_PATTERN)
        return _tts(s, ISO_PATTERN)
    if layout == "datetime_t":
        return _tts(F.concat(s, F.lit("Z")), ISO_PATTERN)
    if layout == "datetime_space":
        return _tts(F.concat(F.regexp_replace(s, " ", "T"), F.lit("Z")), ISO_PATTERN)
    if layout == "date":
        return _tts(F.concat(s, F.lit("T00:00:00Z")), ISO_PATTERN)
    if layout == "us_date":
        return _tts(F.concat(s, F.lit(" Z")), "MM/dd/yyyy XXX")
    if layout == "day_mon_year":
        return _tts(F.concat(s, F.lit(" Z")), "dd-MMM-yyyy XXX")
    if layout == "mon_day_year":
        return _tts(F.concat(s, F.lit(" Z")), "MMM d, yyyy XXX")
    if layout == "rfc1123":
        mid = F.regexp_replace(F.regexp_replace(s, r"^[A-Z][a-z]{2}, ", ""), r" [A-Z]{3,5}$", "")
        return _tts(F.concat(mid, F.lit(" Z")), "dd MMM yyyy HH:mm:ss[.SSSSSSSSS] XXX")
    if layout == "rfc1123z":
        mid = F.regexp_replace(s, r"^[A-Z][a-z]{2}, ", "")
        if wall_clock:
            mid = F.concat(F.regexp_replace(mid, r" [+-]\d{4}$", ""), F.lit(" +0000"))
        return _tts(mid, "dd MMM yyyy HH:mm:ss[.SSSSSSSSS] xx")
    if layout == "rfc822":
        # two-digit years: 69..99 -> 19xx, 00..68 -> 20xx
        yy = F.regexp_extract(s, r"^\d{2} [A-Z][a-z]{2} (\d{2})", 1)
        century = F.when(yy.cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
        dm = F.regexp_extract(s, r"^(\d{2} [A-Z][a-z]{2}) ", 1)
        hm = F.regexp_extract(s, r" (\d{2}:\d{2}) [A-Z]{3,5}$", 1)
        return _tts(F.concat_ws(" ", dm, F.concat(century, yy), hm, F.lit("Z")), "dd MMM yyyy HH:mm XXX")
    raise ValueError(f"unknown layout {layout!r}")


def parse_time(s: Column, layouts=STRICT_LAYOUTS, epoch_seconds: bool = True, wall_clock: bool = False) -> Column:
    """First layout whose guard matches and which parses; optional integer epoch seconds last.

    ``coalesce`` of guarded parses: each parse runs at most once per row and
    only when its regex guard matches. ``wall_clock=True`` drops any offset
    and keeps the written clock time, which is what formatting in the
    written zone needs.
    """
    tries = [F.when(s.rlike(LAYOUT_GUARDS[name]), _parse_one(s, name, wall_clock)) for name in layouts]
    if epoch_seconds:
        tries.append(F.timestamp_seconds(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))))
    return F.coalesce(*tries)


def rfc3339(ts: Column) -> Column:
    """RFC 3339 text in UTC (``Z`` suffix)."""
    return F.date_format(ts, RFC3339_OUT)


# Date-format tokens of the mapping language and their Spark pattern letters.
DATE_TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("mm", "mm"), ("ss", "ss"), ("SSS", "SSS"))


def translate_date_format(fmt: str) -> str:
    """Mapping-language date format -> Spark datetime pattern (other letters quoted)."""
    out = []
    i = 0
    literal = []

    def flush():
        if literal:
            out.append("'" + "".join(literal).replace("'", "''") + "'")
            literal.clear()

    while i < len(fmt):
        for tok, pat in DATE_TOKENS:
            if fmt.startswith(tok, i):
                flush()
                out.append(pat)
                i += len(tok)
                break
        else:
            ch = fmt[i]
            if ch.isalpha() or ch == "'":
                literal.append(ch)
            else:
                flush()
                out.append(ch)
            i += 1
    flush()
    return "".join(out)
