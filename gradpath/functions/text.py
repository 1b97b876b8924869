"""Text clean-up, display names and chat mark-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Display names of features in the web form.
FEATURE_NAMES = {
    "Age": "Student Age",
    "Gender_Female": "Gender: Female",
    "Gender_Male": "Gender: Male",
    "Internships": "Number of Internships",
    "CGPA": "Cumulative GPA",
    "Hostel": "Hostel Accommodation",
    "HistoryOfBacklogs": "Academic Backlogs",
}

# Mark-up rules, applied in this order.
CHAT_RULES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"\*(.+?)\*", "<em>$1</em>"),
    (r"`(.+?)`", "<code>$1</code>"),
    (r"(?m)^\s*[-•]\s+(.+)", "<li>$1</li>"),
    (r"(?m)^\s*(\d+)\.\s+(.+)", "<li>$2</li>"),
    (r"\n", "<br>"),
]

# Signs of a failed model reply.
FAILURE_MARKS = ["Connection error", "404", "Unknown model error"]


# What counts as white space, Unicode's and the separators of ASCII.
SPACES = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def strip(c: Column) -> Column:
    """Remove every kind of white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACES}", ""), f"{SPACES}$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def feature_display(name: Column) -> Column:
    """Display name of an encoded feature column."""
    known = F.create_map(*[F.lit(x) for pair in FEATURE_NAMES.items() for x in pair])
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    # a word begins after anything but a letter, digit or underscore
    words = F.transform(
        F.regexp_extract_all(spaced, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1)),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)),
    )
    stream = F.concat(F.lit("Stream: "), F.replace(F.substring(name, 8, 1 << 30), F.lit("_"), F.lit(" ")))
    return F.when(name.startswith("Stream_"), stream).otherwise(
        F.coalesce(F.try_element_at(known, name), F.array_join(words, ""))
    )


def chat_html(text: Column) -> Column:
    """Chat text as HTML: escape, bold, italic, code, list items, line breaks."""
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in CHAT_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def failed_reply(text: Column, status: Column | None = None) -> Column:
    hit = F.lit(False)
    for mark in FAILURE_MARKS:
        hit = hit | text.contains(mark)
    if status is not None:
        hit = hit | (F.lower(F.coalesce(status, F.lit(""))) == "error")
    return F.coalesce(hit, F.lit(False))


def yes_no(value: Column, numeric: bool = False) -> Column:
    """"Yes" for 1, "1", "true", "yes" (any case, padded); "No" for everything else."""
    if numeric:
        return F.when(F.coalesce(value.try_cast("bigint") == 1, F.lit(False)), "Yes").otherwise("No")
    plain = F.lower(strip(value))
    whole = F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))
    return F.when(plain.isin("true", "yes") | F.coalesce(whole == 1, F.lit(False)), "Yes").otherwise("No")


def client_ip(forwarded: Column, real_ip: Column, peer: Column) -> Column:
    """Client address: first forwarded hop, else the proxy's header, else the peer."""
    return F.coalesce(strip(F.split(forwarded, ",")[0]), real_ip, peer, F.lit("0.0.0.0"))


def india_time(ts_utc_ntz: Column) -> Column:
    """Zone-less UTC time as text in India time."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), ts_utc_ntz)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" IST"))
