"""Partition numbers, slugs and request keys as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: kept length of a task key.
TASK_KEY_HEX = 40


def event_partition(key: Column, partitions: int = 4) -> Column:
    """Stable partition of a message key: crc32 of its UTF-8 text."""
    return F.pmod(F.crc32(key.cast("binary")), F.lit(max(1, partitions))).cast("int")


def slugify(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""
    )


def json_quoted(text: Column) -> Column:
    """Quoted JSON string, taken out of a one-field object; control characters in lower-case hex."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    lower = quoted
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        # an even number of backslashes before it: not an escaped backslash with letters after it
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(text.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), lower).otherwise(quoted)


def json_number(value: Column) -> Column:
    """A double as JSON text: the digits Java finds shortest, plain between 1e-4 and 1e16, else with an exponent."""
    return number_text(value, F.abs(value).cast("string"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shortest_number(value: Column) -> Column:
    """``json_number`` with the fewest digits that read back: Java 17 now and then prints one too many."""

    def spelled(size: Column, java: Column) -> Column:
        text = F.when(java == "4.9E-324", "5.0E-324").otherwise(java)
        for digits in (17, 16):
            shorter = F.upper(F.format_string(f"%.{digits - 1}e", size))
            fits = (F.length(java) > digits) & (shorter.try_cast("double") == size)
            text = F.when(fits, F.regexp_replace(shorter, r"E\+?(-?)0*([0-9])", "E$1$2")).otherwise(text)
        return text

    return bound(
        value,
        lambda v: bound(F.abs(v).cast("string"), lambda java: bound(spelled(F.abs(v), java), lambda text: number_text(v, text))),
    )


def number_text(value: Column, text: Column) -> Column:
    """JSON text of a double from Java's text of its absolute value."""
    mantissa = F.regexp_extract(text, r"^([0-9.]+)E", 1)
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
    count = F.length(digits)
    point = power + 1
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")), F.lit("."))
    rest = F.when(count > point, F.substring(digits, point + 1, count)).otherwise("0")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    tail = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise("")
    sign = F.when(power < 0, "-").otherwise("+")
    far = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    plain = (
        F.when(power.isNull(), text)
        .when((power >= 0) & (power < 16), F.concat(whole, rest))
        .when((power < 0) & (power >= -4), small)
        .otherwise(far)
    )
    negative = value.cast("string").startswith("-")
    return F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.when(negative, "-Infinity").otherwise("Infinity")).otherwise(
        F.concat(F.when(negative, "-").otherwise(""), plain)
    )


def escape_non_ascii(text: Column) -> Column:
    """JSON text with every non-ASCII character as ``\\uXXXX``, in UTF-16 pairs."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    escaped = F.array_join(
        F.transform(
            units,
            lambda u: F.when(
                (u >= "0020") & (u < "007F"),
                F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8"),
            ).otherwise(F.concat(F.lit("\\u"), F.lower(u))),
        ),
        "",
    )
    return F.when(text.rlike("^[\\x20-\\x7e]*$"), text).otherwise(escaped)


def json_string(text: Column) -> Column:
    """Quoted JSON string in plain ASCII."""
    return escape_non_ascii(json_quoted(text))


def task_key(intent: Column, capabilities: Column, prefix: str) -> Column:
    """Replay-safe key after ``prefix``: same intent and capability set, same key."""
    caps = F.array_join(
        F.transform(F.array_sort(capabilities), lambda c: json_string(c)), ", "
    )
    text = F.concat(
        F.lit('{"capabilities": ['), caps, F.lit('], "intent": '), json_string(intent), F.lit("}")
    )
    return F.concat(
        F.lit(prefix), F.substring(F.sha2(text, 256), 1, TASK_KEY_HEX)
    )


def request_digest(body_json: Column, method: Column, path: Column) -> Column:
    """Digest of a request; ``body_json`` is the body as canonical JSON text."""
    text = F.concat(
        F.lit('{"body": '),
        body_json,
        F.lit(', "method": '),
        json_string(method),
        F.lit(', "path": '),
        json_string(path),
        F.lit("}"),
    )
    return F.sha2(text, 256)
