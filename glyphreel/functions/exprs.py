"""Scalar expressions. All are built-in Catalyst expressions, so they stay in generated code and push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes (Unicode), and that \s means in the patterns here (without the vertical tab).
UNICODE_SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN_SPACE = "\\t\\n\\f\\r "
SEPARATOR = "0123456789"
DEFAULT_TAIL_MS, LEAST_MS = 2000, 500


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: The same white space, one by one.
SPACES = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(x: Column | str) -> Column:
    return F.btrim(c(x), F.lit(SPACES))


def srt_timestamp(ms: Column | str) -> Column:
    """HH:MM:SS,mmm; below zero counts as zero; hours may need more digits."""
    v = F.greatest(c(ms).cast("bigint"), F.lit(0).cast("bigint"))
    div = lambda k: F.floor(v / F.lit(k))
    return F.format_string("%02d:%02d:%02d,%03d", div(3_600_000), div(60_000) % 60, div(1000) % 60, v % 1000)


def ticks_to_ms(pts90k: str) -> Column:
    """Ticks / 90 rounded half up, exact in integers for ticks >= 0."""
    return F.expr(f"(cast(({pts90k}) as bigint) + 45) div 90")


def cue_end(start: Column | str, following: Column | str, tail_ms: int = DEFAULT_TAIL_MS, least_ms: int = LEAST_MS) -> Column:
    end = F.coalesce(c(following), c(start) + tail_ms)
    return F.when(end <= c(start), c(start) + least_ms).otherwise(end)


def sheet_name(number: Column | str) -> Column:
    return F.format_string("sheet_%04d.png", c(number))


def cue_name(index: Column | str) -> Column:
    return F.format_string("cue_%05d.png", c(index))


def marker(sheet: Column | str, position: Column | str) -> Column:
    return F.format_string("[img:%s#%02d]", c(sheet), c(position))


def marker_fallback(text: Column | str, sheet: Column | str, position: Column | str) -> Column:
    clean = trim_space(text)
    return F.coalesce(F.when(clean != "", clean), marker(sheet, position))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    a, b, d = c(y).cast("int") - 16, c(cb).cast("int") - 128, c(cr).cast("int") - 128
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(v + 128, 8)))
    return [clamp(298 * a + 409 * d), clamp(298 * a - 100 * b - 208 * d), clamp(298 * a + 516 * b)]


def fitted_height(width: Column | str, height: Column | str, max_width: int) -> Column:
    w, h = c(width), c(height)
    return F.when(w <= max_width, h).otherwise(F.greatest(F.lit(1), F.floor(h * (F.lit(float(max_width)) / w) + 0.5)).cast("int"))


def fitted_width(width: Column | str, max_width: int) -> Column:
    return F.least(c(width), F.lit(max_width))


def bilinear_channel(c00: Column, c10: Column, c01: Column, c11: Column, wx: Column, wy: Column) -> Column:
    top, low = c00 + (c10 - c00) * wx, c01 + (c11 - c01) * wx
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), top + (low - top) * wy)) + 0.5).cast("int")


def strict_timestamp_ms(text: Column | str) -> Column:
    """Exactly HH:MM:SS:mmm once trimmed, else null."""
    t = trim_space(text)
    return F.when(t.rlike(f"^{CLOCK}$"), clock_ms(t))


CLOCK = "[0-9]{2}:[0-9]{2}:[0-9]{2}:[0-9]{3}"


def clock_ms(stamp: Column | str) -> Column:
    """Of a text of the form HH:MM:SS:mmm; null for an empty one."""
    part = lambda at, n: F.substring(c(stamp), at, n).try_cast("bigint")
    return ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)) * 1000 + part(10, 3)


def found_stamp(line: Column | str) -> Column:
    """The first HH:MM:SS:mmm anywhere, else an empty text."""
    return F.regexp_extract(c(line), f"({CLOCK})", 1)


def found_timestamp_ms(line: Column | str) -> Column:
    return clock_ms(found_stamp(line))


def found_pos_digits(line: Column | str) -> Column:
    """Hex digits behind the first lower-case `filepos:` that has some, without leading zeros; else an empty text."""
    return F.regexp_extract(c(line), "filepos:[ \\t]*0*([0-9a-fA-F]+)", 1)


def pos_of_digits(digits: Column | str) -> Column:
    """Null for no digits or above 63 bits."""
    d = c(digits)
    fits = (F.length(d) > 0) & ((F.length(d) < 16) | ((F.length(d) == 16) & (F.lower(d) <= "7fffffffffffffff")))
    return F.when(fits, F.conv(F.when(fits, d), 16, 10).cast("bigint"))


def found_file_pos(line: Column | str) -> Column:
    return pos_of_digits(found_pos_digits(line))


def split_lines(text: Column | str) -> Column:
    """Cut at the separator, trimmed, empties dropped (so an empty line in the middle shifts those behind it)."""
    parts = F.split(trim_space(text), f"[{PATTERN_SPACE}]*{SEPARATOR}[{PATTERN_SPACE}]*", -1)
    return F.filter(F.transform(parts, trim_space), lambda x: x != "")


def align_lines(lines: Column | str, expected: Column | int) -> Column:
    """Exactly `expected` lines: padded with empty ones, or with the surplus joined to the last by spaces."""
    n = F.lit(expected) if isinstance(expected, int) else expected
    ls = F.transform(c(lines), trim_space)
    short = F.concat(ls, F.array_repeat(F.lit(""), F.greatest(n - F.size(ls), F.lit(0))))
    merged = F.concat(F.slice(ls, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.array_join(F.slice(ls, F.greatest(n, F.lit(1)), F.greatest(F.size(ls), F.lit(1))), " ")))
    return F.when(F.size(ls) <= n, short).when(n == 0, F.array().cast("array<string>")).otherwise(merged)


def strip_fence(text: Column | str) -> Column:
    t = trim_space(text)
    bare = trim_space(F.regexp_replace(t, "^`+|`+$", ""))
    return F.when(F.startswith(t, F.lit("```")), F.when(F.startswith(bare, F.lit("json")), trim_space(F.substring(bare, 5, 1 << 30))).otherwise(bare)).otherwise(t)


def strip_tags(markdown: Column | str) -> Column:
    """Closing cell, row and block tags become line breaks, other tags go; entities are left to the caller."""
    return F.regexp_replace(F.regexp_replace(c(markdown), "(?i)</(?:td|th|tr|p|div|li)>", "\n"), "<[^>]*>", "")


def data_uri(png: Column | str) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64(c(png)), "\r\n", ""))


#: Braces pair from the left, so the count's place can't be followed by a third closing one.
TEMPLATE_TOKEN = r"[^{}]+|\{\{|\}\}|\{expected_count\}(?!\})|[{}]"


def render_template(template: Column | str, expected: Column) -> Column:
    """Doubled braces stand for one; {expected_count} is replaced; any other brace is an error, as in ocr.config.prompt.

    The template is read as a list of tokens: plain runs, doubled braces, the count's place, single braces.
    """
    tokens = F.regexp_extract_all(c(template), F.lit(TEMPLATE_TOKEN), F.lit(0))
    wrong = F.array_contains(tokens, F.lit("{")) | F.array_contains(tokens, F.lit("}"))
    shown = F.transform(tokens, lambda x: F.when(x == "{expected_count}", expected.cast("string")).when(x == "{{", "{").when(x == "}}", "}").otherwise(x))
    return F.when(wrong, F.raise_error(F.lit("a brace of the template is neither doubled nor part of {expected_count}")).cast("string")).otherwise(F.array_join(shown, ""))


def be_uint(body: Column | str, at: int, n: int) -> Column:
    """Big-endian number of n bytes at a zero-based place of a binary column."""
    return F.conv(F.hex(F.substring(c(body), at + 1, n)), 16, 10).cast("bigint")
