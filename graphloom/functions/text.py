"""Text functions, all inside the JVM.

White space is Unicode white space and the four ASCII separators \\x1c-\\x1f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The same characters, one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ASCII = [chr(c) for c in range(128)]
#: Colours that types are drawn in, in order; fixed values.
PALETTE = ("#1b6b73", "#bf5b45", "#5a6f2a", "#8a5a2b", "#7356a6", "#28745d", "#b0446f", "#5f6f89", "#a36a00", "#3f6d9a")


def _text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def is_ascii(text: Column) -> Column:
    """Whether all characters are ASCII, for which most patterns have a faster form."""
    return F.octet_length(text) == F.length(text)


def strip(value: Column | str) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.btrim(_text(value), F.lit(SPACES))


def compact_text(value: Column | str) -> Column:
    """Stripped, with at most one empty line in a row."""
    text = strip(value)
    return F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)


def _translated(text: Column, to: dict[str, str], kept: str, once: str) -> Column:
    """ASCII text with characters replaced by ``to``, others than letters, digits and ``kept`` gone, and ``once`` never twice in a row."""
    gone = [c for c in _ASCII if not c.isalnum() and c not in kept and c not in to]
    out = F.translate(text, "".join([*to, *gone]), "".join(to.values()))
    return F.when(F.contains(out, F.lit(once * 2)), F.regexp_replace(out, f"{once}{{2,}}", once)).otherwise(out)


_KEY_SPACES = {c: " " for c in "_-" + SPACES if c.isascii() and c != " "}


def normalize_key(value: Column | str) -> Column:
    """Key for comparing names: lower case, ``_ -`` as spaces, other signs than ``. / + = %`` gone."""
    plain = F.btrim(_translated(F.lower(_text(value)), _KEY_SPACES, " ./+=%", " "))
    return F.when(is_ascii(_text(value)), plain).otherwise(_unicode_key(value))


def _unicode_key(value: Column | str) -> Column:
    words = F.regexp_replace(F.lower(strip(value)), r"[_\-]+", " ")
    kept = F.regexp_replace(words, rf"(?U)[^\w\s\x1c-\x1f./+=%]+", "")
    return strip(F.regexp_replace(kept, rf"(?U){SPACE}+", " "))


_SLUG_SIGNS = {c: "-" for c in _ASCII if not c.isalnum() and c not in "_.-"}


def slugify(value: Column | str, fallback: str = "item") -> Column:
    """A path key: heading marks off, everything but word characters, dots and hyphens to single hyphens."""
    filled = F.when(_text(value) == "", F.lit(fallback)).otherwise(_text(value))
    base = F.when(strip(filled) == "", F.lit(fallback)).otherwise(strip(filled))
    base = F.when(F.startswith(base, F.lit("#")), F.regexp_replace(base, rf"(?U)\A#{{1,6}}{SPACE}+", "")).otherwise(base)
    joined = base
    for pattern in (rf"(?U){SPACE}+", r"[\\/]+", r"(?U)[^\w.\-]+", r"-{2,}"):
        joined = F.regexp_replace(joined, pattern, "-")
    joined = F.when(is_ascii(base), _translated(base, _SLUG_SIGNS, "_.-", "-")).otherwise(joined)
    joined = F.btrim(joined, F.lit("-_."))
    return F.when(joined == "", F.lit(fallback)).otherwise(joined)


def stable_id(*parts: Column | str, prefix: str = "") -> Column:
    """Prefix and the first 16 hex digits of the SHA-1 of the parts, one to a line; null reads None."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.encode(F.concat_ws("\n", *texts), "UTF-8")), 1, 16))


def merge_lines(texts: Column) -> Column:
    """The distinct stripped lines of an array of texts, in order, empty ones left out."""
    lines = F.flatten(F.transform(texts, lambda t: F.split(_text(t), "\n", -1)))
    return F.array_join(F.array_distinct(F.filter(F.transform(lines, strip), lambda x: x != "")), "\n")


def type_color(value: Column | str) -> Column:
    """The palette colour of a type name, from a 32-bit polynomial hash of its characters."""
    letters = F.filter(F.split(_text(value), ""), lambda c: c != "")
    hashed = F.aggregate(letters, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(0xFFFFFFFF))
    return F.element_at(F.array(*map(F.lit, PALETTE)), (hashed % len(PALETTE) + 1).cast("int"))
