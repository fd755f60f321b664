"""Column functions on text: folding, slugs, tokens, hashes."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


@cache
def accent_table(kind: str = "NFD") -> tuple[str, str]:
    """Letters that decompose into one base letter and combining marks, and their bases, by Unicode's rule."""
    marked, plain = [], []
    for point in range(0x00C0, 0x2000):
        parts = unicodedata.normalize(kind, chr(point))
        if len(parts) > 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            marked.append(chr(point))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def strip_accents(c: Column) -> Column:
    """Drop accents: marks are removed by translation of composed letters and of free combining marks.

    Texts without any letter beyond ASCII skip the translation.
    """
    marked, plain = accent_table()
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(c, marked, plain), r"\p{Mn}+", "")).otherwise(c)


def squeeze(c: Column) -> Column:
    """Every run of blanks of any kind becomes one space; outer blanks go."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def fold(c: Column) -> Column:
    """Trimmed, lower case, without accents, single spaces. Null stays null."""
    return squeeze(strip_accents(F.lower(c)))


def slug(c: Column, default: str = "unknown") -> Column:
    """Lower-case words of a-z and 0-9 joined by '-'; ``default`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def doc_slug(filename: Column) -> Column:
    """Canonical document id: 'doc:' and the slug of the file's stem."""
    return F.concat(F.lit("doc:"), slug(F.regexp_replace(filename, r"\.[^.]*$", "")))


def last_line(c: Column) -> tuple[Column, Column]:
    """The last line that holds more than blanks, and the text before it; of a wholly blank text, its first line.

    In time linear in the text: the pattern ``[^\\n]*\\s*$`` would be tried at every place of every line.
    """
    held = F.rtrim(c, F.lit(" \t\n\f\r"))
    before = F.length(held) - F.length(F.substring_index(held, "\n", -1))
    return F.substring_index(F.substr(c, before + 1), "\n", 1), F.left(c, before)


# Fixed value: words with parts joined by '.', '/' or '-', or whole and decimal numbers. Possessive here, so that long runs need no stack.
TOKEN = r"[a-zñáéíóúü]++(?:[./-]?[a-z0-9]++)*+|\d++(?:[.,]\d++)?+"


def tokens(c: Column) -> Column:
    """Lower-case words and numbers; parts of a word joined by '.', '/' or '-' stay one token, and so do decimals."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
