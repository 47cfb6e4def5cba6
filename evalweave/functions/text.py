"""Text functions with the white-space and case rules the engine relies on."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without white space at either end (Unicode, unlike trim)."""
    return F.regexp_replace(c, EDGE, "")


def clean_id(c: Column) -> Column:
    """An id without surrounding blanks, in lower case; null if blank."""
    return F.nullif(F.lower(strip(c.cast("string"))), F.lit(""))


def tokens(c: Column) -> Column:
    """Runs of non-white-space; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda x: x != "")


def lower_tokens(c: Column) -> Column:
    return tokens(F.lower(c))


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! ? at white space; empty for null and blank texts."""
    return F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"), lambda x: x != "")


def document_text(title: Column, text: Column) -> Column:
    """Title and text, joined by a blank and stripped; missing parts count as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def parent_of(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, "::", 1)


def numbered(contexts: Column) -> Column:
    """'[1] first', blank line, '[2] second' ... ; empty for null and empty arrays."""
    return F.coalesce(F.array_join(F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x, F.lit("")))), "\n\n"), F.lit(""))


def fill(template: str, **slots: Column) -> Column:
    """A prompt template with its ``{slots}`` filled by columns; null counts as empty, doubled braces are braces."""
    parts = re.split(r"(?<!\{)\{(\w+)\}(?!\})", template)
    return F.concat(*[F.coalesce(slots[x], F.lit("")) if i % 2 else F.lit(x.replace("{{", "{").replace("}}", "}")) for i, x in enumerate(parts)])
