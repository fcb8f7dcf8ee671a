"""XML's named references as column expressions; redaction of documents is in ``redact``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.redact import COMMENTS, EVENTS, Rules, pseudonym, redact_xml  # noqa: F401

#: The five named references of XML; the ampersand comes last when reading, first when writing.
NAMED = [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")]


def unescape(text: Column) -> Column:
    for sign, name in NAMED:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text
