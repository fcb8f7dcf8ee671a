"""What fetched bytes are: type by their first bytes, pixel size, verdict on a fetch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.lazy import arrow_udf

#: First bytes in hex, and the types they tell.
MAGIC = [("FFD8FF", "image/jpeg"), ("89504E47", "image/png"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp", "image/tiff": "tif"}


def sniff_mime(content: Column) -> Column:
    """The type by content alone; null for fewer than four bytes or unknown ones."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.octet_length(content) < 4, F.lit(None).cast("string"))
    for magic, mime in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), mime)
    out = out.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "image/webp")
    text = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    return out.when(text.rlike(r"<!doctype html|<html|<head|<body"), "text/html").when(text.rlike(r"^\s*<\?xml"), "text/xml")


def _le(content: Column, at: int, n: int) -> Column:
    return F.conv(F.concat(*(F.hex(F.substring(content, at + i, 1)) for i in reversed(range(n)))), 16, 10).cast("long")


def _be(content: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")


def _signed(value: Column) -> Column:
    """The size that a 32-bit number in two's complement means: rows stored from the top down have a negative height."""
    return F.when(value >= 1 << 31, (1 << 32) - value).otherwise(value)


def jpeg_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first start-of-frame segment; stray bytes between segments are passed over."""
    at, b = 2, content or b""
    while (at := b.find(b"\xff", at)) >= 0 and at + 9 <= len(b):
        kind, n = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if kind in (0x00, 0x01, 0xFF) or 0xD0 <= kind <= 0xD8:  # fill bytes and marks without a segment
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
        elif kind in (0xD9, 0xDA) or n < 2:
            return None
        else:
            at += 2 + n
    return None


@arrow_udf("width int, height int")
def jpeg_size_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jpeg_size(None if c is None else bytes(c)) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def read_size(content: Column) -> Column:
    """struct<width, height>, null where the header is cut off or names a size of 2^31 or more; only JPEG needs Python."""
    mime, n, most = sniff_mime(content), F.octet_length(content), (1 << 31) - 1
    of = lambda w, h: F.when((w <= most) & (h <= most), F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))
    jpeg = jpeg_size_udf(F.when(mime == "image/jpeg", content))
    return (
        F.when((mime == "image/png") & (n >= 24), of(_be(content, 17, 4), _be(content, 21, 4)))
        .when((mime == "image/gif") & (n >= 10), of(_le(content, 7, 2), _le(content, 9, 2)))
        .when((mime == "image/bmp") & (n >= 26), of(_signed(_le(content, 19, 4)), _signed(_le(content, 23, 4))))
        .when((mime == "image/jpeg") & jpeg["width"].isNotNull(), of(jpeg["width"], jpeg["height"]))
    )


def classify(http_status: Column, error: Column, content: Column, size: Column) -> Column:
    """struct<status, reason> of a fetch: the first rule that holds."""
    mime = sniff_mime(content)
    dead = lambda why: F.struct(F.lit("dead").alias("status"), why.alias("reason"))
    return (
        F.when(error.isNotNull(), dead(error))
        .when(~http_status.between(200, 299), dead(F.concat(F.lit("HTTP "), http_status.cast("string"))))
        .when(content.isNull() | (F.octet_length(content) == 0), dead(F.lit("empty")))
        .when(mime.isNull(), dead(F.lit("unknown type")))
        .when(mime.startswith("text/"), dead(F.lit("a page, not an image")))
        .when((size["width"] <= 1) & (size["height"] <= 1), dead(F.lit("tracking pixel")))
        .otherwise(F.struct(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason")))
    )
