"""Kind and size of an image from the first bytes of its file, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = 64  # of a JPEG file before its frame
HEAD = 65_536  # bytes that are looked at


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """``size`` bytes from 1-based ``at`` on, as a number; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(content, at, F.lit(size))
    raw = F.hex(part)
    if little:
        raw = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.octet_length(part) == size, F.conv(raw, 16, 10).cast("long"))


def _jpeg(content: Column) -> Column:
    """(width, height) of a JPEG file: its segments are walked up to the frame header; nulls if there is none."""
    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"].cast("int")
        mark, kind, size = _number(content, at, 1), _number(content, at + 1, 1), _number(content, at + 2, 2)
        frame = kind.between(0xC0, 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        broken = F.coalesce((mark != 0xFF) | (size < 2), F.lit(True))
        found = F.struct(s["at"].alias("at"), F.lit(True).alias("done"), _number(content, at + 7, 2).alias("width"), _number(content, at + 5, 2).alias("height"))
        ended = F.struct(s["at"].alias("at"), F.lit(True).alias("done"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
        next_ = F.struct((s["at"] + 2 + size).alias("at"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
        return F.when(s["done"], s).when(broken, ended).when(frame, found).otherwise(next_)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)


def image_header(content: Column) -> Column:
    """(kind, width, height) of PNG, GIF, BMP and JPEG bytes. An unknown file has null kind, a broken header null sizes."""
    head = F.substring(content, F.lit(1), F.lit(HEAD))
    begins = lambda digits: F.startswith(F.hex(F.substring(head, F.lit(1), F.lit(len(digits) // 2))), F.lit(digits))
    # The signatures of the formats.
    kind = F.when(begins("89504E470D0A1A0A"), "png").when(begins("474946383761") | begins("474946383961"), "gif").when(begins("424D"), "bmp").when(begins("FFD8FF"), "jpeg")
    jpeg = _jpeg(head)
    signed = lambda c: F.abs(F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c))  # noqa: E731  heights of bitmaps may be negative
    width = F.when(kind == "png", _number(head, 17, 4)).when(kind == "gif", _number(head, 7, 2, True)).when(kind == "bmp", signed(_number(head, 19, 4, True))).when(kind == "jpeg", jpeg["width"])
    height = F.when(kind == "png", _number(head, 21, 4)).when(kind == "gif", _number(head, 9, 2, True)).when(kind == "bmp", signed(_number(head, 23, 4, True))).when(kind == "jpeg", jpeg["height"])
    return F.struct(kind.alias("kind"), width.alias("width"), height.alias("height"))
