"""What a reader of answers and sources sees: labels, footnotes, highlights. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and glyphs of source kinds; kinds that can be fetched again.
LABELS = {"folder": "Folder", "repo": "Repository", "youtube": "YouTube", "pdf": "PDF", "url": "Web page"}
ICONS = {"folder": "📁", "repo": "", "youtube": "▶", "pdf": "", "url": "🔗"}
OTHER_ICON = "📄"
SYNCABLE = ("repo", "url", "youtube")


def _mapped(key: Column, values: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), other)


def label_for(kind: Column) -> Column:
    return _mapped(kind, LABELS, kind)


def icon_for(kind: Column) -> Column:
    return _mapped(kind, ICONS, F.lit(OTHER_ICON))


def is_syncable(kind: Column) -> Column:
    return kind.isin(*SYNCABLE)


def char_span(locator: Column) -> Column:
    """struct<start, end> of a charspan or page locator, else null."""
    has = locator["kind"].isin("charspan", "page")
    return F.when(has, F.struct(locator["char_start"].alias("start"), locator["char_end"].alias("end")))


def segments(text: Column, start: Column, end: Column) -> Column:
    """array<struct<text, highlighted>>: what stands before, in and after a span that is clamped to the text; empty runs go."""
    n = F.char_length(text)
    low = F.greatest(F.lit(0), F.least(start, n))
    high = F.greatest(low, F.least(end, n))
    part = lambda a, b, lit: F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(lit).alias("highlighted"))
    return F.filter(F.array(part(F.lit(0), low, False), part(low, high, True), part(high, n, False)), lambda s: s["text"] != "")


def highlighted_lines(text: Column, first: Column, last: Column) -> Column:
    """array<struct<number, text, highlighted>>: lines from 1, those in the range (either way round) flagged."""
    low, high = F.least(first, last), F.greatest(first, last)
    return F.transform(F.split(text, "\n"), lambda line, k: F.struct((k + 1).alias("number"), line.alias("text"), (k + 1).between(low, high).alias("highlighted")))


def clock(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def bbox_rect(bbox: Column) -> Column:
    """struct<left, top, width, height> in percent of a box of fractions."""
    at = lambda k: F.get(bbox, F.lit(k)).cast("double")
    return F.struct((at(0) * 100).alias("left"), (at(1) * 100).alias("top"), ((at(2) - at(0)) * 100).alias("width"), ((at(3) - at(1)) * 100).alias("height"))


def percent(index: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.lit(100.0) * index / total, 0)).otherwise(0.0).cast("int")


def rendered(content: Column, used: Column) -> Column:
    """content with each marker of the array `used` as its footnote number and all others removed; content as it is if none is used."""
    parts = F.split(content, r"(?=\[\^[^\]]+\])|(?<=\])")
    marker = r"^\[\^([^\]]+)\]$"

    def one(part: Column) -> Column:
        at = F.array_position(used, F.regexp_extract(part, marker, 1))
        return F.when(part.rlike(marker), F.when(at > 0, at.cast("string")).otherwise("")).otherwise(part)

    return F.when(F.size(used) == 0, content).otherwise(F.array_join(F.transform(parts, one), ""))
