"""Text expressions. All are built-in functions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
)

NOT_ALPHANUMERIC = r"[^\p{IsAlphabetic}\p{N}]+"


def tokenize(text: Column) -> Column:
    """Lower-case terms: split first, then lower-case each, then drop single characters and stop words; repeats stay."""
    parts = F.transform(F.split(text, NOT_ALPHANUMERIC), F.lower)
    return F.filter(parts, lambda t: (F.char_length(t) >= 2) & ~t.isin(*STOP_WORDS))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters that aren't white space, 1 at least unless there are none."""
    dense = F.char_length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(dense == 0, 0).otherwise(F.greatest(F.floor(dense / 4).cast("int"), F.lit(1)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def estimate_tokens_by_words(text: Column) -> Column:
    """1.3 tokens a word, rounded up."""
    return F.ceil(F.size(words(text)) * F.lit(1.3)).cast("int")


def heading_level(line: Column) -> Column:
    """1 to 6 for a line of as many # and a space, else null."""
    marks = F.regexp_extract(F.ltrim(line), "^(#{1,6}) ", 1)
    return F.when(marks != "", F.char_length(marks))


def heading_title(line: Column) -> Column:
    return F.when(heading_level(line).isNotNull(), F.trim(F.regexp_extract(F.ltrim(line), "^#{1,6} (.*)$", 1)))


def line_segments(text: Column) -> Column:
    """Lines with their line ends; a text that ends with one has no empty last line."""
    return F.filter(F.split(text, r"(?<=\n)"), lambda s: s != "")


def sentence_segments(text: Column) -> Column:
    """Cuts after . ! ? before white space or the end, and after a line feed before another; leading space is trimmed, blank pieces go."""
    marked = F.regexp_replace(text, r"(?U)(?<=[.!?])(?=\s)|(?<=\n)(?=\n)", "\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"(?U)^\s+", ""))
    return F.filter(parts, lambda s: s != "")


def truncated(text: Column, most: int = 60) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def base_name(uri: Column) -> Column:
    """What follows the last slash or backslash that something follows; the whole if nothing does."""
    parts = F.filter(F.split(uri, r"[\\/]"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), uri)


def content_hash(content: Column) -> Column:
    """Only equality matters: any strong digest does."""
    return F.sha2(content.cast("binary"), 256)


def lossy_utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


# Web pages


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_region(html: Column, tag: str) -> Column:
    """Removes each <tag ... </tag>; one that isn't closed takes the rest. The opening is a prefix, as <tag matches."""
    return F.regexp_replace(html, rf"(?is)<{tag}.*?(</{tag}>|\z)", "")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--(?:>|->|.*?(?:-->|\z))", "")


def strip_tags(html: Column) -> Column:
    """Each tag and each stray > becomes a space; a tag that isn't closed goes."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>|>", " "), r"(?s)<.*\z", "")


def html_text(html: Column, *, strict_head: bool = True) -> Column:
    """Readable text of a page: head, scripts, styles, comments and tags go. With strict_head=False, <header> is not taken for <head>."""
    body = strip_region(html, "head") if strict_head else F.regexp_replace(html, r"(?is)<head(?![a-z]).*?(</head>|\z)", "")
    return collapse_whitespace(strip_tags(strip_comments(strip_region(strip_region(body, "script"), "style"))))


def html_title(html: Column) -> Column:
    found = collapse_whitespace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(found, F.lit(""))
