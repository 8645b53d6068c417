"""Text functions, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def cut_to(text: Column, size: int) -> Column:
    """The first ``size`` characters and ``...`` if the text is longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem_of(path: Column) -> Column:
    """File name without its folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def extension_of(path: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(path, r"\."), -1)


# Named character references that are decoded, in this order (the ampersand last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def valid_utf8(text: Column) -> Column:
    """The text without bytes that aren't UTF-8; Python stages can't read them."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def numbered(text: Column) -> Column:
    """Decodes numeric character references, decimal and hexadecimal; those that name no character stay."""

    def decoded(part: Column) -> Column:
        code = F.regexp_extract(part, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        value = F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).try_cast("int")
        valid = ((value >= 32) & (value < 0xD800)) | ((value > 0xDFFF) & (value <= 0x10FFFF)) | value.isin(9, 10, 13)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, value).otherwise(32)), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.substring(part, F.length(code) + 2, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))

    def built(t: Column) -> Column:
        parts = F.transform(F.split(t, "&#", -1), lambda p, i: F.when(i == 0, p).otherwise(decoded(p)))
        return F.when(F.contains(t, F.lit("&#")), F.array_join(parts, "")).otherwise(t)

    return F.get(F.transform(F.array(text), built), F.lit(0))  # the text, which may be costly, is made once


# What of a page is never shown, and its tags.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"


def _decoded(text: Column) -> Column:
    """Character references replaced; numeric ones first, so that what a named one spells isn't read again."""
    text = numbered(text)
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; references decoded; white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " ")
    return F.trim(F.regexp_replace(_decoded(text), r"\s+", " "))


def html_to_markdown(html: Column) -> Column:
    """All visible text as markdown: the first ``h1`` is the title, each paragraph has a heading of its own, numbered from 1.

    What stands before the first paragraph is one line before the title and one after it. Lines that would read as a
    heading or fence are escaped. A null page has no text.
    """
    text = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), "\x01\x02\x03", "   "), HIDDEN, " ")
    for pattern, mark in ((r"(?i)<p(?:\s[^>]*)?>", "\x01"), (r"(?i)<h1(?:\s[^>]*)?>", "\x02"), (r"(?i)</h1\s*>", "\x03"), (TAG, " ")):
        text = F.regexp_replace(text, pattern, mark)
    text = F.regexp_replace(_decoded(text), r"\s+", " ")  # once for the whole page; no reference gives a mark

    def line(part: Column) -> Column:
        marked = F.contains(part, F.lit("\x02")) | F.contains(part, F.lit("\x03"))
        plain = F.trim(F.when(marked, F.regexp_replace(F.translate(part, "\x02\x03", "  "), " +", " ")).otherwise(part))
        return F.when(plain.startswith("#") | plain.startswith("```") | plain.startswith("~~~"), F.concat(F.lit("\\"), plain)).otherwise(plain)

    def built(parts: Column) -> Column:
        head = F.get(parts, F.lit(0))
        title = F.regexp_extract(head, r"\x02([^\x03]*)\x03", 1)
        has_title = F.regexp_like(head, F.lit(r"\x02[^\x03]*\x03"))
        before = line(F.when(has_title, F.regexp_extract(head, r"^([^\x02]*)\x02", 1)).otherwise(head))
        after = F.when(has_title, line(F.regexp_extract(head, r"\x02[^\x03]*\x03(.*)$", 1))).otherwise("")
        heading = F.when(has_title, F.concat(F.lit("\n\n# "), F.trim(title), F.lit("\n"))).otherwise("")
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.concat(F.lit("\n\n## Part "), (i + 1).cast("string"), F.lit("\n"), line(p)))
        return F.concat(before, heading, after, F.array_join(rest, ""))

    # the page is taken apart once, whatever is made of its parts
    return F.get(F.transform(F.array(F.split(text, "\x01", -1)), built), F.lit(0))


def suffix_number(parent_id: Column) -> Column:
    """The number at the end of a parent id, else 0."""
    return F.coalesce(F.regexp_extract(parent_id, r"_parent_(\d+)$", 1).try_cast("long"), F.lit(0))


def merge_path(old: Column, new: Column) -> Column:
    """Join two metadata maps: values of a shared key become ``old -> new``."""
    return F.map_zip_with(old, new, lambda k, a, b: F.concat_ws(" -> ", a, b))
