"""Text functions as Spark columns. All are null in, null out unless said otherwise, and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file extension; anything else is DEFAULT_MEDIA_TYPE.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "txt": "text/plain",
    "csv": "text/csv",
    "json": "application/json",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def safe_path(name: Column, max_bytes: int = 255) -> Column:
    """A file name of at most ``max_bytes`` UTF-8 bytes.

    A longer name keeps its first ``max_bytes - 17`` bytes (a broken last character is dropped), an underscore and
    16 hex digits of the SHA-256 of the whole name, so distinct names stay distinct.
    """
    if max_bytes < 18:
        raise ValueError("max_bytes must be at least 18")
    data, keep = name.cast("binary"), max_bytes - 17
    head = F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, keep - lost).cast("string")) for lost in range(4)))
    return F.when(F.octet_length(name) <= max_bytes, name).otherwise(F.concat(head, F.lit("_"), F.substring(F.sha2(name, 256), 1, 16)))


def slugify(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("_")))


def unslugify(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def snake_to_camel(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "_"), F.initcap), "")


def media_type(name: Column) -> Column:
    """Media type by the part after the last dot, in any letter case; no dot or an unknown one gives the default."""
    known = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.when(F.contains(name, F.lit(".")), F.substring_index(F.lower(name), ".", -1)).otherwise(F.lit(""))), F.lit(DEFAULT_MEDIA_TYPE))


def content_md5(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def content_base64(content: Column) -> Column:
    """Base64 in one line, whatever the session's chunking setting is."""
    return F.translate(F.base64(content.cast("binary")), "\r\n", "")


def normal_uuid(value: Column) -> Column:
    return F.lower(F.replace(value, F.lit("-"), F.lit("")))


def decode_lossy(content: Column) -> Column:
    """Bytes as UTF-8 text, invalid sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def url_with(base: str, params: list[tuple[str, Column]]) -> Column:
    """``base?k=v&...`` in the given order, values form-encoded; a null value leaves its parameter out."""
    parts = [F.concat(F.lit(f"{key}="), F.url_encode(value.cast("string"))) for key, value in params]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def relative_to(path: Column, root: Column, master: Column) -> Column:
    """The path below ``root``, or ``.`` for the master file."""
    return F.when(path == master, F.lit(".")).otherwise(F.substr(path, F.length(root) + 2))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals; ties go away from zero."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def first_token(message: Column, most: int = 48, default: str = "Unknown") -> Column:
    """The first word of a message, cut to ``most`` characters; ``default`` for null, empty and blank ones."""
    word = F.substring(F.get(F.split(strip(message), r"\s+"), F.lit(0)), 1, most)
    return F.coalesce(F.nullif(word, F.lit("")), F.lit(default))


def render(template: str, *values: Column) -> Column:
    """A ``%``-style template filled from columns."""
    return F.format_string(template, *values)


def markdown_row(*values: Column) -> Column:
    """One row of a Markdown table; null is an empty cell."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), F.lit(" |"))
