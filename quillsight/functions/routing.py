"""Routing and validation of input items: Column -> Column, JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File extensions by content type.
EXTENSIONS = {
    "text": (".txt", ".md", ".html", ".htm", ".json", ".xml", ".csv"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg"),
    "audio": (".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac"),
    "video": (".mp4", ".mov", ".avi", ".webm", ".mkv", ".wmv"),
}
CONTENT_TYPES = (*EXTENSIONS, "unknown")

# Limits of the input checks, in bytes.
LEAST_TEXT, MOST_TEXT = 10, 100_000
MOST_FILE = 100 * 1024 * 1024
MOST_BODY = 10 * 1024 * 1024
#: What a fetched item is cut to, by content type.
FETCH_LIMITS = {"text": 1 << 20, "image": 50 << 20, "audio": 100 << 20, "video": 500 << 20}


def type_of_filename(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./]*)$", 1))
    out = F.lit("unknown")
    for kind, listed in EXTENSIONS.items():
        out = F.when(extension.isin(*listed), kind).otherwise(out)
    return out


def type_of_url(url: Column) -> Column:
    """By the extension before the first ?; a fragment isn't cut and the host counts like a path."""
    return type_of_filename(F.substring_index(F.coalesce(url, F.lit("")), "?", 1))


def type_of_mime(mime: Column) -> Column:
    name = F.trim(F.lower(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    out = F.when(name.isin("application/json", "application/xml"), "text").otherwise("unknown")
    for kind in EXTENSIONS:
        out = F.when(name.startswith(kind + "/"), kind).otherwise(out)
    return out


def _at(data: Column, start: int, hexadecimal: str) -> Column:
    expected = bytes.fromhex(hexadecimal)
    return F.substring(data, start + 1, len(expected)) == F.lit(expected)


def byte_at(data: Column, position: int) -> Column:
    return F.conv(F.hex(F.substring(data, position + 1, 1)), 16, 10).cast("int")


def type_of_magic(data: Column) -> Column:
    riff = _at(data, 0, "52494646") & (F.octet_length(data) >= 12)
    return (
        F.when(F.coalesce(F.octet_length(data), F.lit(0)) < 4, "unknown")
        .when(_at(data, 0, "ffd8ff") | _at(data, 0, "89504e47") | _at(data, 0, "47494638"), "image")
        .when(riff & _at(data, 8, "57454250"), "image")
        .when((byte_at(data, 0) == 0xFF) & (byte_at(data, 1).bitwiseAND(F.lit(0xE0)) == 0xE0) | _at(data, 0, "494433"), "audio")
        .when((F.octet_length(data) >= 8) & _at(data, 4, "66747970"), "video")
        .when(riff & _at(data, 8, "57415645"), "audio")
        .otherwise("unknown")
    )


def content_type(text: Column, filename: Column, url: Column, data: Column) -> Column:
    """The first of text, file name, URL and bytes that is present decides, even if it says unknown."""
    present = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return (
        F.when(present(text), "text").when(present(filename), type_of_filename(filename)).when(present(url), type_of_url(url))
        .when(present(data), type_of_magic(data)).otherwise("unknown")
    )


def content_hash(text: Column, data: Column | None = None, url: Column | None = None) -> Column:
    """SHA-256 of the text, else of the bytes, else of the URL; of nothing where all are empty."""
    some = lambda c: F.when(F.octet_length(c) > 0, c)
    parts = [some(text.cast("binary"))]
    if data is not None:
        parts.append(some(data))
    if url is not None:
        parts.append(some(url.cast("binary")))
    return F.sha2(F.coalesce(*parts, F.lit(b"")), 256)


def validation_error(text: Column, url: Column, data: Column | None = None, most_file: int = MOST_FILE) -> Column:
    """Why an item is refused, or null."""
    empty = lambda c: F.coalesce(F.octet_length(c) == 0, F.lit(True))
    no_data = F.lit(True) if data is None else empty(data)
    out = F.when(empty(text) & empty(url) & no_data, "no content")
    out = out.when(~empty(url) & ~F.coalesce(url.rlike("^https?://"), F.lit(False)), "invalid url")
    out = out.when(~empty(text) & (F.octet_length(text) < LEAST_TEXT), "text too short")
    out = out.when(~empty(text) & (F.octet_length(text) > MOST_TEXT), "text too long")
    return out if data is None else out.when(F.octet_length(data) > most_file, "file too large")


def url_over_text(url: Column, text: Column) -> tuple[Column, Column]:
    """Of a request with both, the URL counts: (url, text)."""
    has_url = F.coalesce(url != "", F.lit(False))
    return url, F.when(has_url, F.lit("")).otherwise(text)


def client_ip(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    """The first forwarded address, else the real one, else the host part of the remote address."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    host = F.regexp_replace(F.regexp_replace(remote, r":\d+$", ""), r"^\[(.*)\]$", "$1")
    return F.when(F.coalesce(forwarded != "", F.lit(False)), first).when(F.coalesce(real_ip != "", F.lit(False)), real_ip).otherwise(host)
