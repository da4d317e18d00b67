"""Text expressions: chunkers, truncation, titles, URLs, hashes. Positions count code points."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS = "array<struct<pos:int,text:string>>"


def blank_to_null(c: Column) -> Column:
    """Missing, null and blank strings are all absent."""
    return F.nullif(F.trim(c), F.lit(""))


def truncated(c: Column, n: int = 10_000, mark: str = "...") -> Column:
    """The first ``n`` characters with ``mark`` if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def collapsed(c: Column, n: int = 5_000) -> Column:
    """White space runs become one blank; the first ``n`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def grid_size(length: Column, size: int, overlap: int) -> Column:
    """How many chunks start on the grid k * (size - overlap); 0 for an empty or null text."""
    step = size - overlap
    more = F.ceil((length - size) / F.lit(step)).cast("int")
    return F.when(length.isNull() | (length == 0), F.lit(0)).when(length <= size, F.lit(1)).otherwise(1 + more)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grid(c: Column, size: int, overlap: int, piece: Callable[[Column, Column, Column], Column]) -> Column:
    """``piece`` of each place on the grid, its window, and whether text follows that. Finding a place in a text
    takes as long as the text before it, so the grid is cut into stretches, about as many as a stretch has places:
    each stretch is found in the text, and the windows are found in their stretch."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap

    def pieces(length: Column) -> Column:
        n = grid_size(length, size, overlap)
        many = F.greatest(F.lit(16), F.ceil(F.sqrt(n))).cast("int")
        first = F.when(n > 0, F.sequence(F.lit(0), n - 1, many)).otherwise(F.array().cast("array<int>"))

        def stretch(k: Column) -> Column:
            own = F.sequence(k, F.least(n, k + many) - 1)
            window = lambda part, i: F.substring(part, (i - k) * step + 1, F.lit(size))
            return _let(F.substring(c, k * step + 1, many * step + overlap), lambda part: F.transform(own, lambda i: piece(i, window(part, i), i * step + size < length)))

        return F.flatten(F.transform(first, stretch))

    return _let(F.length(c), pieces)


def fixed_chunks(c: Column, size: int = 1500, overlap: int = 150) -> Column:
    """Overlapping pieces of at most ``size`` characters: array<struct<pos, text>>."""
    return _grid(c, size, overlap, lambda k, window, more: F.struct(k.alias("pos"), window.alias("text")))


def break_aware_chunks(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Like ``fixed_chunks``, but a chunk ends early: after a blank line past its half, else after the last
    sentence end (. ! ? and a blank) past its half, else before a blank at or past its half. Text between
    such an end and the next start can be in no chunk. Chunks are stripped; empty ones are left out."""
    half = size // 2

    def end(window: Column, back: Column) -> Column:
        def last(mark: str) -> Column:
            """Position (from 1) of the last occurrence in the window, 0 if there is none: the first one in it reversed."""
            return _let(F.locate(mark[::-1], back), lambda at: F.when(at > 0, F.length(window) - at - len(mark) + 2).otherwise(F.lit(0)))

        stop = F.greatest(*[last(m) for m in (". ", "! ", "? ")])
        rest = lambda: _let(stop, lambda s: F.when(s - 1 > half, s).otherwise(_let(last(" "), lambda b: F.when(b - 1 >= half, b - 1).otherwise(F.length(window)))))
        return _let(last("\n\n"), lambda p: F.when(p - 1 > half, p + 1).otherwise(rest()))

    def piece(k: Column, window: Column, more: Column) -> Column:
        cut = _let(window, lambda w: F.when(more, F.substring(w, F.lit(1), _let(F.reverse(w), lambda back: end(w, back)))).otherwise(w))
        return F.struct(k.alias("pos"), F.trim(cut).alias("text"))

    return F.filter(_grid(c, size, overlap, piece), lambda x: x["text"] != "")


def _sentence(text: str, size: int, overlap: int, most: int) -> list[dict]:
    text = text.replace("\r\n", " ").replace("\n", " ").replace("\r", " ")
    out: list[dict] = []
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            low = max(start, end - 100)
            dot = text.rfind(". ", low, end)
            blank = text.rfind(" ", low, end)
            end = dot + 1 if dot > start else blank if blank > start else end
        piece = text[start:end].strip()
        if piece:
            out.append({"pos": len(out), "text": piece})
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def _paragraph(text: str, size: int, overlap: int, most: int) -> list[dict]:
    import re

    text = re.sub(r"\n{3,}", "\n\n", text)[:most]
    out: list[dict] = []
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            low = max(start, end - 200)
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, low, end)
                if at > start:
                    end = at
                    break
        piece = text[start:end].strip()
        if piece:
            out.append({"pos": len(out), "text": piece})
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def sequential_chunks(c: Column, size: int = 1000, overlap: int = 200, by: str = "sentence", most: int = 100_000) -> Column:
    """Chunks whose start depends on the end of the one before: ``by`` sentence (line ends become blanks;
    a chunk ends at a full stop, else a blank, of its last 100 characters) or paragraph (a blank line, else
    a line end, of its last 200; line ends in a row count as two, and of what is left the first ``most``
    characters are cut up). A null text has none. Only a chunk's own last characters are searched."""
    cut = {"sentence": _sentence, "paragraph": _paragraph}[by]

    @F.pandas_udf(CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t, size, overlap, most) if t else [])

    return run(c)


def with_paragraphs(chunks: Column, text: Column, fewer: int = 20, longer: int = 2000, least: int = 100) -> Column:
    """Where a long text has few chunks, its paragraphs over ``least`` characters that are not yet chunks."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    return F.when((F.size(chunks) < fewer) & (F.length(text) > longer), F.concat(chunks, F.array_except(parts, chunks))).otherwise(chunks)


def display_title(filename: Column) -> Column:
    """A title from a file name: no extension, no 14- or 8-digit prefix, blanks for _ and -, capitals."""
    stem = F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", "")
    stem = F.regexp_replace(stem, r"^\d{14}_", "")
    stem = F.regexp_replace(stem, r"^\d{8}[_-]?", "")
    return F.initcap(F.trim(F.regexp_replace(stem, r"[_-]+", " ")))


def origin(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^([a-zA-Z]+://[^/]+)", 1)


def url_path(url: Column) -> Column:
    """The path; ``/`` for a bare host, null for null."""
    return F.when(url.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/")))


def last_part(url: Column) -> Column:
    """The last part of the path; empty for a bare host."""
    return F.element_at(F.split(F.regexp_replace(url_path(url), "/+$", ""), "/"), -1)


def topic_name(url: Column) -> Column:
    return F.initcap(F.regexp_replace(last_part(url), "[-_]", " "))


def topic_url(base: str, topic: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(F.lower(F.trim(topic)), r"\s+", "-"))


def html_title(html: Column, url: Column) -> Column:
    """The page's title, else one from the last part of the path, else the host."""
    titled = blank_to_null(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.coalesce(titled, F.nullif(topic_name(url), F.lit("")), F.regexp_extract(url, r"^[a-zA-Z]+://([^/]+)", 1))


def text_key(text: Column, first: int | None = None) -> Column:
    """md5 of the text, or of its first characters only."""
    return F.md5((F.substring(text, 1, first) if first else text).cast("binary"))


def url_slugs(url: Column, least: int = 5) -> Column:
    """Path parts longer than ``least`` with a hyphen."""
    return F.filter(F.split(url_path(url), "/"), lambda p: (F.length(p) > least) & F.contains(p, F.lit("-")))


def topics(c: Column) -> Column:
    """Topics of a request: a JSON array, else comma- or line-separated; trimmed, without empty ones."""
    listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    split = F.when(F.contains(c, F.lit(",")), F.split(c, ",")).otherwise(F.split(c, "\n"))
    return F.filter(F.transform(F.coalesce(listed, split), lambda x: F.trim(x)), lambda x: x != "")
