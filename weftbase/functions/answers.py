"""Answers with numbered sources: reading the marks, renumbering, tidying."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = r"\[(\d+)\]"


def cited(answer: Column) -> Column:
    """Distinct cited numbers in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(MARK), F.lit(1)), lambda x: x.cast("int")))


def tidy(answer: Column) -> Column:
    """Without a closing list of sources; blank lines collapsed; [a][a] as one mark, [a][b] apart."""
    c = F.regexp_replace(answer, r"(?is)\n\s*(\*\*)?(sources|references)(\*\*)?\s*:.*$", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(\[\d+\])(?:\1)+", "$1")
    return F.trim(F.regexp_replace(c, r"\]\[", "] ["))


def new_numbers(answer: Column, titles: Column) -> Column:
    """map<int, int> from cited numbers that have a source to 1, 2, ... in ascending order, one number for
    sources of the same title. ``titles``: the sources' titles in order."""
    known = F.array_sort(F.filter(cited(answer), lambda k: (k >= 1) & (k <= F.size(titles))))
    named = F.transform(known, lambda k: F.element_at(titles, k))
    order = F.array_distinct(named)
    return F.map_from_arrays(known, F.transform(named, lambda t: F.array_position(order, t).cast("int")))


def renumbered(answer: Column, titles: Column) -> Column:
    """The answer with its marks renumbered all at once; marks without a source go."""
    new = new_numbers(answer, titles)
    texts = F.split(answer, r"\[\d+\]", -1)
    marks = F.transform(F.regexp_extract_all(answer, F.lit(MARK), F.lit(1)), lambda x: F.try_element_at(new, x.cast("int")))
    pieces = F.zip_with(texts, marks, lambda t, m: F.concat(t, F.coalesce(F.concat(F.lit("["), m.cast("string"), F.lit("]")), F.lit(""))))
    return F.array_join(pieces, "")


def source_key(source_type: Column, title: Column, url: Column, page: Column, key: Column) -> Column:
    """What makes two sources the same: the title of a pdf, URL and page of a website, else the entry itself."""
    return F.when(source_type == "pdf", F.concat(F.lit("pdf:"), title)).when(source_type == "website", F.concat(F.lit("web:"), url, F.lit("#"), F.coalesce(page.cast("string"), F.lit("")))).otherwise(F.concat(F.lit("id:"), key))
