"""Citations as expressions over bibliographic columns. Dates come as parameters, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftbase.functions.text import display_title


def _initials(given: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(given, F.lit("")), r"[\s.-]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), "")


def apa(authors: Column, year: Column, title: Column, journal: Column, volume: Column, issue: Column, pages: Column, doi: Column) -> Column:
    """APA style: ``authors`` is array<struct<family, given>>; at most six are named, then et al."""
    name = lambda a: F.when(_initials(a["given"]) != "", F.concat(a["family"], F.lit(", "), _initials(a["given"]))).otherwise(a["family"])
    n = F.coalesce(F.size(authors), F.lit(0))
    named = F.transform(F.slice(authors, 1, 6), name)
    who = (
        F.when(n <= 0, F.lit(None).cast("string"))
        .when(n == 1, F.get(named, F.lit(0)))
        .when(n > 6, F.concat(F.array_join(named, ", "), F.lit(", et al.")))
        .otherwise(F.concat(F.array_join(F.slice(named, F.lit(1), n - 1), ", "), F.lit(", & "), F.element_at(named, -1)))
    )
    date = F.concat(F.lit("("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")."))
    number = F.concat(volume, F.coalesce(F.concat(F.lit("("), issue, F.lit(")")), F.lit("")))
    place = F.when(journal.isNotNull(), F.concat(F.concat_ws(", ", F.concat(F.lit("<em>"), journal, F.lit("</em>")), number, pages), F.lit(".")))
    link = F.concat(F.lit("https://doi.org/"), doi)
    return F.concat_ws(" ", who, date, F.concat(title, F.lit(".")), place, link)


def plain(authors: Column, year: Column, title: Column, journal: Column, volume: Column, issue: Column, pages: Column, doi: Column) -> Column:
    """authors. title. journal (year) volume(issue) :pages DOI."""
    dot = lambda c: F.concat(c, F.lit("."))
    bracket = lambda c: F.concat(F.lit("("), c.cast("string"), F.lit(")"))
    number = F.concat(volume, F.coalesce(bracket(issue), F.lit("")))
    return F.concat_ws(" ", dot(authors), dot(title), journal, bracket(year), number, F.concat(F.lit(":"), pages), F.concat(F.lit("https://doi.org/"), doi))


def from_columns(authors: Column, year: Column, title: Column, journal: Column, doi: Column, label: str = "PDF Document") -> Column:
    """The full form with authors, journal and year; else the title with ``label``. The DOI link follows."""
    full = F.concat(authors, F.lit(" ("), year.cast("string"), F.lit("). "), title, F.lit(". "), journal, F.lit("."))
    basic = F.concat(title, F.lit(f". ({label})"))
    complete = authors.isNotNull() & journal.isNotNull() & year.isNotNull()
    return F.concat_ws(" ", F.when(complete, full).otherwise(basic), F.concat(F.lit("https://doi.org/"), doi))


def from_filename(filename: Column, retrieved_on: str) -> Column:
    """``Author2020``, ``title_2020`` or ``title-2020``; any other name is undated."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", ""), r"^\d{14}_", "")
    year = F.regexp_extract(stem, r"((?:19|20)\d{2})(?!\d)", 1)
    author = F.regexp_extract(stem, r"^([A-Za-z]+)(?:19|20)\d{2}(?!\d)", 1)
    title = display_title(F.regexp_replace(F.concat(F.lit("x_"), stem), r"^x_", ""))
    who = F.when(author != "", F.initcap(author)).otherwise(title)
    return F.concat(who, F.lit(" ("), F.coalesce(F.nullif(year, F.lit("")), F.lit("n.d.")), F.lit("). Retrieved "), F.lit(retrieved_on))


def website(title: Column, url: Column, retrieved_on: str) -> Column:
    """Organisation (from the host), year, title, retrieval date and URL."""
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://([^/]+)", 1), r"^www\.", "")
    labels = F.split(host, r"\.")
    who = F.array_join(F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda x: F.initcap(x)), " ")
    return F.concat(who, F.lit(f". ({retrieved_on[:4]}). "), title, F.lit(f". Retrieved {retrieved_on}, from "), url)


def shown_title(title: Column, authors: Column, journal: Column) -> Column:
    """``first author et al. - journal`` where the journal is known and does not begin the title already."""
    lead = F.concat(F.split(authors, ";")[0], F.lit(" et al. - "), journal)
    return F.when(journal.isNotNull() & authors.isNotNull() & ~F.coalesce(F.startswith(title, journal), F.lit(False)), lead).otherwise(title)


def author_list(authors: Column) -> Column:
    """``family, given`` joined by semicolons, from array<struct<family, given>>."""
    return F.array_join(F.transform(authors, lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")


def source_citation(citation: Column, formatted: Column, record: Column, title: Column, doi: Column, text: Column, is_web: Column, url: Column, page: Column) -> Column:
    """The first of: stored citation, formatted citation, record of the DOI (joined beforehand), title with
    DOI link, DOI found in the text, the title. Websites: title, page and URL."""
    from weftbase.functions.doi import extract

    link = lambda d: F.concat(title, F.lit(". https://doi.org/"), d)
    pdf = F.coalesce(citation, formatted, record, link(doi), link(extract(text)), title)
    web = F.concat(F.lit("Website: "), title, F.coalesce(F.concat(F.lit(" (Page "), page.cast("string"), F.lit(")")), F.lit("")), F.lit(" - "), url)
    return F.when(is_web, web).otherwise(pdf)


def with_pages(citation: Column, pages: Column) -> Column:
    """`` (page n)`` or `` (pages a, b)`` after a citation that has no such suffix; ``pages``: array<string>."""
    suffix = F.when(F.size(pages) == 1, F.concat(F.lit(" (page "), F.get(pages, F.lit(0)), F.lit(")"))).when(F.size(pages) > 1, F.concat(F.lit(" (pages "), F.array_join(pages, ", "), F.lit(")"))).otherwise(F.lit(""))
    return F.when(F.instr(citation, "(page") == 0, F.concat(citation, suffix)).otherwise(citation)
