"""DOIs: finding them in text, cleaning, join keys, and the fields of work records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a DOI looks like and how it is labelled, in the order in which the patterns are tried (the
# order decides which of several DOIs is found). Group 1 is the DOI.
LOOSE = (
    r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b",
    r"(?i)doi:?\s*(10\.\d{4,9}/[-._;()/:A-Z0-9]+)",
    r"https?://doi\.org/(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)",
)
STRICT = (
    r"(?i)doi\.org/(10\.\d{4,9}/[^\s()<>\"]+)",
    r"(?i)doi[:=\s]+(10\.\d{4,9}/[^\s()<>\"]+)",
    r"(?i)(?:digital object identifier|d\.o\.i\.)[:=\s]+(10\.\d{4,9}/[^\s()<>\"]+)",
    r"(?i)\((10\.\d{4,9}/[^\s()<>\"]+)\)",
    r"(?i)(10\.\d{4,9}/[^\s()<>\"]+)",
)
LABEL = r"(?i)^(doi|digital object identifier|d\.o\.i\.)[:=\s]*"
INNER = r"10\.\d+/[^\s\"'<>)]+"


def extract(text: Column, patterns: tuple[str, ...] = STRICT) -> Column:
    """The first DOI by the first pattern that matches; null if none does. Texts without ``10.`` are not scanned."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
    return F.when(F.contains(text, F.lit("10.")), F.regexp_replace(found, r"[.,;:]+$", ""))


def clean(doi: Column) -> Column:
    """Without brackets round it, resolver or label before it and punctuation after it. If that does not begin
    ``10.``, the first DOI within it; null if there is none."""
    c = F.regexp_replace(F.trim(doi), r"^\(|\)$", "")
    c = F.regexp_replace(c, r"(?i)^(https?://)?(dx\.)?doi\.org/", "")
    c = F.regexp_replace(c, LABEL, "")
    c = F.regexp_replace(c, r"[.,;:]+$", "")
    return F.when(F.startswith(c, F.lit("10.")), c).otherwise(F.nullif(F.regexp_replace(F.regexp_extract(c, INNER, 0), r"[.,;:]+$", ""), F.lit("")))


def join_key(doi: Column) -> Column:
    return F.lower(clean(doi))


def first_of_document(chunks: DataFrame) -> DataFrame:
    """document_id, doi: the first DOI in chunk order."""
    found = chunks.withColumn("doi", extract(F.col("text_content"))).filter("doi is not null")
    return found.groupBy("document_id").agg(F.min_by("doi", "chunk_index").alias("doi"))


def first_of_pages(pages: DataFrame, reference_pages: int = 5) -> DataFrame:
    """document_id, doi: page 1 and pages of references among the first few count with their whole text,
    other pages with their headers and footers only; the first page with a DOI wins."""
    refs = (F.col("page_number") <= reference_pages) & F.col("text").rlike(r"(?i)\b(references|bibliography)\b")
    whole = F.when((F.col("page_number") == 1) | refs, F.col("text")).otherwise(F.concat_ws("\n", "header_text", "footer_text"))
    found = pages.withColumn("doi", extract(whole, LOOSE)).filter("doi is not null")
    return found.groupBy("document_id").agg(F.min_by("doi", "page_number").alias("doi"))


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def work_fields(works: DataFrame) -> DataFrame:
    """Bibliographic fields of work records (columns DOI, title, container_title: array<string>; author:
    array<struct<family, given>>; year_print, year_online, year_created: int; volume, issue, page)."""
    name = lambda a: F.concat_ws(", ", a["family"], a["given"])
    return works.select(
        join_key(F.col("DOI")).alias("doi"), _first(F.col("title")).alias("title"), _first(F.col("container_title")).alias("journal"),
        F.array_join(F.transform("author", name), "; ").alias("authors"), F.coalesce("year_print", "year_online", "year_created").alias("publication_year"),
        "volume", "issue", F.col("page").alias("pages"),
    )


def datacite_fields(works: DataFrame) -> DataFrame:
    """The same fields of records in DataCite's shape (columns DOI; titles: array<struct<title>>; container:
    struct<title>; creators: array<struct<name>>; publicationYear: int; dates: array<struct<date, dateType>>).
    Without a publication year, the year of the first date of type ``Issued`` counts."""
    issued = F.get(F.filter("dates", lambda d: (d["dateType"] == "Issued") & d["date"].isNotNull()), F.lit(0))["date"]
    none = F.lit(None).cast("string")
    return works.select(
        join_key(F.col("DOI")).alias("doi"), _first(F.filter("titles", lambda t: t["title"].isNotNull()))["title"].alias("title"), F.col("container.title").alias("journal"),
        F.array_join(F.transform("creators", lambda c: c["name"]), "; ").alias("authors"), F.coalesce("publicationYear", F.substring(issued, 1, 4).try_cast("int")).alias("publication_year"),
        none.alias("volume"), none.alias("issue"), none.alias("pages"),
    )


def enrich(documents: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Documents (id, doi) with the fields of the primary record of their DOI, or of the fallback where the
    primary source has none. Rows without a DOI stay, without fields; two equi-joins, no lookups per row."""
    fields = ["title", "journal", "authors", "publication_year", "volume", "issue", "pages"]
    rows = documents.select("id", join_key(F.col("doi")).alias("doi"))
    keyed = rows.filter("doi is not null")
    one = primary.dropDuplicates(["doi"]).select("doi", F.struct(*fields).alias("p"))
    two = fallback.dropDuplicates(["doi"]).select("doi", F.struct(*fields).alias("f"))
    found = keyed.join(one, "doi", "left").join(two, "doi", "left").withColumn("w", F.coalesce("p", "f"))
    found = found.select("id", "doi", *[F.col(f"w.{c}").alias(c) for c in fields], F.when(F.col("p").isNotNull(), "primary").when(F.col("f").isNotNull(), "fallback").alias("found_in"))
    rest = rows.filter("doi is null")
    return found.unionByName(rest, allowMissingColumns=True)
