"""Column lists of the knowledge base's tables."""

from __future__ import annotations

DOCUMENTS = (
    "id int, filename string, title string, file_type string, source_url string, file_path string, file_size int, page_count int, "
    "created_at timestamp, updated_at timestamp, processed boolean, processing_state string, doi string, authors string, journal string, "
    "publication_year int, volume string, issue string, pages string, formatted_citation string"
)
CHUNKS = "id int, document_id int, chunk_index int, page_number int, text_content string, created_at timestamp"
COLLECTIONS = "id int, name string, description string, created_at timestamp, updated_at timestamp"
COLLECTION_DOCS = "collection_id int, document_id int"
ENTRIES = "entry_id string, pos long, text string, embedding array<float>, metadata map<string,string>"
PROCESSING_STATE = "total_chunks int, processed_chunks int, status string"
WORKS = (
    "DOI string, title array<string>, container_title array<string>, author array<struct<family:string,given:string>>, "
    "year_print int, year_online int, year_created int, volume string, issue string, page string"
)
PAGES = "page_id long, url string, html string"
PDF_PAGES = "document_id int, page_number int, text string, header_text string, footer_text string"
PROGRESS = "timestamp timestamp, vector_chunks long, progress_percent double, processing_rate double, bottlenecks array<string>, run_id string"
ERRORS = "timestamp timestamp, error_type string, message string, document_id int, traceback string, recoverable boolean"
RESOURCES = "ts timestamp, host string, cpu_percent double, memory_percent double, process_memory_mb double"
ANSWERS = (
    "answer_id long, query string, answer string, "
    "sources array<struct<doc_id:int,source_type:string,title:string,url:string,page_number:int,page:string,citation:string>>"
)
BATCH_RESULTS = "chunk_id long, success boolean, time_taken double, error string"

#: Metadata keys of an entry that are numbers; a value that is none counts as missing.
INTEGER_KEYS = ("chunk_id", "db_id", "document_id", "chunk_index", "page", "page_number", "publication_year")
TEXT_KEYS = ("source_type", "file_type", "filename", "file_path", "title", "document_title", "url", "source_url", "doi", "citation", "formatted_citation", "authors", "journal", "volume", "issue", "pages", "date_scraped", "extraction_method")
