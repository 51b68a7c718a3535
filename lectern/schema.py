"""Row types of the engine's tables and its fixed vocabularies."""

from __future__ import annotations

WORKS = "work_id string, title string, author string, source_class string, publication_year int, word_count bigint, genre_tags array<string>, subject_headings array<string>, source_metadata string, ingestion_date date"
CHUNKS = "chunk_id bigint, work_id string, text string, annotation string, granularity string, source_class string, chapter string, section_type string, position bigint, parent_chunk_id bigint, pass_number int, metadata string"
EMBEDDINGS = "chunk_id bigint, embedding array<float>, provider string, model string"
NODES = "label string, key string, name string"
EDGES = "src string, type string, dst string, link_type string, confidence string, score double"
CAPTURES = "user_id bigint, capture_id bigint, ts timestamp_ntz, work_id string, themes array<string>"
DOC_NODES = "doc_id string, node_id int, parent_id int, ord int, depth int, node_type string, section_type string, text string"

# Fixed values.
SOURCE_CLASSES = ("primary", "secondary", "tertiary", "contextual", "personal", "reference")
GRANULARITIES = ("macro", "meso", "micro", "nano")
ENTITY_EDGES = ("EXPLORES_THEME", "MAKES_ARGUMENT", "ATTRIBUTED_BY_CRITIC", "CONCEPT_USED_IN", "REFERENCES_PERSON")
STRUCTURAL_SECTIONS = ("toc", "index", "bibliography", "front_matter")
CONTENT_SECTIONS = ("chapter", "preface", "back_matter")
ROUTABLE_SECTIONS = ("index", "bibliography")
ROUTES = {"primary": "full_pipeline", "secondary": "critical_pipeline", "tertiary": "metadata_only", "contextual": "context_pipeline", "personal": "reflection_pipeline", "reference": "lookup_pipeline"}
CONFIDENCE_RANK = {"high": 1, "medium": 2, "low": 3}
VAULT_FOLDERS = {"book": "books", "video": "videos", "audio": "audio", "podcast": "podcasts", "article": "articles"}
LANGUAGES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "lat": "la"}
#: Question type: limits of the first and third pass, weights of vectors and words, preferred granularity.
STRATEGIES = {
    "factual": (15, 5, 0.6, 0.4, "micro"),
    "thematic": (20, 10, 0.7, 0.3, "macro"),
    "generative": (20, 10, 0.8, 0.2, "meso"),
    "quote": (15, 10, 0.3, 0.7, "micro"),
}
STOP_WORDS = (
    "that this with from have been were will would could should their there these those "
    "which what when where about into than them then some such also more most very "
    "just over only even each much many does being other after before between through "
    "under during without however another because"
).split()
