"""Declared schemas for the paper shapes and landed payloads."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

AUTHOR_INFO = T.StructType([
    T.StructField("fullname", S),
    T.StructField("institution", S),
])

# One paper as stored in a dataset file: the union of the feed (sub-conference)
# form and the JSON-API (main conference) form.  Fields absent in a file are NULL.
PAPER = T.StructType([
    # feed form
    T.StructField("title", S),
    T.StructField("abstract", S),
    T.StructField("url", S),
    T.StructField("id", S),
    T.StructField("pdf", S),
    T.StructField("authors", T.MapType(S, S)),
    T.StructField("pmlr_pdf", S),
    T.StructField("github_url", S),
    T.StructField("conf_info", S),
    T.StructField("supplemental", S),
    # JSON-API form
    T.StructField("name", S),
    T.StructField("author", T.MapType(S, AUTHOR_INFO)),
    T.StructField("keywords", T.ArrayType(S)),
    T.StructField("topic", S),
    T.StructField("session", S),
    T.StructField("event_type", S),
    T.StructField("virtualsite_url", S),
    T.StructField("paper_url", S),
    T.StructField("paper_pdf_url", S),
    T.StructField("sourceurl", S),
    # saved-search annotations
    T.StructField("metric_match", T.DoubleType()),
    T.StructField("metric_thres", T.DoubleType()),
    T.StructField("conference", S),
])

AUTHOR_ROW = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("name", S),
    T.StructField("institution", S),
])

# JSON API payload of a main conference.
API_AUTHOR = T.StructType([T.StructField("fullname", S), T.StructField("institution", S)])
API_RESULT = T.StructType([
    T.StructField("id", S),
    T.StructField("name", S),
    T.StructField("authors", T.ArrayType(API_AUTHOR)),
    T.StructField("abstract", S),
    T.StructField("keywords", T.ArrayType(S)),
    T.StructField("topic", S),
    T.StructField("session", S),
    T.StructField("event_type", S),
    T.StructField("virtualsite_url", S),
    T.StructField("url", S),
    T.StructField("paper_url", S),
    T.StructField("paper_pdf_url", S),
    T.StructField("sourceurl", S),
])
API_PAYLOAD = T.StructType([
    T.StructField("count", T.LongType()),
    T.StructField("results", T.ArrayType(API_RESULT)),
])

# Fields of the API result copied into a paper (order as stored).
API_PAPER_FIELDS = ("id", "name", "author", "abstract", "keywords", "topic", "session",
                    "event_type", "virtualsite_url", "url", "paper_url", "paper_pdf_url",
                    "sourceurl")

# Searchable fields and scorers offered by the search front end (fixed values).
SEARCH_FIELDS = ("title", "keywords", "topic", "abstract")
SEARCH_MODELS = ("Fuzzy", "Cosine", "Word2Vec", "Marco", "Specter")

# Conference lists (fixed values).
MAIN_CONFERENCES = ("ICML", "ICLR", "NEURIPS")
SUB_CONFERENCES = ("COLT", "AISTATS", "AAAI", "CHIL", "ML4H", "ICCV", "ECCV")
