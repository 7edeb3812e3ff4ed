"""Schemas. JSON corpora must be read with these: inference would turn every personal value into a column name."""

from __future__ import annotations

CORPUS = "id string, lang string, source string, text string, expected map<string,string>, must_preserve array<string>, tokens_estimate int"
PART = "struct<type:string,text:string,image_url:struct<url:string>>"
CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
#: content is a string, a list or null in the source: it is read as raw JSON and split afterwards.
STRUCTURED_RAW = f"id string, lang string, source string, expected map<string,string>, messages array<struct<role:string,content:string,tool_calls:array<{CALL}>>>"
LABELS = "id string, lang string, expected map<string,string>"
WRAPPED_LABELS = f"_about string, source_dataset string, labels array<struct<{', '.join(x.replace(' ', ':', 1) for x in LABELS.split(', '))}>>"
MASKED = "id string, source_text string, privacy_mask array<struct<label:string,value:string>>"
TERMS = "term string, type string"
TIMINGS = "config string, doc_id string, run int, ms double"
