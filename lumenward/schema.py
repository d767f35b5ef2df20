"""Schemas of messages and results."""

from __future__ import annotations

# Every field is text on input; nothing is inferred.
RAW_FIELDS = ("id", "text", "content", "direction", "senderRelationship", "platform", "source", "timestamp")
RAW_SCHEMA = ", ".join(f"{name} string" for name in RAW_FIELDS)

LANGUAGE_COLUMNS = ("language", "languageName", "languageConfidence")

HIT_TYPE = "struct<ord:int,category:string,signal:string,lang:string,weight:double,start:int,end:int>"
FINDING_TYPE = (
    "struct<category:string,label:string,confidence:double,language:string,languageName:string,"
    "excerpt:string,signals:array<string>,senderRelationship:string,direction:string>"
)
CANDIDATES_SCHEMA = "id string, candidates array<struct<code:string,score:double>>"
