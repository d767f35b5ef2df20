"""The given tables as raw messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.functions.text import quote
from lumenward.sources.tables import as_raw_messages
from workload.phrases import PHRASES, SHORT_TEXTS

SOURCES = ("family-link", "screen-time", "youtube-data-api", "comment-moderation-api", "android-accessibility",
           "device-notification", "manual", "scraping", "")


def _pick(values, index: str) -> str:
    listed = ", ".join("NULL" if v is None else quote(v) for v in values)
    return f"element_at(array({listed}), cast({index} AS int) + 1)"


def _dressed(key: str) -> str:
    """The whole text between two phrases."""
    n = len(PHRASES)
    front = _pick(PHRASES, f"{key} % {n}")
    back = _pick(PHRASES, f"({key} * 7 + {key} div {n} + 11) % {n}")
    return f"concat({front}, ' ', text, '. ', {back})"


# Minutes from the beginning of 2024 on; all messages lie in the past, whatever their number.
MINUTE = "(conv_id * 90 + turn) % 720000"


def _conversation_time() -> str:
    """The message's time in one of the forms that turn up, or none."""
    at = f"timestampadd(MINUTE, {MINUTE}, TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    seconds = f"(1704067200 + ({MINUTE}) * 60)"
    text = """date_format({}, "yyyy-MM-dd'T'HH:mm:ss")"""
    ahead = text.format(f"timestampadd(HOUR, 2, {at})")
    forms = ("NULL", "'yesterday'", f"cast({seconds} AS string)", f"cast({seconds} * 1000 AS string)",
             f"concat({ahead}, '+02:00')", text.format(at), "'2999-01-01T00:00:00Z'")
    cases = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms))
    return f"CASE (conv_id * 5 + turn) % 17 {cases} ELSE concat({text.format(at)}, 'Z') END"


# SQL expressions of the message fields, by table; the oracle has its own.
DOCUMENT_FIELDS = {
    "id": "if(doc_id % 11 = 0, NULL, concat('d', doc_id))",
    "text": f"if(doc_id % 5 = 0, '', {_dressed('doc_id')})",
    "content": f"if(doc_id % 5 = 0, {_dressed('doc_id')}, 'unused')",
    "direction": _pick(("incoming", "outgoing", "OUTGOING", None), "doc_id % 4"),
    "senderRelationship": _pick(("mutual", "not-mutual", "unknown", "bogus", None), "doc_id div 3 % 5"),
    "platform": _pick(("instagram", "", None), "doc_id % 3"),
    "source": _pick((*SOURCES, None), "doc_id % 10"),
    "timestamp": "concat(date_format(timestampadd(MINUTE, doc_id * 37, TIMESTAMP_NTZ'2024-01-01 00:00:00'),"
                 """ "yyyy-MM-dd'T'HH:mm:ss"), 'Z')""",
}
CONVERSATION_FIELDS = {
    "id": "concat('c', conv_id, '-', turn)",
    "text": _dressed("(conv_id * 5 + turn)"),
    "direction": "if(role = 'user', 'outgoing', 'incoming')",
    "senderRelationship": _pick(("mutual", "not-mutual", "unknown"), "conv_id % 3"),
    "platform": "'chat'",
    "source": "if((conv_id * 3 + turn) % 13 = 0, 'scraping', 'family-link')",
    "timestamp": _conversation_time(),
}
# A short message of each kind before a whole text, the text without its letters, or its blanks.
_KIND = _pick((*PHRASES, *SHORT_TEXTS), f"doc_id % {len(PHRASES) + len(SHORT_TEXTS)}")
PHRASE_FIELDS = {
    "text": f"concat({_KIND}, ' ', CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '\\\\p{{L}}+', '')"
            " ELSE regexp_replace(text, '[^ \\\\n]+', ' ') END)"}

DOCUMENT_KEY = ("doc_id",)
CONVERSATION_KEY = ("conv_id", "turn")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without anything put around them."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return as_raw_messages(table, DOCUMENT_FIELDS, DOCUMENT_KEY)


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations")
    return as_raw_messages(table, CONVERSATION_FIELDS, CONVERSATION_KEY)


def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language labels for the documents in ``labels``, none for those of low quality.

    Every third document has a second row of candidates, some codes are empty or
    null, and some rows have no id."""
    table = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rated = table.join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    first = rated.selectExpr(
        "if(doc_id % 29 = 0, NULL, concat('d', doc_id)) AS id",
        """if(quality = 0, cast(array() AS array<struct<code:string,score:double>>), array(
             named_struct('code', 'pt-BR', 'score', (doc_id % 100) / 100D),
             named_struct('code', upper(lang), 'score', (n_chars % 97) / 100D),
             named_struct('code', concat(lang, '-XX'), 'score', (doc_id % 100) / 100D))) AS candidates""")
    second = rated.where("doc_id % 3 = 0").selectExpr(
        "concat('d', doc_id) AS id",
        """array(named_struct('code', case doc_id % 4 when 0 then '' when 1 then cast(null as string) else 'it-IT' end,
             'score', (doc_id % 89) / 100D)) AS candidates""")
    return first.unionByName(second)
