"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphreel.llm import pii, suffixes, urlrules
from glyphreel.llm.bpe import digests, op10_bpe
from glyphreel.llm.common import table
from glyphreel.llm.decontaminate import op3_decontaminate
from glyphreel.llm.htmltext import op9_html_text
from glyphreel.llm.langid import op5_langid
from glyphreel.llm.media import op6_media
from glyphreel.llm.pii import op7_pii
from glyphreel.llm.simhash import op4_simhash
from glyphreel.llm.suffixes import op8_suffix_dedup
from glyphreel.llm.toxicity import op1_toxicity
from glyphreel.llm.urlrules import op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_langid": op5_langid,
    "op6_media": op6_media,
    "op7_pii": op7_pii,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_text": op9_html_text,
    "op10_bpe": op10_bpe,
}



def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 reads back, by size and digest: the columns that SQL can express."""
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op7: the columns that SQL can express."""
    return op7_pii(spark, sf_dir).drop("spans")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what op10's ids decode to. Texts are dealt over the tasks: to encode them costs much more than to move them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return digests(docs.repartition(n, "doc_id")).select("doc_id", "decoded_sha256")


QUERIES |= {"media_payload": media_payload, "pii_base": pii_base, "bpe_round_trip": bpe_round_trip}

#: For the queries that SQL can express whole; the others are held to brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": urlrules.SQL,
    "op8_suffix_dedup": suffixes.SQL,
    "media_payload": """with p as (select doc_id, encode(coalesce(text, '')) as x, octet_length(x) as n_bytes, greatest(64, (n_bytes + 63) // 64 * 64) as payload_bytes from documents)
select doc_id, n_bytes, payload_bytes, sha256(unhex(hex(x) || repeat('00', payload_bytes - n_bytes))) as payload_sha256 from p""",
    "pii_base": pii.BASE_SQL,
    "bpe_round_trip": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents",
}
