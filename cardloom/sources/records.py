"""The driver's tables as raw cards: uid, rel_path, slug, type, a map of raw fields, and a body.

Each kind is given by expressions that Spark and DuckDB read alike, so that the
same cards stand on both sides of a comparison: as maps in Spark, as plain
columns in DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.sources.bridge import table


@dataclass(frozen=True)
class Kind:
    """``rows``: what to select from, in terms of which ``key`` and ``fields`` are given; ``folder`` and ``stem`` make a card's path and slug."""

    source: str
    where: str
    key: str
    folder: str
    stem: str
    fields: dict[str, str]
    body: str = "''"
    distinct: str = ""  # instead of the rows: the distinct values of this expression, as k


_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)"
_DAY = "substr(CAST({} AS STRING), 1, 10)"

KINDS = {
    "person": Kind("customer", "true", "c_custkey", "People", "customer", {
        "summary": "c_name", "first_name": "'Customer'", "last_name": "substr(c_name, 10)", "aliases": "'[Cust ' || c_custkey || ', ' || c_name || ']'",
        "emails": "'[c' || c_custkey || '@example.org, c' || (c_custkey % 50) || '@shared.org]'", "phones": "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '[+1 555 010 ' || (c_custkey % 400) || ']' END",
        "company": "c_mktsegment", "title": "CASE WHEN c_custkey % 2 = 0 THEN 'Buyer' ELSE '' END", "linkedin": "CASE WHEN c_custkey % 5 = 0 THEN 'in/C' || c_custkey || '/' ELSE '' END",
        "reports_to": "'[[Customer ' || (c_custkey % 100) || ']]'", "orgs": "'[' || c_mktsegment || ', Everyone]'", "source": "'[crm, seed]'", "source_id": "'crm-' || c_custkey",
        "created": "'2024-01-01'", "updated": "CASE WHEN c_custkey % 3 = 0 THEN '2024-02-03T04:05:06Z' ELSE '' END",
    }),
    "finance": Kind("orders", "true", "o_orderkey", "Finance", "order", {
        "summary": "'Order ' || o_orderpriority", "amount": "CASE WHEN o_orderkey % 50 = 0 THEN '-' ELSE '' END || " + _MONEY.format("o_totalprice"),
        "currency": "CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN '' ELSE 'USD' END", "transaction_type": "CASE WHEN o_orderkey % 50 = 0 THEN 'refund' ELSE 'regular' END",
        "counterparty": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'customer-' || o_custkey END", "counterparties": "'[' || o_orderpriority || ']'",
        "source_email": "CASE WHEN o_orderkey % 3 = 0 THEN '[[mail-' || (o_orderkey % 250) || '|the mail]]' ELSE '' END", "people": "'[customer-' || o_custkey || ', nobody-' || (o_orderkey % 9) || ']'",
        "source": "'[orders]'", "source_id": "'o-' || o_orderkey", "created": _DAY.format("o_orderdate"), "updated": "''",
    }, "'Paid [[customer-' || o_custkey || ']] and [[Order ' || (o_orderkey % 700) || '|that one]] or [[missing-' || (o_orderkey % 5) || ']]'"),
    "purchase": Kind("orders", "o_orderstatus = 'F'", "o_orderkey", "Purchases", "purchase", {
        "summary": "'Purchase ' || o_orderkey", "vendor": "CASE WHEN o_orderkey % 2 = 0 THEN 'SQ *' || o_orderpriority || ' Inc.' ELSE 'Amazon.com' END", "total": _MONEY.format("o_totalprice"),
        "items": "CASE WHEN o_orderkey % 7 = 0 THEN '[]' ELSE '[thing]' END", "subtotal": "'0'", "tax": "'1'", "shipping_cost": "'x'", "order_number": "'N' || o_orderkey",
        "currency": "CASE WHEN o_orderkey % 8 = 0 THEN 'EUR' ELSE 'usd' END", "source_email": "CASE WHEN o_orderkey % 3 = 0 THEN '[[mail-' || (o_orderkey % 250) || ']]' ELSE '' END",
        "source": "'[mail]'", "source_id": "'p-' || o_orderkey", "created": _DAY.format("o_orderdate + INTERVAL '1' DAY * (o_orderkey % 5)"), "updated": "''",
    }),
    "shipment": Kind("orders", "o_orderkey % 2 = 0", "o_orderkey", "Shipments", "shipment", {
        "summary": "'Shipment ' || o_orderkey", "carrier": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'UPS' END", "tracking_number": "'T' || o_orderkey",
        "linked_purchase": "CASE o_orderkey % 6 WHEN 0 THEN 'n' || o_orderkey WHEN 2 THEN '[[purchase-' || o_orderkey || ']]' ELSE '' END", "source_email": "'[[mail-' || (o_orderkey % 300) || ']]'",
        "shipped_at": _DAY.format("o_orderdate"), "source": "'[mail]'", "source_id": "'s-' || o_orderkey", "created": "'2024-01-01'", "updated": "''",
    }),
    "email_message": Kind("pages", "true", "page_id", "Email/2024-01", "mail", {
        "summary": "'Mail ' || page_id", "gmail_message_id": "'m' || page_id", "gmail_thread_id": "'t' || (page_id % 60)", "thread": "CASE WHEN page_id % 3 = 0 THEN '[[thread-' || (page_id % 60) || ']]' ELSE '' END",
        "from_email": "'C' || (page_id % 200) || '@example.org'", "from_name": "'Customer'", "to_emails": "'[c' || (page_id % 30) || '@shared.org]'",
        "participant_emails": "'[c' || (page_id % 200) || '@example.org, c' || (page_id % 30) || '@shared.org]'", "subject": "'Meet ' || (page_id % 60)", "snippet": "'Snippet  of ' || url",
        "attachments": "CASE WHEN page_id % 8 = 0 THEN '[att-' || page_id || ']' ELSE '' END", "event_id_hint": "CASE WHEN page_id % 2 = 0 THEN 'ev' || (page_id * 10) ELSE '' END",
        "calendar_events": "CASE WHEN page_id % 4 = 0 THEN '[event-' || (page_id * 10) || ']' ELSE '' END", "sent_at": "'2024-01-' || (10 + page_id % 20) || 'T10:00:00Z'",
        "people": "CASE WHEN page_id % 11 = 0 THEN '[Customer#000000000]' ELSE '' END", "has_attachments": "CASE WHEN page_id % 4 = 0 THEN 'true' ELSE 'false' END",
        "source": "'[gmail]'", "source_id": "'g-' || page_id", "created": "'2024-01-01'", "updated": "''",
    }, "coalesce(html, '')"),
    "email_thread": Kind("pages", "true", "k", "EmailThreads/2024-01", "thread", {
        "summary": "'Thread ' || k", "gmail_thread_id": "'t' || k", "subject": "'Meet ' || k || CASE WHEN k % 2 = 0 THEN ' again' ELSE '' END",
        "messages": "CASE WHEN k % 2 = 0 THEN '[mail-' || k || ', Mail ' || (k + 60) || ']' ELSE '' END", "participants": "'[c' || (k % 30) || '@shared.org]'", "account_email": "'c' || k || '@example.org'",
        "event_id_hint": "CASE WHEN k % 3 = 0 THEN 'ev' || (k * 10) ELSE '' END", "calendar_events": "''", "first_message_at": "'2024-01-10T10:00:00Z'", "last_message_at": "'2024-01-20T10:00:00Z'",
        "source": "'[gmail]'", "source_id": "'gt-' || k", "created": "'2024-01-01'", "updated": "''",
    }, distinct="page_id % 60"),
    "email_attachment": Kind("pages", "page_id % 4 = 0", "page_id", "EmailAttachments/2024-01", "att", {
        "summary": "'Attachment ' || page_id", "gmail_message_id": "'m' || page_id", "gmail_thread_id": "'t' || (page_id % 60)", "filename": "page_id || '.pdf'", "mime_type": "'application/pdf'",
        "size_bytes": "'10'", "is_inline": "'false'", "attachment_id": "'a' || page_id", "source": "'[gmail]'", "source_id": "'ga-' || page_id", "created": "'2024-01-01'", "updated": "''",
    }),
    "calendar_event": Kind("events", "event_type = 'signup'", "event_id", "Calendar/2024-01", "event", {
        "summary": "'Meet ' || (user_id % 60)", "title": "'Meet ' || (user_id % 60)", "event_id": "'ev' || event_id", "ical_uid": "'ical' || event_id", "status": "'confirmed'",
        "start_at": "CAST(ts AS STRING)", "end_at": "''", "timezone": "'UTC'", "organizer_email": "'c' || user_id || '@example.org'",
        "attendee_emails": "'[c' || (user_id % 30) || '@shared.org, none@example.org]'", "all_day": "'false'", "location": "CASE WHEN event_id % 5 = 0 THEN 'Room ' || (user_id % 7) ELSE '' END",
        "source_messages": "CASE WHEN event_id % 20 = 0 THEN '[mail-' || (event_id % 250) || ']' ELSE '' END", "source_threads": "''", "meeting_transcripts": "''", "people": "'[Customer#00000000' || (user_id % 9) || ']'",
        "source": "'[calendar]'", "source_id": "'ce-' || event_id", "created": "'2024-01-01'", "updated": "''",
    }),
    "meeting_transcript": Kind("events", "event_type = 'view' AND event_id % 5 = 0", "event_id", "Transcripts/2024-01", "transcript", {
        "summary": "'Transcript ' || event_id", "title": "'Meet ' || (user_id % 60)", "start_at": "CAST(ts AS STRING)", "end_at": "''", "event_id_hint": "CASE WHEN event_id % 3 = 0 THEN 'ical' || (event_id + 1) ELSE '' END",
        "participant_emails": "'[c' || user_id || '@example.org]'", "calendar_events": "''", "otter_meeting_id": "'om' || event_id", "duration_seconds": "'60'",
        "source": "'[otter]'", "source_id": "'mt-' || event_id", "created": "'2024-01-01'", "updated": "''",
    }, "'# A' || chr(10) || 'x' || chr(10) || '# B' || chr(10) || 'Ann: hello' || chr(10) || 'Bob: yes ' || event_id"),
    "media_asset": Kind("events", "event_type = 'click' AND event_id % 9 = 0", "event_id", "Photos/2024-01", "photo", {
        "summary": "'Photo of Meet ' || (user_id % 60)", "captured_at": "CAST(ts AS STRING)", "person_labels": "'[Customer#00000000' || (user_id % 9) || ', Cust ' || user_id || ']'",
        "place_name": "CASE WHEN event_id % 2 = 0 THEN 'Room ' || (user_id % 7) ELSE '' END", "photos_asset_id": "'ph' || event_id", "width": "'10'", "height": "'x'", "favorite": "'true'",
        "source": "'[photos]'", "source_id": "'ma-' || event_id", "created": "'2024-01-01'", "updated": "''",
    }),
    "document": Kind("documents", "true", "doc_id", "Documents", "document", {
        "summary": "substr(text, 1, 40)", "title": "lang || ' text'", "description": "CASE WHEN doc_id % 3 = 0 THEN 'From ' || source ELSE '' END", "library_root": "source", "relative_path": "source || '/' || doc_id", "extension": "'txt'",
        "page_count": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE '1' END", "authors": "'[customer-' || (doc_id % 50) || ']'", "emails": "''", "document_date": "'2024-03-01'", "source": "'[files, ' || source || ']'",
        "source_id": "'d-' || doc_id", "created": "'2024-01-01'", "updated": "''",
    }, "coalesce(text, '')"),
}


def records(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The cards of ``kinds`` (all if none is named)."""
    parts = []
    for name in kinds or KINDS:
        k = KINDS[name]
        rows = table(spark, sf_dir, k.source).filter(k.where)
        rows = rows.selectExpr(f"{k.distinct} AS k").distinct() if k.distinct else rows
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if "ts" in rows.columns else rows
        fields = F.create_map(*(c for n, e in k.fields.items() for c in (F.lit(n), F.expr(e))))
        parts.append(rows.select(
            F.expr(f"'card-{name}-' || {k.key}").alias("uid"), F.expr(f"'{k.folder}/{k.stem}-' || {k.key} || '.md'").alias("rel_path"), F.expr(f"'{k.stem}-' || {k.key}").alias("slug"),
            F.lit(name).alias("type"), fields.alias("fields"), F.expr(k.body).alias("body"),
        ))
    return reduce(DataFrame.unionByName, parts)


def record_sql(*kinds: str) -> str:
    """Named DuckDB subqueries, one for each kind, with a column for each field."""
    out = []
    for name in kinds or KINDS:
        k = KINDS[name]
        rows = f"(SELECT DISTINCT {k.distinct} AS k FROM {k.source} WHERE {k.where})" if k.distinct else f"{k.source} WHERE {k.where}"
        fields = ", ".join(f'{e} AS "{n}"' for n, e in k.fields.items())
        # the fields' names hide columns of the table, which they are made of
        out.append(f"{name} AS (SELECT 'card-{name}-' || {k.key} AS uid, '{k.folder}/{k.stem}-' || {k.key} || '.md' AS rel_path, '{k.stem}-' || {k.key} AS slug, '{name}' AS \"type\", {fields}, {k.body} AS body FROM {rows})")
    return ", ".join(out)
