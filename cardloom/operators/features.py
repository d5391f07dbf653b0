"""What is read off a card besides its typed table: identifiers, relations, hashes, slugs, lookups and edges.

Cards have uid, rel_path, slug, type, fields (a map of raw values) and body.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cardloom.functions.normalize import clean, email, handle, slug, wikilinks
from cardloom.operators.projections import raw
from cardloom.sources.notes import items

# Fields that hold identifiers, by provider; those of LISTS hold several.
PROVIDERS = {
    "canonical": ("source_id",), "gmail": ("gmail_thread_id", "gmail_message_id", "gmail_history_id"), "email": ("message_id_header",), "attachment": ("attachment_id", "content_id"),
    "calendar": ("calendar_id", "event_id", "event_etag", "ical_uid", "invite_ical_uid", "invite_event_id_hint", "event_id_hint"), "imessage": ("imessage_chat_id", "imessage_message_id"),
    "beeper": ("beeper_room_id", "beeper_event_id"), "photos": ("photos_asset_id",), "otter": ("otter_meeting_id", "otter_conversation_id"),
    "github_repo": ("repository_id", "repository_name_with_owner"), "github_commit": ("commit_sha", "review_commit_sha", "original_commit_sha"), "github_thread": ("github_thread_id",),
    "github_message": ("github_message_id",), "github_thread_number": ("number",), "medical_encounter": ("encounter_source_id",), "booking": ("confirmation_code",), "shipping": ("tracking_number",),
    "purchase": ("order_number",),
}
LISTS = {
    "calendar": ("invite_ical_uids", "invite_event_id_hints"), "github_commit": ("parent_shas",), "github_thread_number": ("associated_pr_numbers",), "github_pr": ("associated_pr_urls",),
}
# Fields that relate a card to others, and those that hold a person's handles.
RELATIONS = (
    "people", "orgs", "reports_to", "messages", "attachments", "calendar_events", "meeting_transcripts", "source_messages", "source_threads", "thread", "message", "repository", "source_email",
    "linked_purchase", "evidence_uids",
)
HANDLES = ("linkedin", "github", "twitter", "instagram", "telegram", "discord")


def _identifiers(fields: Column) -> Column:
    """(field_name, provider, external_id) of every identifier, single ones first."""
    row = lambda f, p, v: F.struct(F.lit(f).alias("field_name"), F.lit(p).alias("provider"), v.alias("external_id"))
    one = F.array(*(row(f, p, F.trim(raw(fields, f))) for p, names in PROVIDERS.items() for f in names))
    each = lambda f, p: F.transform(items(raw(fields, f)), lambda v: row(f, p, v))
    many = [each(f, p) for p, names in LISTS.items() for f in names]
    return F.filter(F.concat(one, *many), lambda r: r["external_id"] != "")


def external_ids(cards: DataFrame) -> DataFrame:
    """card_uid, field_name, provider and external_id of every identifier that a card holds."""
    return cards.select(F.col("uid").alias("card_uid"), F.explode(_identifiers(F.col("fields"))).alias("e")).select("card_uid", "e.*")


def external_ids_map(fields: Column) -> Column:
    """Distinct identifiers by provider, in the order of the fields; providers without any are left out."""
    found = _identifiers(fields)
    providers = F.array_distinct(F.transform(found, lambda r: r["provider"]))
    own = lambda p: F.array_distinct(F.transform(F.filter(found, lambda r: r["provider"] == p), lambda r: r["external_id"]))
    return F.map_from_entries(F.transform(providers, lambda p: F.struct(p, own(p))))


def relationships_map(fields: Column) -> Column:
    """The members of each filled relation field."""
    every = F.array(*(F.struct(F.lit(n).alias("k"), items(raw(fields, n)).alias("v")) for n in RELATIONS))
    return F.map_from_entries(F.filter(every, lambda r: F.size(r["v"]) > 0))


@F.pandas_udf(StringType())
def sorted_json(fields: pd.Series) -> pd.Series:
    """A map of text as JSON with sorted keys, escaped non-ASCII characters and no NUL, which Spark's own JSON doesn't write."""
    plain = lambda m: {k.replace("\0", ""): (v or "").replace("\0", "") for k, v in (m or {}).items()}
    return fields.map(lambda m: json.dumps(plain(m), sort_keys=True))


def frontmatter_hash(fields: Column) -> Column:
    return F.sha2(sorted_json(fields), 256)


def content_hash(fields: Column, body: Column) -> Column:
    return F.sha2(F.concat(sorted_json(fields), F.lit("\n"), F.replace(F.coalesce(body, F.lit("")), F.lit("\0"), F.lit(""))), 256)


def plain_hash(fields: dict[str, str], body: str) -> str:
    """:func:`content_hash` of one card."""
    return hashlib.sha256((json.dumps(fields, sort_keys=True) + "\n" + body).encode()).hexdigest()


def register_slugs(cards: DataFrame) -> DataFrame:
    """slug and rel_path: a note below People/ wins a slug over others, then the smallest path; one row a slug, pre-aggregated."""
    order = F.struct((~F.col("rel_path").startswith("People/")).alias("o"), "rel_path")
    return cards.groupBy("slug").agg(F.min_by(F.struct("rel_path", "uid"), order).alias("m")).select("slug", "m.rel_path", "m.uid")


def person_lookup(cards: DataFrame) -> DataFrame:
    """key, rel_path and uid: a person by slug, by the slugs of name and aliases, by mail address and handle; of several the largest path."""
    f, n = F.col("fields"), int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = cards.filter("type = 'person'").select("rel_path", "uid", "slug", *(raw(f, x).alias(f"_{x}") for x in ("summary", "aliases", "emails", *HANDLES)))
    # a file of millions of persons may be one task; it would expand and sort all their keys
    told = told.repartition(n, "uid")
    keys = F.concat(
        F.array(F.col("slug"), slug(F.col("_summary"))), F.transform(items(F.col("_aliases")), slug), F.transform(items(F.col("_emails")), email),
        F.array(*(F.lower(F.trim(F.col(f"_{h}"))) for h in HANDLES)),
    )
    rows = told.select("rel_path", "uid", F.explode(F.array_distinct(keys)).alias("key")).filter("key <> ''")
    return rows.groupBy("key").agg(F.max(F.struct("rel_path", "uid")).alias("m")).select("key", "m.*")


def field_index(cards: DataFrame, card_type: str, field: str) -> DataFrame:
    """value (lower case), rel_path and uid of the cards of a type by one field; of several the smallest path."""
    rows = cards.filter(F.col("type") == card_type).select(F.lower(F.trim(raw(F.col("fields"), field))).alias("value"), "rel_path", "uid").filter("value <> ''")
    return rows.groupBy("value").agg(F.min(F.struct("rel_path", "uid")).alias("m")).select("value", "m.*")


@dataclass(frozen=True)
class EdgeRule:
    """The values of ``fields`` are references of cards of ``card_type`` to a card or a person.

    ``lookup``: (type, field) by which a target is found before its slug is tried.
    """

    card_type: str
    edge_type: str
    fields: tuple[str, ...]
    target: str = "card"
    lookup: tuple[str, str] | None = None


_RECEIPT = ("accommodation", "car_rental", "event_ticket", "flight", "grocery_order", "meal_order", "payroll", "purchase", "ride", "shipment", "subscription")
_PLACED = {"accommodation": ("address",), "event_ticket": ("venue",), "grocery_order": ("store",), "meal_order": ("restaurant",), "ride": ("pickup_location", "dropoff_location")}
_PROVIDED = {
    "accommodation": "booking_source", "car_rental": "company", "flight": "airline", "grocery_order": "service", "meal_order": "service", "payroll": "employer", "purchase": "vendor", "ride": "service",
    "subscription": "service_name",
}
# Which fields make which edges.
RULES = (
    EdgeRule("person", "person_reports_to", ("reports_to",), "person"),
    EdgeRule("finance", "transaction_with_person", ("counterparty",), "person"), EdgeRule("finance", "finance_from_email", ("source_email",)),
    EdgeRule("medical_record", "record_has_provider", ("provider_name",), "person"),
    EdgeRule("email_thread", "thread_has_message", ("messages",)), EdgeRule("email_thread", "thread_has_calendar_event", ("calendar_events",)),
    EdgeRule("email_thread", "thread_has_person", ("account_email", "participants"), "person"),
    EdgeRule("email_message", "message_has_attachment", ("attachments",)), EdgeRule("email_message", "message_has_calendar_event", ("calendar_events",)),
    EdgeRule("email_message", "message_in_thread", ("thread",)),
    EdgeRule("email_message", "message_mentions_person", ("from_email", "participant_emails", "to_emails", "cc_emails", "bcc_emails"), "person"),
    EdgeRule("imessage_thread", "thread_has_message", ("messages",)), EdgeRule("imessage_thread", "thread_has_attachment", ("attachments",)),
    EdgeRule("imessage_thread", "thread_has_person", ("participant_handles",), "person"),
    EdgeRule("imessage_message", "message_in_thread", ("thread",)), EdgeRule("imessage_message", "message_has_attachment", ("attachments",)),
    EdgeRule("imessage_message", "message_mentions_person", ("sender_handle", "participant_handles"), "person"),
    EdgeRule("calendar_event", "event_has_message", ("source_messages",)), EdgeRule("calendar_event", "event_has_thread", ("source_threads",)),
    EdgeRule("calendar_event", "event_has_transcript", ("meeting_transcripts",)), EdgeRule("calendar_event", "event_has_person", ("organizer_email", "attendee_emails"), "person"),
    EdgeRule("meeting_transcript", "transcript_has_calendar_event", ("calendar_events",)),
    EdgeRule("git_commit", "commit_in_repo", ("repository",)), EdgeRule("git_thread", "thread_in_repo", ("repository",)), EdgeRule("git_thread", "thread_has_message", ("messages",)),
    EdgeRule("git_message", "message_in_thread", ("thread",)), EdgeRule("git_message", "message_in_repo", ("repository",)),
    EdgeRule("observation", "observed_from", ("evidence_uids",)), EdgeRule("shipment", "ships_for", ("linked_purchase",), lookup=("purchase", "order_number")),
    *(EdgeRule(k, "derived_from", ("source_email",)) for k in _RECEIPT), *(EdgeRule(k, "located_at", (f,)) for k, names in _PLACED.items() for f in names),
    *(EdgeRule(k, "provided_by", (f,)) for k, f in _PROVIDED.items()),
)
#: Edges from the field ``people``, where they aren't called mentions_person.
PERSON_EDGES = {
    "email_thread": "thread_has_person", "email_message": "message_mentions_person", "imessage_thread": "thread_has_person", "imessage_message": "message_mentions_person",
    "calendar_event": "event_has_person", "git_repository": "repo_owned_by_person", "git_commit": "commit_authored_by_person", "git_thread": "thread_has_person", "git_message": "message_authored_by_person",
}
EDGE_COLUMNS = ("source_uid", "source_path", "target_uid", "target_path", "target_slug", "target_kind", "edge_type", "field_name")


def reference(value: Column) -> Column:
    """The slug that "[[target|shown]]" or a bare value names."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), r"^\[\[|\]\]$", ""), r"\|.*$", ""))


def resolved(refs: DataFrame, slugs: DataFrame) -> DataFrame:
    """``refs`` (with slug) and target_path, target_uid: by the slug as it stands, else in lower case with dashes; null without a card.

    Lookup tables may be large: plain joins, of which AQE broadcasts small ones.
    """
    exact = slugs.select(F.col("slug").alias("_a"), F.struct("rel_path", "uid").alias("_exact"))
    loose = slugs.groupBy(slug(F.col("slug")).alias("_b")).agg(F.min(F.struct("rel_path", "uid")).alias("_loose"))
    out = refs.join(exact, refs["slug"] == F.col("_a"), "left").join(loose, slug(refs["slug"]) == F.col("_b"), "left")
    told = F.coalesce("_exact", "_loose")
    return out.select(*(refs[c] for c in refs.columns), told["rel_path"].alias("target_path"), told["uid"].alias("target_uid"))


def people_of(refs: DataFrame, people: DataFrame) -> DataFrame:
    """``refs`` (with slug) and target_path, target_uid of the person that the value names, as it stands or as a slug."""
    by = lambda name: people.select(F.col("key").alias(f"_k{name}"), F.struct("rel_path", "uid").alias(f"_p{name}"))
    out = refs.join(by("a"), F.lower(refs["slug"]) == F.col("_ka"), "left").join(by("b"), slug(refs["slug"]) == F.col("_kb"), "left")
    told = F.coalesce("_pa", "_pb")
    return out.select(*(refs[c] for c in refs.columns), told["rel_path"].alias("target_path"), told["uid"].alias("target_uid"))


def rule_edges(cards: DataFrame, rules: tuple[EdgeRule, ...] = RULES) -> DataFrame:
    """The edges that ``rules`` make, as EDGE_COLUMNS; references that name no card are left out.

    One scan unpivots all rules' fields; then one join for each kind of target.
    """
    f = F.col("fields")

    def made(r: EdgeRule, name: str) -> Column:
        told = F.lit(r.edge_type).alias("edge_type"), F.lit(name).alias("field_name"), F.lit(r.target).alias("kind"), F.lit(":".join(r.lookup) if r.lookup else None).cast("string").alias("lookup")
        return F.transform(items(raw(f, name)), lambda v: F.struct(*told, reference(v).alias("slug")))

    refs = [made(r, name) for r in rules for name in r.fields]
    of_type = {k: F.concat(*(x for x, t in zip(refs, (r.card_type for r in rules for _ in r.fields)) if t == k)) for k in dict.fromkeys(r.card_type for r in rules)}
    found = F.explode(F.coalesce(*(F.when(F.col("type") == k, x) for k, x in of_type.items())))
    rows = cards.filter(F.col("type").isin(*of_type)).select(F.col("uid").alias("source_uid"), F.col("rel_path").alias("source_path"), found.alias("e")).select("source_uid", "source_path", "e.*").filter("slug <> ''")
    slugs = register_slugs(cards)
    parts = [resolved(rows.filter("kind = 'card' and lookup is null"), slugs), people_of(rows.filter("kind = 'person'"), person_lookup(cards))]
    for kind, name in dict.fromkeys(r.lookup for r in rules if r.lookup):
        index = field_index(cards, kind, name).select(F.col("value").alias("_v"), F.struct("rel_path", "uid").alias("_m"))
        own = resolved(rows.filter(F.col("lookup") == f"{kind}:{name}"), slugs)
        own = own.join(index, F.lower("slug") == F.col("_v"), "left").withColumns({"target_path": F.coalesce("_m.rel_path", "target_path"), "target_uid": F.coalesce("_m.uid", "target_uid")})
        parts.append(own.drop("_v", "_m"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _deduped(out.filter("target_path is not null").withColumn("target_kind", F.col("kind")))


def universal_edges(cards: DataFrame) -> DataFrame:
    """Edges that every card has: wikilinks of fields and body, identifiers, and the field people."""
    text = F.concat_ws("\n", F.map_values("fields"), F.array("body"))
    start = [F.col("uid").alias("source_uid"), F.col("rel_path").alias("source_path")]
    links = cards.select(*start, F.explode(F.array_distinct(wikilinks(text))).alias("slug")).withColumns({"edge_type": F.lit("wikilink"), "field_name": F.lit("wikilink"), "target_kind": F.lit("card")})
    links = resolved(links, register_slugs(cards)).withColumn("target_path", F.coalesce("target_path", "slug"))
    people = cards.select(*start, "type", F.explode(items(raw(F.col("fields"), "people"))).alias("v")).select("*", reference(F.col("v")).alias("slug"))
    named = F.coalesce(*(F.when(F.col("type") == k, F.lit(e)) for k, e in PERSON_EDGES.items()), F.lit("mentions_person"))
    people = people_of(people.withColumns({"edge_type": named, "field_name": F.lit("people"), "target_kind": F.lit("person")}), person_lookup(cards)).filter("target_path is not null")
    ids = external_ids(cards).join(cards.select(F.col("uid").alias("card_uid"), F.col("rel_path").alias("source_path")), "card_uid").select(
        F.col("card_uid").alias("source_uid"), "source_path", F.concat_ws("/", F.lit("external-id:/"), "provider", "external_id").alias("target_path"), F.lit("").alias("target_uid"), F.col("external_id").alias("slug"),
        F.lit("entity_has_external_id").alias("edge_type"), "field_name", F.lit("external_id").alias("target_kind"))
    return _deduped(links.unionByName(people.drop("type", "v")).unionByName(ids))


def _deduped(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target path, type, field)."""
    key = ["source_uid", "target_path", "edge_type", "field_name"]
    rest = [c for c in ("source_path", "target_uid", "slug", "target_kind")]
    one = edges.groupBy(*key).agg(F.min(F.struct(*rest)).alias("m")).select(*key, "m.*")
    return one.select("source_uid", "source_path", F.coalesce("target_uid", F.lit("")).alias("target_uid"), "target_path", F.col("slug").alias("target_slug"), "target_kind", "edge_type", "field_name")


def card_rows(cards: DataFrame) -> DataFrame:
    """The table of all cards: what every card has, besides its typed table."""
    from cardloom.operators import projections as P

    f, q = F.col("fields"), P.quality(F.col("type"), F.col("fields"), F.col("body"))
    first = lambda n: F.coalesce(F.try_element_at(items(raw(f, n)), F.lit(1)), F.lit(""))
    return cards.withColumn("_q", q).select(
        "uid", "rel_path", "slug", "type", raw(f, "summary").alias("summary"), first("source").alias("primary_source"), raw(f, "source_id").alias("source_id"), raw(f, "created").alias("created"),
        raw(f, "updated").alias("updated"), P.activity_at(f).alias("activity_at"), P.activity_end_at(F.col("type"), f).alias("activity_end_at"), frontmatter_hash(f).alias("frontmatter_hash"),
        content_hash(f, F.col("body")).alias("content_hash"), P.search_text(f, F.col("body")).alias("search_text"), F.size(F.split(clean(F.col("body")), " ")).alias("body_words"),
        F.char_length("body").alias("body_chars"), F.to_json(external_ids_map(f)).alias("external_ids_json"), F.to_json(relationships_map(f)).alias("relationships_json"),
        F.col("_q.quality_score").alias("quality_score"), F.col("_q.quality_flags").alias("quality_flags"), F.lit(0).alias("enrichment_version"), F.lit("none").alias("enrichment_status"),
    )


def bridge_rows(cards: DataFrame, field: str, people: DataFrame | None = None) -> DataFrame:
    """card_uid and value: each member of a list field once; with ``people`` (of :func:`person_lookup`) a person's uid where it names one."""
    rows = cards.select(F.col("uid").alias("card_uid"), F.explode(F.array_distinct(items(raw(F.col("fields"), field)))).alias("value"))
    if people is None:
        return rows
    told = people_of(rows.withColumn("slug", reference(F.col("value"))), people)
    return told.select("card_uid", F.coalesce("target_uid", "value").alias("value")).distinct()


def handles_of(fields: Column) -> Column:
    """All handles of a person, normalised."""
    return F.filter(F.array(*(handle(raw(fields, h)) for h in HANDLES)), lambda h: h != "")
