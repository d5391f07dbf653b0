"""Chunks by card type: which fields and stretches of a body make which chunk.

A type's parts are rows of a plain table; one expression per type packs them
into chunks within a card's row, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.normalize import clean
from cardloom.operators.chunking import _bare, _without_nul, colon_turns, content_hash, heading_sections, paragraphs, pipe_turns, split_chunks
from cardloom.operators.projections import raw
from cardloom.operators.vectors import chunk_key, token_count
from cardloom.sources.notes import items


@dataclass(frozen=True)
class Part:
    """A chunk type and its text.

    lines: (label, fields) blocks, a line each; text: the first filled one of
    some fields; body: the whole body; windows and recent: runs, and the last,
    of ``size`` paragraphs; first: the first ``size`` paragraphs; sections,
    turns: of a body with headings. ``when``: only for a body with (True) or
    without (False) sections.
    """

    kind: str
    how: str
    fields: tuple = ()
    size: int = 0
    when: bool | None = None
    sources: tuple[str, ...] = ("body",)


def lines(kind: str, *blocks: tuple, sources: tuple[str, ...] = ()) -> Part:
    return Part(kind, "lines", blocks, sources=sources or tuple(dict.fromkeys(f for _, *names in blocks for f in names)))


def value(kind: str, *fields: str) -> Part:
    return Part(kind, "text", fields, sources=fields)


def body(kind: str, when: bool | None = None) -> Part:
    return Part(kind, "body", when=when)


def _thread(prefix: str, size: int) -> tuple[Part, ...]:
    return Part(f"{prefix}_window", "windows", size=size, sources=("body", "messages")), Part(f"{prefix}_recent_window", "recent", size=size, sources=("body", "last_message_at"))


# The chunks of each card type.
BUILDERS = {
    "person": (
        lines("person_profile", ("name", "summary", "first_name", "last_name"), ("aliases", "aliases"), ("emails", "emails"), ("phones", "phones"), ("handles", "linkedin", "github", "twitter", "instagram", "telegram"), sources=("summary", "emails", "phones", "aliases")),
        lines("person_role", ("company", "company", "companies"), ("title", "title", "titles"), ("reports_to", "reports_to"), ("relationship", "relationship_type")),
        lines("person_context", ("description", "description"), ("people", "people"), ("orgs", "orgs"), ("tags", "tags")), body("person_body"),
    ),
    "email_thread": (
        value("thread_subject", "subject"),
        lines("thread_context", ("summary", "summary"), ("participants", "account_email", "participants"), ("labels", "label_ids"), ("time", "first_message_at", "last_message_at"), sources=("summary", "participants", "account_email", "label_ids", "first_message_at", "last_message_at")),
        value("thread_summary", "thread_summary"), *_thread("thread", 2),
    ),
    "email_message": (
        value("message_subject", "subject"), value("message_snippet", "snippet"),
        lines("message_context", ("summary", "summary"), ("from", "from_name", "from_email"), ("to", "to_emails"), ("participants", "participant_emails"), ("thread", "thread", "gmail_thread_id")),
        lines("message_invite_context", ("invite_title", "invite_title"), ("invite_time", "invite_start_at", "invite_end_at"), ("calendar_events", "calendar_events"), sources=("invite_title", "invite_start_at", "invite_end_at", "calendar_events", "invite_ical_uid", "invite_event_id_hint")),
        body("message_body"),
    ),
    "imessage_thread": (
        lines("imessage_thread_context", ("summary", "summary"), ("display", "display_name", "chat_identifier"), ("participants", "participant_handles"), ("service", "service")),
        value("imessage_thread_summary", "thread_summary"), *_thread("imessage_thread", 3),
    ),
    "calendar_event": (
        lines("event_title_time", ("title", "title", "summary"), ("time", "start_at", "end_at", "timezone"), ("location", "location", "conference_url")),
        lines("event_participants", ("organizer", "organizer_name", "organizer_email"), ("attendees", "attendee_emails"), ("people", "people")), value("event_description", "description"),
        lines("event_sources", ("source_messages", "source_messages"), ("source_threads", "source_threads"), ("meeting_transcripts", "meeting_transcripts"), ("status", "status", "ical_uid")), body("event_body"),
    ),
    "meeting_transcript": (
        lines("meeting_transcript_identity", ("title", "title", "summary"), ("otter_ids", "otter_meeting_id", "otter_conversation_id"), ("status", "status", "language"), ("time", "start_at", "end_at"), ("urls", "meeting_url", "transcript_url")),
        lines("meeting_transcript_participants", ("speaker_names", "speaker_names"), ("speaker_emails", "speaker_emails"), ("participant_names", "participant_names"), ("participant_emails", "participant_emails"), ("people", "people")),
        lines("meeting_transcript_links", ("calendar_events", "calendar_events"), ("event_hints", "event_id_hint", "ical_uid"), ("conference_url", "conference_url")),
        Part("meeting_transcript_section", "sections", when=True), Part("meeting_transcript_turn", "turns", when=True), Part("meeting_transcript_summary", "first", size=2, when=False),
        Part("meeting_transcript_window", "windows", size=3, when=False), body("meeting_transcript_body", False),
    ),
    "document": (
        lines("document_title_meta", ("title", "title", "summary"), ("type", "document_type", "extension"), ("date", "document_date", "date_start", "date_end", "file_created_at", "file_modified_at"), ("location", "location"), ("path", "library_root", "relative_path")),
        lines("document_entities", ("authors", "authors"), ("counterparties", "counterparties"), ("emails", "emails"), ("phones", "phones"), ("websites", "websites"), ("people", "people"), ("orgs", "orgs"), ("sheets", "sheet_names"), ("tags", "tags")),
        lines("document_extraction_meta", ("status", "extraction_status"), ("quality_flags", "quality_flags"), ("page_count", "page_count")), value("document_description", "description"),
        Part("document_section", "sections", when=True), body("document_body", False),
    ),
    "git_repository": (
        lines("git_repo_identity", ("repo", "name_with_owner", "summary"), ("owner", "owner_login", "owner_type"), ("visibility", "visibility"), ("default_branch", "default_branch"), ("parent", "parent_name_with_owner")),
        lines("git_repo_topics", ("primary_language", "primary_language"), ("languages", "languages"), ("topics", "topics"), ("license", "license_name"), ("orgs", "orgs")), value("git_repo_description", "description"), body("git_repo_body"),
    ),
    "git_commit": (
        value("git_commit_headline", "message_headline", "summary"),
        lines("git_commit_context", ("repo", "repository_name_with_owner"), ("sha", "commit_sha"), ("author", "author_name", "author_login", "author_email"), ("committer", "committer_name", "committer_login", "committer_email"), ("time", "authored_at", "committed_at"),
              ("stats", "=additions", "=deletions", "=changed_files"), ("associated_prs", "associated_pr_numbers")), body("git_commit_body"),
    ),
    "git_thread": (
        lines("git_thread_title_state", ("title", "title", "summary"), ("repo", "repository_name_with_owner"), ("thread", "thread_type", "number"), ("state", "state", "merged_at", "closed_at")),
        lines("git_thread_participants", ("participants", "participant_logins"), ("assignees", "assignees"), ("labels", "labels"), ("people", "people")),
        lines("git_thread_branch_context", ("base_ref", "base_ref"), ("head_ref", "head_ref"), ("message_count", "message_count"), ("messages", "messages")), body("git_thread_body"),
    ),
    "git_message": (
        lines("git_message_context", ("summary", "summary"), ("repo", "repository_name_with_owner"), ("thread", "thread"), ("type", "message_type", "review_state"), ("actor", "actor_name", "actor_login", "actor_email"), ("time", "sent_at", "updated_at")),
        lines("git_message_review_context", ("path", "path"), ("position", "position", "original_position"), ("commits", "review_commit_sha", "original_commit_sha"), ("reply_to", "in_reply_to_message_id")),
        value("git_message_diff_hunk", "diff_hunk"), body("git_message_body"),
    ),
}
#: Of all other types: these fields, each a chunk type of its own, and the body.
TEXT_FIELDS = ("summary", "subject", "snippet", "description", "title", "thread_summary")
DEFAULT = (*(value(f, f) for f in TEXT_FIELDS), body("body"))


def labelled(label: str, values: Column) -> Column:
    """"label: a; b" of the filled values; null without any."""
    held = F.filter(F.transform(values, lambda v: clean(v)), lambda v: v != "")
    return F.when(F.size(held) > 0, F.concat(F.lit(f"{label}: "), F.array_join(held, "; ")))


def _block(fields: Column, label: str, names: tuple[str, ...]) -> Column:
    own = [F.array(F.concat(F.lit(f"{n[1:]}="), F.coalesce(F.nullif(raw(fields, n[1:]), F.lit("")), F.lit("0")))) if n.startswith("=") else items(raw(fields, n)) for n in names]
    return labelled(label, F.concat(*own) if len(own) > 1 else own[0])


def _texts(part: Part, fields: Column, told: Column) -> Column:
    """The texts that a part gives, before they are cut to the limit."""
    text = told["body"]
    none = F.array().cast("array<string>")
    if part.how == "lines":
        return F.array(F.concat_ws("\n", *(_block(fields, label, tuple(names)) for label, *names in part.fields)))
    if part.how == "text":
        return F.array(F.coalesce(*(F.nullif(raw(fields, n), F.lit("")) for n in part.fields), F.lit("")))
    made = {
        "body": lambda: F.array(text), "windows": lambda: _runs(told["paragraphs"], part.size), "recent": lambda: F.array(F.array_join(F.slice(told["paragraphs"], -F.least(F.lit(part.size), F.size(told["paragraphs"])), F.lit(part.size)), "\n\n")),
        "first": lambda: F.array(F.array_join(F.slice(told["paragraphs"], 1, part.size), "\n\n")), "sections": lambda: told["sections"], "turns": lambda: _turns(told["sections"]),
    }[part.how]()
    test = text != ""
    if part.how == "recent":
        test = F.size(told["paragraphs"]) > 0
    if part.when is not None:
        test = test & ((F.size(told["sections"]) >= 2) == F.lit(part.when))
    return F.when(test, made).otherwise(none)


def _turns(sections: Column) -> Column:
    """Speaker turns of the section headed transcript, else of the last one."""
    named = F.filter(sections, lambda s: F.lower(F.regexp_extract(s, r"^#{1,6}\s+([^\n]+)", 1)).contains("transcript"))
    focus = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(sections, F.lit(-1)))
    piped = pipe_turns(focus)
    return F.when(F.size(piped) > 0, piped).otherwise(colon_turns(focus))


def _runs(parts: Column, size: int) -> Column:
    """Each run of ``size`` paragraphs, fewer at the end."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, size), "\n\n"))


def build_chunks(cards: DataFrame, limit: int = 1200, builders: dict[str, tuple[Part, ...]] | None = None) -> DataFrame:
    """uid, chunk_type, chunk_index, source_fields, content, content_hash, token_count, chunk_key of ``cards`` (uid, type, fields, body).

    Of equal chunks of one type the first stays with its index, so indexes may
    have gaps. Null bodies are empty. Types without a builder of their own
    chunk their text fields and body.
    """
    known = BUILDERS if builders is None else builders
    f, told = F.col("fields"), F.col("_told")
    text = _bare(_without_nul(F.col("body")))
    rows = cards.select("uid", "type", "fields", F.struct(text.alias("body"), paragraphs(F.col("body")).alias("paragraphs"), heading_sections(F.col("body")).alias("sections")).alias("_told"))

    def made(parts: tuple[Part, ...]) -> Column:
        several = F.size(told["paragraphs"]) > 1
        return F.array(*(F.struct(
            F.lit(p.kind).alias("chunk_type"), F.array(*(F.lit(x.lstrip("=")) for x in p.sources)).alias("source_fields"), _texts(p, f, told).alias("texts"), (several & F.lit(p.how == "windows")).alias("once"),
        ) for p in parts))

    # a branch for each type, so that a card runs its own type's expressions alone; then one cut for all
    branches = [rows.filter(F.col("type") == k).select("uid", F.inline(made(parts))) for k, parts in known.items()]
    branches.append(rows.filter(~F.coalesce(F.col("type").isin(*known), F.lit(False))).select("uid", F.inline(made(DEFAULT))))
    texts = branches[0]
    for b in branches[1:]:
        texts = texts.unionByName(b)
    cut = texts.withColumn("cut", F.flatten(F.transform("texts", lambda t: split_chunks(t, limit)))).withColumn("cut", F.when(F.col("once"), F.array_distinct("cut")).otherwise(F.col("cut")))
    out = cut.select("uid", "chunk_type", "source_fields", "cut", F.posexplode("cut").alias("chunk_index", "content")).filter(F.array_position("cut", F.col("content")) == F.col("chunk_index") + 1).drop("cut")
    hashed = out.withColumn("content_hash", content_hash("chunk_type", "content", "source_fields"))
    return hashed.withColumns({"token_count": token_count(F.col("content")), "chunk_key": chunk_key(F.col("uid"), F.col("chunk_type"), F.col("chunk_index"), F.col("content_hash"))})
