"""Candidate links between cards: generators as equi-joins, scores, policies, decisions, promotion and the quality gate.

Cards have uid, rel_path, slug, type, fields (raw values) and body. A candidate
is (module, link_type, source_uid, target_uid, det, lex, graph, emb, risk), one
for each key of the first four.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cardloom.functions.normalize import alias, clean, email, handle, path_bucket, phone, slug, wikilinks
from cardloom.operators.features import HANDLES, LISTS, PROVIDERS, external_ids, reference, register_slugs
from cardloom.operators.projections import activity_at, raw
from cardloom.sources.notes import items
from cardloom.sources.shared import written

KEY = ("module", "link_type", "source_uid", "target_uid")
SCORES = ("det", "lex", "graph", "emb", "risk")
PARTICIPANTS = ("participants", "participant_emails", "attendee_emails", "to_emails", "cc_emails", "bcc_emails")
HINTS = ("calendar_events", "invite_ical_uids", "invite_event_id_hints", "invite_ical_uid", "invite_event_id_hint", "event_id", "ical_uid", "event_id_hint")
PLACES = ("location", "place_name", "place_city", "place_state", "place_country")
#: The field of an event that refers back to a card of a type, and the links between them.
BACK = {
    "email_message": ("source_messages", "message_has_calendar_event", "event_has_message"), "email_thread": ("source_threads", "thread_has_calendar_event", "event_has_thread"),
    "meeting_transcript": ("meeting_transcripts", "transcript_has_calendar_event", "event_has_transcript"),
}


@dataclass(frozen=True)
class Policy:
    module: str
    surface: str
    field: str = ""  # of the source, where a promotion writes the target
    review: float = 0.45
    auto: float = 0.80
    canonical: float = 0.92


# What may become of a link of each type.
POLICIES = {
    "message_in_thread": Policy("communicationLinker", "canonical_safe", "thread", auto=0.82, canonical=0.93),
    "thread_has_message": Policy("graphConsistencyLinker", "canonical_safe", "messages", auto=0.78, canonical=0.84),
    "message_has_calendar_event": Policy("calendarLinker", "canonical_safe", "calendar_events", auto=0.85, canonical=0.95),
    "thread_has_calendar_event": Policy("calendarLinker", "canonical_safe", "calendar_events", auto=0.85, canonical=0.95),
    "transcript_has_calendar_event": Policy("calendarLinker", "canonical_safe", "calendar_events", auto=0.85, canonical=0.95),
    "event_has_message": Policy("graphConsistencyLinker", "canonical_safe", "source_messages", auto=0.85, canonical=0.95),
    "event_has_thread": Policy("graphConsistencyLinker", "canonical_safe", "source_threads", auto=0.85, canonical=0.95),
    "event_has_transcript": Policy("graphConsistencyLinker", "canonical_safe", "meeting_transcripts", auto=0.85, canonical=0.95),
    "message_has_attachment": Policy("communicationLinker", "canonical_safe", "attachments", auto=0.82, canonical=0.93),
    "thread_has_attachment": Policy("graphConsistencyLinker", "derived_only", auto=0.78),
    "thread_has_person": Policy("communicationLinker", "canonical_safe", "people", auto=0.82, canonical=0.93),
    "message_mentions_person": Policy("communicationLinker", "canonical_safe", "people", auto=0.82, canonical=0.93),
    "event_has_person": Policy("calendarLinker", "canonical_safe", "people", auto=0.85, canonical=0.95),
    "media_has_person": Policy("mediaLinker", "derived_only", auto=0.88, canonical=1.0),
    "media_has_event": Policy("mediaLinker", "derived_only", auto=0.88, canonical=1.0),
    "possible_same_person": Policy("identityLinker", "candidate_derived", auto=0.97, canonical=0.97),
    "orphan_repair_exact": Policy("orphanRepairLinker", "derived_only", auto=0.84, canonical=0.94),
    "orphan_repair_fuzzy": Policy("orphanRepairLinker", "candidate_derived", auto=0.98, canonical=0.99),
    "semantically_related": Policy("semanticLinker", "derived_only", review=0.40, auto=0.50, canonical=1.0),
    "finance_reconciles": Policy("financeReconcileLinker", "derived_only", review=0.40, canonical=1.0),
    "part_of_trip": Policy("tripClusterLinker", "derived_only", review=0.60, canonical=1.0),
}
#: Modules whose tier's score says all.
BY_TIER = ("meetingArtifactLinker", "tripClusterLinker", "financeReconcileLinker")
SCALARS = ("thread",)


def _members(fields: Column, names: tuple[str, ...], how) -> Column:
    """Distinct, normalised, non-empty members of some fields."""
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*(items(raw(fields, n)) for n in names))), lambda v: how(v)), lambda v: v != ""))


def sketch(cards: DataFrame) -> DataFrame:
    """What the generators look at: identifiers, participants, hints, places, labels, day and title of each card."""
    f = F.col("fields")
    filled = lambda *names: F.coalesce(*(F.when(clean(raw(f, n)) != "", clean(raw(f, n))) for n in names), F.lit(""))
    day = F.date_format(F.coalesce(activity_at(f), F.trim(raw(f, "invite_start_at")).try_cast("timestamp")), "yyyy-MM-dd")
    return cards.select(
        "uid", "rel_path", "slug", "type", "fields", "body", clean(raw(f, "summary")).alias("summary"), filled("invite_title", "subject", "title", "summary").alias("title"),
        _members(f, PARTICIPANTS, email).alias("participants"), _members(f, HINTS, clean).alias("hints"), _members(f, (*PROVIDERS["calendar"], *LISTS["calendar"]), F.trim).alias("calendar_ids"),
        _members(f, PLACES, email).alias("places"), _members(f, ("person_labels", "people"), alias).alias("labels"), day.alias("day"),
    )


def _slugs(fields: Column, name: str) -> Column:
    return F.transform(items(raw(fields, name)), lambda v: slug(reference(v)))


def words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(alias(text), " ")), lambda w: w != "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct words, to four digits; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4))


def _candidates(rows: DataFrame, module: str | Column, link: str | Column, source: str, target: str, det=0.0, lex=0.0, graph=0.0, risk=0.0) -> DataFrame:
    bound = lambda c, most=1.0: F.greatest(F.lit(0.0), F.least(F.lit(most), (c if isinstance(c, Column) else F.lit(c)).cast("double")))
    return rows.select(
        (F.lit(module) if isinstance(module, str) else module).alias("module"), (F.lit(link) if isinstance(link, str) else link).alias("link_type"), F.col(source).alias("source_uid"), F.col(target).alias("target_uid"),
        bound(det).alias("det"), bound(lex).alias("lex"), bound(graph).alias("graph"), F.lit(0.0).alias("emb"), bound(risk, 0.8).alias("risk"),
    )


def deduped(candidates: DataFrame) -> DataFrame:
    """One candidate a key; of several the best scored."""
    one = F.max(F.struct("det", "lex", "graph", "emb", (-F.col("risk")).alias("r"))).alias("m")
    return candidates.groupBy(*KEY).agg(one).select(*KEY, "m.det", "m.lex", "m.graph", "m.emb", (-F.col("m.r")).alias("risk"))


def _identifiers(f: Column) -> dict[str, Column]:
    """By kind (exact_email, exact_phone, exact_handle, exact_alias) the values of a person's fields, as they come."""
    names = F.concat(F.array(raw(f, "summary"), raw(f, "name"), raw(f, "first_name"), raw(f, "last_name"), F.concat_ws(" ", F.trim(raw(f, "first_name")), F.trim(raw(f, "last_name")))), items(raw(f, "aliases")))
    return {
        "exact_email": F.transform(items(raw(f, "emails")), email), "exact_phone": F.transform(items(raw(f, "phones")), phone),
        "exact_handle": F.array(*(handle(raw(f, h)) for h in HANDLES)), "exact_alias": F.transform(names, alias),
    }


def person_identifiers(cards: DataFrame) -> DataFrame:
    """uid, kind (exact_email, exact_phone, exact_handle, exact_alias) and value of every person's identifiers."""
    named = lambda k, v: F.transform(F.array_distinct(v), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("value")))
    each = F.concat(*(named(k, v) for k, v in _identifiers(F.col("fields")).items()))
    return cards.filter("type = 'person'").select("uid", F.explode(each).alias("i")).select("uid", "i.*").filter("value <> ''")


def person_matches(sought: DataFrame, persons: DataFrame) -> DataFrame:
    """uid, target_uid and hits (sorted kinds) of the persons that share an identifier (uid, kind, value) with a card."""
    met = sought.join(persons.withColumnRenamed("uid", "target_uid"), ["kind", "value"])
    return met.groupBy("uid", "target_uid").agg(F.array_sort(F.collect_set("kind")).alias("hits"))


def identifier_classes(sought: DataFrame, persons: DataFrame) -> DataFrame:
    """side (card or person), uid, kind, value and n_links: who holds an identifier (uid, kind, value) that both a card and a person have, and how many of the other side do.

    An identifier is a class: each card that holds it is linked to each person
    that does, so these rows are the links of :func:`person_matches` without
    the pairs of a shared address. A card's links are those of its values.
    """
    sides = sought.select(F.lit("card").alias("side"), "uid", "kind", "value").unionByName(persons.select(F.lit("person").alias("side"), "uid", "kind", "value")).distinct()
    n = sides.groupBy("kind", "value").agg(*(F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("card", "person"))).filter("card > 0 and person > 0")
    return sides.join(n, ["kind", "value"]).select("side", "uid", "kind", "value", F.when(F.col("side") == "card", F.col("person")).otherwise(F.col("card")).alias("n_links"))


def identity_candidates(cards: DataFrame, most_shared: int = 1_000) -> DataFrame:
    """Persons that share an identifier, the smaller uid first.

    A value that more than ``most_shared`` persons have links each of them to
    the smallest one, so that no value makes pairs without bound; the rest
    are all pairs.
    """
    ids = person_identifiers(cards)
    size = ids.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("uid").alias("least")).filter("n > 1")
    known = ids.join(size, ["kind", "value"])
    few = known.filter(F.col("n") <= most_shared).select("uid", "kind", "value")
    pairs = few.join(few.withColumnRenamed("uid", "target_uid"), ["kind", "value"]).filter("uid < target_uid")
    stars = known.filter((F.col("n") > most_shared) & (F.col("uid") > F.col("least"))).select("kind", "value", F.col("least").alias("uid"), F.col("uid").alias("target_uid"))
    met = pairs.unionByName(stars).groupBy("uid", "target_uid").agg(F.array_sort(F.collect_set("kind")).alias("hits"))
    both = met.select("uid", "target_uid").unionByName(met.select(F.col("target_uid").alias("uid"), F.col("uid").alias("target_uid"))).distinct()
    ambiguous = both.groupBy("uid").agg(F.count("*").alias("others"))
    f = F.col("fields")
    told = cards.filter("type = 'person'").select("uid", words(raw(f, "summary")).alias("w"), alias(raw(f, "company")).alias("company"), _members(f, ("people",), alias).alias("people"))
    side = lambda s, uid: told.select(F.col("uid").alias(uid), *(F.col(c).alias(f"{c}_{s}") for c in ("w", "company", "people")))
    rows = met.join(ambiguous, "uid").join(side("a", "uid"), "uid").join(side("b", "target_uid"), "target_uid")
    hit = lambda k, v: F.when(F.array_contains("hits", k), v).otherwise(0.0)
    det = hit("exact_email", 1.0) + hit("exact_phone", 1.0) + hit("exact_handle", 0.9) + hit("exact_alias", 0.6)
    lex = 0.75 * likeness(F.col("w_a"), F.col("w_b")) + F.when((F.col("company_a") == F.col("company_b")) & (F.col("company_a") != ""), 0.25).otherwise(0.0)
    graph = 0.2 * F.least(F.size(F.array_intersect("people_a", "people_b")), F.lit(3))
    risk = F.when(F.col("others") > 1, 0.15).otherwise(0.0) + F.when((det == 0) & (lex < 0.85), 0.2).otherwise(0.0)
    return _candidates(rows, "identityLinker", "possible_same_person", "uid", "target_uid", det, lex, graph, risk)


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], many: int = 1_000, parts: int = 16) -> DataFrame:
    """The inner join by ``keys``; rows of ``left`` (with uid) that share a key by the thousand are dealt to parts, for each of which the key's rows of ``right`` are repeated."""
    hot = left.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > many).select(*keys, F.least(F.ceil(F.col("n") / many), F.lit(parts)).cast("int").alias("parts"))
    n = F.coalesce("parts", F.lit(1))
    a = left.join(F.broadcast(hot), keys, "left").withColumn("part", F.pmod(F.xxhash64("uid"), n).cast("int")).drop("parts")  # hot keys are at most a thousandth of the rows
    b = right.join(F.broadcast(hot), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes come in, which would be put together into few tasks, but many pairs go out
    a, b = (df.repartition(tasks, *keys, "part") for df in (a, b))
    return a.join(b.hint("shuffle_merge"), [*keys, "part"]).drop("part")


def _crowded(sought: DataFrame, persons: DataFrame, most: int = 3) -> DataFrame:
    """uid of those of ``sought`` (uid, kind, value) that more than ``most`` ``persons`` (target_uid, kind, value) share a value with; a value that more have settles it without pairs."""
    size = persons.groupBy("kind", "value").agg(F.count("*").alias("n"))
    told = sought.join(size, ["kind", "value"])
    few = told.filter(F.col("n") <= most).join(persons, ["kind", "value"]).groupBy("uid").agg(F.countDistinct("target_uid").alias("met")).filter(F.col("met") > most)
    return told.filter(F.col("n") > most).select("uid").unionByName(few.select("uid")).distinct()


def _participants(s: DataFrame, kinds: dict[str, tuple[tuple[str, ...], str, str, str]], cards: DataFrame) -> DataFrame:
    """Links of cards to the persons whose addresses or handles they name, but for persons already among their people.

    ``kinds``: by card type further fields, the identifiers' kind, the link type and the module.
    A pair counts where the smallest identifier that it shares meets, so that
    it comes once (of distinct uids) and no pair is shuffled, kept or sorted:
    what a shared address links is many times the tables.
    """
    f = F.col("fields")
    ids = person_identifiers(cards).filter("kind in ('exact_email', 'exact_handle')").withColumnRenamed("uid", "target_uid").distinct()
    rows = []
    for kind, (more, how, link, module) in kinds.items():
        own = F.array_union("participants", _members(f, more, email)) if how == "exact_email" else _members(f, (*more, "participant_handles"), handle)
        rows.append(s.filter(F.col("type") == kind).select("uid", path_bucket(F.col("rel_path")).alias("path"), _members(f, ("people",), alias).alias("known"), own.alias("own"), F.lit(how).alias("kind"), F.lit(link).alias("link"), F.lit(module).alias("module")))
    sought = reduce(DataFrame.unionByName, rows)
    each = written(sought.select("*", F.explode("own").alias("value")), "sought")
    ids = written(ids, "identifiers")
    crowded = _crowded(each.select("uid", "kind", "value"), ids).withColumn("crowded", F.lit(True))
    names = cards.filter("type = 'person'").select(F.col("uid").alias("target_uid"), alias(raw(f, "summary")).alias("name"), path_bucket(F.col("rel_path")).alias("target_path"))
    held = ids.groupBy("target_uid", "kind").agg(F.collect_set("value").alias("held")).join(names, "target_uid")  # a person's own identifiers
    met = _dealt(each.join(crowded, "uid", "left"), held.select("*", F.explode("held").alias("value")), ["kind", "value"])
    new = met.filter((F.col("value") == F.array_min(F.array_intersect("own", "held"))) & ~F.array_contains("known", F.col("name")))
    overlap, talk = F.size("own"), F.col("module") == "communicationLinker"
    lex = F.when(talk, 0.12 * F.least(overlap, F.lit(3))).otherwise(0.08 * F.least(overlap, F.lit(3)))
    graph = F.when(talk, F.when(F.col("path") == F.col("target_path"), 0.6).otherwise(0.0)).otherwise(0.12 * F.least(overlap, F.lit(4)))
    risk = F.when(talk, F.when(F.col("crowded"), 0.12).otherwise(0.0)).otherwise(F.when(lex < 0.55, 0.15).otherwise(0.0))
    return _candidates(new, F.col("module"), F.col("link"), "uid", "target_uid", F.when(talk, 0.85).otherwise(0.0), lex, graph, risk)


def communication_candidates(cards: DataFrame) -> DataFrame:
    """Messages and threads of one thread id, attachments of a message or thread, and persons among the participants."""
    f, s = F.col("fields"), sketch(cards)
    id_of = lambda n: clean(raw(f, n))
    out = []
    for kind, thread_kind, field in (("email_message", "email_thread", "gmail_thread_id"), ("imessage_message", "imessage_thread", "imessage_chat_id")):
        m = s.filter(F.col("type") == kind).select(F.col("uid").alias("m"), slug(F.col("slug")).alias("m_slug"), slug(reference(raw(f, "thread"))).alias("named"), words(raw(f, "subject")).alias("m_w"), id_of(field).alias("id"))
        t = s.filter(F.col("type") == thread_kind).select(F.col("uid").alias("t"), slug(F.col("slug")).alias("t_slug"), _slugs(f, "messages").alias("held"), words(raw(f, "subject")).alias("t_w"), id_of(field).alias("id"))
        met = m.filter("id <> ''").join(t, "id").withColumn("back", F.array_contains("held", F.col("m_slug")))
        lex = 0.6 * likeness(F.col("m_w"), F.col("t_w")) if kind == "email_message" else 0.0
        unnamed = met.filter("named <> t_slug" if kind == "email_message" else "named = ''")
        out.append(_candidates(unnamed, "communicationLinker", "message_in_thread", "m", "t", 1.0, lex, F.when(F.col("back"), 0.8).otherwise(0.0)))
        out.append(_candidates(met.filter("not back"), "graphConsistencyLinker", "thread_has_message", "t", "m", 1.0, 0.0, 0.65))
    a = s.filter("type = 'email_attachment'").select(F.col("uid").alias("a"), slug(F.col("slug")).alias("a_slug"), id_of("gmail_message_id").alias("mid"), id_of("gmail_thread_id").alias("tid"))
    m = s.filter("type = 'email_message'").select(F.col("uid").alias("m"), _slugs(f, "attachments").alias("held"), id_of("gmail_message_id").alias("mid")).filter("mid <> ''")
    t = s.filter("type = 'email_thread'").select(F.col("uid").alias("t"), id_of("gmail_thread_id").alias("tid")).filter("tid <> ''")
    n = a.groupBy("mid").agg(F.count("*").alias("n"))
    met = m.join(a, "mid").join(n, "mid").filter(~F.array_contains("held", F.col("a_slug")))
    out.append(_candidates(met, "communicationLinker", "message_has_attachment", "m", "a", 1.0, risk=F.when(F.col("n") > 3, 0.12).otherwise(0.0)))
    out.append(_candidates(t.join(a, "tid"), "graphConsistencyLinker", "thread_has_attachment", "t", "a", 0.0, 0.0, 0.65))
    people = _participants(s, {
        "email_message": (("from_email",), "exact_email", "message_mentions_person", "communicationLinker"), "email_thread": (("account_email",), "exact_email", "thread_has_person", "communicationLinker"),
        "imessage_message": (("sender_handle",), "exact_handle", "message_mentions_person", "communicationLinker"), "imessage_thread": ((), "exact_handle", "thread_has_person", "communicationLinker"),
    }, cards)
    return deduped(reduce(DataFrame.unionByName, out)).unionByName(people)


def _side(rows: DataFrame, p: str, more: dict[str, Column]) -> DataFrame:
    """What of sketches decides whether they meet, and ``more``, all with ``p`` before their names: written once, as each rule reads it and nothing else goes through the joins."""
    own = {"hints": F.col("hints"), "day": F.col("day"), "words": F.array_sort(words(F.col("title"))), "places": F.col("places"), **more}
    return written(rows.select("uid", *(c.alias(f"{p}_{n}") for n, c in own.items())), "side")


def event_side(events: DataFrame, more: dict[str, Column]) -> DataFrame:
    f = F.col("fields")
    ids = F.filter(F.array_distinct(F.array(clean(raw(f, "event_id")), clean(raw(f, "ical_uid")))), lambda v: v != "")
    return _side(events, "e", {"ids": ids, **more}).withColumnRenamed("uid", "e_uid")


def met_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of sources (:func:`_side`) and events (:func:`event_side`), with s_uid and e_uid, the sides' columns and the likeness of titles (alike): by a hint that is the event's identifier, or on its day by place or by titles alike to 0.6.

    Titles meet by day and word: of two sets alike to 0.6 one of the first
    ``n - ceil(0.6 n) + 1`` words, in alphabetical order, is shared. A pair
    counts under the first of the three rules that it meets, at the smallest
    key that both share, so it comes once (of distinct uids) without pairs
    being shuffled or kept: a day's title brings many together.
    """
    first = lambda c: F.slice(c, 1, F.size(c) - F.ceil(F.lit(0.6) * F.size(c)).cast("int") + 1)
    alike = likeness(F.col("s_words"), F.col("e_words"))
    hinted = F.arrays_overlap("s_hints", "e_ids")
    titled = (F.size("s_words") > 0) & (F.size("e_words") > 0) & (alike >= 0.6)
    least = lambda x, y: F.array_min(F.array_intersect(x, y))

    def met(x: Column, y: Column, by: list[str], test: Column) -> DataFrame:
        left, right = a.withColumn("key", F.explode(x)), b.withColumn("key", F.explode(y))
        if by:
            left, right = left.withColumn("day", F.col("s_day")).filter("day is not null"), right.withColumn("day", F.col("e_day")).filter("day is not null")
        return _dealt(left, right, [*by, "key"]).filter(test).drop("key", *by)

    key = F.col("key")
    found = [
        met(F.col("s_hints"), F.col("e_ids"), [], key == least("s_hints", "e_ids")),
        met(first(F.col("s_words")), first(F.col("e_words")), ["day"], (key == least(first(F.col("s_words")), first(F.col("e_words")))) & titled & ~hinted),
        met(F.col("s_places"), F.col("e_places"), ["day"], (key == least("s_places", "e_places")) & ~titled & ~hinted),
    ]
    return reduce(DataFrame.unionByName, found).withColumn("alike", alike).withColumnRenamed("uid", "s_uid")


def calendar_candidates(cards: DataFrame) -> DataFrame:
    """Mail, threads and transcripts with their events, both ways, and events with the persons that take part. Cards have distinct uids."""
    s, f = sketch(cards), F.col("fields")
    people = F.array_union("participants", _members(f, ("organizer_email", "emails"), email))
    events = event_side(s.filter("type = 'calendar_event'"), {"slug": slug(F.col("slug")), "calendar_ids": F.col("calendar_ids"), "people": people, **{field: _slugs(f, field) for field, _, _ in BACK.values()}})
    out = []
    for kind, (field, there, back) in BACK.items():
        rows = met_events(_side(s.filter(F.col("type") == kind), "s", {"slug": slug(F.col("slug")), "named": _slugs(f, "calendar_events"), "people": F.col("participants")}), events)
        same_id, named_back = F.arrays_overlap("s_hints", "e_calendar_ids"), F.array_contains(f"e_{field}", F.col("s_slug"))
        overlap = F.size(F.array_intersect("s_people", "e_people"))
        det = F.least(F.lit(1.0), F.when(same_id, 1.0).otherwise(0.0) + F.when(named_back, 0.8).otherwise(0.0))
        lex = 0.7 * F.col("alike") + 0.08 * F.least(overlap, F.lit(3))
        graph = F.when(named_back, 0.85).otherwise(0.12 * F.least(overlap, F.lit(4)))
        ways = [  # both ways of a pair from one pass over the pairs
            (~F.array_contains("s_named", F.col("e_slug")), "calendarLinker", there, "s_uid", "e_uid", det, lex, graph, F.when((det < 1) & (lex < 0.55), 0.15).otherwise(0.0)),
            (~named_back, "graphConsistencyLinker", back, "e_uid", "s_uid", F.when(same_id, 1.0).otherwise(0.0), F.lit(0.0), F.lit(0.65), F.lit(0.0)),
        ]
        names = ("module", "link", "source", "target", "det", "lex", "graph", "risk")
        way = [F.when(test, F.struct(*(c.alias(n) for n, c in zip(names, (F.lit(module), F.lit(link), F.col(x), F.col(y), *(v.cast("double") for v in scores)))))) for test, module, link, x, y, *scores in ways]
        each = rows.select(F.explode(F.array_compact(F.array(*way))).alias("c")).select("c.*")
        out.append(_candidates(each, F.col("module"), F.col("link"), "source", "target", F.col("det"), F.col("lex"), F.col("graph"), F.col("risk")))
    out.append(_participants(s, {"calendar_event": (("organizer_email",), "exact_email", "event_has_person", "calendarLinker")}, cards))
    return reduce(DataFrame.unionByName, out)


def media_candidates(cards: DataFrame) -> DataFrame:
    """Photos with the persons that their labels name, and with events of the same day. Cards have distinct uids."""
    s = sketch(cards)
    photos, events = s.filter("type = 'media_asset'"), s.filter("type = 'calendar_event'")
    aliases = F.array_distinct(F.filter(_identifiers(F.col("fields"))["exact_alias"], lambda v: v != ""))
    held = written(cards.filter("type = 'person'").select(F.col("uid").alias("target_uid"), aliases.alias("held")), "aliases")  # a row a person: nothing to group
    persons = held.select("target_uid", F.lit("exact_alias").alias("kind"), F.explode("held").alias("value"))
    sought = photos.select("uid", "labels", F.lit("exact_alias").alias("kind"), F.explode("labels").alias("value"))
    several = _crowded(sought.select("uid", "kind", "value"), persons, 1).withColumn("several", F.lit(True))
    met = _dealt(sought.join(several, "uid", "left"), held.select("*", F.explode("held").alias("value")), ["value"]).filter(F.col("value") == F.array_min(F.array_intersect("labels", "held")))
    people = _candidates(met, "mediaLinker", "media_has_person", "uid", "target_uid", 0.9, 0.0, 0.0, 0.18 + F.when(F.col("several"), 0.12).otherwise(0.0))
    told = {"labels": F.col("labels"), "summary": words(F.col("summary"))}
    rows = met_events(_side(photos, "s", told), event_side(events, {"labels": _members(F.col("fields"), ("people",), alias), "summary": told["summary"]}))
    lex = 0.45 * likeness(F.col("s_summary"), F.col("e_summary")) + F.when(F.arrays_overlap("s_places", "e_places"), 0.35).otherwise(0.0)
    graph = F.when(F.col("s_day") == F.col("e_day"), 0.4).otherwise(0.0) + 0.18 * F.least(F.size(F.array_intersect("s_labels", "e_labels")), F.lit(3))
    return people.unionByName(_candidates(rows, "mediaLinker", "media_has_event", "s_uid", "e_uid", 0.0, lex, graph, 0.18))


def graph_candidates(cards: DataFrame) -> DataFrame:
    """References back that are missing: thread to message of its id, event to mail, thread and transcript that hint at it."""
    f, s = F.col("fields"), sketch(cards)
    id_of = clean(raw(f, "gmail_thread_id"))
    t = s.filter("type = 'email_thread'").select(F.col("uid").alias("t"), _slugs(f, "messages").alias("held"), id_of.alias("id")).filter("id <> ''")
    m = s.filter("type = 'email_message'").select(F.col("uid").alias("m"), slug(F.col("slug")).alias("m_slug"), id_of.alias("id"))
    out = [_candidates(t.join(m, "id").filter(~F.array_contains("held", F.col("m_slug"))), "graphConsistencyLinker", "thread_has_message", "t", "m", 1.0, 0.0, 0.9)]
    e = s.filter("type = 'calendar_event'").select(F.col("uid").alias("e"), "fields", F.explode("calendar_ids").alias("hint"))
    for kind, (field, _, back) in BACK.items():
        own = s.filter(F.col("type") == kind).select(F.col("uid").alias("x"), slug(F.col("slug")).alias("x_slug"), F.explode("hints").alias("hint"))
        out.append(_candidates(e.join(own, "hint").filter(~F.array_contains(_slugs(f, field), F.col("x_slug"))), "graphConsistencyLinker", back, "e", "x", 1.0, 0.0, 0.9))
    return deduped(reduce(DataFrame.unionByName, out))


def orphan_candidates(cards: DataFrame) -> DataFrame:
    """Wikilinks of fields and body that no slug equals, to the card that the slug in lower case with dashes names."""
    text = F.concat_ws("\n", F.map_values("fields"), F.array("body"))
    refs = cards.select("uid", F.explode(F.array_distinct(wikilinks(text))).alias("ref")).filter("ref <> ''")
    lost = refs.join(register_slugs(cards).select(F.col("slug").alias("ref")), "ref", "left_anti")
    known = cards.groupBy(slug(F.col("slug")).alias("loose")).agg(F.min("uid").alias("target_uid"))
    return deduped(_candidates(lost.join(known, slug(F.col("ref")) == F.col("loose")), "orphanRepairLinker", "orphan_repair_exact", "uid", "target_uid", 1.0, 0.65, 0.4))


def evaluate(candidates: DataFrame, judge: DataFrame | None = None) -> DataFrame:
    """``candidates`` with llm, confidence, decision and reason, by the policy of their link type.

    ``judge`` (the key, llm, verdict): a model's judgement; without one, or
    for candidates that it leaves out, llm is 1 where det is 1, else 0.
    Modules by tier count det less risk. Semantic links need the verdict YES
    and floors of llm and emb (0.70 and 0.55 across types, 0.90 and 0.85
    within one; column ``cross_type``). All others: a weighted mean less risk.
    """
    policy = lambda get: F.coalesce(*(F.when(F.col("link_type") == k, F.lit(get(p))) for k, p in POLICIES.items()))
    rows = candidates.join(judge, list(KEY), "left") if judge is not None else candidates.withColumns({"llm": F.lit(None).cast("double"), "verdict": F.lit(None).cast("string")})
    rows = rows if "cross_type" in rows.columns else rows.withColumn("cross_type", F.lit(False))
    det, risk = F.col("det"), F.col("risk")
    rows = rows.withColumns({"llm": F.coalesce("llm", F.when(det >= 1, 1.0).otherwise(0.0)), "surface": policy(lambda p: p.surface)})
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    floors = lambda a, b: F.when(F.col("cross_type"), a).otherwise(b)
    likely = (F.upper(F.coalesce("verdict", F.lit(""))) == "YES") & (F.col("llm") >= floors(0.70, 0.90)) & (F.col("emb") >= floors(0.55, 0.85))
    mean = 0.45 * det + 0.12 * F.col("lex") + 0.13 * F.col("graph") + 0.18 * F.col("llm") + 0.12 * F.col("emb") - risk
    score = F.when(F.col("module").isin(*BY_TIER), unit(det - risk)).when(F.col("module") == "semanticLinker", F.when(likely, unit(F.col("llm") * F.col("emb") - risk)).otherwise(0.0)).otherwise(unit(mean))
    safe = (F.col("surface") == "canonical_safe") & (det >= 1) & (risk < 0.2)
    canonical, auto = policy(lambda p: p.canonical), policy(lambda p: p.auto)
    rows = rows.withColumn("confidence", F.round(F.when(safe, F.greatest(score, canonical)).otherwise(score), 6))
    doubtful = (F.col("link_type") == "possible_same_person") & (det < 1)
    photo = (F.col("module") == "mediaLinker") & (det < 1)
    auto = F.when(doubtful, F.greatest(auto, F.lit(0.99))).when(photo, F.greatest(auto, F.lit(0.90))).otherwise(auto)
    canonical = F.when(doubtful, F.greatest(canonical, F.lit(0.99))).when(photo, 1.0).otherwise(canonical)
    c = F.col("confidence")
    decision = F.when(safe & (c >= canonical), "canonical_safe").when((c >= auto) & (risk < 0.25), "auto_promote").when(c >= policy(lambda p: p.review), "review").otherwise("discard")
    sure = det >= 1
    reason = (
        F.when(risk >= 0.25, "high_risk").when(sure & F.col("link_type").isin("message_in_thread", "thread_has_message", "message_has_attachment", "event_has_message", "event_has_thread"), "exact_reverse_link")
        .when(sure & F.col("link_type").isin("thread_has_person", "message_mentions_person", "event_has_person"), "exact_participant").when(sure, "exact_identifier")
        .when((F.col("module") == "calendarLinker") & ((det >= 0.8) | (F.col("lex") >= 0.6)), "calendar_hint").when(F.col("decision") == "review", "borderline").otherwise("low_confidence")
    )
    return rows.withColumn("decision", decision).withColumn("reason", reason)


def promoted(decided: DataFrame, cards: DataFrame) -> DataFrame:
    """What canonical links write: source_uid, field, value, and status: applied, present (named already) or conflict (a single value that differs).

    List fields take the targets that they lack, in order of uid.
    """
    field = F.coalesce(*(F.when(F.col("link_type") == k, F.lit(p.field)) for k, p in POLICIES.items() if p.field))
    person = F.coalesce(*(F.when(F.col("link_type") == k, p.field == "people") for k, p in POLICIES.items() if p.field), F.lit(False))
    rows = decided.filter("decision = 'canonical_safe'").withColumns({"field": field, "by_name": person}).filter("field is not null")
    names = cards.select(F.col("uid").alias("target_uid"), F.col("slug").alias("t_slug"), clean(raw(F.col("fields"), "summary")).alias("t_name"))
    own = cards.select(F.col("uid").alias("source_uid"), F.col("fields"))
    told = rows.join(names, "target_uid").join(own, "source_uid").withColumn("value", F.when(F.col("by_name"), F.col("t_name")).otherwise(F.concat(F.lit("[["), "t_slug", F.lit("]]"))))
    held = items(F.coalesce(F.try_element_at("fields", F.col("field")), F.lit("")))
    there = F.exists(held, lambda v: slug(reference(v)) == slug(reference(F.col("value"))))
    status = F.when(there, "present").when(F.col("field").isin(*SCALARS) & (F.size(held) > 0), "conflict").otherwise("applied")
    return told.select("source_uid", "target_uid", "link_type", "field", "value", status.alias("status"))


def with_promoted(edges: DataFrame, decided: DataFrame) -> DataFrame:
    """``edges`` (source_uid, target_uid, edge_type, confidence) and the links that were promoted as derived ones."""
    more = decided.filter("decision = 'auto_promote'").select("source_uid", "target_uid", F.col("link_type").alias("edge_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return edges.select("source_uid", "target_uid", "edge_type", "confidence").unionByName(more)


def impact(edges: DataFrame, own_types: tuple[str, ...]) -> DataFrame:
    """(uid, neighbour), both ways, that only edges of other types join: what is left without ``own_types``."""
    both = edges.select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("neighbour"), "edge_type").unionByName(edges.select(F.col("target_uid"), F.col("source_uid"), "edge_type").toDF("uid", "neighbour", "edge_type"))
    own = F.col("edge_type").isin(*own_types)
    return both.groupBy("uid", "neighbour").agg(F.max(own).alias("own")).filter("not own").select("uid", "neighbour")


def quality_gate(cards: DataFrame, jobs: DataFrame, decided: DataFrame, metrics: DataFrame, orphans: int, duplicates: int, coverage: float = 1.0, backlog: int = 50, precision: float = 0.95) -> DataFrame:
    """One row: scan_coverage, review_backlog, high_risk_precision, dead ends left out, and whether the gate passes.

    ``jobs`` (source_uid, status), ``metrics`` (module, sample_precision).
    Backlog: links for review of persons, mail, chats, events and transcripts.
    """
    urgent = ("person", "email_thread", "email_message", "imessage_thread", "imessage_message", "calendar_event", "meeting_transcript")
    scanned = jobs.agg(F.countDistinct("source_uid").alias("asked"), F.countDistinct(F.when(F.col("status") == "completed", F.col("source_uid"))).alias("done"))
    waiting = decided.filter("decision = 'review'").join(cards.filter(F.col("type").isin(*urgent)).select(F.col("uid").alias("source_uid")), "source_uid", "left_semi").agg(F.count("*").alias("review_backlog"))
    risky = metrics.filter(F.col("module").isin("identityLinker", "mediaLinker", "calendarLinker") & (F.col("sample_precision") > 0)).agg(F.coalesce(F.round(F.min("sample_precision"), 6), F.lit(1.0)).alias("high_risk_precision"))
    one = scanned.join(waiting).join(risky)  # a row each
    share = F.when(F.col("asked") > 0, F.round(F.col("done") / F.col("asked"), 6)).otherwise(0.0)
    passes = (F.col("scan_coverage") >= coverage) & F.lit(orphans == 0) & F.lit(duplicates == 0) & (F.col("review_backlog") <= backlog) & (F.col("high_risk_precision") >= precision)
    return one.withColumn("scan_coverage", share).select("scan_coverage", "review_backlog", "high_risk_precision", passes.alias("passes"))


# merchants and finance

# Marks of payment processors before a merchant's name, names that stand for one, endings of firms.
PROCESSORS = r"(?i)^(?:SQ|TST|SP|PAYPAL|PY|DOORDASH|UBER|AMZ)\s*\*\s*"
AMAZON = r"(?i)^\s*(?:AMZN(?:\s+MKTPLACE|\s+MKTPL)?|AMAZON(?:\s+MKTPL)?)\b"
FIRM = r"\s+(?:com|inc|llc|ltd|co|corp|incorporated)\b\.?\s*$"
TIERS = {"source_email": (0.98, 0.0), "source_email_weak": (0.72, 0.06), "high": (0.90, 0.0), "medium": (0.78, 0.05), "low": (0.55, 0.15)}
WINDOWS = {"high": (2, 60), "medium": (5, 60), "low": (3, 14)}
#: By card type the fields that add up to its amount, and those that name its merchant.
AMOUNTS = {
    "finance": ("amount",), "purchase": ("total",), "meal_order": ("total",), "grocery_order": ("total",), "ride": ("fare", "tip"), "flight": ("fare_amount",), "accommodation": ("total_cost",),
    "car_rental": ("total_cost",), "subscription": ("price",), "payroll": ("net_amount",), "event_ticket": ("price",),
}
MERCHANTS = {
    "finance": ("counterparty",), "purchase": ("vendor",), "meal_order": ("restaurant", "service"), "grocery_order": ("store", "service"), "ride": ("service",), "flight": ("airline",),
    "accommodation": ("property_name", "booking_source"), "car_rental": ("company",), "subscription": ("service_name",), "payroll": ("employer",), "event_ticket": ("venue", "event_name"),
}


def merchant(name: Column) -> Column:
    """A merchant's name without processor, punctuation and firm's ending, lower case."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), PROCESSORS, ""), AMAZON, "amazon")
    out = F.trim(F.lower(F.regexp_replace(out, r"(?U)[^\w\s]", " ")))
    return clean(F.regexp_replace(out, FIRM, ""))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's likeness of two texts, 0 to 1; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def merchants_match(a: Column, b: Column) -> Column:
    """Of normalised names: equal, one (of four letters or more) within the other, or alike to 0.70; empty ones match nothing."""
    short = F.when(F.char_length(a) <= F.char_length(b), a).otherwise(b)
    long = F.when(F.char_length(a) <= F.char_length(b), b).otherwise(a)
    surely = (a == b) | ((F.char_length(short) >= 4) & F.contains(long, short))
    # letters in common are at most half of what edit distance leaves of both lengths, so most pairs need no matcher
    may = (a != "") & (b != "") & ~surely & (F.levenshtein(a, b) <= 0.3 * (F.char_length(a) + F.char_length(b)) + 1e-9)
    return (a != "") & (b != "") & (surely | (may & (sequence_ratio(F.when(may, a), F.when(may, b)) >= 0.70)))


def charges(cards: DataFrame) -> DataFrame:
    """uid, type, amount, merchant, currency, mail (the source mail's slug), at and refund of the cards that have an amount."""
    f = F.col("fields")
    number = lambda n: F.coalesce(F.trim(raw(f, n)).try_cast("double"), F.lit(0.0))
    amount = F.coalesce(*(F.when(F.col("type") == k, sum((number(n) for n in names), F.lit(0.0))) for k, names in AMOUNTS.items()))
    amount = F.when(F.col("type") == "finance", F.abs(amount)).when(F.col("type") == "event_ticket", amount * F.greatest(F.trim(raw(f, "quantity")).try_cast("int"), F.lit(1))).otherwise(amount)
    named = lambda names: F.coalesce(*(F.when(F.trim(raw(f, n)) != "", raw(f, n)) for n in names), F.lit(""))
    who = F.coalesce(*(F.when(F.col("type") == k, named(names)) for k, names in MERCHANTS.items()))
    currency = F.upper(F.trim(raw(f, "currency")))
    refund = (number("amount") < 0) & F.lower(F.trim(raw(f, "transaction_type"))).isin("refund", "credit", "return", "chargeback")
    return cards.filter(F.col("type").isin(*AMOUNTS)).select(
        "uid", "type", F.round(amount, 2).alias("amount"), merchant(who).alias("merchant"), F.when(currency == "", "USD").otherwise(currency).alias("currency"),
        F.lower(reference(raw(f, "source_email"))).alias("mail"), activity_at(f).alias("at"), refund.alias("refund"),
    ).filter("amount > 0")


def finance_candidates(cards: DataFrame) -> DataFrame:
    """finance_uid, target_uid, tier, det and risk of charges and the receipts that they pay; the first tier of each pair wins.

    source_email: one source mail, and two of the same amount (to a cent), two
    days, one merchant; with one of them, weak. high, medium, low: the same
    amount to the cent within WINDOWS' days (more for refunds), and for high
    one merchant, for medium one mail thread. Always one currency. Pairs meet
    by mail, or by currency, amount and stretches of days, so that no day's
    charges all meet.
    """
    all_cards = charges(cards)
    threads = cards.filter("type = 'email_message'").select(F.lower("slug").alias("mail"), clean(raw(F.col("fields"), "gmail_thread_id")).alias("thread")).groupBy("mail").agg(F.min("thread").alias("thread"))
    all_cards = all_cards.join(threads, "mail", "left")
    side = lambda df, p: df.select("currency", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "currency"))
    fin, tgt = side(all_cards.filter("type = 'finance' and at is not null"), "f"), side(all_cards.filter("type <> 'finance'"), "t")
    apart = F.abs(F.col("f_at").cast("double") - F.col("t_at").cast("double")) / 86400
    one = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    n = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mailed = fin.filter("f_mail <> ''").repartition(n, "f_mail", "currency").join(tgt.filter("t_mail <> ''"), (F.col("f_mail") == F.col("t_mail")) & (fin["currency"] == tgt["currency"])).drop(tgt["currency"])
    signals = one(F.abs(F.col("f_amount") - F.col("t_amount")) <= 0.01) + one(apart <= 2) + one(merchants_match(F.col("f_merchant"), F.col("t_merchant")))
    mailed = mailed.withColumn("signals", signals).filter("signals > 0").select("f_uid", "t_uid", F.when(F.col("signals") >= 2, 0).otherwise(1).alias("tier"))
    found = [mailed]
    for refund, width in ((False, 5), (True, 60)):
        block = lambda c, d=width: F.floor(F.col(c).cast("double") / 86400 / d)
        a = fin.filter(F.col("f_refund") == refund).withColumns({"key": F.format_string("%.2f", "f_amount"), "block": block("f_at")})
        b = tgt.filter("t_at is not null").withColumns({"key": F.format_string("%.2f", "t_amount"), "block": F.explode(F.array(*(block("t_at") + i for i in (-1, 0, 1))))})
        near = a.join(b, ["currency", "key", "block"])
        within = lambda tier: apart <= WINDOWS[tier][int(refund)]  # noqa: E731, B023
        same_thread = (F.col("f_thread") != "") & (F.col("f_thread") == F.col("t_thread"))
        tier = F.when(within("high") & merchants_match(F.col("f_merchant"), F.col("t_merchant")), 2).when(within("medium") & same_thread, 3).when(within("low"), 4)
        found.append(near.withColumn("tier", tier).filter("tier is not null").select("f_uid", "t_uid", "tier"))
    best = reduce(DataFrame.unionByName, found).groupBy(F.col("f_uid").alias("finance_uid"), F.col("t_uid").alias("target_uid")).agg(F.min("tier").alias("n"))
    names = list(TIERS)
    pick = lambda value: F.coalesce(*(F.when(F.col("n") == i, F.lit(value(t))) for i, t in enumerate(names)))
    return best.select("finance_uid", "target_uid", pick(lambda t: t).alias("tier"), pick(lambda t: TIERS[t][0]).alias("det"), pick(lambda t: TIERS[t][1]).alias("risk"))


def external_matches(cards: DataFrame, provider: str) -> DataFrame:
    """external_id, n and the smallest uid of identifiers of a provider that several cards hold."""
    ids = external_ids(cards).filter(F.col("provider") == provider)
    return ids.groupBy("external_id").agg(F.countDistinct("card_uid").alias("n"), F.min("card_uid").alias("uid")).filter("n > 1")
