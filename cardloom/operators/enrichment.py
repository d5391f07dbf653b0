"""Mail threads before a model sees them: stubs, what is known by sender and subject, gates, classifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.stems import words
from cardloom.operators.emails import RULES, route
from cardloom.operators.projections import raw
from cardloom.operators.ranks import folded_digests
from cardloom.sources.notes import items


@dataclass(frozen=True)
class Signs:
    """Lists that tell kinds of mail apart, lower-case; all are parameters, the defaults a small start.

    ``marketing``: words of a subject; ``automatic``: how subjects of automatic
    mail begin; ``robots``: local parts of senders that nobody reads;
    ``private``: domains of personal mailboxes.
    """

    marketing: tuple[str, ...] = ("bargain", "clearance", "coupon", "discount", "giveaway", "newsletter", "sale", "save", "voucher")
    automatic: tuple[str, ...] = ("out of office", "auto:", "automated response", "undeliverable")
    robots: tuple[str, ...] = ("noreply", "no-reply", "donotreply", "mailer-daemon", "postmaster", "bounce", "bounces")
    private: tuple[str, ...] = ("gmail.com", "icloud.com", "outlook.com", "proton.me")

    def trade(self, subject: Column) -> Column:
        return F.arrays_overlap(words(subject), F.array(*map(F.lit, self.marketing)))

    def machine(self, subject: Column) -> Column:
        """Does a subject, without its reply marks, begin like automatic mail?"""
        bare = F.regexp_replace(F.lower(F.trim(subject)), r"^((re|fwd?|aw)\s*:\s*)+", "")
        return F.exists(F.array(*map(F.lit, self.automatic)), lambda start: F.startswith(bare, start))

    def robot(self, address: Column) -> Column:
        return F.lower(F.substring_index(address, "@", 1)).isin(*self.robots)


def stubs(cards: DataFrame) -> DataFrame:
    """uid, thread, sent_at, from_email, subject and participants of mail cards; a message without a thread is one of its own."""
    f = F.col("fields")
    thread = F.trim(raw(f, "gmail_thread_id"))
    return cards.filter("type = 'email_message'").select(
        "uid", F.when(thread != "", thread).otherwise(F.concat(F.lit("_singleton:"), "uid")).alias("thread"), F.trim(raw(f, "sent_at")).alias("sent_at"), F.lower(F.trim(raw(f, "from_email"))).alias("from_email"),
        F.trim(raw(f, "subject")).alias("subject"), F.transform(items(raw(f, "participant_emails")), lambda e: F.lower(e)).alias("participants"), "body",
    )


def thread_index(messages: DataFrame) -> DataFrame:
    """Per thread: n, first and last time, the first message's subject, and the digest of its messages' digests in order of time.

    A thread's bodies never meet: each message gives its digest, and digests
    meet in blocks, so no row holds a thread.
    """
    digest = F.sha2(F.concat_ws("\n", "uid", F.coalesce("body", F.lit(""))), 256)
    told = messages.groupBy("thread").agg(F.count("*").alias("n"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"), F.min_by("subject", F.struct("sent_at", "uid")).alias("subject"))
    folded = folded_digests(messages, ["thread"], digest, ["sent_at", "uid"])
    return told.join(folded, "thread").select("thread", "n", "first_at", "last_at", "subject", F.col("digest").alias("thread_sha"))


def participant_names(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(thread, address, name) of all who take part; the address where no person (address, name) is known."""
    who = messages.select("thread", F.explode(F.array_distinct(F.concat(F.array("from_email"), "participants"))).alias("address")).filter("address <> ''").distinct()
    names = people.groupBy("address").agg(F.min("name").alias("name"))
    return who.join(names, "address", "left").select("thread", "address", F.coalesce("name", "address").alias("name"))


def prefilter(messages: DataFrame, known: DataFrame, noise: DataFrame, own_domains: tuple[str, ...] = (), signs: Signs = Signs()) -> DataFrame:
    """thread, decision (fast_track, skip or triage) and card_types (sorted) of each thread.

    ``known`` (domain, card_type): senders of receipts; ``noise`` (domain).
    fast_track: such a sender, unless all subjects are marketing. skip:
    noise, automatic mail, or private and own senders alone.
    """
    domain = F.lower(F.substring_index("from_email", "@", -1))
    types = known.groupBy("domain").agg(F.array_sort(F.collect_set("card_type")).alias("types"))  # a few each
    rows = messages.withColumn("domain", F.when(F.contains("from_email", F.lit("@")), domain).otherwise("")).join(types, "domain", "left").join(noise.select("domain", F.lit(True).alias("noisy")).distinct(), "domain", "left")
    noisy = F.coalesce("noisy", F.lit(False)) | signs.robot(F.col("from_email"))
    trade = ~noisy & F.col("types").isNotNull()
    friend = F.col("domain").isin(*signs.private, *own_domains) | noisy
    told = rows.groupBy("thread").agg(
        F.max(noisy | signs.machine(F.col("subject"))).alias("noise"), F.max(trade).alias("trade"), F.min(friend & ~trade).alias("friends"),
        F.coalesce(F.min(F.when(F.col("subject") != "", signs.trade(F.col("subject")))), F.lit(False)).alias("marketing"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(trade, F.col("types")))))).alias("card_types"),
    )
    decision = F.when(F.col("trade") & F.col("marketing"), "skip").when(F.col("trade"), "fast_track").when(F.col("noise") | F.col("friends"), "skip").otherwise("triage")
    return told.select("thread", decision.alias("decision"), F.when(decision == "fast_track", F.col("card_types")).otherwise(F.array().cast("array<string>")).alias("card_types"))


def gate(messages: DataFrame, known: DataFrame, noise: DataFrame, own_domains: tuple[str, ...] = (), signs: Signs = Signs()) -> DataFrame:
    """thread, decision (classify_with_types, classify or skip) and card_types: extractors by sender and subject count besides known domains."""
    routed = route(messages, body="body", rules=RULES).groupBy("thread").agg(F.array_sort(F.collect_set("card_type")).alias("routed"))
    told = prefilter(messages, known, noise, own_domains, signs).join(routed, "thread", "left")
    marketing = messages.filter("subject <> ''").groupBy("thread").agg(F.min(signs.trade(F.col("subject"))).alias("all_marketing"))
    types = F.array_sort(F.array_union("card_types", F.coalesce("routed", F.array().cast("array<string>"))))
    rows = told.join(marketing, "thread", "left").withColumn("types", types)
    some = F.size("types") > 0
    decision = F.when(some & F.coalesce("all_marketing", F.lit(False)), "skip").when(some, "classify_with_types").when(F.col("decision") == "skip", "skip").otherwise("classify")
    return rows.select("thread", decision.alias("decision"), F.when(decision == "classify_with_types", F.col("types")).otherwise(F.array().cast("array<string>")).alias("card_types"))


def latest_classifications(rows: DataFrame) -> DataFrame:
    """The last classification (thread, category, confidence, at, extracted) of each thread."""
    return rows.groupBy("thread").agg(F.max_by(F.struct("category", "confidence", "extracted"), F.struct("at", "category")).alias("m")).select("thread", "m.*")


def category_counts(rows: DataFrame) -> DataFrame:
    """Per category: threads, and those of them that aren't extracted yet."""
    return latest_classifications(rows).groupBy("category").agg(F.count("*").alias("n"), F.count(F.when(~F.col("extracted"), 1)).alias("open"))


def workflow_gate(cards: DataFrame) -> DataFrame:
    """uid, workflow and input_hash of the cards that a type's workflow takes: threads and events with a body or several messages, documents with text, charges with a counterparty."""
    f = F.col("fields")
    filled = lambda n: F.trim(raw(f, n)) != ""
    written = F.char_length(F.trim(F.coalesce("body", F.lit("")))) > 20
    tests = {
        "email_thread": written | (F.coalesce(raw(f, "message_count").try_cast("int"), F.size(items(raw(f, "messages")))) > 1), "imessage_thread": written, "calendar_event": filled("title") & (filled("description") | filled("attendee_emails")),
        "document": written & (raw(f, "extraction_status") != "failed"), "finance": filled("counterparty") & (F.coalesce(F.abs(raw(f, "amount").try_cast("double")), F.lit(0.0)) > 0),
    }
    keyed = {"finance": ("counterparty", "amount", "created", "category"), "document": ("title", "extracted_text_sha"), "calendar_event": ("title", "description", "attendee_emails", "start_at", "end_at")}
    test = F.coalesce(*(F.when(F.col("type") == k, t) for k, t in tests.items()))
    own = lambda k: F.concat_ws("|", *(raw(f, n) for n in keyed.get(k, ("subject", "messages", "last_message_at"))), F.sha2(F.coalesce("body", F.lit("")), 256))
    digest = F.coalesce(*(F.when(F.col("type") == k, own(k)) for k in tests))
    return cards.filter(F.col("type").isin(*tests)).filter(test).select("uid", F.col("type").alias("workflow"), F.sha2(digest, 256).alias("input_hash"))


def due(work: DataFrame, done: DataFrame) -> DataFrame:
    """The work (uid, workflow, input_hash) that wasn't done on the same input."""
    return work.join(done.select("uid", "workflow", "input_hash").distinct(), ["uid", "workflow", "input_hash"], "left_anti")


def day_links(sources: DataFrame, targets: DataFrame, days: int) -> DataFrame:
    """uid, side (source or target), day and n_links of rows (uid, day): a row each, linked to all of the other side within ``days`` days.

    A day is a class: all of it have the same links, those to the other side's
    rows of the days around, so links are counted by day and no pair is made.
    Rows without a day have no links.
    """
    rows = sources.select("uid", F.lit("source").alias("side"), "day").unionByName(targets.select("uid", F.lit("target").alias("side"), "day"))
    held = rows.filter("day is not null").groupBy("side", "day").agg(F.count("*").alias("n"))
    other = F.when(F.col("side") == "source", "target").otherwise("source")
    near = held.select(other.alias("side"), F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda i: F.date_add("day", i))).alias("day"), "n").groupBy("side", "day").agg(F.sum("n").alias("n_links"))
    return rows.join(near, ["side", "day"], "left").select("uid", "side", "day", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def day_candidates(sources: DataFrame, targets: DataFrame, days: int, block: int = 15) -> DataFrame:
    """(uid, target_uid) within ``days`` days (uid, day): they meet in stretches of ``block`` days, so no target is copied more than the window asks for."""
    of = lambda c: F.floor(F.date_diff(F.col(c), F.lit("1970-01-01").cast("date")) / block)
    reach = -(-days // block)
    a = sources.select("uid", "day", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda i: of("day") + i)).alias("b"))
    b = targets.select(F.col("uid").alias("target_uid"), F.col("day").alias("target_day"), of("day").alias("b"))
    return a.join(b, "b").filter(F.abs(F.date_diff("day", "target_day")) <= days).select("uid", "target_uid")

