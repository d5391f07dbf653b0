"""Exports of other services as raw cards: uid, type, source_id, fields (map of raw values) and body.

Each reader takes what a service exports (JSON, CSV, TSV, XML, vCard, notes,
tables) with Spark's own sources, a row an item; nothing goes through the
driver. A card's uid comes from its source and id, so reading twice gives the
same cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.normalize import clean, email, handle, person_key
from cardloom.sources.notes import read_notes

MIN_AMOUNT = 20.0


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def listed(values: Column) -> Column:
    """An array as a raw list value; empty for none."""
    held = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v) != "")
    return F.when(F.size(held) > 0, F.concat(F.lit("["), F.array_join(F.transform(held, lambda v: F.trim(v)), ", "), F.lit("]"))).otherwise("")


def cards(rows: DataFrame, kind: str | Column, source: str, source_id: Column, fields: dict[str, Column], body: Column | None = None) -> DataFrame:
    """Rows without an id are left out; of rows of one id the greatest stays."""
    told = {"source": F.lit(f"[{source}]"), "source_id": source_id, **fields}
    out = rows.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), source_id.alias("source_id"), F.create_map(*(x for k, v in told.items() for x in (F.lit(k), text(v)))).alias("fields"), text(body if body is not None else F.lit("")).alias("body"),
    ).filter("trim(source_id) <> ''")
    uid = F.concat(F.lit("card-"), "type", F.lit("-"), F.left(F.sha2(F.concat(F.lit(f"{source}:"), "source_id"), 256), F.lit(12)))
    best = out.withColumn("uid", uid).groupBy("uid", "type", "source_id").agg(F.max(F.struct("body", F.map_entries("fields").alias("f"))).alias("m"))
    return best.select("uid", "type", "source_id", F.map_from_entries("m.f").alias("fields"), F.col("m.body").alias("body"))


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with a header, names in lower case with underscores, nulls empty."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(F.coalesce(F.trim(df[f"`{c}`"]), F.lit("")).alias(c.strip().lower().replace(" ", "_")) for c in df.columns))


def _has(df: DataFrame, *names: str) -> Column:
    """The first filled one of the columns that there are."""
    own = [F.when(F.col(n) != "", F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*own, F.lit("")) if own else F.lit("")


def linkedin(spark: SparkSession, path: str) -> DataFrame:
    """Connections, whatever notes stand above the header."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?is)\A.*?(?=first ?name,last ?name,)", "").alias("v"))
    line = F.explode(F.split("v", r"\r?\n"))
    schema = "first_name string, last_name string, url string, email string, company string, position string, connected_on string"
    rows = whole.select(line.alias("line")).filter("trim(line) <> '' and not lower(line) like 'first%name,last%name,%'").select(F.from_csv("line", schema).alias("r")).select("r.*")
    user = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"linkedin\.com/in/([^/?#]+)", 1))
    name = clean(F.concat_ws(" ", "first_name", "last_name"))
    sid = F.when(user != "", user).when(text(F.col("email")) != "", email(F.col("email"))).otherwise(name)
    return cards(rows, "person", "linkedin", sid, {
        "summary": name, "first_name": F.col("first_name"), "last_name": F.col("last_name"), "emails": listed(F.array(email(F.col("email")))), "linkedin": user, "company": F.col("company"), "title": F.col("position"),
    }, F.when(text(F.col("connected_on")) != "", F.concat(F.lit("Connected on: "), "connected_on")))


def notion_people(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    name = _has(df, "name", "full_name")
    return cards(df, "person", "notion", F.when(_has(df, "email") != "", email(_has(df, "email"))).otherwise(name), {
        "summary": name, "emails": listed(F.split(_has(df, "email", "emails"), r"[,;]\s*")), "phones": listed(F.array(_has(df, "phone"))), "company": _has(df, "company", "organization"), "title": _has(df, "title", "role"),
    })


def copilot_finance(spark: SparkSession, path: str, least: float = MIN_AMOUNT) -> DataFrame:
    """Transactions of at least ``least``, whatever their sign."""
    df = _csv(spark, path)
    amount = F.coalesce(F.regexp_replace(_has(df, "amount"), r"[$,]", "").try_cast("double"), F.lit(0.0))
    day, who = F.left(_has(df, "date", "transaction_date"), F.lit(10)), F.coalesce(F.nullif(_has(df, "merchant", "name", "description"), F.lit("")), F.lit("transaction"))
    rows = df.withColumns({"_amount": amount, "_day": day, "_who": who}).filter(F.abs(F.col("_amount")) >= least)
    sid = F.sha2(F.concat_ws("|", "_day", "_who", F.format_string("%.2f", "_amount"), _has(df, "account"), _has(df, "note")), 256)
    return cards(rows, "finance", "copilot", sid, {
        "summary": F.col("_who"), "amount": F.format_string("%.2f", "_amount"), "currency": F.upper(F.coalesce(F.nullif(_has(df, "currency"), F.lit("")), F.lit("USD"))), "counterparty": F.col("_who"), "created": F.col("_day"),
        "category": _has(df, "category", "account_type"), "transaction_type": _has(df, "type"), "tags": listed(F.split(_has(df, "tags"), ",")),
    })


def contacts_vcf(spark: SparkSession, path: str) -> DataFrame:
    """vCards, folded lines joined."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n[ \t]", "").alias("v"))
    rows = whole.select(F.explode(F.regexp_extract_all("v", F.lit(r"(?is)BEGIN:VCARD(.*?)END:VCARD"), F.lit(1))).alias("c"))
    all_of = lambda name: F.transform(F.regexp_extract_all("c", F.lit(rf"(?im)^(?:item\d+\.)?{name}(?:;[^:\r\n]*)?:([^\r\n]*)"), F.lit(1)), lambda v: F.trim(v))
    one = lambda name: F.coalesce(F.try_element_at(all_of(name), F.lit(1)), F.lit(""))
    parts = F.split(one("N"), ";")
    mails = F.transform(all_of("EMAIL"), lambda v: email(v))
    sid = F.coalesce(F.nullif(one("UID"), F.lit("")), F.try_element_at(mails, F.lit(1)), F.nullif(one("FN"), F.lit("")), F.lit(""))
    return cards(rows, "person", "contacts.vcf", sid, {
        "summary": one("FN"), "first_name": F.get(parts, F.lit(1)), "last_name": F.get(parts, F.lit(0)), "emails": listed(mails), "phones": listed(all_of("TEL")), "company": F.regexp_replace(one("ORG"), ";.*$", ""), "title": one("TITLE"), "birthday": one("BDAY"),
    })


def contacts_google(spark: SparkSession, path: str) -> DataFrame:
    schema = "resourceName string, names array<struct<displayName string, givenName string, familyName string>>, emailAddresses array<struct<value string>>, phoneNumbers array<struct<value string>>, organizations array<struct<name string, title string>>"
    rows = spark.read.schema(schema).json(path)
    first = lambda c, f: F.get(c, F.lit(0))[f]
    return cards(rows, "person", "contacts.google", F.col("resourceName"), {
        "summary": first("names", "displayName"), "first_name": first("names", "givenName"), "last_name": first("names", "familyName"), "emails": listed(F.transform("emailAddresses", lambda e: email(e["value"]))),
        "phones": listed(F.transform("phoneNumbers", lambda p: p["value"])), "company": first("organizations", "name"), "title": first("organizations", "title"),
    })


def calendar(spark: SparkSession, path: str) -> DataFrame:
    at = "struct<dateTime string, date string, timeZone string>"
    rows = spark.read.schema(f"id string, etag string, iCalUID string, status string, summary string, description string, location string, hangoutLink string, start {at}, end {at}, organizer struct<email string, displayName string>, attendees array<struct<email string>>").json(path)
    when = lambda c: F.coalesce(F.col(f"{c}.dateTime"), F.col(f"{c}.date"))
    return cards(rows, "calendar_event", "calendar", F.col("id"), {
        "summary": F.col("summary"), "title": F.col("summary"), "event_id": F.col("id"), "event_etag": F.col("etag"), "ical_uid": F.col("iCalUID"), "status": F.col("status"), "start_at": when("start"), "end_at": when("end"), "timezone": F.col("start.timeZone"),
        "all_day": F.col("start.dateTime").isNull(), "location": F.col("location"), "conference_url": F.col("hangoutLink"), "organizer_email": email(F.col("organizer.email")), "organizer_name": F.col("organizer.displayName"),
        "attendee_emails": listed(F.transform("attendees", lambda a: email(a["email"]))), "description": F.col("description"),
    })


_PART = "struct<filename: string, mimeType: string, partId: string, body: struct<attachmentId: string, size: long, data: string>>"
_MAIL = f"id string, threadId string, historyId string, labelIds array<string>, snippet string, internalDate string, payload struct<mimeType: string, headers: array<struct<name: string, value: string>>, body: struct<data: string>, parts: array<{_PART}>>"
ADDRESS = r"<?([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)>?"


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """Messages with a map of their headers, names in lower case, the first of each."""
    rows = spark.read.schema(_MAIL).json(path)
    pairs = F.transform(F.coalesce("payload.headers", F.array().cast("array<struct<name: string, value: string>>")), lambda h: F.struct(F.lower(h["name"]).alias("k"), h["value"].alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return rows.withColumn("h", F.map_from_entries(first))


def _addresses(header: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text(F.try_element_at("h", F.lit(header))), F.lit(ADDRESS), F.lit(1)), lambda v: F.lower(v)))


def _decoded(data: Column) -> Column:
    """URL-safe base64 as text."""
    return F.decode(F.unbase64(F.translate(text(data), "-_", "+/")), "UTF-8")


def gmail_messages(spark: SparkSession, path: str) -> DataFrame:
    rows = _headers(spark, path)
    head = lambda n: text(F.try_element_at("h", F.lit(n)))
    plain = F.filter("payload.parts", lambda p: p["mimeType"] == "text/plain")
    body = F.coalesce(_decoded(F.get(plain, F.lit(0))["body"]["data"]), _decoded(F.col("payload.body.data")))
    files = F.filter("payload.parts", lambda p: F.coalesce(p["filename"], F.lit("")) != "")
    sent = F.date_format(F.timestamp_millis(F.col("internalDate").try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return cards(rows, "email_message", "gmail", F.col("id"), {
        "summary": head("subject"), "subject": head("subject"), "gmail_message_id": F.col("id"), "gmail_thread_id": F.col("threadId"), "gmail_history_id": F.col("historyId"), "message_id_header": head("message-id"), "in_reply_to": head("in-reply-to"),
        "from_email": F.coalesce(F.get(_addresses("from"), F.lit(0)), F.lit("")), "from_name": F.trim(F.regexp_replace(head("from"), r"\s*<.*$|\"", "")), "to_emails": listed(_addresses("to")), "cc_emails": listed(_addresses("cc")),
        "participant_emails": listed(F.array_distinct(F.concat(_addresses("from"), _addresses("to"), _addresses("cc")))), "sent_at": sent, "snippet": F.col("snippet"), "label_ids": listed(F.col("labelIds")), "has_attachments": F.coalesce(F.size(files) > 0, F.lit(False)),
    }, body)


def gmail_attachments(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema(_MAIL).json(path).select("id", "threadId", F.explode("payload.parts").alias("p")).filter("coalesce(p.filename, '') <> ''")
    return cards(parts, "email_attachment", "gmail", F.concat_ws(":", "id", F.coalesce("p.body.attachmentId", "p.partId", "p.filename")), {
        "summary": F.col("p.filename"), "filename": F.col("p.filename"), "mime_type": F.col("p.mimeType"), "size_bytes": F.col("p.body.size"), "attachment_id": F.col("p.body.attachmentId"), "gmail_message_id": F.col("id"), "gmail_thread_id": F.col("threadId"),
    })


def gmail_threads(messages: DataFrame) -> DataFrame:
    """Threads of message cards: counted, dated and named by partial aggregates; their subject is the first message's."""
    f = F.col("fields")
    rows = messages.select(f["gmail_thread_id"].alias("t"), f["sent_at"].alias("at"), f["subject"].alias("subject"), f["from_email"].alias("sender")).filter("t <> ''")
    told = rows.groupBy("t").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("subject", "at").alias("subject"))
    return cards(told, "email_thread", "gmail", F.col("t"), {
        "summary": F.col("subject"), "subject": F.col("subject"), "gmail_thread_id": F.col("t"), "message_count": F.col("n"), "first_message_at": F.col("first"), "last_message_at": F.col("last"),
    })


def gmail_correspondents(spark: SparkSession, path: str, own: str) -> DataFrame:
    """Persons of mail headers but for ``own``: how often they were seen, since when, and by which name most."""
    rows = _headers(spark, path).select(F.timestamp_millis(F.col("internalDate").try_cast("long")).alias("at"), F.explode(F.split(F.concat_ws(",", *(F.try_element_at("h", F.lit(n)) for n in ("from", "to", "cc"))), r",(?=[^\"]*(?:\"[^\"]*\"[^\"]*)*$)")).alias("v"))
    seen = rows.select("at", F.lower(F.regexp_extract("v", ADDRESS, 1)).alias("address"), F.trim(F.regexp_replace("v", r"<.*$|\"", "")).alias("name")).filter((F.col("address") != "") & (F.col("address") != own.lower()))
    named = seen.filter(~F.contains("name", F.lit("@")) & (F.col("name") != "")).groupBy("address", "name").agg(F.count("*").alias("n")).groupBy("address").agg(F.max(F.struct("n", "name")).alias("m"))
    counts = seen.groupBy("address").agg(F.count("*").alias("seen"), F.min("at").alias("first"), F.max("at").alias("last")).join(named, "address", "left")
    return cards(counts, "person", "gmail.correspondents", F.col("address"), {
        "summary": F.coalesce("m.name", "address"), "emails": listed(F.array("address")), "emails_seen_count": F.col("seen"), "created": F.date_format("first", "yyyy-MM-dd"), "updated": F.date_format("last", "yyyy-MM-dd"),
    })


def otter(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts: what was said, a line "speaker: text" each."""
    rows = spark.read.schema("otid string, meeting_id string, title string, start_time long, end_time long, duration double, language string, url string, calendar_event_id string, speakers array<struct<name string, email string>>, transcripts array<struct<speaker string, transcript string>>").json(path)
    at = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.array_join(F.transform("transcripts", lambda t: F.concat_ws(": ", t["speaker"], t["transcript"])), "\n\n")
    return cards(rows, "meeting_transcript", "otter", F.col("otid"), {
        "summary": F.col("title"), "title": F.col("title"), "otter_conversation_id": F.col("otid"), "otter_meeting_id": F.col("meeting_id"), "start_at": at("start_time"), "end_at": at("end_time"), "duration_seconds": F.col("duration"), "language": F.col("language"), "transcript_url": F.col("url"),
        "event_id_hint": F.col("calendar_event_id"), "speaker_names": listed(F.transform("speakers", lambda s: s["name"])), "speaker_emails": listed(F.transform("speakers", lambda s: email(s["email"]))),
    }, said)


TEXTS = ("txt", "md", "csv", "json", "html", "htm", "xml")


def file_library(spark: SparkSession, root: str) -> DataFrame:
    """A folder of files as documents: where they lie, size and digest; the text of plain ones, HTML without its tags."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext, name = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.regexp_extract("path", r"([^/]+)$", 1)
    plain = F.when(ext.isin(*TEXTS), F.decode("content", "UTF-8"))
    body = F.when(ext.isin("html", "htm"), document_text(plain)).otherwise(plain)
    relative = F.regexp_replace("path", rf"^.*?{root.rstrip('/').split('/')[-1]}/", "")
    return cards(files, "document", "files", relative, {
        "summary": name, "title": name, "library_root": F.lit(root.rstrip("/").split("/")[-1]), "relative_path": relative, "extension": ext, "content_sha": F.sha2("content", 256), "file_modified_at": F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "extraction_status": F.when(plain.isNull(), "unsupported").when(F.trim(plain) == "", "empty").otherwise("done"), "extracted_text_sha": F.when(body.isNotNull(), F.sha2(body, 256)),
    }, body)


def document_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags gone, white space single."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return clean(out)


def photos(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("uuid string, original_filename string, date string, persons array<string>, keywords array<string>, labels array<string>, albums array<string>, favorite boolean, hidden boolean, ismovie boolean, width int, height int, latitude double, longitude double, place struct<name string, city string, state string, country string>").json(path)
    same = {c: F.col(c) for c in ("original_filename", "favorite", "hidden", "width", "height", "latitude", "longitude")}
    return cards(rows, "media_asset", "photos", F.col("uuid"), {
        "summary": F.col("original_filename"), "photos_asset_id": F.col("uuid"), "captured_at": F.col("date"), "media_type": F.when(F.col("ismovie"), "video").otherwise("photo"), "person_labels": listed(F.col("persons")), "keywords": listed(F.col("keywords")),
        "labels": listed(F.col("labels")), "albums": listed(F.col("albums")), **{f"place_{p}": F.col(f"place.{p}") for p in ("name", "city", "state", "country")}, **same,
    })


def github(spark: SparkSession, root: str) -> DataFrame:
    """repositories, commits, threads (issues and pull requests) and messages of JSON lines in folders of these names."""
    of = lambda name, schema: spark.read.schema(schema).json(f"{root}/{name}")
    user = "struct<login string>"
    repos = of("repositories", f"id long, full_name string, html_url string, description string, default_branch string, private boolean, fork boolean, topics array<string>, language string, stargazers_count int, forks_count int, open_issues_count int, owner {user}")
    commits = of("commits", "sha string, repo string, commit struct<message string, author struct<name string, email string, date string>>, parents array<struct<sha string>>")
    threads = of("threads", f"id long, number int, repo string, title string, body string, state string, user {user}, labels array<struct<name string>>, assignees array<{user}>, pull_request struct<url string>, closed_at string, merged_at string, created_at string")
    notes = of("messages", f"id long, repo string, number int, body string, user {user}, path string, position int, commit_id string, diff_hunk string, created_at string")
    repo = lambda c: F.concat(F.lit("[[repo-"), F.replace(c, F.lit("/"), F.lit("-")), F.lit("]]"))
    out = cards(repos, "git_repository", "github", F.col("full_name"), {
        "summary": F.col("full_name"), "repository_name_with_owner": F.col("full_name"), "repository_id": F.col("id"), "repository_url": F.col("html_url"), "default_branch": F.col("default_branch"), "is_private": F.col("private"), "is_fork": F.col("fork"),
        "topics": listed(F.col("topics")), "languages": listed(F.array("language")), "stargazer_count": F.col("stargazers_count"), "fork_count": F.col("forks_count"), "open_issue_count": F.col("open_issues_count"), "owner_login": F.col("owner.login"), "description": F.col("description"),
    }, F.col("description"))
    out = out.unionByName(cards(commits, "git_commit", "github", F.col("sha"), {
        "summary": F.regexp_extract("commit.message", r"^[^\n]*", 0), "message_headline": F.regexp_extract("commit.message", r"^[^\n]*", 0), "repository_name_with_owner": F.col("repo"), "repository": repo(F.col("repo")), "commit_sha": F.col("sha"), "author_name": F.col("commit.author.name"),
        "author_email": email(F.col("commit.author.email")), "committed_at": F.col("commit.author.date"), "parent_shas": listed(F.transform("parents", lambda p: p["sha"])),
    }, F.col("commit.message")))
    out = out.unionByName(cards(threads, "git_thread", "github", F.concat_ws("#", "repo", "number"), {
        "summary": F.col("title"), "title": F.col("title"), "repository_name_with_owner": F.col("repo"), "repository": repo(F.col("repo")), "github_thread_id": F.col("id"), "thread_kind": F.when(F.col("pull_request").isNull(), "issue").otherwise("pull_request"), "number": F.col("number"), "state": F.col("state"),
        "author_login": F.col("user.login"), "labels": listed(F.transform("labels", lambda x: x["name"])), "assignees": listed(F.transform("assignees", lambda a: a["login"])), "closed_at": F.col("closed_at"), "merged_at": F.col("merged_at"), "created": F.col("created_at"),
    }, F.col("body")))
    return out.unionByName(cards(notes, "git_message", "github", F.col("id").cast("string"), {
        "summary": F.left(clean(F.col("body")), F.lit(80)), "repository_name_with_owner": F.col("repo"), "repository": repo(F.col("repo")), "thread": F.concat(F.lit("[[thread-"), F.replace("repo", F.lit("/"), F.lit("-")), F.lit("-"), "number", F.lit("]]")), "github_message_id": F.col("id"),
        "actor_login": F.col("user.login"), "path": F.col("path"), "position": F.col("position"), "review_commit_sha": F.col("commit_id"), "diff_hunk": F.col("diff_hunk"), "created": F.col("created_at"),
    }, F.col("body")))


# health and medicine

def apple_health(spark: SparkSession, path: str) -> DataFrame:
    """Records per type and day: how many, sum, least and most; workouts per kind and day with their minutes."""
    xml = lambda tag, names: spark.read.format("xml").option("rowTag", tag).schema(", ".join(f"_{n} string" for n in names)).load(path)
    rec = xml("Record", ("type", "unit", "value", "startDate", "endDate"))
    day, value = F.left("_startDate", F.lit(10)), F.col("_value").try_cast("double")
    at = lambda c: F.to_timestamp(F.left(c, F.lit(19)), "yyyy-MM-dd HH:mm:ss")
    hours = (at("_endDate").cast("double") - at("_startDate").cast("double")) / 3600
    asleep = F.contains("_type", F.lit("SleepAnalysis"))
    rolled = rec.groupBy(F.regexp_replace("_type", "^HK(Quantity|Category)TypeIdentifier", "").alias("kind"), day.alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.when(asleep, hours).otherwise(value)), 4).alias("total"), F.min(F.when(~asleep, value)).alias("least"), F.max(F.when(~asleep, value)).alias("most"), F.max(F.when(asleep, "h").otherwise(F.col("_unit"))).alias("unit"))
    work = xml("Workout", ("workoutActivityType", "duration", "startDate", "totalDistance", "totalEnergyBurned"))
    done = work.groupBy(F.regexp_replace("_workoutActivityType", "^HKWorkoutActivityType", "").alias("kind"), day.alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("_duration").try_cast("double")), 4).alias("total"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), F.lit("min").alias("unit"))
    both = rolled.withColumn("record", F.lit("rollup")).unionByName(done.withColumn("record", F.lit("workout"))).filter("day <> ''")
    return cards(both, "medical_record", "apple_health", F.concat_ws(":", "record", "kind", "day"), {
        "summary": F.concat_ws(" ", "kind", "day"), "source_system": F.lit("apple_health"), "source_format": F.lit("xml"), "record_type": F.col("record"), "record_subtype": F.col("kind"), "occurred_at": F.col("day"), "value_numeric": F.col("total"), "unit": F.col("unit"),
        "details": F.to_json(F.struct("n", "least", "most")),
    })


_CODE = "struct<text: string, coding: array<struct<system: string, code: string, display: string>>>"
_FHIR = (
    f"struct<resourceType: string, id: string, status: string, code: {_CODE}, vaccineCode: {_CODE}, medicationCodeableConcept: {_CODE}, effectiveDateTime: string, occurrenceDateTime: string, onsetDateTime: string, authoredOn: string, recordedDate: string, "
    "lotNumber: string, manufacturer: struct<display: string>, valueQuantity: struct<value: double, unit: string>, valueString: string, encounter: struct<reference: string>, performer: array<struct<display: string>>>"
)


def fhir(spark: SparkSession, path: str) -> DataFrame:
    """The resources of FHIR bundles (or of single resources): immunisations as vaccinations, all else as medical records."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<entry: array<struct<resource: {_FHIR}>>, resourceType: string>").alias("b"), "value")
    inner = rows.filter("b.entry is not null").select(F.explode("b.entry").alias("e")).select("e.resource.*")
    single = rows.filter("b.entry is null and b.resourceType is not null").select(F.from_json("value", _FHIR).alias("r")).select("r.*")
    r = inner.unionByName(single).filter("id is not null")
    concept = F.coalesce("vaccineCode", "medicationCodeableConcept", "code")
    first = F.get(concept["coding"], F.lit(0))
    name = F.coalesce(first["display"], concept["text"], F.lit(""))
    at = F.coalesce("effectiveDateTime", "occurrenceDateTime", "onsetDateTime", "authoredOn", "recordedDate")
    shot = F.col("resourceType") == "Immunization"
    return cards(r, F.when(shot, "vaccination").otherwise("medical_record"), "fhir", F.concat_ws("/", "resourceType", "id"), {
        "summary": name, "source_system": F.lit("fhir"), "source_format": F.lit("json"), "record_type": F.lower("resourceType"), "status": F.col("status"), "occurred_at": at, "recorded_at": F.col("recordedDate"), "code_system": first["system"], "code": first["code"], "code_display": name,
        "vaccine_name": F.when(shot, name), "cvx_code": F.when(shot, first["code"]), "lot_number": F.col("lotNumber"), "manufacturer": F.col("manufacturer.display"), "value_numeric": F.col("valueQuantity.value"), "unit": F.col("valueQuantity.unit"), "value_text": F.col("valueString"),
        "encounter_source_id": F.regexp_replace("encounter.reference", "^Encounter/", ""), "provider_name": F.get("performer", F.lit(0))["display"],
    })


def ccd(spark: SparkSession, path: str) -> DataFrame:
    """The sections of CCD documents: code, title and text without its tags."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<section\b[^>]*>(.*?)</section>"), F.lit(1))).alias("i", "s"))
    code, title = F.regexp_extract("s", r'(?i)<code\b[^>]*\bcode="([^"]*)"', 1), clean(F.regexp_extract("s", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return cards(whole, "medical_record", "ccd", F.concat_ws("#", "file", "i"), {
        "summary": title, "source_system": F.lit("ccd"), "source_format": F.lit("xml"), "record_type": F.lit("section"), "record_subtype": title, "code": code,
    }, document_text(F.regexp_extract("s", r"(?is)<text[^>]*>(.*?)</text>", 1)))


def vaccine_key(name: Column, day: Column) -> Column:
    return F.concat_ws("|", person_key(name), F.left(day, F.lit(10)))


def overlaid_vaccinations(records: DataFrame, overlay: DataFrame) -> DataFrame:
    """vaccine_name, occurred_at, lot_number, manufacturer of both sides, one row a shot (name and day); ``records`` win where both tell."""
    side = lambda df, p: df.select(vaccine_key(F.col("vaccine_name"), F.col("occurred_at")).alias("key"), *(F.nullif(F.col(c), F.lit("")).alias(f"{p}_{c}") for c in SHOT)).dropDuplicates(["key"])
    both = side(records, "a").join(side(overlay, "b"), "key", "full_outer")
    return both.select(*(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in SHOT))


SHOT = ("vaccine_name", "occurred_at", "lot_number", "manufacturer")


def epic(spark: SparkSession, root: str) -> DataFrame:
    """Problems and shots of an Epic bundle of tab-separated tables, with the names of their coded values; shots of one name and day are one."""
    tsv = lambda name: _csv(spark, f"{root}/{name}.tsv", "\t")
    problems, diagnoses = tsv("PROBLEM_LIST"), tsv("CLARITY_EDG")
    named = problems.join(diagnoses.select("dx_id", "dx_name"), "dx_id", "left")
    out = cards(named, "medical_record", "epic", F.concat(F.lit("problem:"), "problem_list_id"), {
        "summary": F.coalesce("dx_name", F.lit("")), "source_system": F.lit("epic"), "source_format": F.lit("tsv"), "record_type": F.lit("problem"), "code": F.col("dx_id"), "code_display": F.col("dx_name"), "occurred_at": F.col("noted_date"), "status": F.col("problem_status"),
    })
    shots, kinds = tsv("IMMUNE"), tsv("CLARITY_IMMUNZATN")
    given = shots.join(kinds.select("immunzatn_id", "name"), "immunzatn_id", "left")
    return out.unionByName(cards(given, "vaccination", "epic", F.concat(F.lit("shot:"), vaccine_key(F.col("name"), F.col("immune_date"))), {
        "summary": F.coalesce("name", F.lit("")), "source_system": F.lit("epic"), "source_format": F.lit("tsv"), "vaccine_name": F.col("name"), "occurred_at": F.left("immune_date", F.lit(10)), "lot_number": F.col("lot"), "manufacturer": F.col("mfg"),
    }))


# chats, from the tables of their databases

def imessage(messages: DataFrame, chats: DataFrame, membership: DataFrame, handles: DataFrame, since: int = 0) -> DataFrame:
    """Messages and threads after row id ``since``. ``messages`` (rowid, guid, text, date, is_from_me, handle_id, chat_id), ``chats`` (chat_id, guid, display_name, service), ``membership`` (chat_id, handle_id), ``handles`` (handle_id, address)."""
    who = handles.select("handle_id", handle(F.col("address")).alias("address"))
    new = messages.filter(F.col("rowid") > since).join(who, "handle_id", "left").join(chats.select("chat_id", F.col("guid").alias("chat")), "chat_id", "left")
    out = cards(new, "imessage_message", "imessage", F.col("guid"), {
        "summary": F.left(clean(F.col("text")), F.lit(80)), "imessage_message_id": F.col("guid"), "imessage_chat_id": F.col("chat"), "sender_handle": F.when(F.col("is_from_me") == 1, "").otherwise(F.col("address")), "is_from_me": F.col("is_from_me") == 1, "sent_at": F.col("date"),
    }, F.col("text"))
    members = membership.join(who, "handle_id").groupBy("chat_id").agg(F.array_sort(F.collect_set("address")).alias("people"))  # of one chat
    touched = chats.join(new.select("chat_id").distinct(), "chat_id", "left_semi").join(members, "chat_id", "left")
    return out.unionByName(cards(touched, "imessage_thread", "imessage", F.col("guid"), {
        "summary": F.coalesce(F.nullif("display_name", F.lit("")), "guid"), "thread_title": F.col("display_name"), "imessage_chat_id": F.col("guid"), "service": F.col("service"), "participant_handles": listed(F.col("people")), "is_group": F.size("people") > 1,
    }))


def beeper(events: DataFrame, rooms: DataFrame, participants: DataFrame, since: int = 0) -> DataFrame:
    """Messages, threads and attachments after order ``since``. ``events`` (order_id, event_id, room_id, sender_id, type, text, sent_at, file_url, mime_type), ``rooms`` (room_id, title, bridge), ``participants`` (room_id, user_id, name)."""
    new = events.filter(F.col("order_id") > since)
    names = participants.select("room_id", F.col("user_id").alias("sender_id"), F.col("name").alias("sender_name")).dropDuplicates(["room_id", "sender_id"])
    said = new.join(names, ["room_id", "sender_id"], "left")
    out = cards(said.filter("type = 'message'"), "beeper_message", "beeper", F.col("event_id"), {
        "summary": F.left(clean(F.col("text")), F.lit(80)), "beeper_event_id": F.col("event_id"), "beeper_room_id": F.col("room_id"), "thread": F.concat(F.lit("[[beeper-"), "room_id", F.lit("]]")), "sender_id": F.col("sender_id"), "sender_name": F.col("sender_name"), "sent_at": F.col("sent_at"),
    }, F.col("text"))
    out = out.unionByName(cards(new.filter("coalesce(file_url, '') <> ''"), "beeper_attachment", "beeper", F.concat(F.lit("file:"), "event_id"), {
        "summary": F.col("file_url"), "message": F.col("event_id"), "src_url": F.col("file_url"), "mime_type": F.col("mime_type"), "is_gif": F.col("mime_type") == "image/gif",
    }))
    people = participants.groupBy("room_id").agg(F.array_sort(F.collect_set("name")).alias("names"))  # of one room
    touched = rooms.join(new.select("room_id").distinct(), "room_id", "left_semi").join(people, "room_id", "left")
    return out.unionByName(cards(touched, "beeper_thread", "beeper", F.col("room_id"), {
        "summary": F.coalesce(F.nullif("title", F.lit("")), "room_id"), "thread_title": F.col("title"), "beeper_room_id": F.col("room_id"), "bridge_name": F.col("bridge"), "participant_names": listed(F.col("names")),
    }))


def seed_people(spark: SparkSession, root: str) -> DataFrame:
    """The person notes of a folder."""
    notes = read_notes(spark, root).filter("type = 'person'")
    f = F.col("fields")
    return notes.select("uid", "type", text(F.try_element_at(f, F.lit("source_id"))).alias("source_id"), "fields", "body")
