"""Exports of other services, on small fixtures with missing fields and repeated items."""

import base64
import json

from pyspark.sql import functions as F

from cardloom.sources import adapters as A


def put(path, text):
    path.write_text(text)
    return str(path)


def lines(path, rows):
    return put(path, "\n".join(map(json.dumps, rows)) + "\n")


def by_id(df):
    out = {r.source_id: r for r in df.collect()}
    assert len(out) == df.count() and all(r.uid.startswith(f"card-{r.type}-") for r in out.values())
    return out


def test_tables_of_people_and_money(spark, tmp_path):
    got = by_id(A.linkedin(spark, put(tmp_path / "l.csv", 'Notes:\n"some, note"\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nAnn,Lee,https://www.linkedin.com/in/AnnLee/,,"Acme, Inc",Boss,01 Jan 2024\nBob,,,B@x.org,,,\n,,,,,,\n')))
    assert set(got) == {"annlee", "b@x.org"} and got["annlee"].fields["company"] == "Acme, Inc" and got["annlee"].body == "Connected on: 01 Jan 2024" and got["b@x.org"].fields["emails"] == "[b@x.org]"
    people = by_id(A.notion_people(spark, put(tmp_path / "n.csv", "Name,Email,Title\nAnn Lee,A@x.org,Boss\nBob,,\n")))
    assert set(people) == {"a@x.org", "Bob"} and people["a@x.org"].fields["title"] == "Boss"
    money = A.copilot_finance(spark, put(tmp_path / "c.csv", 'date,name,amount,currency,tags\n2024-01-02,Shop,"$1,025.50",,"a, b"\n2024-01-03,Small,19.99,,\n2024-01-04,Back,-20,eur,\n2024-01-04,Bad,x,,\n')).collect()
    assert sorted((r.fields["amount"], r.fields["currency"], r.fields["tags"]) for r in money) == [("-20.00", "EUR", ""), ("1025.50", "USD", "[a, b]")]


def test_contacts(spark, tmp_path):
    card = "BEGIN:VCARD\r\nUID:u1\r\nFN:Ann\r\n  Lee\r\nN:Lee;Ann;;;\r\nitem1.EMAIL;TYPE=home:Ann@X.org\r\nTEL;TYPE=cell:+1 555\r\nORG:Acme;Unit\r\nEND:VCARD\r\n"
    got = by_id(A.contacts_vcf(spark, put(tmp_path / "c.vcf", card + card.replace("u1", "u2").replace("FN:Ann\r\n  Lee\r\n", ""))))
    assert (got["u1"].fields["summary"], got["u1"].fields["first_name"], got["u1"].fields["emails"], got["u1"].fields["company"]) == ("Ann Lee", "Ann", "[ann@x.org]", "Acme") and got["u2"].fields["summary"] == ""
    rows = [{"resourceName": "p/1", "names": [{"displayName": "Ann"}], "emailAddresses": [{"value": "A@x.org"}]}, {"resourceName": "p/2"}, {"names": []}]
    google = by_id(A.contacts_google(spark, lines(tmp_path / "g.json", rows)))
    assert set(google) == {"p/1", "p/2"} and google["p/1"].fields["emails"] == "[a@x.org]" and google["p/2"].fields["summary"] == ""


def test_calendar_and_transcripts(spark, tmp_path):
    rows = [{"id": "e1", "iCalUID": "i1", "summary": "Sync", "start": {"dateTime": "2024-01-01T10:00:00Z"}, "attendees": [{"email": "A@x.org"}]}, {"id": "e2", "start": {"date": "2024-01-02"}}]
    got = by_id(A.calendar(spark, lines(tmp_path / "e.json", rows)))
    assert (got["e1"].fields["all_day"], got["e1"].fields["attendee_emails"], got["e2"].fields["all_day"], got["e2"].fields["start_at"]) == ("false", "[a@x.org]", "true", "2024-01-02")
    said = by_id(A.otter(spark, lines(tmp_path / "o.json", [{"otid": "o1", "title": "T", "start_time": 0, "transcripts": [{"speaker": "Ann", "transcript": "hi"}, {"speaker": "Bob", "transcript": "yes"}]}])))
    assert said["o1"].body == "Ann: hi\n\nBob: yes" and said["o1"].fields["start_at"] == "1970-01-01T00:00:00Z"


def mail(i, thread, sender, at, parts=()):
    heads = [("From", sender), ("To", "me@x.org, c@y.org"), ("Subject", f"S{i}"), ("subject", "second")]
    return {"id": f"m{i}", "threadId": thread, "internalDate": str(at * 1000), "payload": {"headers": [{"name": n, "value": v} for n, v in heads], "parts": list(parts)}}


def test_mail(spark, tmp_path):
    part = {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode("hé?>".encode()).decode()}}
    file = {"filename": "a.pdf", "mimeType": "application/pdf", "body": {"attachmentId": "A1", "size": 5}}
    path = lines(tmp_path / "m.json", [mail(1, "t1", '"Lee, Ann" <Ann@x.org>', 100, [part, file]), mail(2, "t1", "ann@x.org", 200), mail(3, "t2", "Ann L <ann@x.org>", 50), {"id": "m4"}])
    messages = A.gmail_messages(spark, path)
    got = by_id(messages)
    assert (got["m1"].fields["from_email"], got["m1"].fields["from_name"], got["m1"].fields["subject"], got["m1"].body, got["m1"].fields["has_attachments"]) == ("ann@x.org", "Lee, Ann", "S1", "hé?>", "true")
    assert got["m1"].fields["participant_emails"] == "[ann@x.org, me@x.org, c@y.org]" and got["m4"].fields["from_email"] == ""
    threads = by_id(A.gmail_threads(messages))
    assert (threads["t1"].fields["message_count"], threads["t1"].fields["subject"]) == ("2", "S1") and set(threads) == {"t1", "t2"}
    assert {r.source_id: r.fields["gmail_message_id"] for r in A.gmail_attachments(spark, path).collect()} == {"m1:A1": "m1"}
    seen = by_id(A.gmail_correspondents(spark, path, "me@x.org"))
    assert set(seen) == {"ann@x.org", "c@y.org"} and seen["ann@x.org"].fields["emails_seen_count"] == "3" and seen["ann@x.org"].fields["summary"] in ("Lee, Ann", "Ann L")


def test_files_and_photos(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("hello")
    (root / "sub" / "p.html").write_text("<html><head>x</head><p>Hi&nbsp;<b>all</b></p></html>")
    (root / "x.bin").write_bytes(b"\0\1")
    got = by_id(A.file_library(spark, str(root)))
    assert {k: (r.body, r.fields["extraction_status"]) for k, r in got.items()} == {"a.txt": ("hello", "done"), "sub/p.html": ("Hi all", "done"), "x.bin": ("", "unsupported")}
    photo = by_id(A.photos(spark, lines(tmp_path / "p.json", [{"uuid": "u", "persons": ["Ann", " "], "place": {"city": "Rome"}, "ismovie": False}])))["u"].fields
    assert (photo["person_labels"], photo["place_city"], photo["media_type"]) == ("[Ann]", "Rome", "photo")


def test_repositories(spark, tmp_path):
    for name in ("repositories", "commits", "threads", "messages"):
        (tmp_path / name).mkdir()
    lines(tmp_path / "repositories" / "r.json", [{"id": 1, "full_name": "a/b", "private": True, "topics": ["x"]}])
    lines(tmp_path / "commits" / "c.json", [{"sha": "s1", "repo": "a/b", "commit": {"message": "Head\n\nrest", "author": {"email": "A@x.org"}}, "parents": [{"sha": "s0"}]}])
    lines(tmp_path / "threads" / "t.json", [{"id": 5, "number": 2, "repo": "a/b", "title": "T", "pull_request": {"url": "u"}, "labels": [{"name": "bug"}]}])
    lines(tmp_path / "messages" / "m.json", [{"id": 9, "repo": "a/b", "number": 2, "body": "looks  good", "user": {"login": "ann"}}])
    got = {r.type: r.fields for r in A.github(spark, str(tmp_path)).collect()}
    assert got["git_commit"]["message_headline"] == "Head" and got["git_commit"]["parent_shas"] == "[s0]" and got["git_thread"]["thread_kind"] == "pull_request" and got["git_message"]["thread"] == "[[thread-a-b-2]]" and got["git_repository"]["is_private"] == "true"


def test_health(spark, tmp_path):
    record = lambda kind, value, start, end: f'<Record type="{kind}" unit="count" value="{value}" startDate="{start}" endDate="{end}"/>'
    body = record("HKQuantityTypeIdentifierStepCount", 10, "2024-01-01 08:00:00 +0000", "") + record("HKQuantityTypeIdentifierStepCount", 5, "2024-01-01 09:00:00 +0000", "") + record(
        "HKCategoryTypeIdentifierSleepAnalysis", "x", "2024-01-02 00:00:00 +0000", "2024-01-02 07:30:00 +0000") + '<Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30.5" startDate="2024-01-03 08:00:00 +0000"/>'
    got = by_id(A.apple_health(spark, put(tmp_path / "export.xml", f"<HealthData>{body}</HealthData>")))
    assert {k: r.fields["value_numeric"] for k, r in got.items()} == {"rollup:StepCount:2024-01-01": "15.0", "rollup:SleepAnalysis:2024-01-02": "7.5", "workout:Running:2024-01-03": "30.5"}
    assert json.loads(got["rollup:StepCount:2024-01-01"].fields["details"]) == {"n": 2, "least": 5.0, "most": 10.0}


def test_medicine(spark, tmp_path):
    bundle = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Immunization", "id": "i1", "vaccineCode": {"coding": [{"code": "208", "display": "Shot A"}]}, "occurrenceDateTime": "2024-01-01"}},
                                                  {"resource": {"resourceType": "Observation", "id": "o1", "code": {"text": "Pulse"}, "valueQuantity": {"value": 61.5, "unit": "bpm"}}}, {"resource": {"resourceType": "Patient"}}]}
    (tmp_path / "f").mkdir()
    put(tmp_path / "f" / "b.json", json.dumps(bundle, indent=1))
    put(tmp_path / "f" / "s.json", json.dumps({"resourceType": "Condition", "id": "c1", "code": {"text": "Cold"}}))
    got = by_id(A.fhir(spark, str(tmp_path / "f")))
    assert {k: (r.type, r.fields["summary"]) for k, r in got.items()} == {"Immunization/i1": ("vaccination", "Shot A"), "Observation/o1": ("medical_record", "Pulse"), "Condition/c1": ("medical_record", "Cold")}
    assert got["Observation/o1"].fields["value_numeric"] == "61.5" and got["Immunization/i1"].fields["cvx_code"] == "208"
    sections = A.ccd(spark, put(tmp_path / "d.xml", '<doc><section><code code="11"/><title> Allergies </title><text><p>none &amp; well</p></text></section><section/><section><title>B</title></section></doc>')).collect()
    assert sorted((r.fields["code"], r.fields["summary"], r.body) for r in sections)[-1] == ("11", "Allergies", "none & well")
    shots = lambda rows: spark.createDataFrame(rows, "vaccine_name string, occurred_at string, lot_number string, manufacturer string")
    both = A.overlaid_vaccinations(shots([("Shot-A", "2024-01-01T10:00", "", "M")]), shots([("shot a", "2024-01-01", "L1", "N"), ("Other", "2024-02-01", None, None)])).collect()
    assert sorted(map(tuple, both), key=str) == [("Other", "2024-02-01", None, None), ("Shot-A", "2024-01-01T10:00", "L1", "M")]


def test_epic(spark, tmp_path):
    put(tmp_path / "PROBLEM_LIST.tsv", "PROBLEM_LIST_ID\tDX_ID\tNOTED_DATE\tPROBLEM_STATUS\n1\t7\t2024-01-01\tActive\n2\t8\t\t\n")
    put(tmp_path / "CLARITY_EDG.tsv", "DX_ID\tDX_NAME\n7\tCold\n")
    put(tmp_path / "IMMUNE.tsv", "IMMUNE_ID\tIMMUNZATN_ID\tIMMUNE_DATE\tLOT\tMFG\n1\t3\t2024-01-01 10:00\tL\tM\n2\t3\t2024-01-01 12:00\t\t\n")
    put(tmp_path / "CLARITY_IMMUNZATN.tsv", "IMMUNZATN_ID\tNAME\n3\tShot A\n")
    got = by_id(A.epic(spark, str(tmp_path)))
    assert {k: r.fields["summary"] for k, r in got.items()} == {"problem:1": "Cold", "problem:2": "", "shot:shot a|2024-01-01": "Shot A"} and got["shot:shot a|2024-01-01"].fields["lot_number"] == "L"


def test_chats_after_a_cursor(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    messages = frame([(1, "g1", "old", "2024-01-01", 0, 1, 1), (2, "g2", "new", "2024-01-02", 0, 1, 1), (3, "g3", None, None, 1, None, 2)], "rowid long, guid string, text string, date string, is_from_me int, handle_id long, chat_id long")
    chats = frame([(1, "c1", "", "iMessage"), (2, "c2", "Group", "SMS"), (3, "c3", "", "")], "chat_id long, guid string, display_name string, service string")
    got = by_id(A.imessage(messages, chats, frame([(1, 1), (2, 1), (2, 2)], "chat_id long, handle_id long"), frame([(1, "@Ann"), (2, "+1 555")], "handle_id long, address string"), since=1))
    assert set(got) == {"g2", "g3", "c1", "c2"} and got["g2"].fields["sender_handle"] == "ann" and got["c2"].fields["is_group"] == "true" and got["c1"].fields["summary"] == "c1"
    events = frame([(1, "e1", "r1", "u1", "message", "hi", "t", None, None), (2, "e2", "r1", "u2", "message", "yo", "t", "f://x", "image/gif")], "order_id long, event_id string, room_id string, sender_id string, type string, text string, sent_at string, file_url string, mime_type string")
    rooms = frame([("r1", "Room", "signal"), ("r2", "", "")], "room_id string, title string, bridge string")
    beep = by_id(A.beeper(events, rooms, frame([("r1", "u2", "Bob")], "room_id string, user_id string, name string"), since=1))
    assert set(beep) == {"e2", "file:e2", "r1"} and beep["e2"].fields["sender_name"] == "Bob" and beep["file:e2"].fields["is_gif"] == "true"


def test_seed_people(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nuid: p1\ntype: person\nsummary: Ann\n---\nbody")
    (tmp_path / "b.md").write_text("---\nuid: d1\ntype: document\n---\n")
    assert [(r.uid, r.fields["summary"]) for r in A.seed_people(spark, str(tmp_path)).collect()] == [("p1", "Ann")]


def test_read_twice_gives_the_same_cards(spark, tmp_path):
    path = lines(tmp_path / "o.json", [{"otid": "o1", "title": "T"}, {"otid": "o1", "title": "T"}])
    first, again = (A.otter(spark, path).select("uid", F.to_json("fields").alias("f")).collect() for _ in range(2))
    assert first == again and len(first) == 1
