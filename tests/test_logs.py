"""Each line-log operator on a small hand-made file."""

import json

import pytest

from corpuslens.operators import logs
from corpuslens.sources.readers import split_lines


@pytest.fixture
def lines(spark):
    return lambda text, unfold=False: split_lines(spark.createDataFrame([("f", text)], "path string, text string"), unfold)


@pytest.fixture
def doc(spark):
    return lambda text: spark.createDataFrame([("f", text)], "path string, text string")


def test_http(doc):
    entry = {"startedDateTime": "2024-01-01T00:00:00Z", "time": 1500.0, "request": {"method": "GET", "url": "http://x/", "headers": [{"name": "Cookie", "value": "a"}]}, "response": {"status": 404, "content": {"size": 10, "mimeType": "text/html; charset=x"}, "headers": []}}
    e = logs.http_entries(doc(json.dumps({"log": {"entries": [entry, {**entry, "time": 1.0}]}})))
    r = logs.summarise_http(e).first()
    assert (r.requests, r.bytes, r.slow, r.sensitive, r.statuses, r.types) == (2, 20, 1, 2, {404: 2}, {"text/html": 2})
    assert {(x.short_type, x.status_class) for x in logs.http_requests(e).collect()} == {("html", "4xx")}


def test_json_reports(doc):
    d = doc(json.dumps({"runs": [{"level": "error"}, {"level": "note"}, {"level": "error"}]}))
    assert {(r.value, r.n) for r in logs.tally_json(d, "runs array<struct<level: string>>", "runs", "level").collect()} == {("error", 2), ("note", 1)}
    n = logs.summarise_notebooks(doc(json.dumps({"cells": [{"cell_type": "code", "source": ["a", "b"], "outputs": [{"x": 1}]}, {"cell_type": "markdown", "source": ["x"]}]}))).first()
    assert (n.cells, n.code, n.markdown, n.code_lines, n.outputs) == (2, 1, 1, 2, 1)
    t = logs.summarise_tensors(doc(json.dumps({"__metadata__": {}, "w": {"dtype": "F16", "shape": [2, 3]}, "b": {"dtype": "F32", "shape": []}}))).first()
    assert (t.tensors, t.parameters, t.dtypes) == (2, 7, ["F16", "F32"])


def test_crash(doc):
    r = logs.crash_facts(doc("Process: app [12]\nVersion: 1.2\nException Type: EXC_BAD\nCrashed Thread: 3\n 0x10 - 0x20 lib <AAAAAAAA-1111-2222-3333-444444444444>\n")).first()
    assert (r.process, r.version, r.exception, r.thread, len(r.uuids), r.images) == ("app", "1.2", "EXC_BAD", "3", 1, 1)
    assert logs.crash_facts(doc('{"procName": "x"}')).first().process == "x"


def test_rules_patches_references(lines):
    r = logs.ids_rules(lines('alert tcp any any -> any any (msg:"Hi"; sid:7; classtype:bad-x;)\n# drop udp a (sid:8;)\n# note\n'))
    assert {(x.enabled, x.action, x.protocol, x.sid, x.msg, x.classtype) for x in r.collect()} == {(True, "alert", "tcp", 7, "Hi", "bad-x"), (False, "drop", "udp", 8, None, None)}
    assert {(x.key, x.value, x.n) for x in logs.ids_summary(r).where("key = 'action'").collect()} == {("action", "alert", 1), ("action", "drop", 1)}
    d = logs.summarise_diff(lines("--- a/x\n+++ b/x\n+new\n-old\n-old2\n+++ b/y\n")).first()
    assert (d.files, d.added, d.deleted) == (2, 1, 2)
    s, dup = logs.summarise_bib(lines("@article{k1,\n year = {1999}}\n@book{k2, year = 2005}\n@book{k1, }\n"))
    assert (s.first().entries, s.first().first_year, s.first().last_year, s.first().types) == (3, 1999, 2005, {"article": 1, "book": 2})
    assert [(x.key, x.n) for x in dup.collect()] == [("k1", 2)]


def test_feed_archive_lock(doc, lines, spark):
    f = logs.summarise_feed(doc('<rss><item><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><enclosure url="u" length="12"/></item><item><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item></rss>')).first()
    assert (f.items, f.enclosures, f.enclosure_bytes, str(f.first), str(f.last)) == (2, 1, 12, "2024-01-01 10:00:00", "2024-01-02 10:00:00")
    w = logs.summarise_warc(lines("WARC-Type: response\nWARC-Target-URI: http://a.b/x\nWARC-Date: 2024-01-01T00:00:00Z\nWARC-Type: request\nWARC-Target-URI: http://a.b/y\n")).first()
    assert (w.records, w.urls, w.hosts, w.types) == (2, 2, 1, {"request": 1, "response": 1})
    k = spark.createDataFrame([("a/Cargo.lock", 'version = 3\n[[package]]\nname = "x"\nchecksum = "1"\n[[package]]\n')], "path string, text string")
    r = logs.lockfile_inventory(k).first()
    assert (r.ecosystem, r.packages, r.lock_version, r.integrity) == ("cargo", 2, "3", True)


def test_mail(doc):
    box = "From a\nFrom: Ann <ann@x.org>\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nSubject: =?utf-8?q?caf=C3=A9?=\nReceived: x\nReceived: y\n z\nAuthentication-Results: m; spf=pass dkim=fail\n\nbody\nFrom b\nFrom: bob@y.org\n\nx"
    m = logs.message_facts(logs.split_mailbox(doc(box)))
    r = m.orderBy("msg_no").collect()
    assert (r[0].sender, r[0].subject, r[0].hops, r[0].spf, r[0].dkim, r[0].dmarc, str(r[0].date)) == ("ann@x.org", "café", 2, "pass", "fail", None, "2024-01-01 10:00:00")
    assert r[0].headers["received"] == ["x", "y z"] and r[1].sender == "bob@y.org"
    s = logs.summarise_mailbox(m).first()
    assert (s.messages, s.senders, s.top_senders) == (2, 2, ["ann@x.org", "bob@y.org"])


def test_calendar_directory_contacts(lines):
    comps, ev = logs.summarise_calendar(lines("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:long\n  text\nATTENDEE:a\nATTENDEE;X=1:b\nRRULE:F\nEND:VEVENT\nBEGIN:VTODO\nEND:VTODO\n", unfold=True))
    assert {r.type: r.n for r in comps.collect()} == {"VCALENDAR": 1, "VEVENT": 1, "VTODO": 1}
    e = ev.first()
    assert (e.uid, e.summary, e.attendees, e.recurs) == ("1", "long text", 2, True)
    n, rows = logs.summarise_ldif(lines("dn: cn=a\nobjectClass: top\nobjectClass: Person\ncn: A\ncn: B\nmail: a@x\n\ndn: cn=b\nchangetype: add\n"))
    assert tuple(n.first())[1:] == (2, 1) and rows.where("cn = 'A'").first().classes == ["person", "top"]
    c = logs.contacts(lines("BEGIN:VCARD\nN:Doe;Jo\nTEL;TYPE=x:1\nTEL:2\nADR:;;Street 1;Town\nORG:A;B\nEND:VCARD\n")).first()
    assert (c.name, c.phones, c.addresses, c.organisation) == ("Jo Doe", ["1", "2"], ["Street 1, Town"], "A, B")


def test_sequences_and_positions(lines):
    r = logs.sequence_stats(lines(">a\nACGT\nGG\n>b\nNN\n")).first()
    assert (r.records, r.residues, r.mean_length) == (2, 8, 4.0) and abs(r.gc_percent - 100 * 4 / 6) < 1e-9
    q = logs.sequence_stats(lines("@r\nACGN\n+\nII!I\n"), "fastq").first()
    assert (q.reads, q.bases, q.shortest, q.longest, q.gc_percent, q.quality_low, q.encoding) == (1, 4, 4, 4, 50.0, 33, "phred+33")
    n = logs.summarise_nmea(lines("$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47\n$GPGGA,123520,,,,,0,00,,,M,,M,,*00\nnoise\n")).first()
    assert (n.sentences, n.fixes, n.best_hdop, n.most_satellites, n.checksum_ok, n.checksum_bad, n.types) == (2, 1, 0.9, 8, 1, 1, {"GGA": 2})
    i = logs.summarise_igc(lines("HFPLTPILOT: Jo\nB1101355206343N00006198WA0058700558\nB1101455206343N00006198WA0000100000\n")).first()
    assert (i.fixes, i.first, i.last, i.alt_min, i.alt_max, i.pilot) == (2, "110135", "110145", 1, 558, "Jo")


def test_playlists_workouts_features(lines, doc):
    s, v = logs.summarise_playlist(lines("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=100,RESOLUTION=1x2\n# note\na.m3u8\n#EXTINF:2.5,\nx.ts\n#EXTINF:1,\ny.ts\n#EXT-X-ENDLIST\n"))
    assert tuple(s.first())[1:] == (2, 3.5, False) and tuple(v.first())[1:] == (100, "1x2", "a.m3u8")
    w = logs.summarise_workout(doc("<Lap><TotalTimeSeconds>60</TotalTimeSeconds><DistanceMeters>100</DistanceMeters><Calories>5</Calories><Track><Trackpoint><DistanceMeters>50</DistanceMeters><HeartRateBpm><Value>120</Value></HeartRateBpm></Trackpoint></Track></Lap>")).first()
    assert (w.laps, w.points, w.metres, w.seconds, w.calories, w.hr_min) == (1, 1, 100.0, 60.0, 5.0, 120.0)
    g, p = logs.summarise_features(doc(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1.5, 2, 9]}, "properties": {"a": 1}}, {"geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}, "properties": {"a": 2, "b": None}}]})))
    assert {r.type: (r.n, r.points, r.east, r.high) for r in g.collect()} == {"Point": (1, 1, 1.5, 9.0), "LineString": (1, 2, 3.0, None)}
    assert {r.key: r.features for r in p.collect()} == {"a": 2, "b": 1}


def test_revisions_and_blocks(spark, lines):
    e = spark.createDataFrame([("d", "x", "ins"), ("d", "x", "del"), ("d", "y", "ins")], "doc string, author string, kind string")
    assert [(r.author, r.ins, r["del"], r.rank) for r in logs.revision_audit(e).orderBy("rank").collect()] == [("x", 1, 1, 1), ("y", 1, 0, 2)]
    h = logs.block_histogram(lines("--- !u!1\nGameObject:\n  m: 1\n--- !u!4\nTransform:\n--- !u!5\nGameObject:\n"), r"^--- ", r"^(\w+):")
    assert {r["class"]: r.n for r in h.collect()} == {"GameObject": 2, "Transform": 1}
