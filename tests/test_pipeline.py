import json

import pytest

from corvex.operators import instants, shredding


@pytest.mark.parametrize(
    "raw, zone, order, iso",
    [
        ("2024-04-23T01:58:46Z", None, None, "2024-04-23T01:58:46"),
        (" 2024-03-19t02:46:39z\t", None, None, "2024-03-19T02:46:39"),
        ("2024-02-05T11:35:51,289Z", None, None, "2024-02-05T11:35:51.289"),
        ("2024-12-14T04:08:11.729188999Z", None, None, "2024-12-14T04:08:11.729188"),
        ("2024-06-14 04:47:04.505", "Europe/Berlin", "dmy", "2024-06-14T02:47:04.505"),
        ("2022-10-29T08:57:33+02", None, None, "2022-10-29T06:57:33"),
        ("2022-12-07 14:29:21 -0330", None, None, "2022-12-07T17:59:21"),
        ("2024-01-09 23:24:25 +0000 UTC", None, None, "2024-01-09T23:24:25"),
        ("20240520T154308Z", None, None, "2024-05-20T15:43:08"),
        ("05/10/2024 8:50 AM", "America/New_York", "mdy", "2024-05-10T12:50:00"),
        ("05/10/2024 12:50 AM", "UTC", "dmy", "2024-10-05T00:50:00"),
        ("29.10.2023 02:24", "Europe/Berlin", "dmy", "2023-10-29T00:24:00"),  # twice: the earlier
        ("26.03.2023 02:32", "Europe/Berlin", "dmy", "2023-03-26T01:32:00"),  # skipped: the offset before
        ("Mar 30, 2025 01:15:49", "Europe/Berlin", "dmy", "2025-03-30T00:15:49"),
        ("Tue, 12 Mar 2024 14:47:49 -0700", None, None, "2024-03-12T21:47:49"),
        ("3 Jul 2024 09:14:26 GMT", "Asia/Kolkata", None, "2024-07-03T09:14:26"),
        ("2023-08-09 11:50:10 AEST", "Australia/Sydney", None, "2023-08-09T01:50:10"),
        ("2023-10-29 02:30:00 CET", "Europe/Berlin", None, "2023-10-29T01:30:00"),
        ("2023-07-01 02:30:00 CET", "Europe/Berlin", None, "2023-07-01T01:30:00"),
        ("2022-02-26 08:18:00 America/New_York", "UTC", None, "2022-02-26T13:18:00"),
        ("1757127954", None, None, "2025-09-06T03:05:54"),
        ("1743691258643", None, None, "2025-04-03T14:40:58.643"),
        ("1746428638222915", None, None, "2025-05-05T07:03:58.222915"),
        *[(x, "UTC", "dmy", None) for x in (None, "", "never", "-", "2023-02-30T10:00:00Z", "2024-06-11T25:10:00Z", "2024-03", "0000-00-00 00:00:00", "0001-01-01T00:00:00Z", "2024-03-05", "12345", "0000000000", "2024-01-01 00:00 QQT")],
        ("2024-01-01 00:00", None, None, None),
    ],
)
def test_instants(raw, zone, order, iso):
    from datetime import datetime, timedelta

    want = None if iso is None else (datetime.fromisoformat(iso) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert instants.parse_instant(raw, zone, order) == want


def test_dictionary_grows(spark, tmp_path):
    zones = spark.createDataFrame([("h", "Europe/Berlin", "dmy"), ("h", "UTC", "dmy"), (None, "UTC", "dmy")], "host string, zone string, date_order string")
    path = f"file://{tmp_path}/dict"
    run = lambda rows: sorted(map(tuple, instants.normalise_instants(spark.createDataFrame(rows, "id long, t string, host string, zone string"), "id", "t", "host", zones, path).collect()))
    first = run([(1, "01.07.2024 12:00", "h", "clash"), (2, None, "h", ""), (1, "01.07.2024 12:00", "h", ""), (3, "01.07.2024 12:00", None, "")])
    assert first == [(1, "01.07.2024 12:00", 1719828000000000), (1, "01.07.2024 12:00", 1719828000000000), (2, None, None), (3, "01.07.2024 12:00", None)]
    assert len(run([(4, "x", "h", ""), (1, "01.07.2024 12:00", "h", "")])) == 2
    held = spark.read.parquet(f"{path}/{instants.VERSION}")
    assert held.count() == held.distinct().count() == 3
    assert run([]) == []


def event(**payload):
    return {k: v if v is None or k in ("ref", "before", "after") else json.dumps(v) for k, v in payload.items()}


ROWS = [
    (1, "push", "github", event(ref="refs/heads/main", commits=[{"id": "c1", "added": ["a"], "modified": "b", "removed": None}, {"id": None, "added": ["lost"]}])),
    (1, "push", "github", event(ref="refs/heads/main", commits=[{"id": "c1", "added": ["a"], "modified": "b", "removed": None}])),
    (2, "push", "gitlab", event(ref="r", commits={"id": "c2", "author": {"name": "N"}})),
    (3, "repo:push", "bitbucket", event(push={"changes": [{"new": None, "old": {"name": "dev"}, "commits": [{"hash": "h1", "files": [{"new": {"path": "n"}, "old": {"path": "o"}}, {"old": {"path": "gone"}}]}]}]})),
    (4, "pull_request", "github", event(pull_request={"number": 7, "labels": [{"name": "x"}, "y", None], "review": {"threads": [{"comments": [{"id": 1, "replies": [{"id": "2", "replies": {"id": 3}}]}]}]}})),
    (5, "merge_request_hook", "gitlab", event(object_attributes={"iid": 9, "id": 1, "labels": [{"title": "t"}]}, discussions=[{"id": 5, "notes": [{"id": 6}]}])),
    (6, "pull_request", "gitea", {"pull_request": json.dumps(json.dumps({"number": 8, "labels": ["z"]})), "zen": "{cut"}),
    (7, "issues", "github", {"issue": '{"number": 1, "labels": ["cut"'}),
    (8, "push", None, None),
    (9, "push", "github", {}),
    (10, "issues", "bitbucket", event(issue={"id": 3, "labels": [{"name": "b"}]})),
]


def test_links(spark):
    df = spark.createDataFrame([(i, t, (p,) if p else None, m, "clash") for i, t, p, m in ROWS], "event_id long, event_type string, repository struct<provider:string>, payload map<string,string>, tbl string")
    got = {tuple(r) for r in shredding.links(shredding.shred_events(df, wide=False)).collect()}
    assert got == {
        (1, "commit", "refs/heads/main", "c1"), (1, "file", "c1", "a"), (1, "file", "c1", "b"), (2, "commit", "r", "c2"),
        (3, "commit", "dev", "h1"), (3, "file", "h1", "n"), (3, "file", "h1", "gone"),
        (4, "label", "7", "x"), (4, "label", "7", "y"), (4, "comment", "7", "1"), (4, "reply", "1", "2"), (4, "reply", "2", "3"),
        (5, "label", "9", "t"), (5, "comment", "9", "5"), (5, "reply", "5", "6"), (6, "label", "8", "z"), (10, "label", "3", "b"),
    }
    commits = shredding.table_of(shredding.shred_events(df), "commit")
    assert {(r.event_id, r.key, r.c_author_name) for r in commits.collect()} == {(1, "c1", None), (1, None, None), (2, "c2", "N"), (3, "h1", None)}
    assert shredding.links(shredding.shred_events(df.limit(0))).count() == 0


def test_graph_and_deep_json():
    assert shredding.WEBHOOKS.tables == {"event": "root", "commit": "repeated", "change": "repeated", "path": "repeated", "change_of_file": "repeated", "request": "shared", "label": "repeated", "thread": "repeated", "comment": "recursive", "person": "shared"}
    assert {"new_name", "old_name", "new_target_hash"} <= set(shredding.WEBHOOKS.columns("change"))
    deep = '{"id":1,"replies":[' * 20_000 + "]}" * 20_000
    value = shredding.read_json('{"number":5,"review":{"threads":[{"comments":[' + deep + "]}]}}")
    assert sum(1 for _ in shredding.shred(shredding.WEBHOOKS, {"pull_request": value})) == 20_003
    for text in ('{"a":1,"b":[1.50,null,true],"c":{}}', "[]", ' [ "x\\u00e9" ] '):
        assert json.dumps(shredding._deep(text)) == json.dumps(json.loads(text, parse_int=str, parse_float=str)).replace("true", '"true"')
    for text in ("[1,", '{"a"', '{"a":1,}', "[1]]", "", "nul", "[1 2]", None, "NaN"):
        assert shredding.read_json(text) is None


def test_fields_outside_the_graph_are_kept(spark):
    payload = {"ref": "r", "commits": '[{"id": "c1", "odd": {"x": [1]}, "author": {"name": "N", "age": 7}}]', "sender": '{"login": "s", "prefs": {"mail": {"digest": "d", "more": null}}}', "extra": "[1]"}
    df = spark.createDataFrame([(1, {"provider": "github"}, payload), (2, None, None), (1, {"provider": "github"}, payload)], "event_id long, repository struct<provider:string>, payload map<string,string>")
    rows = shredding.shred_events(df)
    assert [(r.key, r.c_author_name, json.loads(r.c_rest)) for r in shredding.table_of(rows, "commit").collect()] == [("c1", "N", {"odd": {"x": ["1"]}, "author.age": "7"})]
    assert [(r.key, r.c_prefs_mail_digest, r.c_rest) for r in shredding.table_of(rows, "person").collect()] == [("s", "d", '{"prefs.mail.more": null}')]
    assert {r.event_id: r.c_rest for r in shredding.table_of(rows, "event").collect()} == {1: '{"extra": ["1"]}', 2: None}
    assert shredding.orphans(rows).first().orphans == 0 and shredding.orphans(rows.where("tbl <> 'event'")).first().orphans > 0
    fields = {(r.tbl, r.field): (r.mapped, r.n) for r in shredding.schema_graph(rows).collect()}
    assert fields["commit", "odd"] == (False, 2) and fields["commit", "author_name"] == (True, 2)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Sat Jun 1 12:30:00 2024 +0000", "2024-06-01T12:30:00"), ("Sat Jun  1 12:30:00 2024", "2024-06-01T10:30:00"), ("Sat Jun 1 12:30:00 UTC 2024", "2024-06-01T12:30:00"), ("Sat Jun 1 12:30:00 CEST 2024", "2024-06-01T10:30:00"),
        ("2024-06-01T24:00:00Z", "2024-06-02T00:00:00"), ("2024-06-01T23:59:60Z", "2024-06-02T00:00:00"), ("2024-06-01T12:00:00+5:30", "2024-06-01T06:30:00"), ("2024-W22-6T12:00:00Z", "2024-06-01T12:00:00"),
        ("2024-153T12:00:00Z", "2024-06-01T12:00:00"), ("1717245000.5", "2024-06-01T12:30:00.500000"), ("2024-06-01T24:00:01Z", None), ("2024-06-01T12:10:60Z", None), ("2023-366T00:00:00Z", None), ("2024-W54-1T00:00Z", None), ("2024-000T00:00Z", None),
    ],
)
def test_more_notations(text, want):
    from datetime import datetime, timedelta

    got = instants.parse_instant(text, "Europe/Berlin", "dmy")
    assert (got is None and want is None) or (datetime(1970, 1, 1) + timedelta(microseconds=got)).isoformat() == want
