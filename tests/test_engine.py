"""Scenarios of merges, plans, audits, readers, the store and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from provenant.operators import audits, evaluation, extraction, lifecycle, metrics, planning
from provenant.sources import readers, reports, sinks
from provenant.sources.store import SnapshotStore
from provenant.streaming import ingest


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_content_is_never_downgraded_and_conflicts_are_counted(spark):
    got = lifecycle.merge_content(spark.createDataFrame([(1, 1, "FULL", "a"), (1, 2, "PARTIAL", "b"), (2, 1, "PARTIAL", "p"), (2, 2, "FULL", "x"), (2, 3, "FULL", "y"), (3, 5, "METADATA_ONLY", None)], "item_id long, arrival long, completeness string, raw_text string"))
    assert rows(got, "item_id") == [(1, "FULL", "a", 1, 0), (2, "FULL", "x", 2, 1), (3, "METADATA_ONLY", None, 5, 0)]


def test_source_upsert_keeps_known_policy_and_explicit_lifecycle(spark):
    cols = "normalized_key string, name string, lifecycle string, " + ", ".join(f"{c} string" for c in lifecycle.POLICY)
    blank = [None] * len(lifecycle.POLICY)
    current = spark.createDataFrame([(7, "k:a", "A", "CORE", "api", *blank[1:])], "id long, " + cols)
    incoming = spark.createDataFrame([("k:a", "AA", None, *blank), ("k:b", "B", "EXPLORATION", "feed", *blank[1:])], cols)
    got = lifecycle.merge_sources(current, incoming)
    assert [(r["id"], r["name"], r["lifecycle"], r["access_method"]) for r in got.orderBy("id").collect()] == [(7, "AA", "CORE", "api"), (8, "B", "EXPLORATION", "feed")]
    again = lifecycle.merge_sources(got.select(current.columns), incoming)
    assert rows(again.select("id", "name"), "id") == [(7, "AA"), (8, "B")]


def test_profile_merge_treats_empty_arrays_as_missing(spark):
    shape = "source_id long, platform string, notes string, professions array<string>"
    old = spark.createDataFrame([(1, "p", "n", ["x"])], shape)
    new = spark.createDataFrame([(1, None, None, [])], shape)
    assert rows(lifecycle.merge_profiles(old, new, ("platform",), ("professions",))) == [(1, None, "n", ["x"])]


def test_absent_is_null_safe_and_replays_conflict(spark):
    a = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "k long, v string")
    b = spark.createDataFrame([(1, None)], "k long, v string")
    assert rows(lifecycle.absent(a, b, ["k", "v"]), "k") == [(1, "x"), (2, None)]
    assert rows(lifecycle.conflicting_replays(spark.createDataFrame([(1, "y")], "k long, v string"), b, "k", ["v"])) == [(1,)]
    assert rows(lifecycle.conflicting_replays(b, b, "k", ["v"])) == []


def test_policy_defaults_fill_only_open_decisions(spark):
    df = spark.createDataFrame([(None,), ("requires-review",), ("APPROVED",)], "commercial_use_status string")
    assert {r[0] for r in lifecycle.fill_policy_defaults(df, {"commercial_use_status": "X"}).collect()} == {"X", "APPROVED"}


def test_budget_takes_caps_in_order(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "source_id long, cap long")
    got = metrics.take_budget(df, [F.col("source_id")], F.col("cap"), 6)
    assert rows(got.select("source_id", "allocated_items"), "source_id") == [(1, 4), (2, 2)]


def test_round_robin_walks_categories(spark):
    plan = spark.createDataFrame([(1, 1, "a", "x", "CORE", True, 5, False), (2, 2, "b", "x", "CORE", True, 5, False), (3, 3, "c", None, "CORE", True, 5, False), (4, 4, "d", "x", "CORE", True, 0, True)], "ordering int, source_id long, source_name string, category string, strict_relevance string, ready boolean, pilot_size long, conflict boolean")
    assert [r[2] for r in rows(planning.round_robin(plan, 3), "position")] == ["c", "a", "b"]


def test_wave_uses_each_source_once(spark):
    slots = spark.createDataFrame([(1, "a", "b"), (2, "A", "b"), (3, "a", "b")], "slot long, primary_name string, backup_name string")
    health = spark.createDataFrame([("a", "ACTIVE"), ("b", "ACTIVE")], "name string, status string")
    assert rows(planning.select_wave(slots, health).select("source", "selection_status"), "slot") == [("a", "PRIMARY_ACTIVE"), ("b", "REPLACED_WITH_ACTIVE_BACKUP"), ("a", "BLOCKED_NO_HEALTHY_REPLACEMENT")]


def test_pairwise_counts_equal_brute_force(spark):
    data = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 3)]
    got = evaluation.pairwise(spark.createDataFrame(data, "gold string, predicted long")).first()
    pairs = [(x[0] == y[0], x[1] == y[1]) for i, x in enumerate(data) for y in data[i + 1 :]]
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (sum(g and p for g, p in pairs), sum(p and not g for g, p in pairs), sum(g and not p for g, p in pairs), sum(not g and not p for g, p in pairs))


def test_scores_of_nothing_are_zero(spark):
    got = evaluation.confusion(spark.createDataFrame([], "gold boolean, predicted boolean")).first()
    assert (got["precision"], got["recall"], got["f1"]) == (0.0, 0.0, 0.0)


def test_state_moves_and_immutable_text(spark):
    before = spark.createDataFrame([(1, "OPEN"), (2, "REVIEW")], "id long, status string")
    after = spark.createDataFrame([(1, "COMPLETE"), (2, "COMPLETE"), (3, "OPEN"), (4, "REVIEW")], "id long, status string")
    assert rows(audits.illegal_moves(before, after, audits.CASE_MOVES, "OPEN").select("id"), "id") == [(1,), (4,)]
    old, new = (spark.createDataFrame([(1, t), (2, t)], "id long, raw_text string") for t in ("a", "b"))
    assert rows(audits.changed_after_evidence(old, new, spark.createDataFrame([(1,)], "source_item_id long"))) == [(1,)]


def test_strict_json_reports_every_bad_line(spark, tmp_path):
    path = tmp_path / "items.jsonl"
    path.write_text("\n".join([json.dumps({"external_id": "a", "text": "t"}), "", json.dumps({"external_id": " ", "text": "t", "odd": 1}), "not json"]))
    parsed = readers.read_json(spark, str(path), "items")
    assert [r["external_id"] for r in parsed.rows.collect()] == ["a"]
    assert sorted(r["problem"] for r in parsed.errors.collect()) == ["not a JSON object", "unknown keys: odd; external_id is missing or blank"]
    with pytest.raises(ValueError, match="unknown keys"):
        readers.require_valid(parsed)


def test_registry_csv_keeps_other_columns(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿Subreddit,zielgruppe,scan_now,pilot_posts,extra\nr/Foo,Praktiker / Inhaber,ja,10,\"a,b\"\n", encoding="utf-8")
    got = readers.read_registry(spark, str(path)).first()
    assert (got["name"], got["audience_type"], got["scan_now"], got["pilot_posts"]) == ("Foo", "MIXED", True, 10)
    assert json.loads(got["metadata_json"]) == {"extra": "a,b"}
    with pytest.raises(ValueError, match="expected columns"):
        readers.read_wave_slots(spark, str(path))


def test_archive_and_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"permalink": "/r/x/comments/Q1/s/", "title": "t", "selftext": "body", "author": "u", "created_utc": 0}, {"permalink": "/r/x/comments/q2/s/", "title": "t", "selftext": "[removed]"}]}))
    got = readers.archive_posts(spark, str(tmp_path / "a.json")).orderBy("identity.submission_id").collect()
    assert [(r["identity"]["submission_id"], r["completeness"], r["removal_state"]) for r in got] == [("q1", "FULL", None), ("q2", "METADATA_ONLY", "REMOVED")]
    (tmp_path / "f.xml").write_text('<feed><entry><id>1</id><link href="http://x/1"/><title>T</title><author><name>/u/me</name></author><updated>2026</updated><content type="html">&lt;!-- SC_OFF --&gt;&lt;p&gt;Hi &amp;amp; you&lt;/p&gt;&lt;!-- SC_ON --&gt;</content></entry></feed>')
    assert rows(readers.feed_entries(spark, str(tmp_path / "f.xml"))) == [("1", "http://x/1", "T", "me", "2026", "Hi & you")]


def test_store_publishes_whole_snapshots_and_guards_refuse(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.publish({"a": spark.range(3)}) == 1
    assert store.publish({"b": spark.range(2)}, {"small": lambda t: t["b"].filter("id > 5")}) == 2
    with pytest.raises(ValueError, match="small"):
        store.publish({"b": spark.range(9)}, {"small": lambda t: t["b"].filter("id > 5")})
    assert (store.read("a").count(), store.read("b").count(), store.versions()) == (3, 2, [1, 2])


def test_stream_merges_and_replays(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.jsonl").write_text(json.dumps({"external_id": "A", "text": "short", "metadata": {"completeness": "PARTIAL"}}))
    ingest.ingest_items(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    whole = {"completeness": "FULL", "body_complete": "true", "retrieved_at": "2026-01-02T03:04:05Z"}
    (inbox / "2.jsonl").write_text(json.dumps({"external_id": "a ", "text": "whole", "metadata": whole}) + "\n" + json.dumps({"external_id": "b", "text": "b", "metadata": whole | {"retrieved_at": "2026-01-02T03:04:05"}}))
    ingest.ingest_items(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    ingest.ingest_items(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    shown = ["item_id", "completeness", "raw_text", "conflicts"]
    assert rows(store.read("content").select(shown), "item_id") == [("a", "FULL", "whole", 0), ("b", "PARTIAL", "b", 0)]
    for n in (3, 4):
        (inbox / f"{n}.jsonl").write_text(json.dumps({"external_id": "a", "text": f"other {n}", "metadata": whole}))
        ingest.ingest_items(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    assert rows(store.read("content").select(shown), "item_id") == [("a", "FULL", "whole", 2), ("b", "PARTIAL", "b", 0)]


def test_a_batch_counts_once_and_touches_its_buckets_only(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    shape = "item_id string, arrival long, completeness string, raw_text string"
    ingest.merge_batch(store, spark.createDataFrame([(f"i{n}", 1, "FULL", "t") for n in range(300)], shape), 0)
    before = store.manifest()["content"]
    for _ in range(2):  # the second one is a replay
        ingest.merge_batch(store, spark.createDataFrame([("i7", 2, "FULL", "u")], shape), 1)
    after = store.manifest()["content"]
    assert sum(before[k] != after[k] for k in before) == 1 and set(before) == set(after)
    assert rows(store.read("content").filter("conflicts > 0").select("item_id", "raw_text", "conflicts")) == [("i7", "t", 1)]
    assert store.read("content").count() == 300


def test_the_last_capture_of_a_url_stands(spark):
    taken = spark.createDataFrame([("https://u.example/a", "ACQUISITION_FAILED", 1), ("https://u.example/a", "CONTENT_COMPLETE", 2)], "url string, state string, line long")
    got = readers.replay_acquisition(taken, spark.createDataFrame([("https://u.example/a",)], "canonical_url string"))
    assert [r["state"] for r in got.collect()] == ["CONTENT_COMPLETE"]
    with pytest.raises(ValueError, match="once"):
        readers.replay_search(spark.createDataFrame([("q", "RESULTS"), ("q", "NO_RESULTS")], "query string, availability string"), spark.createDataFrame([("q",)], "query string"))


def test_without_a_line_a_url_is_captured_once(spark):
    twice = spark.createDataFrame([("https://u.example/a", "ACQUISITION_FAILED"), ("https://u.example/a", "CONTENT_COMPLETE")], "url string, state string")
    with pytest.raises(ValueError, match="twice"):
        readers.replay_acquisition(twice, spark.createDataFrame([("https://u.example/a",)], "canonical_url string"))


def test_errors_name_the_line_of_a_file_in_many_splits(spark, tmp_path):
    """Lines of very different lengths, blank ones, a line longer than a split, two files, one without a last line end."""
    good = lambda i, n: json.dumps({"external_id": f"e{i}", "text": "x" * n})
    lines = [good(i, (i * 37) % 900 + 1) if i % 13 else "" for i in range(1, 600)]
    lines[99] = good(99, 9000)
    bad = {151: "not json", 152: "[1]", 400: '{"external_id": "a"}', 599: '{"external_id": "b", "text": "t", "odd": 1}'}
    for n, line in bad.items():
        lines[n - 1] = line
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "in" / "b.jsonl").write_text("\r\n".join([good(1, 3), "", "odd"]) + "\r\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        parsed = readers.read_json(spark, str(tmp_path / "in"), "items")
        assert readers.read_lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 50
        found = {(r["file"].rsplit("/", 1)[1], r["number"]) for r in parsed.errors.collect()}
        assert found == {*(("a.jsonl", n) for n in bad), ("b.jsonl", 3)}
        assert parsed.rows.count() == sum(bool(x) for x in lines) - len(bad) + 1
        with pytest.raises(ValueError, match=r"a\.jsonl:151: not a JSON object; .*a\.jsonl:152"):
            readers.require_valid(parsed)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("row", "why"), [("r/B,YES,1,CORE", "r.csv:3: scan_now has unsupported value 'YES'"), ("B,ja,x,", "r.csv:3: pilot_posts must be an integer"), ("B,,-2,", "r.csv:3: pilot_posts must not be negative"), ("B,,,GOOD", "r.csv:3: strict_relevance has unsupported value 'GOOD'"), (" ,,,", "r.csv:3: the name is empty")])
def test_a_bad_registry_value_is_an_error(spark, tmp_path, row, why):
    path = tmp_path / "r.csv"
    path.write_text(f"name,scan_now,pilot_posts,strict_relevance\nR/A,nein_bis_geprueft,+7,pilot\n{row}\nC,,,\n", encoding="utf-8")
    with pytest.raises(ValueError, match=why.replace(".", r"\.")):
        readers.read_registry(spark, str(path))
    path.write_text("name,scan_now,pilot_posts,strict_relevance\nR/A,nein_bis_geprueft,+7,pilot\nC,,,\n", encoding="utf-8")
    assert rows(readers.read_registry(spark, str(path)).select("name", "scan_now", "pilot_posts", "strict_relevance"), "name") == [("A", False, 7, "PILOT"), ("C", None, None, None)]


def test_the_signature_of_a_set_of_items(spark):
    shape = "id long, source_id long, external_id string, raw_text string, country_code string"
    items = [(i * 997 % 5000 - 40, 1, f"e{i}", f"text {i}", None) for i in range(300)]
    sign = lambda x: extraction.input_signature(spark.createDataFrame(x, shape)).first()[0]
    first = sign(items)
    assert first == sign(items[::-1]) and len(first) == 64
    for other in (items[1:], [*items[1:], (items[0][0], 1, "e0", "text 0", "DE")], [*items[1:], (9999, *items[0][1:])], [*items, items[0]]):
        assert sign(other) != first
    payload = spark.createDataFrame([(1, 2, "e", 'a "quote"\n é', None)], shape)
    assert payload.select(extraction.item_payload(payload)).first()[0] == json.dumps({"country_code": None, "external_id": "e", "id": 1, "language_code": None, "raw_text": 'a "quote"\n é', "source_id": 2}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert sign([]) == extraction.input_signature(spark.createDataFrame([], shape)).first()[0]


def arrivals(spark, *found):
    return spark.createDataFrame(list(found), "item_id string, arrival long, completeness string, raw_text string, provider string, metadata_json string")


def test_conflicts_are_recorded_in_order(spark):
    got = lifecycle.merge_records(arrivals(
        spark, ("a", 3, "FULL", "third", "q", '{"acquired_at":"t3"}'), ("a", 1, "FULL", "first", "p", '{"z":1,"acquired_at":"t1","content_conflicts":[{"provider":"o","detected_at":"t0"}]}'), ("a", 2, "FULL", "first", "r", "{}"), ("a", 4, "FULL", "fourth", None, "no json"), ("a", 0, "PARTIAL", "part", "s", '{"y":2}'),
        ("b", 1, "PARTIAL", "x", "p", None), ("b", 2, "PARTIAL", "y", "p", '{"n":1}'), ("c", 1, "METADATA_ONLY", None, "p", '{"k":{"b":1,"a":2}}'),
    )).collect()
    told = {r["item_id"]: (r["completeness"], r["raw_text"], r["conflicts"], r["metadata_json"]) for r in got}
    assert told["a"] == ("FULL", "first", 3, '{"acquired_at":"t1","content_completeness":"FULL","content_conflicts":[{"detected_at":"t0","provider":"o"},{"detected_at":"t3","provider":"q"},{"detected_at":null,"provider":null}],"z":1}')
    assert told["b"] == ("PARTIAL", "x", 0, '{"content_completeness":"PARTIAL"}') and told["c"] == ("METADATA_ONLY", None, 0, '{"content_completeness":"METADATA_ONLY","k":{"a":2,"b":1}}')


def test_stream_and_batch_record_the_same(spark, tmp_path):
    found = [("abc"[i % 3], i, ("PARTIAL", "FULL", "METADATA_ONLY", "FULL")[i * 7 % 4], f"t{i % 5}", f"p{i % 2}", json.dumps({"acquired_at": f"at {i}", f"k{i % 2}": i})) for i in range(30)]
    whole = rows(lifecycle.merge_records(arrivals(spark, *found)), "item_id")
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    for number, at in enumerate(range(0, 30, 7)):
        for _ in range(2):  # a batch that comes again changes nothing
            ingest.merge_batch(store, arrivals(spark, *found[at : at + 7]), number)
    assert rows(store.read("content").select("item_id", "completeness", "raw_text", "arrival", "conflicts", "metadata_json"), "item_id") == whole and sum(r[4] for r in whole) > 5


def test_json_objects_are_merged(spark):
    got = spark.createDataFrame([('{"b":{"y":1,"x":2},"a":1}', '{"b":3,"c":[{"q":1,"p":2}]}'), ("[1]", '{"a":null}'), (None, None)], "o string, n string").select(lifecycle.merged_json(F.col("o"), F.col("n"))).collect()
    assert [r[0] for r in got] == ['{"a":1,"b":3,"c":[{"p":2,"q":1}]}', '{"a":null}', "{}"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True)], "b int, a string, c boolean")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":null,"b":1,"c":true}']
    assert "| 1 | unknown | true |" in sinks.report("T", {"s": df})
    assert sinks.status_table(df).splitlines()[0].split() == ["b", "a", "c"]
    held = sinks.evidence_excerpts(spark.createDataFrame([("x", False)], "excerpt string, display_approved boolean")).first()[0]
    assert held.startswith("[withheld")


def test_more_readers(spark, tmp_path):
    sources = spark.createDataFrame([(1, "Foo"), (2, "Bar")], "id long, name string")
    assert rows(readers.select_health_sources(sources, name="foo")) == [(1, "Foo")]
    with pytest.raises(ValueError, match="unregistered"):
        readers.select_health_sources(sources, name="baz")
    with pytest.raises(ValueError, match="exactly one"):
        readers.select_health_sources(sources)
    (tmp_path / "q.json").write_text(json.dumps({"sources": [{"name": "a", "query_id": "1"}, {"name": "b"}]}))
    assert rows(readers.query_manifest(spark, str(tmp_path / "q.json")), "name") == [("a", "1"), ("b", None)]
    (tmp_path / "q.json").write_text(json.dumps({"sources": [{"name": "a"}, {"name": "A"}]}))
    with pytest.raises(ValueError, match="distinct"):
        readers.query_manifest(spark, str(tmp_path / "q.json"))
    (tmp_path / "h.json").write_text(json.dumps({"hits": [{"objectID": "7", "title": "Show HN: Tool - does it", "url": "u", "created_at": "2026-01-02T03:04:05Z"}]}))
    assert rows(readers.story_products(spark, str(tmp_path / "h.json"))) == [("story:7", "Tool", "does it", "u", "2026-01-02")]
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "suites": [{"name": "s", "kind": "k", "minimum_coverage": {"cases": 5}, "minimum_metrics": {"f1": 0.8}}]}))
    assert rows(readers.readiness_suites(spark, str(tmp_path / "g.json")), "gate") == [("s", "k", "coverage", "cases", 5.0), ("s", "k", "metrics", "f1", 0.8)]
    line = {"source": "a", "provider": "p", "checked_at": "t", "access_result": "PUBLIC_CONTENT", "http_status": 200, "latest_visible_item_at": None, "visible_item_count": 1, "sample_window_start": None, "sample_window_end": None, "coverage_complete": True, "reason": "r", "evidence_urls": [], "latency_ms": None, "cost_usd": None}
    (tmp_path / "c.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(line | {"source": "A"}))
    assert [r["problem"] for r in readers.health_capture(spark, str(tmp_path / "c.jsonl")).errors.collect()] == ["a source is captured once"]
    del line["cost_usd"]
    (tmp_path / "c.jsonl").write_text(json.dumps(line))
    assert [r["problem"] for r in readers.health_capture(spark, str(tmp_path / "c.jsonl")).errors.collect()] == ["missing keys: cost_usd"]


def test_replays_default_to_unavailable(spark):
    captures = spark.createDataFrame([("q1", "RESULTS")], "query string, availability string")
    assert rows(readers.replay_search(captures, spark.createDataFrame([("q1",), ("q2",)], "query string")), "query") == [("q1", "RESULTS"), ("q2", "SOURCE_UNAVAILABLE")]
    taken = spark.createDataFrame([("https://old.reddit.com/r/x/comments/Q1/s/", "CONTENT_COMPLETE")], "url string, state string")
    urls = spark.createDataFrame([("https://www.reddit.com/r/x/comments/q1/",), ("https://u/",)], "canonical_url string")
    assert sorted(r["state"] for r in readers.replay_acquisition(taken, urls).collect()) == ["ACQUISITION_FAILED", "CONTENT_COMPLETE"]


def test_reports(spark, tmp_path):
    from provenant.sources import reports

    plan = spark.createDataFrame([(1, "a", "CORE", True, 50), (2, "b", "PILOT", False, 25)], "ordering int, source_name string, strict_relevance string, ready boolean, pilot_size long")
    assert json.loads(reports.plan_json(plan))["planned_items"] == 50
    assert "| 2 | b | PILOT | false | 25 |" in reports.plan_markdown(plan)
    row = {"title": "T", "status": "OPEN", "evidence": [{"observation_id": 1, "evidence_scope": "DACH", "problem": "p", "excerpt": "x"}], "passes": None, "competitors": [{"name": "V", "solution_type": "S", "pricing": None}], "counter_evidence": [], "unknowns": [], "questions": []}
    shown, held = reports.opportunity_report(row), reports.opportunity_report(row, approved_sources=set(), language="de")
    assert "“x”" in shown and "unknown" in shown and reports.WITHHELD in held and "## Belege" in held and "unbekannt" in held
    reports.write_review(spark.createDataFrame([("s", 1)], "source string, observation_id long"), str(tmp_path / "r"))
    assert readers.read_csv(spark, str(tmp_path / "r"), reports.REVIEW_COLUMNS).count() == 1
    assert reports.next_sources(["a", "b", "c"], reports.load_state('{"a": "COMPLETE", "b": "FAILED"}')) == ["b", "c"]
    assert reports.load_state("broken") == {}


def test_report_tables_hold_every_row(spark):
    df = spark.range(1500).select("id", F.lit("CORE").alias("strict_relevance"), F.col("id").alias("ordering"))
    assert len(reports.plan_markdown(df).splitlines()) == 2 + 2 + 1500
    assert [int(x.split()[0]) for x in sinks.status_table(df.orderBy("id")).splitlines()[1:]] == list(range(1500))
    board = reports.radar_board(spark.createDataFrame([("b", 1)], "bucket string, products long"), df.select(F.lit("2026-01-01").alias("seen_date"), F.format_string("p%04d", "id").alias("name")))
    assert [x.split()[3] for x in board.splitlines() if "2026" in x] == [f"p{i:04d}" for i in range(120)]
