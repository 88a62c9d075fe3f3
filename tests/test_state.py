"""State across runs: changes, history, delivery, state tables, sinks and streams."""

import glob
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewatch import fixed_values as fv, schemas
from pagewatch.operators import changes, dedupe, outbox, page_state, reports
from pagewatch.operators.ordering import sorted_ranges, with_last_before, with_position, with_rank
from pagewatch.sources import config, page_store, state as state_tables, tableset
from pagewatch.sources.sinks import write_results
from pagewatch.streaming import watch

AS_OF = "2026-06-15"
ITEM = "seq long, url string, content_fingerprint string, grade string, deadline_status string, checked_at string"


def as_of():
    return F.lit(AS_OF).cast("date")


def seen(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], schemas.SEEN)


def run(spark, state, known, *rows):
    items = spark.createDataFrame(rows, ITEM)
    return {r.seq: r for r in changes.mark_changes(items, state, known).collect()}


def test_change_types(spark):
    state = spark.createDataFrame(
        [("a", "f1", "B", "모집중", "t"), ("b", "f1", "B", "모집중", "t"), ("c", "f1", "B", "모집중", "t"), ("d", "f1", "B", "모집중", "t")],
        schemas.NOTICE_STATE,
    )
    got = run(
        spark, state, seen(spark, "e"),
        (0, "a", "f2", "B", "모집중", "t"), (1, "b", "f1", "A", "모집중", "t"), (2, "c", "f1", "B", "긴급", "t"),
        (3, "d", "f1", "B", "모집중", "t"), (4, "e", "f9", "A", "모집중", "t"), (5, "f", "f9", "A", "모집중", "t"), (6, "", "f", "A", "", ""),
    )
    assert [got[i].change_type for i in range(7)] == [
        "content_changed", "grade_changed", "deadline_changed", "unchanged", "unchanged", "new", "new",
    ]
    assert [got[i].previous_grade for i in (0, 4)] == ["B", ""]


def test_state_survives_unobserved_runs(spark):
    nothing = config.empty(spark, schemas.NOTICE_STATE)
    first = changes.update_notice_state(nothing, spark.createDataFrame([(0, "a", "1", "A", "", "x"), (1, "", "1", "A", "", "x")], ITEM))
    second = changes.update_notice_state(first, spark.createDataFrame([(0, "b", "1", "A", "", "y"), (1, "b", "2", "B", "", "y")], ITEM))
    assert sorted((r.url, r.content_fingerprint) for r in second.collect()) == [("a", "1"), ("b", "2")]


TARGET = "seq long, url string, grade string, is_new boolean, change_type string, deadline_status string, notice_date string"


def test_rows_to_mark_seen(spark):
    rows = [(0, "b", "B", True, "", "", AS_OF), (1, "c", "C", True, "", "", AS_OF), (2, "old-c", "C", False, "", "", AS_OF),
            (3, "failed-a", "A", True, "", "", AS_OF), (4, "stale", "A", True, "", "", "2026-01-01"), (5, "c", "C", True, "", "", AS_OF)]
    items = spark.createDataFrame(rows, TARGET)
    got = changes.items_to_mark_seen(items, items.where("url = 'b'"), as_of()).collect()
    assert sorted(r.url for r in got) == ["b", "c", "stale"]


def test_rows_for_state(spark):
    rows = [(0, "sent", "A", False, "content_changed", "접수중", AS_OF), (1, "failed", "B", False, "new", "접수중", AS_OF),
            (2, "unchanged", "C", False, "unchanged", "", AS_OF)]
    items = spark.createDataFrame(rows, TARGET)
    got = changes.items_to_update_state(items, items.where("url = 'sent'"), as_of()).collect()
    assert sorted(r.url for r in got) == ["sent", "unchanged"]


def graduate(spark, *rows):
    base = dict(university_name="u", board_type="게시판", title="모집", url="x", notice_date=AS_OF, matched_keywords=["2026"], attachment_urls=[])
    made = [base | r | {"seq": i} for i, r in enumerate(rows)]
    schema = ("university_name string, board_type string, title string, url string, notice_date string, "
              "matched_keywords array<string>, attachment_urls array<string>, seq long")
    return spark.createDataFrame(made, schema)


def test_graduate_newness(spark):
    old = graduate(spark, {"url": "x"})
    key = old.select(dedupe.item_fingerprint(old)).head()[0]
    rows = graduate(spark, {"url": "y"}, {"url": "x", "title": "다른 모집"}, {"url": "z", "title": "셋"})
    got = changes.mark_graduate_new(rows, seen(spark, key), old).orderBy("seq").collect()
    assert [r.is_new for r in got] == [False, True, True]
    got = changes.mark_graduate_new(rows, seen(spark, "x", "z"), old).orderBy("seq").collect()
    assert [r.is_new for r in got] == [True, True, False]
    portal = graduate(spark, {"board_type": "진학사어플라이", "notice_date": "2026-06-16"})
    before = graduate(spark, {"board_type": "진학사어플라이", "notice_date": "2026-06-15"})
    known = seen(spark, before.select(dedupe.item_fingerprint(before)).head()[0])
    assert not changes.mark_graduate_new(portal, known, before).head().is_new


def test_dedupe_keeps_first_and_is_layout_free(spark):
    rows = [(i, f"u{i % 3}", "univ", f"t{i}", [] if i % 2 else ["f"]) for i in range(60)]
    frame = spark.createDataFrame(rows, "seq long, url string, university_name string, title string, attachment_urls array<string>")
    results = [
        sorted(r.seq for r in dedupe.dedupe_notices(frame.repartition(n)).collect()) for n in (1, 7, 32)
    ]
    assert results == [[0, 1, 2, 3, 4, 5]] * 3


def history(spark, *rows):
    return spark.createDataFrame([tuple({"university_name": "u", "title": "t"}.get(f, "") if f not in r else r[f] for f in fv.HISTORY_FIELDS) for r in rows], schemas.HISTORY)


def test_history(spark):
    merged = dedupe.merge_history(history(spark, {"url": "a", "title": "old"}, {"url": "z"}), history(spark, {"url": "a", "title": "new"}))
    assert [(r.url, r.title) for r in merged.collect()] == [("a", "new"), ("z", "t")]
    a, b = {"url": "a"}, {"url": "b"}
    none = history(spark)
    assert dedupe.merge_history(none, history(spark, b, a, b)).collect() == dedupe.merge_history(none, history(spark, a, b)).collect()


# ------------------------------------------------------------- ordering
@pytest.mark.parametrize("hot", [False, True])
def test_ordered_primitives_match_plain_windows(spark, hot):
    rng = random.Random(7)
    rows = [("k" if hot or rng.random() < 0.3 else f"k{rng.randint(0, 5)}", i, rng.choice([None, "a", "b"])) for i in range(500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, at long, v string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    layout = sorted_ranges(frame, ["key"], ["at"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert layout.select("_range").distinct().count() > 4
    placed = with_position(with_rank(with_last_before(layout, ["key"], {"before": F.col("v")}), ["key"]))
    want, last, rank = [], {}, {}
    for position, (key, at, v) in enumerate(sorted(rows, key=lambda r: (r[0], r[1])), 1):
        rank[key] = rank.get(key, 0) + 1
        want.append((key, at, position, rank[key], last.get(key)))
        last[key] = v or last.get(key)
    got = sorted(tuple(r) for r in placed.select("key", "at", "position", "rank", "before").collect())
    assert got == sorted(want, key=lambda r: r[:2])


# ------------------------------------------------------------- delivery
def fold(spark, *events):
    """Events are (id, kind, status)."""
    import datetime as dt

    rows = [(i, kind, status, f"key{n}", f"m {n}", f"id{n}" if kind == "confirm" else None,
             "Timeout" if kind == "failure" else None, dt.datetime(2026, 6, 1, 0, 0, n), n)
            for n, (i, kind, status) in enumerate(events)]
    frame = spark.createDataFrame(rows, schemas.DELIVERY_EVENTS)
    outcomes = {r.event_id: r.outcome for r in outbox.delivery_outcomes(frame).collect()}
    return [outcomes[n] for n in range(len(rows))], {r.delivery_id: r for r in outbox.delivery_state(frame).collect()}


def test_delivery_protocol(spark):
    begin = ("a", "begin", None)
    outcomes, state = fold(spark, begin, ("a", "confirm", "delivered"), begin)
    assert outcomes == ["accepted", "applied", "skipped"]
    assert (state["a"].status, state["a"].attempt_count, state["a"].message_id) == ("delivered", 1, "id1")
    outcomes, state = fold(spark, begin, begin, ("a", "failure", "failed"), begin, ("a", "failure", "uncertain"), begin)
    assert outcomes == ["accepted", "blocked", "applied", "accepted", "applied", "blocked"]
    assert (state["a"].status, state["a"].attempt_count, state["a"].logical_key) == ("uncertain", 2, "key3")
    assert state["a"].error_type == "Timeout"
    outcomes, state = fold(spark, ("a", "resolve", "delivered"), begin, ("a", "resolve", "failed"), begin)
    assert outcomes == ["unknown", "accepted", "applied", "accepted"]
    assert (state["a"].status, state["a"].attempt_count, state["a"].resolved_at, state["a"].error_type) == ("sending", 2, None, None)


def delivered(spark, *rows):
    full = [(i, s, n, "k", "p", u, None, None, None) for i, s, n, u in rows]
    return spark.createDataFrame(full, schemas.DELIVERY_STATE)


def test_prune_validate_unresolved(spark):
    state = delivered(spark, ("1" * 64, "delivered", 1, "2026-01-01"), ("2" * 64, "delivered", 1, "2026-01-02"), ("3" * 64, "sending", 1, "2025"))
    assert sorted(r.delivery_id[0] for r in outbox.prune_delivered(state, 1).collect()) == ["2", "3"]
    assert [r.delivery_id[0] for r in outbox.unresolved(state).collect()] == ["3"]
    assert outbox.require_valid(state).count() == 3
    for bad in (("x", "sending", 1, "t"), ("1" * 64, "lost", 1, "t"), ("1" * 64, "sending", 0, "t"), ("1" * 64, "sending", 1, "")):
        with pytest.raises(outbox.DurableStateError):
            outbox.require_valid(delivered(spark, bad))


@pytest.mark.parametrize("error,code,message,want", [
    ("HTTPError", 400, "", "failed"), ("HTTPError", 503, "", "uncertain"), ("ConnectTimeout", None, "", "failed"),
    ("Timeout", None, "", "uncertain"), ("ConnectionError", None, "Name resolution failed", "failed"), ("ConnectionError", None, "reset", "uncertain"),
])
def test_triage(spark, error, code, message, want):
    row = spark.createDataFrame([(error, code, message)], "e string, c int, m string")
    assert row.select(outbox.failure_status(F.col("e"), F.col("c"), F.col("m")).alias("s")).head().s == want


def portal_rows(spark, n):
    rows = [(i, f"t{i}", f"u{i}", "A", "유웨이어플라이", AS_OF) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, title string, url string, grade string, board_type string, notice_date string")


def test_digests_do_not_depend_on_input_order(spark):
    frame = portal_rows(spark, 30)
    made = [
        [(r.batch, r.digest_key, len(r["items"])) for r in reports.portal_digests(f).orderBy("batch").collect()]
        for f in (frame, frame.orderBy(F.rand(3)).repartition(7))
    ]
    assert made[0] == made[1] and [n for _, _, n in made[0]] == [25, 5]


def test_empty_summary(spark):
    items = graduate(spark, {"title": "a"}, {"title": "b"})
    print_of = lambda *a: reports.set_fingerprint(*a).head().fingerprint
    base = print_of(items, 17, 4)
    assert base == print_of(items.repartition(5), 17, 4) and base != print_of(items, 18, 4)
    stored = reports.set_fingerprint(items, 17, 4)
    assert not reports.sends_empty_summary(reports.set_fingerprint(items, 17, 4), stored).head().send
    assert reports.sends_empty_summary(reports.set_fingerprint(items, 17, 5), stored).head().send
    assert base != print_of(items.where("title = 'a'").union(items), 17, 4)
    # one definition at every size: a set is told from itself with one more item
    many = items.where("title = 'a'").crossJoin(spark.range(10_001)).withColumn("title", F.col("id").cast("string"))
    prints = [print_of(many.where(F.col("id") < n).drop("id"), 17, 4) for n in (9_999, 10_000, 10_001)]
    assert len(set(prints)) == 3 and prints[2] == print_of(many.drop("id").repartition(7), 17, 4)


def test_page_state(spark):
    fetched = "url string, seq long, etag string, last_modified string, content string, checked_at string, html string, extracted_text string"
    first = spark.createDataFrame([("u", 0, "e1", None, "c", "t1", "h", None), ("v", 1, "e", "", "c", "t0", "x" * 500_001, None)], fetched)
    second = spark.createDataFrame([("u", 0, None, "m2", "d", "t2", None, "text")], fetched)
    state = page_state.update_page_state(config.empty(spark, schemas.PAGE_STATE), page_state.page_updates(first))
    state = page_state.update_page_state(state, page_state.page_updates(second))
    got = {r.url: r for r in state.collect()}
    assert (got["u"].etag, got["u"].last_modified, got["u"].html, got["u"].extracted_text) == ("", "m2", "h", "text")
    assert got["v"].html == "x" * 500_001
    assert [r.url for r in page_state.most_recent(state, 1).collect()] == ["u"]
    reuse = page_state.with_page_reuse(spark.createDataFrame([("u", "d"), ("v", "z")], "url string, content string"), state)
    assert {r.url: (r.unchanged, r.cached) for r in reuse.collect()} == {"u": (True, "h"), "v": (False, None)}


FETCHED = "url string, seq long, etag string, last_modified string, content string, checked_at string, html string, extracted_text string"


def test_page_store_holds_a_content_once(spark, tmp_path):
    store = page_store.PageStore(spark, str(tmp_path / "p"), buckets=4)
    assert store.states().count() == 0
    first = spark.createDataFrame(
        [("u", 0, "e1", None, "c", "t1", "same", "same"), ("v", 1, "e", "", "c", "t0", "same", None), ("w", 2, "", "", "c", "t3", "x" * 500_001, "")],
        FETCHED,
    )
    second = spark.createDataFrame([("u", 0, None, "m2", "d", "t2", None, "text"), ("v", 1, "", "", "k", "t4", "new", None)], FETCHED)
    store.update(first, 0)
    before = store.tables.current()
    assert sorted(len(r.value) for r in store.contents().collect()) == [0, 4, 500_001]
    store.update(second, 1)
    assert store.update(second, 1) is None
    now = store.tables.current()
    assert now.tables["contents"]["1"] == before.tables["contents"]["1"]  # the first run's folder stands as it was
    assert sorted(r.value for r in store.tables.read("contents", now, [2]).collect()) == ["new", "text"]
    state = config.empty(spark, schemas.PAGE_STATE)
    for rows in (first, second):
        state = page_state.update_page_state(state, page_state.page_updates(rows))
    as_set = lambda df: {tuple(r) for r in df.select(*schemas.PAGE_STATE.names).collect()}
    assert as_set(store.states()) == as_set(state)
    probes = spark.createDataFrame([("u", "d"), ("v", "z"), ("nowhere", None)], "url string, content string")
    want = {tuple(r) for r in page_state.with_page_reuse(probes, state).collect()}
    assert {(r.url, r.content, r.content_hash, r.unchanged, r.cached) for r in page_store.with_page_reuse(probes, store).collect()} == want


def test_page_store_prunes_contents_without_a_name(spark, tmp_path):
    store = page_store.PageStore(spark, str(tmp_path / "p"), buckets=4)
    row = lambda url, at, html: (url, 0, "", "", html, at, html, None)
    store.update(spark.createDataFrame([row("a", "t1", "A"), row("b", "t2", "B"), row("c", "t3", "C")], FETCHED), 0)
    store.update(spark.createDataFrame([row("d", "t4", "D")], FETCHED), 1)
    one = store.tables.current().tables["contents"]["2"]
    store.prune(2, keep=3)  # a third of the first folder is without a name: it stays
    assert {r.value for r in store.contents().collect()} == set("ABCD")
    store.prune(3, keep=2)  # two thirds are: it is written anew
    assert {r.value for r in store.contents().collect()} == set("CD") and {r.html for r in store.states().collect()} == set("CD")
    assert store.tables.current().tables["contents"]["2"] == one
    store.tables.retain(1)
    assert len(store.tables.files.names("tables/contents")) == 2 and store.states().count() == 2
    twice = spark.createDataFrame([row("e", "t5", "E"), row("e", "t5", "F")], FETCHED)
    with pytest.raises(outbox.DurableStateError):
        store.update(twice, 4)


# ---------------------------------------------------------- state tables
def test_state_table(spark, tmp_path):
    table = state_tables.StateTable(spark, str(tmp_path / "s"), schemas.SEEN)
    assert table.read().count() == 0
    table.ensure()
    table.write(seen(spark, "a"), batch_id=4)
    table.write(table.read().union(seen(spark, "b")), batch_id=5)
    table.write(seen(spark, "replayed"), batch_id=5)
    assert sorted(r.key for r in table.read().collect()) == ["a", "b"]
    spark.range(1).write.parquet(str(tmp_path / "s" / "v=9"))  # a write that never committed
    assert table.version() == 3 and table.read().count() == 2
    committed = spark.read.json(f"{table.path}/commits").where("version = 3").head().folder
    spark.range(1).write.mode("overwrite").parquet(f"{table.path}/{committed}")
    with pytest.raises(outbox.DurableStateError):
        table.read()


def test_seen_file_layouts(spark, tmp_path):
    def keys(data):
        path = tmp_path / "seen.json"
        path.write_text(data if isinstance(data, str) else json.dumps(data))
        return sorted(r.key for r in state_tables.read_seen_file(spark, str(path)).collect())

    assert keys(["b", "a", "a"]) == ["a", "b"]
    assert keys({"a": ["b", "c"], "d": None, "e": []}) == ["a", "b", "c", "d", "e"]
    assert keys([]) == []
    for bad in ([1], {"a": [1]}, {"a": "b"}, "{broken", '"text"'):
        with pytest.raises((PySparkException, Py4JJavaError)):
            keys(bad)
    assert state_tables.read_seen_file(spark, str(tmp_path / "none.json")).count() == 0


def test_config_and_tolerance(spark, tmp_path):
    path = tmp_path / "u.json"
    path.write_text(json.dumps([{"name": "한국대", "region": "seoul", "domains": ["k.ac.kr"]}, {"name": "b", "region": "incheon"}]))
    assert [r.name for r in config.read_universities(spark, str(path), "seoul").collect()] == ["한국대"]
    path.write_text("{not json")
    assert config.read_universities(spark, str(path)).count() == 0
    with pytest.raises((PySparkException, Py4JJavaError)):
        state_tables.read_durable_json(spark, str(path), schemas.NOTICE_STATE).collect()
    assert config.read_universities(spark, str(tmp_path / "absent.json")).count() == 0
    assert state_tables.read_durable_json(spark, str(tmp_path / "absent.json"), schemas.SEEN).count() == 0
    words = tmp_path / "k.json"
    words.write_text(json.dumps({"computer_positive": {"z": 2, "a": 3}, "registration_positive": {"m": 1}, "course_names": ["x"]}))
    vocabulary = config.vocabulary(config.read_vocabulary(spark, str(words)))
    assert [(w.family, w.word, w.points) for w in vocabulary.words] == [("registration", "m", 1), ("computer", "z", 2), ("computer", "a", 3)]


def test_result_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [("=HYPERLINK(1)", "A", ["a", "b"], {"k": "v"}), ("x", "D", [], {})],
        "title string, grade string, attachment_urls array<string>, ocr_evidence map<string,string>",
    )
    write_results(rows, str(tmp_path), ("title", "grade", "attachment_urls", "ocr_evidence"), debug=True)
    public = spark.read.json(str(tmp_path / "results_json")).collect()
    assert [(r.title, r.attachment_urls, r.ocr_evidence) for r in public] == [("=HYPERLINK(1)", "a; b", "k: v")]
    cells = spark.read.option("header", True).csv(str(tmp_path / "results_csv")).collect()
    assert cells[0].title == "'=HYPERLINK(1)"
    assert spark.read.json(str(tmp_path / "debug_json")).count() == 2


# --------------------------------------------------------------- streams
def _files(spark, folder, frames):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def test_change_stream_equals_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, f"u{rng.randint(0, 3)}", f"f{rng.randint(0, 1)}", rng.choice("AB"), rng.choice(["모집중", "긴급"]), "t") for s in range(40)]
    frames = [spark.createDataFrame(rows[i : i + 10], ITEM) for i in range(0, 40, 10)]
    stream = watch.change_rows(_files(spark, str(tmp_path / "in"), frames))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("url", "seq", "change_type", "previous_grade").collect()
    table = changes.changes_across_runs(spark.createDataFrame(rows, ITEM), "seq").select("url", "seq", "change_type", "previous_grade").collect()
    assert sorted(got) == sorted(table)


RUN_ITEM = "seq long, url string, content_fingerprint string, grade string, deadline_status string, checked_at string, notice_date string"


def run_frames(spark):
    rows = lambda n, *more: [(0, "a", "1", "A", "모집중", f"r{n}", AS_OF), (1, "b", "1", "A", "모집중", f"r{n}", AS_OF), *more]
    return [
        spark.createDataFrame(rows(1, (2, "c", "1", "C", "모집중", "r1", AS_OF)), RUN_ITEM),
        spark.createDataFrame(rows(2, (2, "c", "2", "C", "모집중", "r2", AS_OF)), RUN_ITEM),
    ]


def run_store(spark, folder, buckets=8):
    return tableset.TableSet(spark, str(folder), watch.RUN_TABLES, buckets)


def test_runs_as_batches(spark, tmp_path):
    store, log = run_store(spark, tmp_path / "store"), []

    def deliver(targets):
        log.append(sorted(r.url for r in targets.collect()))
        return targets.where("url = 'a'")  # b fails every time

    stream = _files(spark, str(tmp_path / "in"), run_frames(spark))
    watch.watch_runs(stream, store, deliver, as_of(), str(tmp_path / "cp")).awaitTermination()
    assert log == [["a", "b"], ["b"]]
    assert sorted(r.url for r in store.read("state").collect()) == ["a", "c"]
    assert sorted(r.key for r in store.read("seen").collect()) == ["a", "c"]


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", range(9))
def test_a_run_that_dies_anywhere_ends_in_the_same_tables_and_delivers_once(spark, tmp_path, monkeypatch, step):
    """Every durable write of a run, and the delivery itself, dies before or after it is done; then the run is repeated."""
    first, second = run_frames(spark)
    store, delivered = run_store(spark, tmp_path / "store", buckets=2), []
    sends = lambda targets: targets.where("url != 'x'")

    def deliver(targets):
        delivered.extend(r.url for r in targets.collect())
        crash("delivered")
        return sends(targets)

    places = ["before intent", "after intent", "delivered", "before sent", "after sent", "before state", "before seen", "before commit", "after commit"]
    armed = {places[step]}

    def crash(place):
        if place in armed:
            armed.clear()
            raise Crash(place)

    create, changed = tableset.Files.create, tableset.TableSet.changed

    def creates(self, name, value):
        kind = "commit" if name.startswith("commits") else name.rsplit("/", 1)[1].removesuffix(".json")
        crash(f"before {kind}")
        made = create(self, name, value)
        crash(f"after {kind}")
        return made

    def changes_table(self, name, *rest):
        crash(f"before {name}")
        return changed(self, name, *rest)

    monkeypatch.setattr(tableset.Files, "create", creates)
    monkeypatch.setattr(tableset.TableSet, "changed", changes_table)
    arrived = lambda targets: sends(targets).where(F.col("url").isin(delivered))
    for batch_id, batch in enumerate((first, second)):
        for _ in range(2):
            try:
                watch.run_once(batch, batch_id, store, deliver, as_of(), recover=arrived)
            except Crash:
                continue
    nothing_sent = places[step] == "after intent"  # died with the intent durable and nothing sent: these stay targets of the next run
    assert not armed and sorted(delivered) == ["a", "b"]
    assert sorted(r.url for r in store.read("state").collect()) == ["a", "b", "c"]
    assert sorted(r.key for r in store.read("seen").collect()) == ["a", "b", "c"]
    assert store.current().number == 2 and (not nothing_sent or len(delivered) == 2)


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    tables = {"state": tableset.Keyed(schemas.NOTICE_STATE, "url")}
    store = tableset.TableSet(spark, str(tmp_path / "s"), tables, buckets=64)
    rows = lambda urls, print_: spark.createDataFrame([(u, print_, "A", "", "t", i) for i, u in enumerate(urls)], "url string, content_fingerprint string, grade string, deadline_status string, checked_at string, seq long")
    upsert = lambda old, new: changes.update_notice_state(old, new)
    urls = [f"https://x/{i}" for i in range(300)]
    first = store.commit(store.current(), 0, state=store.changed("state", rows(urls, "1"), upsert, store.current()))
    some = urls[:3] + ["https://new/1"]
    second = store.commit(first, 1, state=store.changed("state", rows(some, "2"), upsert, first))
    differ = [b for b, folder in second.tables["state"].items() if folder != first.tables["state"][b]]
    assert 1 <= len(differ) <= 4 and len(second.tables["state"]) == len(first.tables["state"]) > 50
    got = {r.url: r.content_fingerprint for r in store.read("state").collect()}
    assert got == {u: "1" for u in urls} | {u: "2" for u in some}
    assert {r.url: r.content_fingerprint for r in store.read("state", first).collect()} == {u: "1" for u in urls}
    # a second writer that starts from the same version is told
    late = store.changed("state", rows(["https://x/9"], "3"), upsert, first)
    with pytest.raises(outbox.DurableStateError):
        store.commit(first, 2, state=late)
    # what no kept version names goes: the late writer's folder, and the first one once all its buckets are replaced
    third = store.commit(second, 3, state=store.changed("state", rows(urls, "4"), upsert, second))
    assert store.retain(keep=2) == 1 and store.retain(keep=1) == 2
    assert store.read("state").where("content_fingerprint = '4'").count() == 300 and store.current() == third


def test_stale_split_and_copies(spark, tmp_path):
    frame = spark.createDataFrame([("a", "2026-06-14"), ("b", "2026-01-01"), ("c", "")], "url string, notice_date string")
    timely, stale = watch.split_stale(frame, as_of())
    assert sorted(r.url for r in timely.collect()) == ["a", "c"] and [r.url for r in stale.collect()] == ["b"]


def test_writers_keep_their_own_folders(spark, tmp_path):
    one = state_tables.StateTable(spark, str(tmp_path / "t"), schemas.SEEN)
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    assert one.write(rows("a"), 1) == 1 and one.write(rows("b"), 1) == 1  # a replayed batch changes nothing
    assert [r.key for r in one.read().collect()] == ["a"]
    assert one.write(rows("c"), 2) == 2 and [r.key for r in one.read().collect()] == ["c"]
    # a second writer that took the same version is found, not silently chosen
    late = spark.createDataFrame([(2, 9, "v=2-other")], state_tables.COMMITS)
    late.write.mode("append").json(f"{one.path}/commits")
    with pytest.raises(state_tables.DurableStateError):
        one.read()


def test_long_vocabularies_score_like_short_ones(spark, monkeypatch):
    from pagewatch.functions import scoring, text

    families = ("registration", "external", "computer")
    row = [(1, "w0x w7x w99x", "w4x w98x w5x w11x", "접수중"), (2, "", "", ""), (3, "w3x W2X", "w1x", "마감")]
    frame = spark.createDataFrame(row, "seq long, title string, text string, deadline_status string")
    vocabulary = scoring.Vocabulary(
        tuple(scoring.Word(families[i % 3], "negative" if i % 4 == 3 else "positive", f"w{i}x", i % 7 + 1) for i in range(100))
    )
    read = lambda: sorted(map(tuple, scoring.with_classification(frame, vocabulary).collect()))
    short = read()
    for module in (scoring, text):
        monkeypatch.setattr(module, "FLAT_WORDS", 10)
    assert read() == short
    large = scoring.Vocabulary(tuple(scoring.Word("registration", "positive", f"w{i}x", 1) for i in range(5_000)))
    got = {r.seq: r.registration_score for r in scoring.with_classification(frame, large).collect()}
    assert got == {1: 7, 2: 0, 3: 3}


def delivery_rows(rng, n, ids):
    import datetime as dt

    kinds = {"begin": None, "confirm": "delivered", "failure": "failed", "resolve": "delivered"}
    out = []
    for i in range(n):
        kind = rng.choice(list(kinds))
        status = rng.choice(["failed", "uncertain"]) if kind == "failure" else kinds[kind]
        ts = dt.datetime(2026, 6, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 20))
        out.append((rng.choice(ids), kind, status, f"k{i}", f"m  {i}", f"id{i}" if kind == "confirm" else None, f"E{i % 3}" if kind == "failure" else None, ts, i))
    return out


@pytest.mark.parametrize("ids, lateness", [([f"d{i}" for i in range(12)], "60 days"), (["hot"], "60 days"), (["hot", "d1"], "1 day")])
def test_delivery_stream_equals_the_table(spark, tmp_path, ids, lateness):
    """Shuffled files with a wide lateness; with a narrow one files in order of time, so that buckets settle between batches."""
    from pagewatch.queries.streams import drained
    from pagewatch.streaming import delivery

    rows = delivery_rows(random.Random(6), 160, ids)
    if lateness == "1 day":
        rows.sort(key=lambda r: r[7])
    frames = [spark.createDataFrame(rows[i : i + 40], schemas.DELIVERY_EVENTS) for i in range(0, 160, 40)]
    stream = _files(spark, str(tmp_path / "in"), frames)
    updates = drained(delivery.delivery_updates(stream, lateness), mode="update")
    want = outbox.delivery_state(spark.createDataFrame(rows, schemas.DELIVERY_EVENTS))
    got = delivery.latest_entries(updates).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert updates.count() > len(ids)  # a row per id and batch


class HeldState(dict):
    """A value, map and handle of state in memory."""

    def get(self):
        return super().get("value")

    def update(self, value):
        self["value"] = value

    def getValue(self, key):
        return super().get(key)

    updateValue, removeKey = dict.__setitem__, dict.__delitem__


class HeldStates:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, HeldState())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)


def test_delivery_processor_folds_many_ids_at_once(spark):
    """One frame a shard, whatever its ids, with buckets folded in between; a null id is one of them."""
    import datetime as dt
    import types

    import pandas as pd

    from pagewatch.streaming import delivery

    rows = sorted(delivery_rows(random.Random(3), 400, [None, "null", "=a", *(f"d{i}" for i in range(40))]), key=lambda r: (r[7], r[8]))
    events = spark.createDataFrame(rows, schemas.DELIVERY_EVENTS)
    want = {r.delivery_id: r for r in outbox.delivery_state(events.withColumn("delivery_id", F.coalesce("delivery_id", F.lit("none")))).collect()}
    handle, processor, last = HeldStates(), delivery.DeliveryProcessor(), {}
    processor.init(handle)
    for at in range(0, 400, 100):
        part = [(r[0], int(r[7].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), r[8], r[1], r[2], r[3], r[4].replace("  ", " "), r[5], r[6]) for r in rows[at : at + 100]]
        frame = pd.DataFrame(part, columns=["delivery_id", *delivery._EVENT])
        (out,) = processor.handleInputRows((0,), iter([frame.iloc[:60], frame.iloc[60:]]), None)
        assert set(out["delivery_id"].map(lambda v: v if isinstance(v, str) else None)) == {p[0] for p in part}
        last |= {r.delivery_id if isinstance(r.delivery_id, str) else "none": r for r in out.itertuples()}
        for timer in sorted(t for t in handle.timers if t * 1000 <= part[-1][1]):
            handle.timers.discard(timer)
            passed = types.SimpleNamespace(getExpiryTimeInMs=lambda timer=timer: timer)
            assert list(processor.handleExpiredTimer((0,), None, passed)) == []
    assert len(handle.states["waiting"]) == 1  # all but the last day's bucket are settled
    got = {k: (r.status, r.attempt_count, r.logical_key, r.message_preview) for k, r in last.items() if isinstance(r.status, str)}
    assert got == {k: (r.status, r.attempt_count, r.logical_key, r.message_preview) for k, r in want.items()}


def test_late_rows_go_to_their_own_output(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2026, 6, n)
    frames = [
        spark.createDataFrame(rows, "n int, ts timestamp")
        for rows in ([(0, day(10)), (1, day(1)), (2, None)], [(3, day(9)), (4, day(2)), (5, day(20))], [(6, day(11)), (7, day(18)), (8, None)])
    ]
    stream = _files(spark, str(tmp_path / "in"), frames)
    folders = watch.split_late(stream, "ts", 3 * 86_400, str(tmp_path / "out"), str(tmp_path / "cp"))
    timely, late = ([r.n for r in spark.read.parquet(f).orderBy("n").collect()] for f in folders)
    assert (timely, late) == ([0, 1, 2, 3, 5, 7, 8], [4, 6])


def test_summary_lists_show_the_first_of_each(spark):
    items = spark.createDataFrame(
        [(i, "AB"[i % 2], f"u{i}", f"t{i}", f"https://x/{i}", True, "new", "모집중", AS_OF) for i in range(8)],
        "seq long, grade string, university_name string, title string, url string, is_new boolean, change_type string, deadline_status string, notice_date string",
    )
    failures = spark.createDataFrame(
        [("board", 2, 0, "u", "b", "x2", "e"), ("board", 1, 0, "u", "b", "x1", "e")] + [("detail", 1, n, "u", "b", f"d{n}", "e") for n in range(7)],
        "kind string, _board long, _seq long, university_name string, board_type string, url string, error string",
    )
    row = reports.with_lists(reports.run_summary(items, as_of()), items, failures, as_of()).head()
    assert [i.url for i in row.preview_items] == [f"https://x/{n}" for n in (0, 2, 4, 6, 1)]
    assert [f.url for f in row.failed_boards] == ["x1", "x2"] and [f.url for f in row.failed_details] == [f"d{n}" for n in range(5)]
    empty = reports.with_lists(reports.run_summary(items.limit(0), as_of()), items.limit(0), None, as_of()).head()
    assert (empty.deduped_count, empty.preview_items, empty.failed_boards) == (0, [], [])


def test_history_changes_with_the_run_that_brings_it(spark, tmp_path):
    from pagewatch.plans import course_watch

    store = tableset.TableSet(spark, str(tmp_path / "store"), course_watch.COURSE_TABLES, buckets=4)
    layout = RUN_ITEM + ", registration_score int, university_name string, region string, title string, source_type string, application_start_date string, application_end_date string"
    row = lambda i, url, score, region: (i, url, "1", "A", "모집중", "r", AS_OF, score, "한국대", region, "2026학년도 1학기 안내", "board", "", None)
    first = spark.createDataFrame([row(0, "a", 90, "old"), row(1, "b", 90, "old"), row(2, "c", 1, "old"), row(3, "", 90, "old")], layout)
    second = spark.createDataFrame([row(0, "a", 90, "new"), row(1, "d", 90, "new")], layout)
    for number, batch in enumerate((first, second)):
        assert not watch.has_intent(store, number)
        watch.run_once(batch, number, store, lambda targets: targets, as_of())
        assert watch.has_intent(store, number) and store.current().number == number + 1
    want = dedupe.merge_history(dedupe.history_rows(first), dedupe.history_rows(second))
    got = store.read("history").drop("key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted((r.url, r.region) for r in got.collect()) == [("", "old"), ("a", "new"), ("b", "old"), ("d", "new")]
    assert sorted(r.change_type for r in course_watch.results(store, 1).collect()) == ["new", "unchanged"]
    # a committed run is not run again: nothing of what it is given is looked at
    nothing = [None] * 5
    assert course_watch.run_and_commit(store, 1, None, *nothing, as_of=as_of(), checked_at=None) is None


def test_no_value_of_a_page_is_sorted(spark, tmp_path):
    """Plans of upsert, reuse and store: contents stream past narrow rows."""
    state = spark.createDataFrame([("a", "e", "", "h", "d1", "<a>", "A"), ("b", "e", "", "h", "d1", "<b>", None), (None, "e", "", "h", "d1", "<n>", "N")], schemas.PAGE_STATE)
    layout = "url string, seq long, etag string, last_modified string, content string, checked_at string, html string, extracted_text string"
    rows = [("a", 1, None, None, "c", "d2", None, "A2"), ("a", 2, "x", None, "c2", "d3", "<a2>", None), ("c", 1, None, None, "c", "d2", None, None), (None, None, "y", None, "c", "d2", None, "N2")]
    fetched = spark.createDataFrame(rows + rows[:1], layout)  # one row comes twice
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    new = page_state.update_page_state(state, page_state.page_updates(spark.createDataFrame(rows, layout)))
    assert "Sort" not in plan(new) and "ShuffledHashJoin" in plan(new)
    again = page_state.update_page_state(state, page_state.page_updates(fetched))
    want = [(None, "y", "d2", "<n>", "N2"), ("a", "x", "d3", "<a2>", "A2"), ("b", "e", "d1", "<b>", None), ("c", "", "d2", None, None)]
    for df in (new, again):
        got = [(r.url, r.etag, r.checked_at, r.html, r.extracted_text) for r in df.collect()]
        assert sorted(got, key=lambda r: r[0] or "") == want
    store = page_store.PageStore(spark, str(tmp_path / "store"), buckets=2)
    store.update(spark.createDataFrame(rows, layout), 0)
    assert "Sort" not in plan(store.states())
    asked = fetched.select("url", "seq", "content")
    for df in (page_state.with_page_reuse(asked, new), page_store.with_page_reuse(asked, store)):
        assert "Sort" not in plan(df)
        assert sorted((r.url or "", r.seq or 0, r.unchanged, r.cached) for r in df.collect()) == [
            ("", 0, False, None), ("a", 1, False, None), ("a", 1, False, None), ("a", 2, True, "<a2>"), ("c", 1, True, "")
        ]


def pages_of(spark, folder, column):
    """Rows of every page of a column, and of every row group, in the files of a folder."""
    jvm, pages, groups = spark._jvm, [], []
    for file in glob.glob(f"{folder}/*.parquet"):
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        for block in reader.getFooter().getBlocks():
            index = reader.readOffsetIndex(next(c for c in block.getColumns() if c.getPath().toDotString() == column))
            groups.append(block.getRowCount())
            firsts = [index.getFirstRowIndex(i) for i in range(index.getPageCount())] + [block.getRowCount()]
            pages += [b - a for a, b in zip(firsts, firsts[1:])]
        reader.close()
    return pages, groups


def _long_after_short(spark):
    """200 short values, then 100 of 100 000 characters, in one partition."""
    n = F.col("id")
    html = F.when(n < 200, n.cast("string")).otherwise(F.concat(n.cast("string"), F.repeat(F.lit("x"), 100_000)))
    named = spark.range(0, 300, 1, 1).select(F.format_string("u%03d", n).alias("url"), n.alias("seq"), F.lit("c").alias("content"), html.alias("html"))
    text = [F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified", "checked_at", "extracted_text")]
    return named.select("*", *text)


def test_pages_of_a_file_hold_few_long_values(spark, tmp_path):
    """A writer that looks at sizes seldom puts all long values into one page, a reader takes a row group's rows at once."""
    from pagewatch.durable import stored

    fetched = _long_after_short(spark)
    state = stored(page_state.update_page_state(config.empty(spark, schemas.PAGE_STATE), page_state.page_updates(fetched)), long_values=True)
    pages, groups = pages_of(spark, state.inputFiles()[0].removeprefix("file:").rpartition("/")[0], "html")
    assert sum(pages) == sum(groups) == 300 and max(groups) <= 64
    reuse = page_state.with_page_reuse(fetched.select("url", "content"), state)
    reuse.orderBy("url").coalesce(1).write.parquet(str(tmp_path / "reuse"))
    pages, _ = pages_of(spark, str(tmp_path / "reuse"), "cached")
    assert sum(pages[:-1]) >= 200 and max(pages[1:]) <= 64  # a page over 1 MB ends within 64 rows
    assert reuse.where("unchanged AND length(cached) > 100000").count() == 100


def outer_joins(df):
    """The joins of a plan that ran that hold their outer side, one line each."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].splitlines()
    return [line for line in lines if "ShuffledHashJoin" in line and "LeftOuter, BuildLeft" in line]


def test_states_of_a_shared_content_are_made_one_by_one(spark, tmp_path):
    """Generated code would make the rows of all urls of a content before one is taken; a run's contents have small row groups."""
    store = page_store.PageStore(spark, str(tmp_path / "store"), buckets=2)
    many = spark.range(200).select(F.format_string("u%03d", "id").alias("url"), F.col("id").alias("seq"), F.lit("c").alias("content"), F.lit("same").alias("html"))
    empty = [F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified", "checked_at")]
    store.update(many.select("*", *empty, F.col("url").alias("extracted_text")), 0)
    _, groups = pages_of(spark, f"{store.tables.path}/{store.tables.current().tables['contents']['1']}/_bucket=1", "value")
    assert sum(groups) == 201 and max(groups) <= 64
    states = store.states()
    joins = outer_joins(states)
    assert len(joins) == 2 and not any("*(" in line for line in joins)
    assert {(r.html, r.extracted_text == r.url) for r in states.collect()} == {("same", True)} and states.count() == 200


def test_reuse_of_a_shared_content_is_made_row_by_row(spark, tmp_path):
    store = page_store.PageStore(spark, str(tmp_path / "store"), buckets=2)
    many = spark.range(200).select(F.format_string("u%03d", "id").alias("url"), F.col("id").alias("seq"), F.lit("c").alias("content"), F.lit("same").alias("html"))
    none = [F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified", "checked_at", "extracted_text")]
    store.update(many.select("*", *none), 0)
    spark.conf.unset("spark.sql.codegen.join.buildSideOuterShuffledHashJoin.enabled")
    reuse = page_store.with_page_reuse(many.select("url", "content"), store)
    joins = outer_joins(reuse)
    assert joins and not any("*(" in line for line in joins)
    assert {(r.unchanged, r.cached) for r in reuse.collect()} == {(True, "same")}


class CountedState(HeldState):
    """State in memory that counts the characters written."""

    written = 0

    def updateValue(self, key, value):
        self.written += sum(len(v) for v in value if isinstance(v, str))
        self[key] = value


def test_waiting_events_are_written_once(monkeypatch):
    """However many frames bring a bucket's events, and in whatever order, none is written again."""
    import pandas as pd

    from pagewatch.streaming import delivery

    monkeypatch.setattr(delivery, "HELD_EVENTS", 20, raising=False)
    day = 86_400 * 10**6
    kinds = [("begin", None), ("failure", "failed"), ("confirm", "delivered")]
    events = [("hot", (i % 3) * day + i, i, *kinds[i % 3], f"k{i}", f"m{i}", None, None) for i in range(900)]
    want = delivery.NOTHING
    for event in sorted(events, key=lambda e: e[1:3]):
        want = delivery.step(want, list(event[1:]))
    handle, processor = HeldStates(), delivery.DeliveryProcessor()
    handle.getMapState = lambda name, *schema: handle.states.setdefault(name, CountedState())
    processor.init(handle)
    frame = pd.DataFrame(random.Random(1).sample(events, 900), columns=["delivery_id", *delivery._EVENT])
    (out,) = processor.handleInputRows((0,), iter([frame.iloc[i : i + 20] for i in range(0, 900, 20)]), None)
    assert (out["status"][0], out["attempt_count"][0], out["logical_key"][0]) == want[:3]
    assert handle.states["waiting"].written < 1.2 * sum(len(json.dumps([*e[1:], e[0]])) + 2 for e in events)
