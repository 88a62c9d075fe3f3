"""Readers of boards, payloads, attachment files and page streams."""

import json

from pyspark.sql import functions as F

from pagewatch import schemas
from pagewatch.operators import attachments, links, portals
from pagewatch.sources import config, pages


def test_boards_keep_file_order(spark, tmp_path):
    path = tmp_path / "boards.json"
    rows = [{"university_name": n, "board_type": "b", "url": n} for n in ("z", "a", "m")]
    rows[1]["enabled"] = False
    path.write_text(json.dumps(rows))
    boards = config.read_boards(spark, str(path))
    assert [r.url for r in boards.orderBy("board_idx").collect()] == ["z", "a", "m"]
    univ = spark.createDataFrame([("z", "r", None, None, None, 1, "")], schemas.UNIVERSITIES)
    assert [r.url for r in config.active_boards(boards, univ).collect()] == ["z"]
    assert {r.url: r.skipped for r in config.mark_skipped(boards, univ).collect()} == {"z": False, "a": True, "m": True}


def test_payload_files(spark, tmp_path):
    inner = json.dumps({"Univdata": [{"ShortName": "한국대", "ServiceName": "일반대학원"}]})
    (tmp_path / "p.json").write_text(json.dumps({"d": inner}))
    services = portals.payload_services(pages.read_payloads(spark, str(tmp_path)))
    assert [r.ShortName for r in services.collect()] == ["한국대"]


def test_attachment_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.hwpx").write_bytes(b"123")
    files = attachments.typed_files(pages.read_attachments(spark, str(tmp_path), "https://f.example/files/"))
    assert [(r.url, r.length, r.suffix) for r in files.collect()] == [("https://f.example/files/a/x.hwpx", 3, ".hwpx")]


def test_large_attachments_are_never_opened(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"12345")
    (tmp_path / "edge.bin").write_bytes(b"x" * 10)
    # more than a row of this source can hold: opening it would fail the job
    with (tmp_path / "huge.bin").open("wb") as huge:
        huge.truncate(3 << 30)
    files = pages.read_attachments(spark, str(tmp_path), "https://f.example", max_bytes=10)
    rows = {r.url.rsplit("/", 1)[1]: r for r in files.collect()}
    assert {n: (r.length, r.refused) for n, r in rows.items()} == {
        "small.bin": (5, None), "edge.bin": (10, None), "huge.bin": (3 << 30, "3221225472 bytes, over 10"),
    }
    assert rows["huge.bin"].content is None and bytes(rows["small.bin"].content) == b"12345"
    texts = attachments.extract_texts(attachments.typed_files(files)).collect()
    assert {r.url.rsplit("/", 1)[1]: r.error for r in texts}["huge.bin"] == "3221225472 bytes, over 10"


def test_page_stream_is_parsed(spark, tmp_path):
    from pagewatch.operators.page_parse import parse_pages

    spark.createDataFrame([(1, "u", "<h1>t</h1>")], schemas.PAGES).write.parquet(str(tmp_path / "in"))
    stream = parse_pages(pages.stream_pages(spark, str(tmp_path / "in"))).select("url", "page_text")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).head().page_text == "t"


def test_round_robin(spark):
    rows = [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2)]
    frame = spark.createDataFrame(rows, "board_idx long, board_rank long").orderBy(F.rand(1))
    assert [tuple(r) for r in links.round_robin(frame).collect()] == [(0, 1), (1, 1), (2, 1), (0, 2), (2, 2)]


def test_latest_fetch(spark):
    rows = [("u", 1, "old"), ("u", 3, "new"), ("v", 2, "same"), ("v", 2, "same"), ("w", None, "none"), (None, 5, "x"), (None, 4, "y"), ("z", 1, None), ("z", 0, "b")]
    fetches = spark.createDataFrame(rows, "url string, page_id long, html string")
    got = sorted((tuple(r) for r in pages.latest_fetch(fetches).collect()), key=repr)
    assert got == sorted([("u", 3, "new"), ("v", 2, "same"), ("w", None, "none"), (None, 5, "x"), ("z", 1, None)], key=repr)
    differ = spark.createDataFrame([("u", 1, "a"), ("u", 1, "b"), ("u", 1, "c")], fetches.schema)
    assert pages.latest_fetch(differ).count() == 1 and pages.latest_fetch(fetches.limit(0)).count() == 0
    plan = pages.latest_fetch(differ)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
