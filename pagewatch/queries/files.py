"""Files, state tables and result sinks: inputs made from whole tables, written or packed, and read by the real sources."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from pagewatch import fixed_values as fv, schemas
from pagewatch.durable import shared_folder, stored
from pagewatch.operators import attachments, changes, page_parse, portals
from pagewatch.queries import tables as t
from pagewatch.queries.registry import query
from pagewatch.queries.runs import STATE_SQL, snapshot_columns
from pagewatch.sources.config import in_region
from pagewatch.sources.sinks import write_results
from pagewatch.sources.state import StateTable, read_seen_file
from pagewatch.sources.tableset import Keyed, TableSet


def _folder(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


@query("state_table_rows", "SELECT DISTINCT user_id::VARCHAR || ' ' || event_type AS key FROM events WHERE event_type <> 'error'")
def state_table_rows(spark, sf_dir):
    """Two versions of a seen table, the second on top of the first; a replayed batch adds nothing."""
    events = t.table(spark, sf_dir, "events")
    keys = events.select(F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("key"), "event_type").distinct()
    table = StateTable(spark, _folder(spark, "seen"), schemas.SEEN)
    table.write(keys.where("event_type = 'click'"), 1)
    table.write(table.read().union(keys.where("event_type not in ('click', 'error')").select("key")), 2)
    table.write(keys.where("event_type = 'error'"), 2)
    return table.read()


@query(
    "result_files",
    t.with_sql(
        "SELECT source, title, url, grade, count(*) AS n FROM v_item, (VALUES ('csv'), ('json')) s(source) WHERE grade <> 'D' GROUP BY ALL",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def result_files(spark, sf_dir):
    """Public rows through both sinks and back."""
    fields = ("title", "url", "grade")
    folder = _folder(spark, "results")
    write_results(stored(t.items(spark, sf_dir).select(*fields)), folder, fields)
    json_rows = spark.read.schema("title string, url string, grade string").json(f"{folder}/results_json")
    csv_rows = spark.read.option("header", True).option("escape", '"').schema("title string, url string, grade string").csv(f"{folder}/results_csv")
    both = csv_rows.withColumn("source", F.lit("csv")).unionByName(json_rows.withColumn("source", F.lit("json")))
    return both.groupBy("source", *fields).agg(F.count("*").alias("n"))


@query(
    "packed_attachments",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: x <> ''), chr(10)) END AS text,
      CASE WHEN doc_id % 5 = 0 THEN 'no reader for .pdf' END AS error FROM documents""",
)
def packed_attachments(spark, sf_dir):
    """Every document as an archive with a paragraph per line, or as a file nobody can read; then its text."""

    def pack(batches):
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                url, content = f"https://f.example.com/{doc_id}.pdf", b"%PDF"
                if doc_id % 5:
                    out = io.BytesIO()
                    lines = "".join(f"<h:p><h:t>{escape(line)}</h:t></h:p>" for line in text.split("\n"))
                    with zipfile.ZipFile(out, "w") as archive:
                        archive.writestr("Contents/section0.xml", f"<s xmlns:h='http://h'>{lines}</s>")
                    url, content = f"https://f.example.com/{doc_id}.hwpx", out.getvalue()
                yield pa.RecordBatch.from_pydict({"url": [url], "length": pa.array([len(content)], pa.int64()), "content": [content]})

    files = t.table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(pack, "url string, length bigint, content binary")
    texts = attachments.extract_texts(attachments.typed_files(files))
    return texts.select(F.regexp_extract("url", r"(\d+)\.\w+$", 1).cast("bigint").alias("doc_id"), "text", "error")


@query(
    "portal_payloads",
    f"""SELECT p_name || ' {fv.PORTAL_SCHOOL} ' || k AS title, 'https://s.example.com/' || p_partkey || '/' || k AS url, count(*) AS n,
      count(DISTINCT p_partkey * 10 + k) AS places FROM part, (VALUES (0), (1), (2)) s(k) WHERE p_size % 3 <> 0 GROUP BY ALL""",
)
def portal_payloads(spark, sf_dir):
    """A payload of three services per part; two of three payloads are of graduate schools. Every row has a place of its own."""
    part = t.table(spark, sf_dir, "part")
    school = F.when(F.col("p_size") % 3 != 0, f" {fv.PORTAL_SCHOOL} ").otherwise(" other ")
    service = F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        lambda k: F.struct(
            F.col("p_name").alias("ShortName"),
            F.concat(school, k.cast("string")).alias("ServiceName"),
            F.concat(F.lit("https://s.example.com/"), F.col("p_partkey").cast("string"), F.lit("/"), k.cast("string")).alias("Link"),
        ),
    )
    raw = F.to_json(F.struct(F.to_json(F.struct(service.alias("Univdata"))).alias("d")))
    services = portals.payload_services(part.select(raw.alias("raw")))
    named = services.withColumn("name", F.concat_ws(" ", "ShortName", "ServiceName"))
    rows = portals.portal_rows(
        named.where(F.contains("name", F.lit(fv.PORTAL_SCHOOL))), portal=fv.PORTAL_API, name=F.regexp_replace("name", " +", " "),
        url=F.col("Link"), board_type=F.lit(fv.PORTAL_API_BOARD), reason=F.lit(""), as_of=t.as_of(), checked_at=F.lit(t.CHECKED_AT),
    )
    return rows.groupBy("title", "url").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("places"))


@query(
    "bucketed_state_rows",
    t.with_sql(
        """SELECT url, arg_max(content_fingerprint, o) AS content_fingerprint, arg_max(grade, o) AS grade, arg_max(deadline_status, o) AS deadline_status,
        arg_max(checked_at, o) AS checked_at FROM (SELECT url, content_fingerprint, grade, deadline_status, checked_at, -1 AS o FROM v_state
          UNION ALL SELECT url, content_fingerprint, grade, deadline_status, checked_at, seq FROM v_now) GROUP BY url""",
        STATE_SQL,
    ),
)
def bucketed_state_rows(spark, sf_dir):
    """Two runs over bucketed tables: the second reads and rewrites the buckets its urls fall into; old versions go."""
    rows = snapshot_columns(t.table(spark, sf_dir, "conversations")).withColumn("seq", F.col("run"))
    store = TableSet(spark, _folder(spark, "state"), {"state": Keyed(schemas.NOTICE_STATE, "url")})
    for number, when in enumerate(("deadline_status = '모집중' AND grade <> 'D'", "deadline_status = '긴급'")):
        version = store.current()
        folders = store.changed("state", stored(rows.where(when)), changes.update_notice_state, version)
        store.commit(version, number, state=folders)
    store.retain(keep=1)
    return store.read("state")


@query(
    "seen_file_keys",
    """SELECT DISTINCT key FROM (SELECT 'https://c.example.com/' || conv_id::VARCHAR AS key FROM conversations
      UNION ALL SELECT role || ' ' || conv_id::VARCHAR FROM conversations WHERE conv_id // 100 % 2 = 1)""",
)
def seen_file_keys(spark, sf_dir):
    """Seen files of a hundred conversations each, in turn a list of urls and the older object of urls and keys."""
    bucket = F.floor(F.col("conv_id") / 100)
    url = F.concat(F.lit("https://c.example.com/"), F.col("conv_id").cast("string"))
    keys = F.collect_set(F.concat(F.col("role"), F.lit(" "), F.col("conv_id").cast("string"))).alias("keys")
    each = t.table(spark, sf_dir, "conversations").groupBy(bucket.alias("bucket"), url.alias("url")).agg(keys)
    files = each.groupBy("bucket").agg(F.collect_list("url").alias("urls"), F.map_from_entries(F.collect_list(F.struct("url", "keys"))).alias("object"))
    folder = _folder(spark, "seen-files")
    text = F.when(F.col("bucket") % 2 == 0, F.to_json("urls")).otherwise(F.to_json("object"))
    files.select(text.alias("value"), "bucket").repartition("bucket").write.partitionBy("bucket").text(folder)
    return read_seen_file(spark, folder)


@query(
    "list_portal_rows",
    t.with_sql(
        """SELECT u.name || ' 일반대학원' AS title, u.name AS university_name, 'https://p.example/' || page_id::VARCHAR AS url, 'A' AS grade,
          coalesce(u.region_name, u.region) AS region, u.city FROM pages JOIN v_university u ON u.name = 'NATION_' || (page_id % 25)::VARCHAR
        WHERE page_id % 3 <> 0 AND u.region = (SELECT min(r_name) FROM region)""",
        t.UNIVERSITIES_SQL,
    ),
)
def list_portal_rows(spark, sf_dir):
    """A portal list page per page, with a heading that names the graduate school on two of three; known universities of one region only."""
    page, name = F.col("page_id"), F.concat(F.lit("NATION_"), (F.col("page_id") % 25).cast("string"))
    heading = F.when(page % 3 == 0, "편입학").otherwise("2026 후기 대학원")
    section = F.concat(
        F.lit('<div class="list"><h4>'), heading, F.lit('</h4><a href="https://p.example/'), page.cast("string"),
        F.lit('"><i title="접수중">접</i>'), name, F.lit(" 일반대학원 <span>U</span></a></div>"),
    )
    pages = t.table(spark, sf_dir, "pages").select("page_id", F.lit("https://p.example").alias("url"), F.concat(section, "html").alias("html"))
    rows = portals.list_portal(page_parse.parse_pages(pages), t.as_of(), F.lit(t.CHECKED_AT))
    first = t.table(spark, sf_dir, "region").agg(F.min("r_name")).head()[0]
    known = portals.with_region(rows, in_region(t.universities(spark, sf_dir), first), restrict=True)
    return known.select("title", "university_name", "url", "grade", "region", "city")
