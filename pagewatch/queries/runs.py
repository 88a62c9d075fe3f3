"""State across runs, delivery, crawl health and joins over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewatch import schemas
from pagewatch.durable import shared_folder, stored
from pagewatch.functions import hashing
from pagewatch.operators import changes, health, outbox, page_state, reports
from pagewatch.plans import course_watch
from pagewatch.queries import tables as t
from pagewatch.queries.registry import query
from pagewatch.queries.texts import GRADUATE_PRINT_SQL
from pagewatch.sources import page_store
from pagewatch.sources.config import active_boards, empty, in_region, mark_skipped

# --------------------------------------------------------- run snapshots
RUNS_SQL = """
v_run AS (SELECT 'https://c.example.com/' || (conv_id // 3)::VARCHAR AS url, conv_id % 3 * 1000 + turn AS run, turn,
   sha256(CASE WHEN turn % 3 = 2 THEN role ELSE text END) AS content_fingerprint,
   CASE WHEN length(text) > 900 THEN 'A' WHEN length(text) > 500 THEN 'B' WHEN length(text) > 200 THEN 'C' ELSE 'D' END AS grade,
   CASE WHEN role = 'user' THEN '모집중' ELSE '긴급' END AS deadline_status, strftime(DATE '2026-06-01' + turn::INT, '%Y-%m-%d') AS checked_at, conv_id
   FROM conversations)
"""


def _runs(spark, sf_dir):
    return snapshot_columns(t.table(spark, sf_dir, "conversations"))


def snapshot_columns(conversations):
    """conversations as snapshots of urls: three conversations make the runs of one url."""
    n = F.length("text")
    return conversations.select(
        F.concat(F.lit("https://c.example.com/"), F.floor(F.col("conv_id") / 3).cast("string")).alias("url"),
        (F.col("conv_id") % 3 * 1000 + F.col("turn")).alias("run"),
        "turn",
        F.sha2(F.when(F.col("turn") % 3 == 2, F.col("role")).otherwise(F.col("text")), 256).alias(
            "content_fingerprint"
        ),
        F.when(n > 900, "A").when(n > 500, "B").when(n > 200, "C").otherwise("D").alias("grade"),
        F.when(F.col("role") == "user", "모집중").otherwise("긴급").alias("deadline_status"),
        F.date_format(F.date_add(F.lit("2026-06-01").cast("date"), F.col("turn").cast("int")), "yyyy-MM-dd").alias(
            "checked_at"
        ),
        "conv_id",
    )


def _kind_sql(previous: str, known: str) -> str:
    return f"""CASE WHEN {previous}.url IS NULL AND {known} THEN 'unchanged' WHEN {previous}.url IS NULL THEN 'new'
      WHEN {previous}.content_fingerprint <> i.content_fingerprint THEN 'content_changed'
      WHEN {previous}.grade <> i.grade THEN 'grade_changed' WHEN {previous}.deadline_status <> i.deadline_status THEN 'deadline_changed'
      ELSE 'unchanged' END"""


@query(
    "changes_across_runs",
    t.with_sql(
        f"""SELECT i.url, i.run, {_kind_sql("p", "false")} AS change_type, coalesce(p.grade, '') AS previous_grade
        FROM (SELECT *, lag(run) OVER (PARTITION BY url ORDER BY run) AS before FROM v_run) i
        LEFT JOIN v_run p ON p.url = i.url AND p.run = i.before""",
        RUNS_SQL,
    ),
)
def changes_across_runs(spark, sf_dir):
    marked = changes.changes_across_runs(_runs(spark, sf_dir))
    return marked.select("url", "run", "change_type", "previous_grade")


# State: what user turns left behind; items: the assistant turns; seen: urls with a short turn.
STATE_SQL = f"""
{RUNS_SQL.strip()},
v_state AS (SELECT url, arg_max(content_fingerprint, run) AS content_fingerprint, arg_max(grade, run) AS grade,
   arg_max(deadline_status, run) AS deadline_status, arg_max(checked_at, run) AS checked_at FROM v_run WHERE deadline_status = '모집중' AND grade <> 'D' GROUP BY url),
v_seen AS (SELECT DISTINCT url AS key FROM v_run WHERE grade = 'D'),
v_now AS (SELECT *, run AS seq FROM v_run WHERE deadline_status = '긴급')
"""


def _state(spark, sf_dir):
    rows = _runs(spark, sf_dir).where("deadline_status = '모집중' AND grade <> 'D'").withColumn("seq", F.col("run"))
    nothing = rows.select("url", *changes.STATE_FIELDS).limit(0)
    return changes.update_notice_state(nothing, rows)


def _seen(spark, sf_dir):
    return _runs(spark, sf_dir).where("grade = 'D'").select(F.col("url").alias("key")).distinct()


def _now(spark, sf_dir):
    return _runs(spark, sf_dir).where("deadline_status = '긴급'").withColumn("seq", F.col("run"))


@query(
    "marked_changes",
    t.with_sql(
        f"""SELECT i.url, i.seq, s.key IS NULL AS is_new, {_kind_sql("p", "s.key IS NOT NULL")} AS change_type, coalesce(p.grade, '') AS previous_grade
        FROM v_now i LEFT JOIN v_state p ON p.url = i.url LEFT JOIN v_seen s ON s.key = i.url""",
        STATE_SQL,
    ),
)
def marked_changes(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    rows = changes.mark_is_new(_now(spark, sf_dir), seen)
    marked = changes.mark_changes(rows, _state(spark, sf_dir), seen)
    return marked.select("url", "seq", "is_new", "change_type", "previous_grade")


@query(
    "notice_state_upsert",
    t.with_sql(
        """SELECT url, arg_max(content_fingerprint, o) AS content_fingerprint, arg_max(grade, o) AS grade, arg_max(deadline_status, o) AS deadline_status,
        arg_max(checked_at, o) AS checked_at FROM (SELECT url, content_fingerprint, grade, deadline_status, checked_at, -1 AS o FROM v_state
          UNION ALL SELECT url, content_fingerprint, grade, deadline_status, checked_at, seq FROM v_now) GROUP BY url""",
        STATE_SQL,
    ),
)
def notice_state_upsert(spark, sf_dir):
    return changes.update_notice_state(_state(spark, sf_dir), _now(spark, sf_dir))


@query(
    "seen_union",
    t.with_sql(
        """SELECT key FROM v_seen UNION SELECT url FROM v_now WHERE grade = 'C' UNION SELECT url FROM v_now WHERE grade = 'A'""",
        STATE_SQL,
    ),
)
def seen_union(spark, sf_dir):
    now = _now(spark, sf_dir)
    known = changes.seen_keys(_seen(spark, sf_dir), now)
    return changes.update_seen(known, now.where("grade = 'A'"))


@query(
    "bootstrap_coverage",
    t.with_sql(
        """SELECT count(*) FILTER (url NOT IN (SELECT key FROM v_seen)) AS missing_seen,
        count(*) FILTER (url NOT IN (SELECT url FROM v_state)) AS missing_state FROM (SELECT DISTINCT url FROM v_now)""",
        STATE_SQL,
    ),
)
def bootstrap_coverage(spark, sf_dir):
    return changes.coverage_gaps(_now(spark, sf_dir), _seen(spark, sf_dir), _state(spark, sf_dir))


_SENT_SQL = f"v_sent AS (SELECT * FROM v_item WHERE {t.TARGET_SQL} AND grade = 'B')"


def _sent(spark, sf_dir):
    from pagewatch.functions import rules

    items = t.items(spark, sf_dir)
    c = F.col
    target = rules.is_alert_target(
        c("change_type"), c("is_new"), c("grade"), c("deadline_status"), c("notice_date"), t.as_of()
    )
    return items, items.where(target & (c("grade") == "B"))


@query(
    "rows_to_mark_seen",
    t.with_sql(
        f"""SELECT seq, url FROM v_sent UNION ALL
        SELECT min(seq), url FROM v_item WHERE is_new AND url <> '' AND (grade = 'C' OR {t.stale_sql()}) AND url NOT IN (SELECT url FROM v_sent) GROUP BY url""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL, _SENT_SQL,
    ),
)
def rows_to_mark_seen(spark, sf_dir):
    items, sent = _sent(spark, sf_dir)
    return changes.items_to_mark_seen(items, sent, t.as_of()).select("seq", "url")


_SETTLED = f"NOT ({t.TARGET_SQL} AND url NOT IN (SELECT url FROM v_sent)) AND url <> ''"


@query(
    "run_end",
    t.with_sql(
        f"""SELECT 'target' AS part, url, grade, count(*) AS n FROM v_item WHERE {t.TARGET_SQL} GROUP BY url, grade
        UNION ALL SELECT 'result', url, grade, count(*) FROM v_item WHERE grade IN ('A', 'B', 'C') GROUP BY url, grade
        UNION ALL SELECT 'state', url, arg_max(grade, seq), 1 FROM v_item WHERE {_SETTLED} GROUP BY url
        UNION ALL SELECT DISTINCT 'state', url, 'before', 1 FROM v_item WHERE seq % 7 = 0 AND url NOT IN (SELECT url FROM v_item WHERE {_SETTLED})
        UNION ALL SELECT DISTINCT 'seen', url, '', 1 FROM (SELECT url FROM v_sent UNION ALL SELECT url FROM v_item WHERE seq % 7 = 0 UNION ALL
          SELECT url FROM v_item WHERE is_new AND url <> '' AND (grade = 'C' OR {t.stale_sql()}))
        UNION ALL SELECT DISTINCT 'history', url, CASE WHEN url IN (SELECT url FROM v_item WHERE registration_score >= 40 AND grade <> 'D') THEN '' ELSE 'before' END, 1
          FROM v_item WHERE (registration_score >= 40 AND grade <> 'D') OR seq % 7 = 0
        UNION ALL SELECT 'preview', url, grade, 1 FROM (SELECT url, grade FROM v_item WHERE grade IN ('A', 'B') AND {t.CHANGED_SQL} AND {t.recent_sql()} ORDER BY grade, seq LIMIT 5)
        UNION ALL SELECT 'summary', 'sent', '', (SELECT count(*) FROM v_sent)
        UNION ALL SELECT 'summary', 'public', '', count(*) FILTER (grade <> 'D') FROM v_item WHERE grade IN ('A', 'B', 'C')
        UNION ALL SELECT 'summary', 'crawled', '', count(*) FROM v_item""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL, _SENT_SQL,
    ),
)
def run_end(spark, sf_dir):
    """The end of a run from earlier state, with results from grade C up, in which only grade B rows could be sent."""
    made = {"region": F.lit(""), "source_type": F.lit("board"), "checked_at": F.lit(t.CHECKED_AT)}
    items = stored(t.items(spark, sf_dir).withColumns(made))
    earlier = items.where("seq % 7 = 0").dropDuplicates(["url"])
    fields = {f.name: F.col(f.name) if f.name in earlier.columns else F.lit("") for f in schemas.HISTORY}
    end = course_watch.finish(
        items,
        history=earlier.select(*[c.alias(n) for n, c in (fields | {"semester": F.lit("before")}).items()]),
        state=earlier.select(*[(F.lit("before") if f.name == "grade" else F.col(f.name)).alias(f.name) for f in schemas.NOTICE_STATE]),
        seen=earlier.select(F.col("url").alias("key")), as_of=t.as_of(), checked_at=F.lit(t.CHECKED_AT),
        deliver=lambda rows: rows.where("grade = 'B'"), at_least="C", facts={"crawled_count": items.count()},
    )
    one, none = F.lit(1).cast("bigint").alias("n"), F.lit("")
    counted = lambda part, rows: rows.groupBy("url", "grade").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "url", "grade", "n")
    out = counted("target", end.targets).unionAll(counted("result", end.results))
    out = out.unionAll(end.state.select(F.lit("state"), "url", "grade", one)).unionAll(end.seen.select(F.lit("seen"), F.col("key"), none, one))
    out = out.unionAll(end.history.select(F.lit("history"), "url", F.when(F.col("semester") == "before", "before").otherwise(""), one))
    shown = end.summary.select(F.explode("preview_items").alias("i")).select(F.lit("preview"), "i.url", "i.grade", one)
    numbers = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("n")) for k, c in (("sent", "sent_count"), ("public", "public_count"), ("crawled", "crawled_count"))]))
    return out.unionAll(shown).unionAll(end.summary.select(numbers.alias("x")).select(F.lit("summary"), "x.k", none, "x.n"))


@query(
    "rows_for_notice_state",
    t.with_sql(
        f"SELECT seq, url FROM v_item WHERE NOT ({t.TARGET_SQL} AND url NOT IN (SELECT url FROM v_sent))",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL, _SENT_SQL,
    ),
)
def rows_for_notice_state(spark, sf_dir):
    items, sent = _sent(spark, sf_dir)
    return changes.items_to_update_state(items, sent, t.as_of()).select("seq", "url")


@query(
    "graduate_newness",
    t.with_sql(
        f"""SELECT i.seq, CASE WHEN i.fp IN (SELECT key FROM k) THEN false WHEN i.url = '' OR i.url NOT IN (SELECT key FROM k) THEN true
          WHEN p.fp IS NULL THEN false ELSE p.fp <> i.fp END AS is_new
        FROM f i LEFT JOIN (SELECT url, arg_max(old, seq) AS fp FROM f WHERE url <> '' AND grade <> 'B' GROUP BY url) p ON p.url = i.url""",
        t.NOTICES_SQL, t.SCORED_SQL,
        f"""f AS (SELECT seq, url, grade, {GRADUATE_PRINT_SQL} AS fp,
             {GRADUATE_PRINT_SQL.replace("notice_date", "CASE WHEN seq % 2 = 0 THEN notice_date ELSE 'x' END")} AS old FROM v_graded),
        k AS (SELECT fp AS key FROM f WHERE grade = 'A' UNION SELECT url FROM f WHERE grade <> 'D')""",
    ),
)
def graduate_newness(spark, sf_dir):
    from pagewatch.operators.dedupe import item_fingerprint

    rows = stored(t.graded(spark, sf_dir).drop("body_text"))
    old_date = F.when(F.col("seq") % 2 == 0, F.col("notice_date")).otherwise("x")
    before = rows.where("grade <> 'B'").withColumn("notice_date", old_date)
    seen = (
        rows.where("grade = 'A'").select(item_fingerprint(rows).alias("key"))
        .union(rows.where("grade <> 'D'").select("url"))
        .distinct()
    )
    return changes.mark_graduate_new(rows, seen, before).select("seq", "is_new")


# ------------------------------------------------------------ page state
PAGE_STATE_SQL = """
v_fetch AS (SELECT 'https://c.example.com/' || conv_id::VARCHAR AS url, turn AS seq, 'e' || turn::VARCHAR AS etag,
   CASE WHEN turn % 2 = 0 THEN 'm' || turn::VARCHAR ELSE '' END AS last_modified, text AS content,
   strftime(DATE '2026-06-01' + turn::INT, '%Y-%m-%d') AS checked_at,
   CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN NULL ELSE repeat('x', 500001) END AS html,
   CASE WHEN turn % 2 = 1 THEN role END AS extracted_text FROM conversations),
v_update AS (SELECT url, seq, etag, last_modified, sha256(content) AS content_hash, checked_at,
   html, extracted_text FROM v_fetch),
v_pages AS (SELECT url, arg_max(etag, seq) AS etag, arg_max(last_modified, seq) AS last_modified, arg_max(content_hash, seq) AS content_hash,
   arg_max(checked_at, seq) AS checked_at, arg_max(html, seq) FILTER (html IS NOT NULL) AS html,
   arg_max(extracted_text, seq) FILTER (extracted_text IS NOT NULL) AS extracted_text FROM v_update GROUP BY url)
"""


def _fetched(spark, sf_dir):
    turn = F.col("turn")
    return t.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("https://c.example.com/"), F.col("conv_id").cast("string")).alias("url"),
        turn.alias("seq"),
        F.concat(F.lit("e"), turn.cast("string")).alias("etag"),
        F.when(turn % 2 == 0, F.concat(F.lit("m"), turn.cast("string"))).otherwise("").alias("last_modified"),
        F.col("text").alias("content"),
        F.date_format(F.date_add(F.lit("2026-06-01").cast("date"), turn.cast("int")), "yyyy-MM-dd").alias("checked_at"),
        F.when(turn % 3 == 0, F.col("text")).when(turn % 3 == 2, F.repeat(F.lit("x"), 500_001)).alias("html"),
        F.when(turn % 2 == 1, F.col("role")).alias("extracted_text"),
    )


def _page_state(spark, sf_dir):
    updates = page_state.page_updates(_fetched(spark, sf_dir))
    first, later = updates.where("seq < 2"), updates.where("seq >= 2")
    nothing = first.drop("seq").limit(0)
    return page_state.update_page_state(stored(page_state.update_page_state(nothing, first), long_values=True), later)


@query(
    "page_state_upsert",
    t.with_sql("SELECT url, etag, last_modified, content_hash, checked_at, html, extracted_text FROM v_pages", PAGE_STATE_SQL),
)
def page_state_upsert(spark, sf_dir):
    return _page_state(spark, sf_dir)


@query(
    "page_reuse",
    t.with_sql(
        """SELECT f.url, f.seq, coalesce(p.content_hash = sha256(f.content), false) AS unchanged,
        CASE WHEN p.content_hash = sha256(f.content) THEN coalesce(p.html, '') END AS cached,
        nullif(p.etag, '') AS if_none_match, nullif(p.last_modified, '') AS if_modified_since
        FROM v_fetch f LEFT JOIN v_pages p ON p.url = f.url""",
        PAGE_STATE_SQL,
    ),
)
def page_reuse(spark, sf_dir):
    state = stored(_page_state(spark, sf_dir), long_values=True)
    rows = page_state.with_page_reuse(_fetched(spark, sf_dir).select("url", "seq", "content"), state)
    rows = rows.join(page_state.conditional_headers(state).hint("shuffle_hash"), "url", "left")
    return rows.select("url", "seq", "unchanged", "cached", "if_none_match", "if_modified_since")


def _page_store(spark, sf_dir) -> page_store.PageStore:
    store = page_store.PageStore(spark, f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}", buckets=8)
    fetched = _fetched(spark, sf_dir)
    for number, part in enumerate((fetched.where("seq < 2"), fetched.where("seq >= 2"))):
        store.update(part, number)
    return store


@query(
    "page_store_rows",
    t.with_sql("SELECT url, etag, last_modified, content_hash, checked_at, html, extracted_text FROM v_pages", PAGE_STATE_SQL),
)
def page_store_rows(spark, sf_dir):
    """The rows of ``page_state_upsert`` from two runs over a store that holds every content once."""
    return _page_store(spark, sf_dir).states()


@query(
    "page_store_reuse",
    t.with_sql(
        """SELECT f.url, f.seq, coalesce(p.content_hash = sha256(f.content), false) AS unchanged,
        CASE WHEN p.content_hash = sha256(f.content) THEN coalesce(p.html, '') END AS cached
        FROM v_fetch f LEFT JOIN v_pages p ON p.url = f.url""",
        PAGE_STATE_SQL,
    ),
)
def page_store_reuse(spark, sf_dir):
    rows = page_store.with_page_reuse(_fetched(spark, sf_dir).select("url", "seq", "content"), _page_store(spark, sf_dir))
    return rows.select("url", "seq", "unchanged", "cached")


_KEPT_PAGES = 50


@query(
    "page_store_contents",
    t.with_sql(
        f"""SELECT sha256(value) AS key, length(value) AS n_chars FROM (
          SELECT unnest([html, extracted_text]) AS value FROM (SELECT * FROM v_pages ORDER BY checked_at DESC, url LIMIT {_KEPT_PAGES}))
        WHERE value IS NOT NULL GROUP BY value""",
        PAGE_STATE_SQL,
    ),
)
def page_store_contents(spark, sf_dir):
    """What a store holds after pruning: the contents of the states checked last, each once."""
    store = _page_store(spark, sf_dir)
    store.prune(2, keep=_KEPT_PAGES, dead_share=0.0)
    return store.contents().select("key", F.length("value").alias("n_chars"))


@query(
    "recent_page_states",
    """SELECT key AS url, checked_at FROM (SELECT 'https://o.example.com/' || o_orderkey::VARCHAR AS key,
       strftime(o_orderdate, '%Y-%m-%d') AS checked_at FROM orders) ORDER BY checked_at DESC, url LIMIT 1000""",
)
def recent_page_states(spark, sf_dir):
    states = t.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://o.example.com/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("checked_at"),
    )
    return page_state.most_recent(states)


# -------------------------------------------------------------- delivery
def _sql_events(per_day: bool) -> str:
    key = "user_id::VARCHAR || ' ' || strftime(ts, '%Y-%m-%d')" if per_day else "(user_id % 3)::VARCHAR"
    return f"""
v_event AS (SELECT sha256('chat' || chr(10) || {key}) AS delivery_id, ts, event_id, {key} AS logical_key,
   CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'begin' WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'failure' ELSE 'resolve' END AS event,
   CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN CASE WHEN value > 20 THEN 'failed' ELSE 'uncertain' END
     WHEN 'signup' THEN CASE WHEN value > 60 THEN 'delivered' ELSE 'failed' END END AS status,
   'message  ' || props AS message, CASE WHEN event_type = 'purchase' THEN 'm' || event_id::VARCHAR END AS message_id,
   CASE WHEN event_type = 'error' THEN 'Timeout' || (event_id % 3)::VARCHAR END AS error_type FROM events)
"""


def _events(spark, sf_dir, per_day: bool):
    return event_columns(t.table(spark, sf_dir, "events"), per_day)


def event_columns(e, per_day: bool):
    """events as a delivery log: an id per user and day, or three ids that share all events."""
    kind = F.col("event_type")
    user = F.col("user_id")
    key = (
        F.concat(user.cast("string"), F.lit(" "), F.date_format("ts", "yyyy-MM-dd"))
        if per_day
        else (user % 3).cast("string")
    )
    event = (
        F.when(kind.isin("view", "click"), "begin").when(kind == "purchase", "confirm").when(kind == "error", "failure")
        .otherwise("resolve")
    )
    status = (
        F.when(kind == "purchase", "delivered")
        .when(kind == "error", F.when(F.col("value") > 20, "failed").otherwise("uncertain"))
        .when(kind == "signup", F.when(F.col("value") > 60, "delivered").otherwise("failed"))
    )
    return e.select(
        hashing.delivery_id(F.lit("chat"), key).alias("delivery_id"),
        event.alias("event"),
        status.alias("status"),
        key.alias("logical_key"),
        F.concat(F.lit("message  "), "props").alias("message"),
        F.when(kind == "purchase", F.concat(F.lit("m"), F.col("event_id").cast("string"))).alias("message_id"),
        F.when(kind == "error", F.concat(F.lit("Timeout"), (F.col("event_id") % 3).cast("string"))).alias("error_type"),
        "ts",
        "event_id",
    )




def _outcome_sql(per_day: bool) -> str:
    """A recursive walk over each id's events, one event per step."""
    return f"""{_sql_events(per_day).strip()},
v_num AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY ts, event_id) AS n FROM v_event),
v_walk AS (
  SELECT delivery_id, 0::BIGINT AS n, ''::VARCHAR AS after, NULL::VARCHAR AS outcome, ''::VARCHAR AS status_before, NULL::BIGINT AS event_id FROM v_num WHERE n = 1
  UNION ALL
  SELECT e.delivery_id, e.n,
    CASE WHEN e.event = 'resolve' AND w.after = '' THEN w.after WHEN e.event <> 'begin' THEN e.status
         WHEN w.after IN ('delivered', 'sending', 'uncertain') THEN w.after ELSE 'sending' END,
    CASE WHEN e.event = 'resolve' AND w.after = '' THEN 'unknown' WHEN e.event <> 'begin' THEN 'applied' WHEN w.after = 'delivered' THEN 'skipped'
         WHEN w.after IN ('sending', 'uncertain') THEN 'blocked' ELSE 'accepted' END,
    w.after, e.event_id
  FROM v_walk w JOIN v_num e ON e.delivery_id = w.delivery_id AND e.n = w.n + 1),
v_marked AS (SELECT e.*, w.outcome, w.status_before, CASE WHEN w.outcome = 'accepted' THEN 'sending' ELSE e.status END AS becomes FROM v_event e JOIN v_walk w USING (event_id)),
v_begun AS (SELECT delivery_id, max((ts, event_id)) AS b FROM v_marked WHERE outcome = 'accepted' GROUP BY delivery_id),
v_state AS (SELECT m.delivery_id,
   arg_max(becomes, (ts, event_id)) FILTER (outcome IN ('accepted', 'applied')) AS status,
   count(*) FILTER (outcome = 'accepted') AS attempt_count,
   coalesce(arg_max(logical_key, (ts, event_id)) FILTER (outcome = 'accepted'), '') AS logical_key,
   coalesce(arg_max(left({t.ns("message")}, 240), (ts, event_id)) FILTER (outcome = 'accepted'), '') AS message_preview,
   strftime(max(ts) FILTER (outcome IN ('accepted', 'applied')), '%Y-%m-%dT%H:%M:%S+00:00') AS updated_at,
   arg_max(message_id, (ts, event_id)) FILTER (event = 'confirm' AND (b IS NULL OR (ts, event_id) > b)) AS message_id,
   arg_max(error_type, (ts, event_id)) FILTER (event = 'failure' AND (b IS NULL OR (ts, event_id) > b)) AS error_type,
   strftime(max(ts) FILTER (event = 'resolve' AND outcome = 'applied' AND (b IS NULL OR (ts, event_id) > b)), '%Y-%m-%dT%H:%M:%S+00:00') AS resolved_at
   FROM v_marked m LEFT JOIN v_begun USING (delivery_id) GROUP BY m.delivery_id HAVING count(*) FILTER (outcome IN ('accepted', 'applied')) > 0)
"""


def _recursive(body: str, per_day: bool) -> str:
    return t.with_sql(body, _outcome_sql(per_day)).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "delivery_outcomes", _recursive("SELECT event_id, delivery_id, event, status_before, outcome FROM v_marked", True)
)
def delivery_outcomes(spark, sf_dir):
    return outbox.delivery_outcomes(_events(spark, sf_dir, True)).select(
        "event_id", "delivery_id", "event", "status_before", "outcome"
    )


DELIVERY_SQL, HOT_DELIVERY_SQL = (_recursive("SELECT * FROM v_state", per_day) for per_day in (True, False))


@query("delivery_state", DELIVERY_SQL)
def delivery_state(spark, sf_dir):
    return outbox.delivery_state(_events(spark, sf_dir, True))


@query("delivery_state_of_hot_ids", HOT_DELIVERY_SQL)
def delivery_state_of_hot_ids(spark, sf_dir):
    """Three ids share all events: a third of the table each."""
    return outbox.delivery_state(_events(spark, sf_dir, False))


@query(
    "unresolved_deliveries",
    _recursive(
        "SELECT delivery_id, status, logical_key, message_preview, updated_at FROM v_state WHERE status IN ('sending', 'uncertain')",
        True,
    ),
)
def unresolved_deliveries(spark, sf_dir):
    return outbox.unresolved(outbox.delivery_state(_events(spark, sf_dir, True)))


@query(
    "pruned_deliveries",
    _recursive(
        """SELECT delivery_id, status FROM v_state WHERE status <> 'delivered' UNION ALL
        SELECT * FROM (SELECT delivery_id, status FROM v_state WHERE status = 'delivered' ORDER BY updated_at DESC, delivery_id DESC LIMIT 50)""",
        True,
    ),
)
def pruned_deliveries(spark, sf_dir):
    state = outbox.delivery_state(_events(spark, sf_dir, True))
    return outbox.prune_delivered(state, keep=50).select("delivery_id", "status")


@query(
    "state_violations",
    _recursive(
        """SELECT delivery_id, CASE WHEN attempt_count < 1 THEN 'invalid attempt count' ELSE 'invalid id' END AS violation FROM (
          SELECT CASE WHEN status = 'failed' THEN 'x' ELSE '' END || delivery_id AS delivery_id, attempt_count, status FROM v_state)
        WHERE attempt_count < 1 OR status = 'failed'""".replace(
            "CASE WHEN attempt_count < 1 THEN 'invalid attempt count' ELSE 'invalid id' END",
            "CASE WHEN status = 'failed' THEN 'invalid id' ELSE 'invalid attempt count' END",
        ),
        True,
    ),
)
def state_violations(spark, sf_dir):
    state = outbox.delivery_state(_events(spark, sf_dir, True))
    marked = F.when(F.col("status") == "failed", F.concat(F.lit("x"), "delivery_id")).otherwise(F.col("delivery_id"))
    return outbox.violations(state.withColumn("delivery_id", marked)).select("delivery_id", "violation")


_ERRORS = ("ConnectTimeout", "HTTPError", "ConnectionError", "Timeout", "ProxyError")


@query(
    "failure_triage",
    """SELECT event_id, CASE WHEN k = 0 THEN 'failed' WHEN k = 1 AND code BETWEEN 400 AND 499 THEN 'failed'
      WHEN k IN (2, 4) AND event_id % 2 = 0 THEN 'failed' ELSE 'uncertain' END AS status
    FROM (SELECT event_id, event_id % 5 AS k, 350 + user_id % 200 AS code FROM events)""",
)
def failure_triage(spark, sf_dir):
    key = F.col("event_id")
    error = F.lit(None).cast("string")
    for number, name in enumerate(_ERRORS):
        error = F.when(key % 5 == number, name).otherwise(error)
    text = F.when(key % 2 == 0, "Failed: Connection Refused by peer").otherwise("reset by peer")
    status = outbox.failure_status(error, F.lit(350) + F.col("user_id") % 200, text)
    return t.table(spark, sf_dir, "events").select("event_id", status.alias("status"))


# ---------------------------------------------------------------- health
HEALTH_SQL = f"""
{t.BOARDS_SQL.strip()},
{t.UNIVERSITIES_SQL.strip()},
v_known AS (SELECT b.*, NOT (coalesce(enabled, true) AND university_name IN (SELECT name FROM v_university)) AS skipped,
   CASE WHEN board_idx % 13 = 5 THEN 'timeout' || chr(10) || 'trace' ELSE '' END AS error FROM v_board b),
v_detail AS (SELECT l_suppkey AS board_idx, l_orderkey * 10 + l_linenumber AS seq, 'https://d.example.com/' || l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR || '/' || l_partkey::VARCHAR AS url,
   l_returnflag <> 'R' AND l_suppkey % 8 <> 1 AS succeeded FROM lineitem),
v_outcome AS (SELECT k.*, coalesce(n, 0) AS details_total, coalesce(bad, 0) AS details_failed,
   CASE WHEN skipped THEN 'skipped' WHEN error <> '' OR (coalesce(n, 0) > 0 AND n = bad) THEN 'failed' ELSE 'succeeded' END AS outcome,
   CASE WHEN error = '' AND coalesce(n, 0) > 0 AND n = bad THEN 'All ' || n::VARCHAR || ' detail pages failed.' ELSE error END AS message
   FROM v_known k LEFT JOIN (SELECT board_idx, count(*) AS n, count(*) FILTER (NOT succeeded) AS bad FROM v_detail GROUP BY 1) d USING (board_idx))
"""


def _outcomes(spark, sf_dir):
    boards = mark_skipped(t.boards(spark, sf_dir), t.universities(spark, sf_dir)).withColumn(
        "error", F.when(F.col("board_idx") % 13 == 5, "timeout\ntrace").otherwise("")
    )
    line = t.table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    details = line.select(
        F.col("l_suppkey").alias("board_idx"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("https://d.example.com/"), F.concat_ws("/", s("l_orderkey"), s("l_linenumber"), s("l_partkey"))).alias("url"),
        ((F.col("l_returnflag") != "R") & (F.col("l_suppkey") % 8 != 1)).alias("succeeded"),
    )
    return health.board_outcomes(boards, details), details


@query(
    "board_outcomes",
    t.with_sql("SELECT board_idx, details_total, details_failed, outcome, message AS error FROM v_outcome", HEALTH_SQL),
)
def board_outcomes(spark, sf_dir):
    outcomes, _ = _outcomes(spark, sf_dir)
    return outcomes.select("board_idx", "details_total", "details_failed", "outcome", "error")


@query(
    "run_counters",
    t.with_sql(
        """SELECT count(*) AS boards_total, count(*) FILTER (outcome = 'succeeded') AS boards_succeeded, count(*) FILTER (outcome = 'failed') AS boards_failed,
        count(*) FILTER (outcome = 'skipped') AS boards_skipped, sum(details_total)::BIGINT AS details_total, sum(details_failed)::BIGINT AS details_failed,
        CASE WHEN count(*) FILTER (outcome IN ('succeeded', 'failed')) = 0 THEN 'ok' WHEN count(*) FILTER (outcome = 'succeeded') = 0 THEN 'all boards failed'
          WHEN count(*) FILTER (outcome = 'failed') >= count(*) FILTER (outcome = 'succeeded') THEN 'below safe majority' ELSE 'ok' END AS verdict FROM v_outcome""",
        HEALTH_SQL,
    ),
)
def run_counters(spark, sf_dir):
    outcomes, _ = _outcomes(spark, sf_dir)
    counters = health.run_counters(outcomes)
    verdict = health.health_verdict(F.col("boards_succeeded"), F.col("boards_failed"))
    return counters.withColumn("verdict", verdict)


@query(
    "failure_list",
    t.with_sql(
        """SELECT line, left_out FROM (SELECT university_name || ' / ' || board_type || ': ' || split_part(error, chr(10), 1) AS line, 0 AS left_out FROM v_bad ORDER BY kind, b, s, url LIMIT 5)
        UNION ALL SELECT NULL, count(*) - 5 FROM v_bad HAVING count(*) > 5""",
        HEALTH_SQL,
        """v_bad AS (SELECT 'board' AS kind, board_idx AS b, 0 AS s, university_name, board_type, url, message AS error FROM v_outcome WHERE outcome = 'failed'
          UNION ALL SELECT 'detail', d.board_idx, d.seq, o.university_name, o.board_type, d.url, 'HTTP 500' FROM v_detail d JOIN v_board o USING (board_idx) WHERE NOT succeeded)""",
    ),
)
def failure_list(spark, sf_dir):
    outcomes, details = _outcomes(spark, sf_dir)
    labels = t.boards(spark, sf_dir).select("board_idx", "university_name", "board_type")
    named = details.join(labels, "board_idx").withColumn("error", F.lit("HTTP 500"))
    return health.failure_list(health.failures(outcomes, named)).select("line", "left_out")


# ------------------------------------------------------------ dimensions
@query(
    "notice_places",
    t.with_sql(
        """SELECT n.seq, coalesce(u.region_name, u.region, '') AS region, coalesce(u.city, '') AS city
        FROM v_notice n LEFT JOIN v_university u ON u.name = n.university_name""",
        t.NOTICES_SQL, t.UNIVERSITIES_SQL,
    ),
)
def notice_places(spark, sf_dir):
    from pagewatch.operators.portals import with_region

    return with_region(t.notices(spark, sf_dir), t.universities(spark, sf_dir), restrict=False).select(
        "seq", "region", "city"
    )


@query(
    "active_boards",
    t.with_sql(
        """SELECT board_idx FROM v_board WHERE coalesce(enabled, true)
        AND university_name IN (SELECT name FROM v_university WHERE region = (SELECT min(r_name) FROM region))""",
        t.BOARDS_SQL, t.UNIVERSITIES_SQL,
    ),
)
def active_boards_in_region(spark, sf_dir):
    first = t.table(spark, sf_dir, "region").agg(F.min("r_name")).head()[0]
    known = in_region(t.universities(spark, sf_dir), first)
    return active_boards(t.boards(spark, sf_dir), known).select("board_idx")


@query(
    "board_activity",
    t.with_sql(
        """SELECT count(*) FILTER (coalesce(enabled, true)) AS active_count, count(*) FILTER (NOT coalesce(enabled, true)) AS disabled_count FROM v_board""",
        t.BOARDS_SQL,
    ),
)
def board_activity(spark, sf_dir):
    return reports.board_activity(t.boards(spark, sf_dir))
