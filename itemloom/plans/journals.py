"""Queries: marks, keys, verification, attempts and the answer log."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.functions import grading
from itemloom.operators import state
from itemloom.plans import bindings as B
from itemloom.plans.registry import query
from itemloom.session import work_path


@query("current_mark", f"WITH {B.CURRENT_MARK} SELECT question_id, value, marked_at FROM current_mark")
def current_mark(bank):
    return state.current_mark(bank.mark)


@query(
    "mark_counts",
    f"""WITH {B.CURRENT_MARK} SELECT v.value, count(m.question_id) AS n
    FROM (VALUES ('click'), ('view'), ('purchase')) v(value) LEFT JOIN current_mark m ON m.value = v.value GROUP BY v.value""",
)
def mark_counts(bank):
    return state.mark_counts(state.current_mark(bank.mark), B.MARKS)


@query(
    "mark_history",
    f"WITH {B.MARK} SELECT question_id, id, value, row_number() OVER (PARTITION BY question_id ORDER BY created_at, id) AS seq FROM mark",
)
def mark_history(bank):
    return state.mark_history(bank.mark).select("question_id", "id", "value", "seq")


@query(
    "append_marks_refused",
    """SELECT event_type AS value, count(*) AS n FROM events
    WHERE event_type NOT IN ('click', 'view', 'purchase', 'error') GROUP BY event_type""",
)
def append_marks_refused(bank):
    _, refused = state.append_marks(bank.mark.limit(0), bank.mark, (*B.MARKS, B.CLEARED))
    return refused.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "append_marks",
    """WITH old AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), new AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15')
    SELECT user_id AS question_id, count(*) AS n, max(event_id) AS last_id FROM (
      SELECT * FROM old UNION ALL SELECT * FROM new WHERE event_type IN ('click', 'view', 'purchase', 'error')) GROUP BY user_id""",
)
def append_marks(bank):
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    journal, _ = state.append_marks(
        bank.mark.where(F.col("created_at") < split), bank.mark.where(F.col("created_at") >= split), (*B.MARKS, B.CLEARED)
    )
    return journal.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


@query(
    "toggle_fold",
    f"""WITH {B.MARK}, s AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS idx FROM mark
      WINDOW w AS (PARTITION BY question_id ORDER BY created_at, id)),
    r AS (SELECT *, max(CASE WHEN prev IS NULL OR prev <> value THEN idx END) OVER (PARTITION BY question_id ORDER BY created_at, id) AS start FROM s)
    SELECT id, question_id, CASE WHEN (idx - start) % 2 = 0 THEN value END AS state FROM r""",
)
def toggle_fold(bank):
    return state.fold_toggles(bank.mark).select("id", "question_id", "state")


@query(
    "toggle_current_mark",
    f"""WITH {B.MARK}, s AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS idx FROM mark
      WINDOW w AS (PARTITION BY question_id ORDER BY created_at, id)),
    r AS (SELECT *, max(CASE WHEN prev IS NULL OR prev <> value THEN idx END) OVER (PARTITION BY question_id ORDER BY created_at, id) AS start FROM s)
    SELECT question_id, arg_max(coalesce(CASE WHEN (idx - start) % 2 = 0 THEN value END, 'cleared'), row(created_at, id)) AS value FROM r GROUP BY question_id""",
)
def toggle_current_mark(bank):
    folded = state.fold_toggles(bank.mark).withColumn("value", F.coalesce("state", F.lit("cleared")))
    return state.current_mark(folded).select("question_id", "value")


_IMPORT_SQL = f"""WITH {B.CURRENT_MARK}, incoming AS (SELECT c_custkey AS question_id,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'click' WHEN 'MACHINERY' THEN 'view' WHEN 'FURNITURE' THEN 'bogus' WHEN 'HOUSEHOLD' THEN '' ELSE 'purchase' END AS value FROM customer),
    fated AS (SELECT i.question_id, i.value, CASE WHEN coalesce(i.value, '') = '' THEN 'empty' WHEN i.value NOT IN ('click', 'view', 'purchase') THEN 'ignored'
      WHEN d.doc_id IS NULL THEN 'unmatched' WHEN nullif(m.value, 'error') = i.value THEN 'skipped' ELSE 'imported' END AS fate
    FROM incoming i LEFT JOIN documents d ON d.doc_id = i.question_id LEFT JOIN current_mark m ON m.question_id = i.question_id)"""


def _incoming(bank):
    seg = F.col("c_mktsegment")
    return bank.table("customer").select(
        F.col("c_custkey").alias("question_id"),
        F.when(seg == "BUILDING", "click")
        .when(seg == "MACHINERY", "view")
        .when(seg == "FURNITURE", "bogus")
        .when(seg == "HOUSEHOLD", "")
        .otherwise("purchase")
        .alias("value"),
    )


@query("marks_import", f"{_IMPORT_SQL} SELECT question_id, value, fate FROM fated")
def marks_import(bank):
    return state.classify_import(_incoming(bank), bank.question.select("id"), state.current_mark(bank.mark), B.MARKS, B.CLEARED)


@query("marks_import_counts", f"{_IMPORT_SQL} SELECT fate, count(*) AS n FROM fated GROUP BY fate")
def marks_import_counts(bank):
    return marks_import(bank).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- keys, levels

_LEVELS = """mark AS (SELECT user_id AS question_id, CASE WHEN event_type = 'signup' AND value < 3 THEN 3 WHEN event_type = 'signup' OR value <= 30 THEN 0
      WHEN event_type = 'error' THEN 4 WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'view' THEN 1 ELSE 0 END AS weight FROM events),
    question_verification AS (SELECT q.doc_id AS question_id, ['unverified', 'ai_reviewed', 'human_reviewed', 'disputed', 'known_bad'][1 + coalesce(max(weight), 0)] AS verification
      FROM documents q LEFT JOIN mark ON mark.question_id = q.doc_id GROUP BY q.doc_id)"""


def verification(bank):
    kind = F.col("event_type")
    event = bank.table("events").select(
        F.col("user_id").alias("question_id"),
        F.when(F.col("value") <= 30, "noted").when(kind == "error", "known_bad").when(kind == "purchase", "human_reviewed").when(kind == "view", "ai_reviewed").otherwise("noted").alias("level"),
    )
    dispute = bank.table("events").where(kind == "signup").select(
        F.col("user_id").alias("question_id"), F.when(F.col("value") < 3, "open").otherwise("resolved").alias("state")
    )
    return state.question_verification(bank.table("documents").select(F.col("doc_id").alias("id")), event, dispute)


@query("question_verification", f"WITH {_LEVELS} SELECT question_id, verification FROM question_verification")
def question_verification(bank):
    return verification(bank)


@query(
    "current_answer_key",
    """WITH override AS (SELECT o_orderkey AS id, o_custkey AS question_id, o_orderpriority AS correct_labels, o_orderdate AS effective_from FROM orders WHERE o_orderstatus <> 'P'),
    latest AS (SELECT question_id, arg_max(correct_labels, row(effective_from, id)) AS correct_labels, arg_max(id, row(effective_from, id)) AS id FROM override GROUP BY question_id)
    SELECT c_custkey AS question_id, coalesce(l.correct_labels, c_mktsegment) AS correct_labels, l.id AS override_id, CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS is_override
    FROM customer LEFT JOIN latest l ON l.question_id = c_custkey""",
)
def current_answer_key(bank):
    override = bank.table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("question_id"),
        F.col("o_orderpriority").alias("correct_labels"),
        F.col("o_orderdate").alias("effective_from"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("retired_at"),
    )
    question = bank.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("correct_labels"))
    return state.current_answer_key(question, override)


# ------------------------------------------------------------------ attempts


@query(
    "attempt_score",
    f"""WITH {B.ATTEMPT}, {B.ITEM} SELECT a.id AS attempt_id, certification_id, started_at, submitted_at, count(i.attempt_id) AS item_count,
    count(i.answered_at) AS answered_count, count(*) FILTER (i.is_correct) AS correct_count, coalesce(sum(i.credit), 0) AS credit_total
    FROM attempt a LEFT JOIN item i ON i.attempt_id = a.id GROUP BY ALL""",
)
def attempt_score(bank):
    return state.attempt_score(bank.attempt, bank.item)


@query(
    "first_exposure_response",
    f"""WITH {B.ATTEMPT}, {B.ITEM}, kept AS (SELECT i.* FROM item i JOIN attempt a ON a.id = i.attempt_id
      WHERE a.submitted_at IS NOT NULL AND a.abandoned_at IS NULL AND i.answered_at IS NOT NULL)
    SELECT question_id, id AS attempt_item_id, attempt_id, is_correct, credit, answered_at FROM kept
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY answered_at, id) = 1""",
)
def first_exposure_response(bank):
    return state.first_exposure_response(bank.attempt, bank.item)


@query(
    "seen_ordinal",
    f"""WITH {B.ATTEMPT}, {B.ITEM} SELECT i.id, question_id, attempt_id, row_number() OVER (PARTITION BY question_id ORDER BY started_at, attempt_id, i.id) AS seen_ordinal
    FROM item i JOIN attempt a ON a.id = i.attempt_id""",
)
def seen_ordinal(bank):
    return state.seen_ordinal(bank.attempt, bank.item).select("id", "question_id", "attempt_id", "seen_ordinal")


@query("prior_exposures", f"WITH {B.ITEM} SELECT question_id, count(*) AS exposures FROM item GROUP BY question_id")
def prior_exposures(bank):
    return state.prior_exposures(bank.item)


@query(
    "last_seen",
    f"WITH {B.ITEM} SELECT question_id, max(first_shown_at) AS last_seen_at FROM item WHERE first_shown_at IS NOT NULL GROUP BY question_id",
)
def last_seen(bank):
    return state.last_seen(bank.item)


@query(
    "attempt_progress",
    f"""WITH {B.ATTEMPT}, {B.ITEM} SELECT a.id AS attempt_id, count(i.attempt_id) AS items, count(i.answered_at) AS answered,
    count(i.attempt_id) - count(i.answered_at) AS unanswered, count(i.attempt_id) = count(i.answered_at) AS complete,
    coalesce(min(i.position) FILTER (i.answered_at IS NULL), 0) AS first_unanswered
    FROM attempt a LEFT JOIN item i ON i.attempt_id = a.id GROUP BY a.id""",
)
def attempt_progress(bank):
    return state.attempt_progress(bank.attempt, bank.item)


@query(
    "open_attempt_predicate",
    f"WITH {B.ATTEMPT} SELECT certification_id, submitted_at IS NULL AND abandoned_at IS NULL AS open, count(*) AS n FROM attempt GROUP BY ALL",
)
def open_attempt_predicate(bank):
    return bank.attempt.withColumn("open", state.is_open()).groupBy("certification_id", "open").agg(F.count(F.lit(1)).alias("n"))


@query(
    "open_attempt_latest",
    f"""WITH {B.ATTEMPT} SELECT certification_id, id AS attempt_id, started_at FROM attempt WHERE submitted_at IS NULL AND abandoned_at IS NULL
    QUALIFY row_number() OVER (PARTITION BY certification_id ORDER BY started_at DESC, id DESC) = 1""",
)
def open_attempt_latest(bank):
    return state.open_attempt(bank.attempt)


@query(
    "recent_finished_attempts",
    f"WITH {B.ATTEMPT} SELECT id, certification_id, submitted_at FROM attempt WHERE submitted_at IS NOT NULL ORDER BY submitted_at DESC, id DESC LIMIT 20",
)
def recent_finished_attempts(bank):
    return state.recent_finished(bank.attempt).select("id", "certification_id", "submitted_at")


@query(
    "questions_blocked_by_open_attempt",
    f"""WITH {B.ATTEMPT}, {B.ITEM} SELECT DISTINCT question_id FROM item WHERE attempt_id IN
    (SELECT id FROM attempt WHERE submitted_at IS NULL AND abandoned_at IS NULL)""",
)
def questions_blocked_by_open_attempt(bank):
    return state.questions_in_open_attempts(bank.attempt, bank.item)


@query(
    "attempt_lifecycle",
    """WITH closing AS (SELECT l_orderkey AS attempt_id, CASE WHEN l_returnflag = 'A' THEN 'abandon' ELSE 'submit' END AS action, l_shipdate AS "at" FROM lineitem),
    firsts AS (SELECT attempt_id, arg_min(action, row("at", action)) AS action, min("at") AS "at", count(*) - 1 AS refused FROM closing GROUP BY attempt_id)
    SELECT o_orderkey AS attempt_id, CASE action WHEN 'submit' THEN 'submitted' WHEN 'abandon' THEN 'abandoned' ELSE 'open' END AS state,
      CASE WHEN action = 'submit' THEN "at" END AS submitted_at, CASE WHEN action = 'abandon' THEN "at" END AS abandoned_at,
      (epoch_us("at") - epoch_us(o_orderdate)) // 1000 AS elapsed_ms, coalesce(refused, 0) AS refused
    FROM orders LEFT JOIN firsts ON attempt_id = o_orderkey""",
)
def attempt_lifecycle(bank):
    closings = bank.table("lineitem").select(
        F.col("l_orderkey").alias("attempt_id"),
        F.when(F.col("l_returnflag") == "A", "abandon").otherwise("submit").alias("action"),
        F.col("l_shipdate").alias("at"),
    )
    return state.lifecycle(bank.attempt, closings)


@query(
    "remaining_seconds",
    """SELECT o_orderkey AS attempt_id, greatest(0, ceil((o_custkey % 7 + 1) * 86400 * 300 - (epoch_us(TIMESTAMP '1997-06-01') - epoch_us(o_orderdate)) / 1e6))::BIGINT AS remaining
    FROM orders WHERE o_orderstatus = 'O'""",
)
def remaining_seconds(bank):
    limit = (F.col("o_custkey") % 7 + 1) * 86400 * 300
    return bank.table("orders").where(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("attempt_id"),
        grading.remaining_seconds(limit, F.col("o_orderdate").cast("timestamp"), F.lit("1997-06-01").cast("timestamp")).alias("remaining"),
    )


# ---------------------------------------------------------------- answer log

_LOG = """log AS (SELECT user_id AS attempt_id, (event_id % 5)::INT AS position, ts AS "at", event_id AS id,
      CASE WHEN event_type = 'view' THEN 'show' ELSE 'answer' END AS kind, event_type AS selection, (floor(value) - 20)::BIGINT AS time_ms FROM events),
    closed AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2024-01-20' END AS closed_at FROM customer),
    kept AS (SELECT log.* FROM log JOIN closed ON closed.id = attempt_id WHERE closed_at IS NULL OR "at" <= closed_at)"""


def _answer_events(events):
    return events.select(
        F.col("user_id").alias("attempt_id"),
        (F.col("event_id") % 5).cast("int").alias("position"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "view", "show").otherwise("answer").alias("kind"),
        F.col("event_type").alias("selection"),
        (F.floor("value") - 20).cast("bigint").alias("time_ms"),
    )


def _closings(bank):
    return bank.table("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 5000, F.lit("2024-01-20").cast("timestamp_ntz")).alias("closed_at"),
    )


def _log(bank):
    return _answer_events(bank.table("events")), _closings(bank)


_JUDGED = _LOG.replace("kept AS (", "judged AS (SELECT log.*, CASE WHEN closed.id IS NULL THEN 'unknown attempt' WHEN kind = 'answer' AND \"at\" > closed_at THEN 'closed' END AS reason FROM log LEFT JOIN closed ON closed.id = attempt_id),\n    before_close AS (") + ",\n    kept AS (SELECT * FROM judged WHERE reason IS NULL)"


_STATE = f"""WITH {_JUDGED}, answers AS (SELECT *, lag(selection) OVER (PARTITION BY attempt_id, position ORDER BY "at", id) AS prev FROM kept WHERE kind = 'answer'),
  folded AS (SELECT attempt_id, position, arg_max(selection, row("at", id)) AS selection, max("at") AS answered_at, sum(greatest(0, time_ms))::BIGINT AS time_ms,
    count(*) FILTER (prev IS NOT NULL AND prev <> selection) AS change_count FROM answers GROUP BY ALL),
  shown AS (SELECT attempt_id, position, min("at") AS first_shown_at FROM kept GROUP BY ALL)
  SELECT s.attempt_id, s.position, selection, answered_at, first_shown_at, coalesce(time_ms, 0) AS time_ms, coalesce(change_count, 0) AS change_count
  FROM shown s LEFT JOIN folded f ON f.attempt_id = s.attempt_id AND f.position = s.position"""


@query("answer_log_fold", _STATE)
@query("answer_log_state", _STATE)
def answer_log_state(bank):
    return state.fold_answers(*_log(bank))


_REFUSED = f"WITH {_JUDGED} SELECT attempt_id, position, \"at\", id, kind, selection, time_ms, reason FROM judged WHERE reason IS NOT NULL"


@query("answer_log_refused", _REFUSED)
def answer_log_refused(bank):
    return state.refused_answers(*_log(bank))


@query(
    "answer_normalisation",
    f"""WITH {B.GRADED_ITEM}, c AS (SELECT id, option_labels, list_distinct(['E'] || list_reverse(selected_labels)) AS chosen FROM graded_item)
    SELECT id, array_to_string(list_filter(option_labels, lambda x: list_contains(chosen, x)), ',') AS kept,
      array_to_string(list_filter(['E'], lambda x: NOT list_contains(option_labels, x)), ',') AS unknown FROM c""",
)
def answer_normalisation(bank):
    chosen = F.array_distinct(F.concat(F.array(F.lit("E")), F.reverse("selected_labels")))
    return bank.graded_item.select(
        "id", state.normalise_answer(F.col("option_labels"), chosen).alias("n")
    ).select("id", F.array_join("n.kept", ",").alias("kept"), F.array_join("n.unknown", ",").alias("unknown"))


@query(
    "stream_current_mark",
    f"WITH {B.CURRENT_MARK} SELECT question_id, value, marked_at FROM current_mark",
)
def stream_current_mark(bank):
    """The events table read as a stream of files and folded batch by batch."""
    from itemloom.streaming import journal

    base = work_path(bank.spark, "stream")
    events = journal.read_events(bank.spark, f"{bank.sf_dir}/event[s].parquet", bank.table("events").schema)
    marks = events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("question_id"), F.col("event_type").alias("value"), F.col("ts").alias("created_at")
    )
    running = journal.maintain_current_marks(marks, f"{base}/state", f"{base}/checkpoint")
    running.awaitTermination()
    return journal.read_state(bank.spark, f"{base}/state").select("question_id", "value", F.col("created_at").alias("marked_at"))


def _streamed_log(bank) -> str:
    """The events table through the stateful stream, as a backlog that may stand in any order."""
    from itemloom.streaming import answers, journal

    base = work_path(bank.spark, "answers")
    events = journal.read_events(bank.spark, f"{bank.sf_dir}/event[s].parquet", bank.table("events").schema)
    running = answers.maintain_answer_log(_answer_events(events), _closings(bank), f"{base}/log", f"{base}/checkpoint", delay="36500 days")
    running.awaitTermination()
    return f"{base}/log"


@query("stream_answer_log", _STATE)
def stream_answer_log(bank):
    from itemloom.streaming import answers

    return answers.item_state(bank.spark, _streamed_log(bank))


@query("stream_answer_log_refused", _REFUSED)
def stream_answer_log_refused(bank):
    from itemloom.streaming import answers

    return answers.refused_events(bank.spark, _streamed_log(bank))
