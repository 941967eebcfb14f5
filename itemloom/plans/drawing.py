"""Queries: blueprint weights, apportionment and exam draws over the part table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from itemloom.operators import blueprint as W
from itemloom.operators import sampling as D
from itemloom.operators import state
from itemloom.plans import bindings as B
from itemloom.plans import journals
from itemloom.plans.registry import query

NOW = datetime(2001, 7, 1)

# Questions are parts; a certification is a part type, a domain a brand inside it.
_QUESTION = """question AS (SELECT p_partkey AS id, p_type AS certification_id, CASE WHEN p_size <> 13 THEN p_type || '/' || p_brand END AS domain_id, p_brand AS label, p_size FROM part)"""
_DOMAIN = """domain AS (SELECT domain_id AS id, certification_id, min(label) AS label, count(*) AS question_count, sum(p_size) AS size FROM question WHERE domain_id IS NOT NULL GROUP BY 1, 2)"""
_BLUE = """blueprint AS (SELECT 'v/' || certification_id AS id, certification_id, max(id) % 3 <> 0 AS is_current, min(id) % 2 = 0 AS exact FROM question GROUP BY 2),
  node AS (SELECT b.id || '#' || d.label AS id, b.id AS blueprint_id, 1 AS depth, CASE WHEN d.question_count % 11 = 0 THEN d.label || ' (old)' ELSE d.label END AS label,
      CASE WHEN exact THEN (d.size % 9 + 1)::DOUBLE END AS weight_pct FROM domain d JOIN blueprint b ON b.certification_id = d.certification_id),
  domain_map AS (SELECT d.id AS domain_id, n.id AS node_id FROM domain d JOIN blueprint b ON b.certification_id = d.certification_id JOIN node n ON n.blueprint_id = b.id AND n.label = d.label)"""
_BASE = f"{_QUESTION}, {_DOMAIN}, {_BLUE}"
_OFFICIAL = """official AS (SELECT b.certification_id, m.domain_id, n.weight_pct AS weight FROM blueprint b JOIN node n ON n.blueprint_id = b.id JOIN domain_map m ON m.node_id = n.id WHERE is_current AND n.weight_pct IS NOT NULL),
  weights AS (SELECT certification_id, domain_id, weight, 'official' AS source FROM official UNION ALL SELECT certification_id, id, question_count::DOUBLE, 'corpus' FROM domain WHERE certification_id NOT IN (SELECT certification_id FROM official))"""


def _question(bank):
    cell = F.concat_ws("/", "p_type", "p_brand")
    return bank.table("part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("certification_id"),
        F.when(F.col("p_size") != 13, cell).alias("domain_id"), F.col("p_brand").alias("label"), "p_size",
    )


def _domain(bank):
    return _question(bank).where(F.col("domain_id").isNotNull()).groupBy(F.col("domain_id").alias("id"), "certification_id").agg(
        F.min("label").alias("label"), F.count(F.lit(1)).alias("question_count"), F.sum("p_size").alias("size")
    )


def _blueprint(bank):
    return _question(bank).groupBy("certification_id").agg((F.max("id") % 3 != 0).alias("is_current"), (F.min("id") % 2 == 0).alias("exact")).withColumn(
        "id", F.concat(F.lit("v/"), "certification_id")
    )


def _node(bank):
    b = _blueprint(bank).select(F.col("id").alias("blueprint_id"), "certification_id", "exact")
    old = F.col("question_count") % 11 == 0
    return _domain(bank).join(b, "certification_id").select(
        F.concat_ws("#", "blueprint_id", "label").alias("id"), "blueprint_id", F.lit(1).alias("depth"), F.col("label").alias("ordinal"),
        F.when(old, F.concat("label", F.lit(" (old)"))).otherwise(F.col("label")).alias("label"),
        F.when(F.col("exact"), (F.col("size") % 9 + 1).cast("double")).alias("weight_pct"),
    )


def _parts(bank):
    from itemloom.operators.projection import domain_map_rows

    d, b, n = _domain(bank), _blueprint(bank), _node(bank)
    return d, b, n, domain_map_rows(d, b, n)


@query("weights_official", f"WITH {_BASE}, {_OFFICIAL} SELECT * FROM official")
def weights_official(bank):
    _, b, n, m = _parts(bank)
    return W.weights_for(b, n, m)


@query("weights_resolved", f"WITH {_BASE}, {_OFFICIAL} SELECT * FROM weights")
def weights_resolved(bank):
    d, b, n, m = _parts(bank)
    return W.resolve_weights(d, W.weights_for(b, n, m))


@query("certifications_with_blueprints", f"WITH {_BASE} SELECT DISTINCT certification_id FROM blueprint WHERE is_current")
def certifications_with_blueprints(bank):
    return W.certifications_with_blueprints(_blueprint(bank))


_CHECK = """j AS (SELECT b.certification_id, d.id AS domain_id, n.label, n.weight_pct AS published_pct, d.question_count FROM blueprint b JOIN node n ON n.blueprint_id = b.id JOIN domain_map m ON m.node_id = n.id JOIN domain d ON d.id = m.domain_id WHERE is_current),
  c AS (SELECT *, round_even(100.0 * question_count / sum(question_count) OVER (PARTITION BY certification_id), 4)::DOUBLE AS corpus_pct FROM j),
  chk AS (SELECT *, round_even(abs(corpus_pct - published_pct), 4) AS deviation_pp, coalesce(round_even(abs(corpus_pct - published_pct), 4) <= 0.7 + 1e-9, TRUE) AS within_tolerance FROM c),
  loose AS (SELECT certification_id, 'domain' AS side, label FROM domain WHERE certification_id IN (SELECT certification_id FROM blueprint WHERE is_current) AND id NOT IN (SELECT domain_id FROM domain_map)
    UNION ALL SELECT b.certification_id, 'node', n.label FROM blueprint b JOIN node n ON n.blueprint_id = b.id WHERE is_current AND n.id NOT IN (SELECT node_id FROM domain_map))"""


@query("blueprint_cross_check", f"WITH {_BASE}, {_CHECK} SELECT * FROM chk")
def blueprint_cross_check(bank):
    return W.cross_check(*_parts(bank))


@query("blueprint_unjoined", f"WITH {_BASE}, {_CHECK} SELECT * FROM loose")
def blueprint_unjoined(bank):
    return W.unjoined(*_parts(bank))


@query(
    "blueprint_cross_check_summary",
    f"""WITH {_BASE}, {_CHECK}, s AS (SELECT certification_id, count(*) AS domains, sum(question_count)::BIGINT AS questions, max(deviation_pp) AS worst_deviation_pp, bool_and(within_tolerance) AS within_tolerance FROM chk GROUP BY 1),
    l AS (SELECT DISTINCT certification_id FROM loose)
    SELECT coalesce(s.certification_id, l.certification_id) AS certification_id, coalesce(domains, 0) AS domains, coalesce(questions, 0) AS questions, worst_deviation_pp, coalesce(within_tolerance, TRUE) AS within_tolerance, l.certification_id IS NULL AS joined_cleanly
    FROM s FULL JOIN l ON l.certification_id = s.certification_id""",
)
def blueprint_cross_check_summary(bank):
    parts = _parts(bank)
    return W.cross_check_summary(W.cross_check(*parts), W.unjoined(*parts))


# -------------------------------------------------------------- apportionment


@query(
    "apportion_by_key",
    """WITH w AS (SELECT p_brand AS grp, p_type AS key, sum(p_size)::DOUBLE AS weight, max(p_partkey) % 90 AS seats FROM part GROUP BY 1, 2),
    s AS (SELECT *, max(seats) OVER (PARTITION BY grp) AS seats_wanted FROM w), q AS (SELECT *, seats_wanted * weight / sum(weight) OVER (PARTITION BY grp) AS quota FROM s),
    f AS (SELECT *, floor(quota)::BIGINT AS fl, seats_wanted - sum(floor(quota)) OVER (PARTITION BY grp) AS spare FROM q)
    SELECT grp, key, weight, seats_wanted, fl + (row_number() OVER (PARTITION BY grp ORDER BY quota - fl DESC, key) <= spare)::INT AS target FROM f""",
)
def apportion_by_key(bank):
    cells = bank.table("part").groupBy(F.col("p_brand").alias("grp"), F.col("p_type").alias("key")).agg(
        F.sum("p_size").cast("double").alias("weight"), (F.max("p_partkey") % 90).alias("s")
    )
    seats = cells.groupBy("grp").agg(F.max("s").alias("seats_wanted"))
    return D.apportion(cells.drop("s").join(seats, "grp"), "grp", "key").select("grp", "key", "weight", "seats_wanted", "target")


# ----------------------------------------------------------------------- draws

_VERIFIED = journals._LEVELS.replace("q.doc_id", "q.p_partkey").replace("FROM documents q", "FROM part q")
_POOL = f"""{_BASE}, {_OFFICIAL}, {_VERIFIED}, {B.ITEM},
  seen AS (SELECT question_id, max(first_shown_at) AS last_seen_at FROM item WHERE first_shown_at IS NOT NULL GROUP BY 1),
  pool AS (SELECT q.id, q.certification_id, q.domain_id, v.verification, s.last_seen_at FROM question q LEFT JOIN question_verification v ON v.question_id = q.id LEFT JOIN seen s ON s.question_id = q.id),
  request AS (SELECT s_suppkey AS request_id, p_type AS certification_id, (10 + s_suppkey % 50) AS seats_wanted, s_suppkey * 31 AS seed FROM supplier JOIN part ON p_partkey = s_suppkey),
  excluded AS (SELECT DISTINCT ps AS id FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity = 50 AND l_discount = 0)),
  eligible AS (SELECT *, verification = 'disputed' AS flagged FROM pool WHERE verification <> 'known_bad' AND id NOT IN (SELECT id FROM excluded)),
  ranked AS (SELECT e.*, e.domain_id AS slice, last_seen_at IS NULL OR last_seen_at < TIMESTAMP '2001-07-01' - INTERVAL 30 DAY AS fresh FROM eligible e WHERE domain_id IS NOT NULL),
  tiered AS (SELECT *, row_number() OVER (PARTITION BY certification_id, slice, fresh ORDER BY CASE WHEN NOT fresh THEN last_seen_at END, md5(id::VARCHAR)) - 1 AS idx FROM ranked),
  cap AS (SELECT certification_id, slice, count(*) FILTER (fresh) AS n_fresh, count(*) FILTER (NOT fresh) AS n_stale FROM tiered GROUP BY 1, 2),
  asked AS (SELECT r.*, w.domain_id AS slice, w.weight, coalesce(n_fresh, 0) AS n_fresh, coalesce(n_stale, 0) AS n_stale, coalesce(n_fresh, 0) + coalesce(n_stale, 0) AS available, md5(r.seed || ':' || w.domain_id) AS tie
    FROM request r JOIN weights w ON w.certification_id = r.certification_id LEFT JOIN cap c ON c.certification_id = w.certification_id AND c.slice = w.domain_id),
  quota AS (SELECT *, seats_wanted * weight / sum(weight) OVER (PARTITION BY request_id) AS q FROM asked),
  floors AS (SELECT *, floor(q)::BIGINT AS fl, seats_wanted - sum(floor(q)) OVER (PARTITION BY request_id) AS spare FROM quota),
  targets AS (SELECT * EXCLUDE (q, fl, spare), fl + (row_number() OVER (PARTITION BY request_id ORDER BY q - fl DESC, tie) <= spare)::INT AS target FROM floors)"""
_GRANT = """grants AS (SELECT request_id, slice, weight, available, tie, seats_wanted::BIGINT AS rest, 0::BIGINT AS granted, 0 AS round FROM targets
  UNION ALL SELECT request_id, slice, weight, available, tie, (rest - sum(take) OVER (PARTITION BY request_id))::BIGINT, (granted + take)::BIGINT, round + 1 FROM (
    SELECT *, CASE WHEN active THEN least(fl + (row_number() OVER (PARTITION BY request_id ORDER BY active DESC, q - fl DESC, tie) <= spare)::INT, available - granted) ELSE 0 END::BIGINT AS take FROM (
      SELECT *, rest - sum(fl) OVER (PARTITION BY request_id) AS spare FROM (
        SELECT *, coalesce(floor(q), 0)::BIGINT AS fl FROM (
          SELECT *, CASE WHEN active THEN rest * weight / sum(CASE WHEN active THEN weight END) OVER (PARTITION BY request_id) ELSE 0 END AS q FROM (
            SELECT *, weight > 0 AND available > granted AS active FROM grants WHERE rest > 0 AND round < 200)
          QUALIFY bool_or(active) OVER (PARTITION BY request_id)))))),
  granted AS (SELECT request_id, slice, arg_max(granted, round) AS granted FROM grants GROUP BY 1, 2)"""
_SUBSET = """list_reduce([]::BIGINT[] || range(greatest({n} - {k}, 0)::BIGINT, {n}::BIGINT), lambda acc, j: acc || [CASE WHEN list_contains(acc, ('0x' || left(md5({seed} || ':' || j), 15))::BIGINT % (j + 1)) THEN j ELSE ('0x' || left(md5({seed} || ':' || j), 15))::BIGINT % (j + 1) END], []::BIGINT[])"""
_PICK = f"""plan AS (SELECT t.*, g.granted, least(g.granted, n_fresh) AS kf, least(g.granted - least(g.granted, n_fresh), n_stale) AS ks, t.seed || ':' || t.slice AS txt FROM targets t JOIN granted g ON g.request_id = t.request_id AND g.slice = t.slice),
  ties AS (SELECT *, min(idx) OVER (PARTITION BY certification_id, slice, last_seen_at) AS tie_start, count(*) OVER (PARTITION BY certification_id, slice, last_seen_at) AS tie_size FROM tiered WHERE NOT fresh),
  picks AS (SELECT request_id, seed, certification_id, slice, TRUE AS fresh, unnest({_SUBSET.format(n='n_fresh', k='kf', seed='txt')}) AS idx FROM plan WHERE kf > 0
    UNION ALL SELECT request_id, seed, p.certification_id, p.slice, FALSE, unnest(range(0::BIGINT, tie_start) || list_transform({_SUBSET.format(n='tie_size', k='(ks - tie_start)', seed="(txt || ':tie')")}, lambda x: x + tie_start))
      FROM plan p JOIN ties e ON e.certification_id = p.certification_id AND e.slice = p.slice AND e.idx = p.ks - 1 WHERE ks > 0),
  chosen AS (SELECT p.request_id, p.seed, t.* FROM picks p JOIN tiered t ON t.certification_id = p.certification_id AND t.slice = p.slice AND t.fresh = p.fresh AND t.idx = p.idx),
  drawn AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY md5(seed || ':order:' || id), id) - 1)::INT AS position FROM chosen)"""
_DRAW = f"WITH RECURSIVE {_POOL}, {_GRANT}, {_PICK}"


def pool(bank):
    kind = F.col("event_type")
    event = bank.table("events").select(
        F.col("user_id").alias("question_id"),
        F.when(F.col("value") <= 30, "noted").when(kind == "error", "known_bad").when(kind == "purchase", "human_reviewed").when(kind == "view", "ai_reviewed").otherwise("noted").alias("level"),
    )
    dispute = bank.table("events").where(kind == "signup").select(
        F.col("user_id").alias("question_id"), F.when(F.col("value") < 3, "open").otherwise("resolved").alias("state")
    )
    scope = _question(bank).select("id", "certification_id", "domain_id")
    return D.pool(scope, state.question_verification(scope.select("id"), event, dispute), state.last_seen(bank.item))


def requests(bank):
    kind = bank.table("part").select(F.col("p_partkey").alias("s_suppkey"), F.col("p_type").alias("certification_id"))
    return bank.table("supplier").join(kind, "s_suppkey").select(
        F.col("s_suppkey").alias("request_id"), "certification_id", (F.col("s_suppkey") % 50 + 10).alias("seats_wanted"), (F.col("s_suppkey") * 31).alias("seed")
    )


def excluded(bank):
    return bank.table("lineitem").where((F.col("l_quantity") == 50) & (F.col("l_discount") == 0)).select(F.col("l_partkey").alias("id")).distinct()


def _weights(bank):
    return weights_resolved(bank).select("certification_id", F.col("domain_id").alias("slice"), "weight")


def _draw(bank):
    return D.draw(requests(bank), pool(bank), _weights(bank), D.at(NOW), exclude=excluded(bank))


@query("candidate_pool", f"WITH {_POOL} SELECT id, certification_id, domain_id, verification, last_seen_at FROM pool")
def candidate_pool(bank):
    return pool(bank)


@query("eligible_candidates", f"WITH {_POOL} SELECT id, certification_id, flagged FROM eligible")
def eligible_candidates(bank):
    return D.eligible(pool(bank), excluded(bank)).select("id", "certification_id", "flagged")


@query("recency_split", f"WITH {_POOL} SELECT id, fresh, idx FROM tiered")
def recency_split(bank):
    sliced = D.slices(D.eligible(pool(bank), excluded(bank))).where(F.col("slice").isNotNull())
    return D.rank_pool(sliced, D.at(NOW)).select("id", "fresh", "idx")


@query("draw_targets", f"WITH {_POOL} SELECT request_id, slice, target, available FROM targets")
def draw_targets(bank):
    sliced = D.slices(D.eligible(pool(bank), excluded(bank))).where(F.col("slice").isNotNull())
    share = D.shares(requests(bank), _weights(bank), D.capacities(D.rank_pool(sliced, D.at(NOW))))
    return share.select("request_id", "slice", "target", "available")


@query("draw_granted_seats", f"WITH RECURSIVE {_POOL}, {_GRANT} SELECT request_id, slice, granted FROM granted")
def draw_granted_seats(bank):
    sliced = D.slices(D.eligible(pool(bank), excluded(bank))).where(F.col("slice").isNotNull())
    share = D.shares(requests(bank), _weights(bank), D.capacities(D.rank_pool(sliced, D.at(NOW))))
    return share.select("request_id", "slice", "granted")


@query("draw_weighted", f"{_DRAW} SELECT request_id, position, id, slice, fresh FROM drawn")
def draw_weighted(bank):
    return _draw(bank)[0].select("request_id", "position", "id", "slice", "fresh")


_UNIFORM = f"""WITH {_POOL}, everyone AS (SELECT *, last_seen_at IS NULL OR last_seen_at < TIMESTAMP '2001-07-01' - INTERVAL 30 DAY AS fresh2 FROM eligible),
  tier AS (SELECT *, row_number() OVER (PARTITION BY certification_id, fresh2 ORDER BY CASE WHEN NOT fresh2 THEN last_seen_at END, md5(id::VARCHAR)) - 1 AS idx FROM everyone),
  n AS (SELECT certification_id, count(*) FILTER (fresh2) AS nf, count(*) FILTER (NOT fresh2) AS ns FROM tier GROUP BY 1),
  p AS (SELECT r.*, nf, ns, least(seats_wanted, nf) AS kf, least(seats_wanted - least(seats_wanted, nf), ns) AS ks, seed || ':*' AS txt FROM request r JOIN n ON n.certification_id = r.certification_id),
  e AS (SELECT *, min(idx) OVER (PARTITION BY certification_id, last_seen_at) AS tie_start, count(*) OVER (PARTITION BY certification_id, last_seen_at) AS tie_size FROM tier WHERE NOT fresh2),
  picks AS (SELECT request_id, certification_id, TRUE AS f, unnest({_SUBSET.format(n='nf', k='kf', seed='txt')}) AS idx FROM p WHERE kf > 0
    UNION ALL SELECT request_id, p.certification_id, FALSE, unnest(range(0::BIGINT, tie_start) || list_transform({_SUBSET.format(n='tie_size', k='(ks - tie_start)', seed="(txt || ':tie')")}, lambda x: x + tie_start))
      FROM p JOIN e ON e.certification_id = p.certification_id AND e.idx = p.ks - 1 WHERE ks > 0)
  SELECT k.request_id, t.id, t.fresh2 AS fresh FROM picks k JOIN tier t ON t.certification_id = k.certification_id AND t.fresh2 = k.f AND t.idx = k.idx"""


@query("draw_uniform", _UNIFORM)
def draw_uniform(bank):
    drawn, _ = D.draw(requests(bank), pool(bank), None, D.at(NOW), exclude=excluded(bank))
    return drawn.select("request_id", "id", "fresh")


@query(
    "draw_report",
    f"""{_DRAW}, u AS (SELECT request_id, count(*) AS drawn, count(*) FILTER (fresh) AS fresh_used, count(*) FILTER (NOT fresh) AS stale_used, count(*) FILTER (flagged) AS flagged FROM drawn GROUP BY 1),
    z AS (SELECT certification_id, count(*) AS pool_size, count(*) FILTER (verification = 'known_bad') AS known_bad FROM pool GROUP BY 1), o AS (SELECT certification_id, count(*) AS eligible FROM eligible GROUP BY 1)
    SELECT r.request_id, r.seed, seats_wanted AS requested, CASE WHEN EXISTS (SELECT 1 FROM weights w WHERE w.certification_id = r.certification_id) THEN 'weights' ELSE 'uniform' END AS weight_source, 30::INT AS recent_window_days, coalesce(pool_size, 0) AS pool_size, coalesce(eligible, 0) AS eligible, coalesce(known_bad, 0) AS known_bad, coalesce(drawn, 0) AS drawn, coalesce(fresh_used, 0) AS fresh_used,
      coalesce(stale_used, 0) AS stale_used, coalesce(flagged, 0) AS flagged, greatest(0, seats_wanted - coalesce(drawn, 0)) AS shortfall
    FROM request r LEFT JOIN z ON z.certification_id = r.certification_id LEFT JOIN o ON o.certification_id = r.certification_id LEFT JOIN u ON u.request_id = r.request_id""",
)
def draw_report(bank):
    return D.draw_report(requests(bank), _draw(bank)[0], pool(bank), excluded(bank), _weights(bank))


@query(
    "draw_ids",
    f"""{_DRAW} SELECT 'flagged' AS list, r.certification_id, d.request_id, d.id FROM drawn d JOIN request r ON r.request_id = d.request_id WHERE flagged
    UNION ALL SELECT 'known_bad', certification_id, NULL, id FROM pool WHERE verification = 'known_bad'""",
)
def draw_ids(bank):
    return D.draw_ids(_draw(bank)[0], pool(bank))


@query(
    "draw_share_report",
    f"""{_DRAW}, got AS (SELECT request_id, slice, count(*) AS drawn FROM drawn GROUP BY 1, 2)
    SELECT t.request_id, t.slice AS domain_id, t.weight, t.target, coalesce(drawn, 0) AS drawn, t.available, greatest(0, t.target - coalesce(drawn, 0)) AS short, coalesce(drawn, 0) < t.target AS under_covered FROM targets t LEFT JOIN got ON got.request_id = t.request_id AND got.slice = t.slice""",
)
def draw_share_report(bank):
    drawn, share = _draw(bank)
    return D.share_report(share, drawn)


@query(
    "draw_unreachable",
    f"WITH {_POOL} SELECT e.certification_id, count(*) AS skipped FROM eligible e WHERE domain_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM official w WHERE w.certification_id = e.certification_id AND w.domain_id = e.domain_id) GROUP BY 1",
)
def draw_unreachable(bank):
    named = weights_official(bank).select("certification_id", F.col("domain_id").alias("slice"))
    return D.unreachable(pool(bank), named, excluded(bank))


@query("draw_default_lengths", "SELECT s_suppkey AS request_id, CASE WHEN s_nationkey % 2 = 0 THEN 25 ELSE CASE p_type WHEN 'ECONOMY' THEN 63 ELSE 60 END END::INT AS seats_wanted FROM supplier JOIN part ON p_partkey = s_suppkey")
def draw_default_lengths(bank):
    asked = requests(bank).drop("seats_wanted").join(
        bank.table("supplier").select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_nationkey") % 2 == 0, 25).alias("seats_wanted")), "request_id"
    )
    return D.sample_requests(asked, {"ECONOMY": 63}).select("request_id", "seats_wanted")


@query("uniform_sample", "SELECT p_partkey, p_brand FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 60")
def uniform_sample(bank):
    return D.uniform_sample(bank.table("part"), "p_partkey", 60, 7).select("p_partkey", "p_brand")


@query(
    "display_permutation",
    f"""WITH {B.GRADED_ITEM} SELECT id, array_to_string(list_transform(list_sort(list_transform(option_labels, lambda x: md5('42:' || position || ':' || question_id || ':' || x) || x)), lambda s: right(s, 1)), '') AS shown FROM graded_item""",
)
def display_permutation(bank):
    shown = D.display_order(F.col("option_labels"), F.lit(42), F.col("position"), F.col("question_id"))
    return bank.graded_item.select("id", F.array_join(shown, "").alias("shown"))


@query(
    "frozen_exam_items",
    f"""{_DRAW}, x AS (SELECT question_id, count(*) AS exposures FROM item GROUP BY 1)
    SELECT d.request_id, d.position, d.id AS question_id, p_name AS snapshot, array_to_string(list_transform(list_sort(list_transform(['A', 'B', 'C', 'D'], lambda o: md5(d.seed || ':' || d.position || ':' || d.id || ':' || o) || o)), lambda s: right(s, 1)), '') AS option_order,
      coalesce(exposures, 0) + 1 AS seen_ordinal, CASE WHEN flagged THEN 'disputed' END AS flag
    FROM drawn d JOIN part ON p_partkey = d.id LEFT JOIN x ON x.question_id = d.id""",
)
def frozen_exam_items(bank):
    snaps = bank.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("snapshot"), F.array(*[F.lit(x) for x in "ABCD"]).alias("option_labels"))
    frozen = D.freeze_items(_draw(bank)[0], snaps, state.prior_exposures(bank.item))
    return frozen.withColumn("option_order", F.array_join("option_order", ""))
