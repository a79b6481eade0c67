"""Learning statistics and budgeted ranking (sections 2.6, 2.11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsignal.operators import learn, rollups
from opsignal.plans.derived import INC, REW, incidents, rewards
from opsignal.plans.registry import query

SCORES = f"""{INC}, scores AS (SELECT route, round_even(count(*) FILTER (status = 'escalated') / count(*), 4) AS score FROM inc GROUP BY route HAVING count(*) >= 3)"""


def _scores(t):
    return learn.escalation_rate(incidents(t), ["route"]).select("route", "score")


@query(
    "budgeted_topk",
    f"""WITH {SCORES}, b AS (SELECT route, least(20, greatest(1, CAST(round_even(50 * score / (SELECT sum(score) FROM scores), 0) AS INTEGER))) AS budget FROM scores),
        c AS (SELECT inc.*, row_number() OVER (PARTITION BY route ORDER BY opened_at DESC, incident_id) AS r FROM inc
              WHERE status = 'resolved' AND incident_id NOT IN (SELECT vec_id FROM embeddings))
        SELECT c.route, incident_id, opened_at FROM c JOIN b ON b.route = c.route WHERE r <= budget""",
)
def _(t):
    done = t.embeddings.select(F.col("vec_id").alias("incident_id"))
    cases = incidents(t).filter("status = 'resolved'").select("route", "incident_id", "opened_at").join(done, "incident_id", "left_anti")
    order = [F.col("opened_at").desc(), F.col("incident_id")]
    return learn.budgeted_top_k(cases, _scores(t), "route", order, "incident_id").select("route", "incident_id", "opened_at")


@query(
    "topk_of_topk",
    f"""WITH {SCORES}, w AS (SELECT * FROM scores ORDER BY score DESC, route LIMIT 3)
        SELECT inc.route, score, incident_id, opened_at FROM inc JOIN w ON w.route = inc.route WHERE status = 'escalated'
        QUALIFY row_number() OVER (PARTITION BY inc.route ORDER BY opened_at DESC, incident_id) <= 5""",
)
def _(t):
    rows = incidents(t).filter("status = 'escalated'").select("route", "incident_id", "opened_at")
    return learn.worst_cases(rows, _scores(t), "route", 3, 5, "incident_id").drop("rank")


ACTUAL = "CASE l_linenumber % 4 WHEN 0 THEN 'known_replay' WHEN 1 THEN 'novel' WHEN 2 THEN 'probe_restart' ELSE 'structured' END"


@query(
    "route_feedback",
    f"""WITH {INC}, {REW}, x AS (SELECT incident_id, l_linenumber, route, {ACTUAL} AS actual FROM inc JOIN rew USING (incident_id) WHERE outcome = 'resolved')
        SELECT incident_id, l_linenumber, route, actual, CASE WHEN split_part(route, '_', 1) = split_part(actual, '_', 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
          CASE WHEN split_part(route, '_', 1) <> split_part(actual, '_', 1) THEN 'negative_outcome_feedback' END AS reward FROM x""",
)
def _(t):
    done = rewards(t).filter("outcome = 'resolved'").select("incident_id", "l_linenumber", F.expr(ACTUAL).alias("actual"))
    rows = incidents(t).select("incident_id", "route").join(done, "incident_id")
    return learn.route_feedback(rows, "route", "actual")


@query(
    "synthesis_gate",
    f"""WITH {SCORES}, r AS (SELECT count(*) AS n FROM (SELECT route, ns FROM inc WHERE status IN ('resolved', 'escalated') GROUP BY ALL HAVING count(*) >= 3)),
        l AS (SELECT max(l_shipdate) AS last_run FROM lineitem)
        SELECT (SELECT max(score) FROM scores) AS max_score, n AS n_recurring,
          n > 0 OR (SELECT max(score) FROM scores) >= 0.3 OR date_diff('day', last_run, TIMESTAMP '2001-11-06') >= 7 AS run_synthesis FROM r, l""",
)
def _(t):
    recurring = learn.recurrence(incidents(t), ["route", "ns"])
    last = t.lineitem.select(F.col("l_shipdate").alias("last_run"))
    return learn.synthesis_gate(_scores(t), recurring, last, dt.datetime(2001, 11, 6))


@query(
    "outcome_rollup",
    f"""WITH {REW} SELECT rule_name, outcome, count(*) AS n, round(avg(duration_s), 4) AS avg_duration, max(duration_s) AS max_duration FROM rew GROUP BY ALL""",
)
def _(t):
    return learn.outcome_rollup(rewards(t), ["rule_name", "outcome"], "duration_s")


@query(
    "brittleness_weighted",
    """SELECT o_orderpriority AS route, round(count(*) FILTER (o_orderstatus = 'P') / count(*) * (1 - avg((o_custkey % 100) / 100)), 6) AS brittleness
       FROM orders GROUP BY ALL""",
)
def _(t):
    rows = t.orders.select(
        F.col("o_orderpriority").alias("route"), F.when(F.col("o_orderstatus") == "P", "escalated").otherwise("resolved").alias("status"),
        ((F.col("o_custkey") % 100) / 100).alias("similarity"),
    )
    return learn.weighted_brittleness(rows, ["route"], "similarity")


@query(
    "rule_context_reward",
    f"""WITH {INC}, {REW} SELECT rule_name, domain, CAST(isodow(opened_at) - 1 AS INTEGER) AS dow, count(*) AS n,
        round(avg(CASE WHEN outcome = 'resolved' THEN 1.0 ELSE 0.0 END), 8) AS mean_reward FROM rew JOIN inc USING (incident_id) GROUP BY ALL""",
)
def _(t):
    context = incidents(t).select("incident_id", "domain", F.weekday("opened_at").alias("dow"))
    out = learn.rule_context_reward(rewards(t).join(context, "incident_id"), ["domain", "dow"])
    return out.withColumn("mean_reward", F.round("mean_reward", 8))


@query(
    "runbook_rows",
    f"""WITH {INC}, {REW}, p AS (SELECT rule_name, count(DISTINCT inc.incident_id) AS times_resolved FROM inc JOIN rew USING (incident_id) WHERE status = 'resolved' GROUP BY rule_name),
        f AS (SELECT incident_id, min(rule_name) AS rule_name FROM rew GROUP BY incident_id),
        st AS (SELECT incident_id, string_agg(concat(l_linenumber, '. `', rule_name, '` -> ', outcome), chr(10) ORDER BY l_linenumber, rule_name, concat(l_linenumber, '. `', rule_name, '` -> ', outcome)) AS steps FROM rew GROUP BY incident_id)
        SELECT inc.incident_id, CASE WHEN coalesce(f.rule_name, '') <> '' THEN f.rule_name ELSE concat(domain, ' incident in ', ns) END AS title, strftime(opened_at, '%Y-%m-%d') AS first_seen,
          coalesce(times_resolved, 1) AS times_resolved, domain, route, coalesce(steps, '_No automated actions recorded._') AS steps
        FROM inc LEFT JOIN f USING (incident_id) LEFT JOIN p ON p.rule_name = f.rule_name LEFT JOIN st ON st.incident_id = inc.incident_id WHERE status = 'resolved'""",
)
def _(t):
    from opsignal.operators.incidents import merge_arrays

    done = rewards(t)
    rules = merge_arrays(done.select("incident_id", F.array("rule_name").alias("r")), ["incident_id"], ["r"], "rules")
    opened = incidents(t).join(rules, "incident_id", "left").withColumn("rule_name", F.coalesce(F.col("rules")[0], F.lit("")))
    prior = rollups.prior_resolutions(opened.filter("rules IS NOT NULL"), "rules")
    actions = done.select("incident_id", F.col("l_linenumber").alias("step"), F.col("rule_name").alias("command"), F.col("outcome").alias("output"))
    return learn.runbook_rows(opened.withColumn("services", F.array("ns")), actions, prior)

