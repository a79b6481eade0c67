"""Similarity and case-based queries (section 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.operators import similar
from opsignal.plans.derived import INC, REW, SIG, incidents, rewards, signals
from opsignal.plans.registry import query

VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
PAIRS = f"""{VEC}, nn AS (SELECT a.id AS query_id, b.id AS neighbour_id, list_cosine_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_distance(a.v, b.v), b.id) AS rank FROM vec a JOIN vec b ON a.id <> b.id)"""


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


@query(
    "knn_cosine",
    f"WITH {PAIRS} SELECT query_id, neighbour_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 5",
)
def _(t):
    v = vectors(t)
    return similar.knn(v, v, 5).withColumn("distance", F.round("distance", 6))


@query(
    "known_match",
    f"""WITH {PAIRS} SELECT query_id, round_even(1 - distance, 4) AS similarity, CASE WHEN distance < 0.5 THEN neighbour_id END AS matched_id,
        CASE WHEN distance < 0.5 THEN 'known' END AS route FROM nn WHERE rank = 1""",
)
def _(t):
    # these vectors are nearly random; a wider limit than the default gives both outcomes
    v = vectors(t)
    return similar.known_match(similar.knn(v, v, 1), 0.5)


@query(
    "similar_resolved",
    f"""WITH {INC}, {REW}, {VEC}, c AS (SELECT vec.* FROM vec JOIN inc ON inc.incident_id = vec.id WHERE status = 'resolved'),
        nn AS (SELECT a.id AS query_id, b.id AS neighbour_id, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_distance(a.v, b.v), b.id) AS rank
               FROM vec a JOIN c b ON a.id <> b.id),
        act AS (SELECT incident_id, string_agg(DISTINCT rule_name, ',' ORDER BY rule_name) AS actions FROM rew GROUP BY incident_id)
        SELECT query_id, neighbour_id, CAST(rank AS INTEGER) AS rank, coalesce(actions, '') AS actions FROM nn LEFT JOIN act ON act.incident_id = neighbour_id WHERE rank <= 3""",
)
def _(t):
    v = vectors(t)
    resolved = incidents(t).filter("status = 'resolved'").select(F.col("incident_id").alias("id"))
    found = similar.knn(v, v.join(resolved, "id", "left_semi"), 3).drop("distance")
    actions = rewards(t).join(found.select(F.col("neighbour_id").alias("incident_id")).distinct(), "incident_id", "left_semi")
    actions = actions.groupBy(F.col("incident_id").alias("neighbour_id")).agg(F.array_join(F.array_sort(F.collect_set("rule_name")), ",").alias("actions"))
    return found.join(actions, "neighbour_id", "left").select("query_id", "neighbour_id", "rank", F.coalesce("actions", F.lit("")).alias("actions"))


@query(
    "cross_source_knn",
    f"""WITH {VEC}, nn AS (SELECT a.id AS query_id, b.id AS neighbour_id, list_cosine_distance(a.v, b.v) AS distance,
          row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_distance(a.v, b.v), b.id) AS rank FROM vec a JOIN vec b ON a.label < 5 AND b.label >= 5)
        SELECT query_id, neighbour_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 3""",
)
def _(t):
    v = vectors(t)
    found = similar.knn(v.filter("label < 5"), v.filter("label >= 5"), 3, exclude_self=False)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "incident_text",
    f"""WITH {SIG}, d AS (SELECT ns, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT concat('t', k))) AS tm, list_sort(list(DISTINCT event_type)) AS r, max(k) AS z FROM sig GROUP BY ALL)
        SELECT ns, day, concat('SRE incident in ', ns, '. Log patterns: ', array_to_string(tm[1:5], ' | '), '. Anomalous metrics: cpu(z=', z, '), mem. Falco: ',
          array_to_string(r, ', '), '.') AS description FROM d""",
)
def _(t):
    rows = signals(t).groupBy("ns", F.to_date("ts").alias("day")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("t"), F.col("k").cast("string")))).alias("templates"),
        F.array_sort(F.collect_set("event_type")).alias("rules"), F.max("k").alias("z"),
    )
    null = F.lit(None).cast("string")
    rows = rows.withColumns({
        "domain": F.lit("SRE"), "services": F.array("ns"), "match_ids": F.array().cast("array<string>"),
        "anomalies": F.array(
            F.struct(F.lit("cpu").alias("metric"), F.col("z").cast("string").alias("zscore")), F.struct(F.lit("mem").alias("metric"), null.alias("zscore"))
        ),
    })
    text = similar.incident_text(rows, "domain", "services", "templates", "anomalies", "rules", "match_ids")
    return rows.select("ns", "day", text.alias("description"))


@query(
    "tfidf_vectors",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
        df AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY term),
        x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN df USING (term)),
        l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM x GROUP BY doc_id)
        SELECT doc_id, term, round(w / len, 6) AS weight FROM x JOIN l USING (doc_id) WHERE len > 0""",
)
def _(t):
    return similar.tfidf(t.documents, "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query(
    "stale_vectors",
    """WITH d AS (SELECT vec_id, CASE WHEN label = 7 THEN 0 ELSE len(embedding) END AS n, CASE WHEN label = 3 THEN 'x METRIC anomalies: cpu' ELSE 'Log patterns: y' END AS descr FROM embeddings)
       SELECT vec_id, CASE WHEN n = 0 THEN 'missing' ELSE 'stale' END AS reason FROM d WHERE n = 0 OR descr ILIKE '%Metric anomalies:%'""",
)
def _(t):
    rows = t.embeddings.select(
        "vec_id", F.when(F.col("label") != 7, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("embedding"),
        F.when(F.col("label") == 3, "x METRIC anomalies: cpu").otherwise("Log patterns: y").alias("descr"),
    )
    return similar.stale_vectors(rows, "embedding", "descr").select("vec_id", "reason")


@query(
    "alignment_score",
    f"""WITH {VEC}, p AS (SELECT a.id AS incident_id, list_dot_product(a.v, b.v) AS d FROM vec a JOIN vec b ON b.id = a.id + 1)
        SELECT incident_id, round(greatest(0, least(1, d)), 6) AS score, CASE WHEN round(greatest(0, least(1, d)), 6) < 0.5 THEN 'negative_ml_judge' END AS reward FROM p""",
)
def _(t):
    v = vectors(t).select("id", "embedding")
    answer = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("resolution"))
    score = F.round(similar.alignment_score("embedding", "resolution"), 6)
    rows = v.join(answer, "id").select(F.col("id").alias("incident_id"), score.alias("score"))
    return rows.withColumn("reward", F.when(F.col("score") < fv.POOR_ALIGNMENT, "negative_ml_judge"))


