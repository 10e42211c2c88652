"""The views of `tables.py` once more, as DuckDB SQL for the twins."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, list[str]]] = {
    "posts": ("""
        SELECT e.event_id AS post_id, 'p' || e.event_id AS external_id, 1 AS source_id, e.user_id AS account_id,
               e.event_id // 25 AS case_id, e.event_id % 25 = 0 AS is_case_root,
               CASE WHEN e.event_id % 25 = 0 THEN NULL
                    WHEN e.event_id % 3 <> 0 THEN (e.event_id // 25) * 25
                    ELSE e.event_id - 1 END AS reply_to_post_id,
               e.ts AS published_at, e.event_id % 97 AS likes_count, e.event_id % 31 AS reposts_count,
               e.event_id % 13 AS replies_count,
               CASE WHEN e.event_type = 'view' THEN 'live' ELSE 'dataset' END AS source_type,
               'demo' AS dataset_name,
               CASE WHEN (e.event_id // 25) % 4 = 0 THEN 'test' ELSE 'train' END AS dataset_split,
               (e.event_id // 25) % 5 AS ingestion_run_id, e.event_type AS kind, d.lang AS language,
               CASE e.event_type WHEN 'purchase' THEN 'Breaking urgent: '
                                 WHEN 'error' THEN 'Unconfirmed, is it true? '
                                 WHEN 'click' THEN 'RT @u: '
                                 WHEN 'view' THEN ''
                                 WHEN 'signup' THEN 'СРОЧНО!!! Репост, скрывают правду. This is fake. '
               END || d.text AS content
        FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""", []),
    "post_tags": ("""
        SELECT event_id AS post_id, 'tag_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS tag
        FROM events""", []),
    "post_links": ("""
        SELECT e.event_id AS post_id, g.url AS url,
               coalesce(regexp_extract(g.url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') AS domain,
               CASE WHEN g.page_id % 5 = 0 THEN '' ELSE g.url || '&full=1' END AS expanded_url
        FROM events e JOIN pages g ON g.page_id = e.event_id % (SELECT count(*) FROM pages)
        WHERE e.event_type IN ('click', 'purchase')""", []),
    "accounts": ("""
        SELECT user_id AS account_id, 1 AS source_id, 'acct:' || user_id AS external_id,
               'user_' || user_id AS username,
               CASE WHEN user_id % 5 <> 0 THEN 'User ' || user_id END AS display_name,
               user_id * 37 % 1000 AS followers_count, user_id * 17 % 500 AS following_count,
               user_id % 50 AS posts_count, user_id % 10 = 0 AS is_verified, user_id % 7 = 0 AS is_bot,
               TIMESTAMP '2024-01-30 00:00:00' - to_days(CAST(user_id % 400 AS INTEGER)) AS created_at
        FROM (SELECT DISTINCT user_id FROM events)""", []),
    "cases": ("""
        SELECT case_id, 'dataset' AS source_type, 'src' || (case_id % 3) AS source_name, 'demo' AS dataset_name,
               CASE WHEN case_id % 4 = 0 THEN 'test' ELSE 'train' END AS dataset_split,
               'c' || case_id AS external_case_id, 'thread' AS case_type,
               CASE WHEN case_id % 10 = 9 THEN '' WHEN case_id % 2 = 0 THEN 'rumour' ELSE 'non-rumour' END AS label,
               CASE WHEN case_id % 3 = 0 THEN '' ELSE 'Case ' || case_id END AS title,
               n.n_name AS event_name, 'region_' || n.n_regionkey AS event_group,
               CASE case_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'finalized' END AS status,
               first_event_at AS opened_at, first_event_at, last_event_at
        FROM (SELECT event_id // 25 AS case_id, min(ts) AS first_event_at, max(ts) AS last_event_at
              FROM events GROUP BY 1) c JOIN nation n ON n.n_nationkey = c.case_id % 25""", []),
    "case_model_scores": ("""
        SELECT case_id, CASE k WHEN 0 THEN 'case_logreg_oof' WHEN 1 THEN 'case_gbt_oof' ELSE 'case_text_oof' END AS scorer_key,
               CASE WHEN case_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS model_version, risk_score,
               CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
               greatest(risk_score, 1 - risk_score) AS confidence_score,
               ((case_id * 31 + k) % 100) / 100.0::DOUBLE AS temporal_score,
               ((case_id * 17 + k) % 100) / 100.0::DOUBLE AS coordination_score,
               ((case_id * 13 + k) % 100) / 100.0::DOUBLE AS content_score
        FROM (SELECT case_id, k, ((case_id * 7919 + k * 104729) % 1000) / 1000.0::DOUBLE AS risk_score
              FROM (SELECT DISTINCT event_id // 25 AS case_id FROM events) CROSS JOIN (VALUES (0), (1), (2)) s(k)
              WHERE NOT (k = 2 AND case_id % 13 = 0))""", []),
    "case_scores": ("""
        SELECT case_id, 'case-' || model_version AS score_version, risk_score, risk_level, temporal_score,
               coordination_score, content_score, 'h0' AS pipeline_hash
        FROM case_model_scores WHERE scorer_key = 'case_logreg_oof' AND case_id % 17 <> 5""", ["case_model_scores"]),
    "analysis_results": ("""
        SELECT *, CASE WHEN manipulation_score > 0.7 AND confidence_score > 0.7 THEN 1
                       WHEN manipulation_score > 0.4 THEN 2 ELSE 3 END AS escalation_priority
        FROM (SELECT event_id AS post_id, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS manipulation_score,
                     ((event_id * 104729) % 1000) / 1000.0::DOUBLE AS confidence_score,
                     ((event_id * 31) % 100) / 100.0::DOUBLE AS coordination_contribution,
                     ((event_id * 17) % 100) / 100.0::DOUBLE AS temporal_contribution,
                     ((event_id * 13) % 100) / 100.0::DOUBLE AS narrative_contribution,
                     'note ' || (event_id % 5) AS confidence_note, ts + INTERVAL 1 HOUR AS created_at
              FROM events WHERE event_type <> 'view')""", []),
    "ingestion_runs": ("""
        SELECT (event_id // 25) % 5 AS run_id, 'dataset' AS source_type, 'demo' AS source_name, 'completed' AS status,
               min(ts) AS started_at, max(ts) AS finished_at
        FROM events GROUP BY 1""", []),
}


def with_views(names: list[str], body: str) -> str:
    """Put the named views, and the views they need, before `body` as CTEs."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][1]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    body = body.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][0].strip()})" for name in ordered)
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
