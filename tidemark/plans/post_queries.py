"""Post-level analysis by name, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicons as L, text as X
from tidemark.functions.scores import fixed
from tidemark.operators import post_analysis as P, similarity as S
from tidemark.plans.feature_queries import any_of
from tidemark.plans.registry import query, r6
from tidemark.plans.tables import Tables

AS_OF = "2024-01-31 00:00:00"
NEWEST, CHECKED, KEPT = 50, 50, 100  # what one analysis looks at: posts of an account, comments of a post


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def hits(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in words) + ")"


def capped(column: str, words, cap: int) -> str:
    return f"least(1.0, {hits(column, words)} / {cap}::DOUBLE)"


def x3(e: str, d: int = 3) -> str:
    return f"CAST(format('{{:.{d}f}}', ({e})::DOUBLE) AS DOUBLE)"


def lexicon_sql(source: str) -> str:
    parts = ", ".join(f"{capped('lo', words, cap)} AS s_{n}" for n, (words, cap) in P.LEXICONS.items())
    emo = " ".join(f"WHEN contains(lo, '{w}') THEN 'Эмоциональный маркер: \"{w}\"; '" for w in L.EMOTIONAL_WORDS[:3])
    call = " ".join(f"WHEN contains(lo, '{w}') THEN 'Призыв к действию: \"{w}\"; '" for w in L.COORDINATION_CALLS[:2])
    return f"""
low AS (SELECT *, lower(txt) AS lo FROM {source}), sc AS (SELECT *, {parts} FROM low),
mx AS (SELECT *, (s_emotional + s_logical + s_propaganda + s_fake) / 4 AS nar FROM sc),
fin AS (SELECT *, nar * 0.5::DOUBLE + s_calls * 0.25::DOUBLE + s_urgency * 0.25::DOUBLE AS score FROM mx),
lex AS (SELECT post_id, txt, {x3('score')} AS manipulation_score, {x3('least(0.95, 0.5::DOUBLE + score * 0.5::DOUBLE)')} AS confidence_score,
  {x3('s_calls')} AS coordination_contribution, {x3('s_urgency')} AS temporal_contribution, {x3('nar')} AS narrative_contribution,
  CASE WHEN nar > 0.7 AND s_calls > 0.5 THEN 'Высокая уверенность: нарративные и координационные сигналы совпадают'
    WHEN nar > 0.7 THEN 'Средняя уверенность: сильные нарративные сигналы, слабая координация'
    WHEN s_calls > 0.5 THEN 'Средняя уверенность: координационные сигналы без нарративного подтверждения'
    WHEN abs(nar - s_calls) > 0.4 THEN 'Низкая уверенность: конфликт между ветками анализа'
    ELSE 'Требуется дополнительный анализ: недостаточно сигналов' END AS confidence_note,
  coalesce(nullif(rtrim(CASE WHEN s_emotional > 0.5 THEN 'эмоциональное давление; ' ELSE '' END || CASE WHEN s_logical > 0.4 THEN 'логическая ошибка; ' ELSE '' END
    || CASE WHEN s_propaganda > 0.4 THEN 'пропагандистский приём; ' ELSE '' END || CASE WHEN s_fake > 0.3 THEN 'манипуляция фактами; ' ELSE '' END, '; '), ''),
    'слабо выраженные признаки') AS tactics,
  coalesce(nullif(rtrim(CASE {emo} ELSE '' END || CASE {call} ELSE '' END
    || CASE WHEN {any_of('lo', L.PROPAGANDA_PHRASES)} THEN 'Обнаружены пропагандистские конструкции; ' ELSE '' END, '; '), ''),
    'Выраженных манипулятивных маркеров не обнаружено') AS key_evidence FROM fin)"""


LEX_COLS = ["manipulation_score", "confidence_score", "coordination_contribution", "temporal_contribution", "narrative_contribution"]


@query("t2_lexicon_scores", views="posts", sql="WITH src AS (SELECT post_id, content AS txt FROM posts)," + lexicon_sql("src") +
       f" SELECT post_id, {', '.join(LEX_COLS)}, confidence_note, tactics, key_evidence FROM lex")
def t2(t: Tables):
    out = P.lexicon_scores(t.posts().select("post_id", "content"))
    return out.select("post_id", *LEX_COLS, "confidence_note", F.array_join("tactics", "; ").alias("tactics"),
                      F.array_join("key_evidence", "; ").alias("key_evidence"))


STRIP = r"regexp_replace(regexp_replace({}, '<[^>]*>?', '', 'g'), '>', '', 'g')"


@query("t1_stripped_pages", sql=f"SELECT page_id, length(s) AS text_length, md5(s) AS text_md5 FROM (SELECT page_id, {STRIP.format('html')} AS s FROM pages)")
def t1(t: Tables):
    s = X.strip_tags(F.col("html"))
    return t.raw("pages").select("page_id", F.length(s).cast("bigint").alias("text_length"), F.md5(s).alias("text_md5"))


@query("t12_batch_analysis", views="posts analysis_results", sql=f"""
WITH src AS (SELECT post_id, trim({STRIP.format('content')}, E' \\t\\n\\r') AS txt FROM posts p
  WHERE NOT EXISTS (SELECT 1 FROM analysis_results r WHERE r.post_id = p.post_id)),{lexicon_sql('src')}
SELECT post_id, manipulation_score, confidence_score, CASE WHEN txt <> '' THEN CASE WHEN manipulation_score > 0.7 AND confidence_score > 0.7 THEN 1
  WHEN manipulation_score > 0.4 THEN 2 ELSE 3 END END AS escalation_priority, length(txt) AS clean_length FROM lex""")
def t12(t: Tables):
    out = P.analyse_unanalysed(t.posts(), t.analysis_results())
    return out.select("post_id", "manipulation_score", "confidence_score", "escalation_priority",
                      F.length("clean_text").cast("bigint").alias("clean_length"))


@query("t12_batch_summary", views="posts analysis_results", sql=f"""
WITH src AS (SELECT post_id, trim({STRIP.format('content')}, E' \\t\\n\\r') AS txt FROM posts p
  WHERE NOT EXISTS (SELECT 1 FROM analysis_results r WHERE r.post_id = p.post_id)),{lexicon_sql('src')},
e AS (SELECT CASE WHEN txt <> '' THEN CASE WHEN manipulation_score > 0.7 AND confidence_score > 0.7 THEN 1
  WHEN manipulation_score > 0.4 THEN 2 ELSE 3 END END AS p FROM lex)
SELECT count(p) AS processed, count(*) FILTER (WHERE p IS NULL) AS failed, count(*) FILTER (WHERE p = 1) AS high,
  count(*) FILTER (WHERE p = 2) AS medium, count(*) FILTER (WHERE p = 3) AS low FROM e""")
def t12_summary(t: Tables):
    return P.analysis_run_summary(P.analyse_unanalysed(t.posts(), t.analysis_results()))


CONTENT_SQL = rf"""
c0 AS (SELECT post_id, content AS txt, lower(content) AS lo FROM posts),
c1 AS (SELECT *, {capped('lo', L.DEEP_EMOTIONAL, 3)} AS emo, {capped('lo', L.DEEP_COORDINATION, 2)} AS coord, {capped('lo', L.DEEP_PROPAGANDA, 1)} AS prop,
  length(txt) - length(replace(txt, '!', '')) AS exclamation_count,
  (length(txt) - length(regexp_replace(txt, '\p{{Lu}}', '', 'g')))::DOUBLE / greatest(1, length(txt)) AS caps FROM c0),
c2 AS (SELECT *, emo * 0.4::DOUBLE + coord * 0.35::DOUBLE + prop * 0.25::DOUBLE AS a FROM c1),
c3 AS (SELECT *, CASE WHEN exclamation_count > 2 THEN least(1.0, a + 0.15::DOUBLE) ELSE a END AS b FROM c2),
c4 AS (SELECT *, CASE WHEN caps > 0.2 THEN least(1.0, b + 0.1::DOUBLE) ELSE b END AS c FROM c3),
c5 AS (SELECT *, CASE WHEN length(txt) < 200 AND c > 0.3 THEN least(1.0, c + 0.1::DOUBLE) ELSE c END AS d FROM c4),
content_scores AS (SELECT post_id, {x3('d')} AS content_score, {x3('emo')} AS emotional_score, {x3('prop')} AS fallacies_score,
  {x3('coord')} AS content_coordination_score, exclamation_count::INT AS exclamation_count, {x3('caps')} AS caps_ratio, length(txt)::INT AS text_length FROM c5)"""
CONTENT_COLS = ["content_score", "emotional_score", "fallacies_score", "content_coordination_score", "exclamation_count", "caps_ratio", "text_length"]


@query("t4_content_scores", views="posts", sql="WITH " + CONTENT_SQL.strip() + f" SELECT post_id, {', '.join(CONTENT_COLS)} FROM content_scores")
def t4(t: Tables):
    return P.content_scores(t.posts().select("post_id", "content")).select("post_id", *CONTENT_COLS)


BEHAVIOUR_SQL = f"""
b0 AS (SELECT * FROM (SELECT account_id, epoch_us(published_at) AS us, hour(published_at) AS hr, md5(lower(content)) AS h,
  row_number() OVER (PARTITION BY account_id ORDER BY published_at DESC, post_id DESC) AS rn FROM posts) WHERE rn <= 50),
b1 AS (SELECT account_id, count(*) AS n, CASE WHEN count(*) > 1 THEN (max(us) - min(us)) / 3600000000.0::DOUBLE / (count(*) - 1) ELSE 0.0 END AS gap,
  (count(*) - count(DISTINCT h))::DOUBLE / count(*) AS dup, count(*) FILTER (WHERE hr <= 5)::DOUBLE / count(*) AS night FROM b0 GROUP BY 1),
behaviour AS (SELECT account_id, (n > 1 AND gap < 0.5) OR dup > 0.3 OR night > 0.5 AS suspicious, {x3('gap', 2)} AS avg_time_gap_hours, {x3('dup')} AS duplicate_ratio,
  {x3('night')} AS night_posts_ratio, n AS total_posts_analyzed,
  CASE WHEN n > 1 AND gap < 0.5 THEN 'Слишком частая публикация (раз в ' || format('{{:.1f}}', gap) || ' часов)'
    WHEN dup > 0.3 THEN 'Высокий уровень дублирования (' || format('{{:.0f}}', dup * 100) || '%)'
    WHEN night > 0.5 THEN 'Подозрительная активность ночью (' || format('{{:.0f}}', night * 100) || '% постов)'
    ELSE 'Поведение аккаунта в пределах нормы' END AS reason FROM b1)"""


@query("t5_account_behaviour", views="posts", sql="WITH " + BEHAVIOUR_SQL.strip() + " SELECT * FROM behaviour")
def t5(t: Tables):
    return P.account_behaviour(t.posts(), NEWEST)


FACTOR_SQL = f"""
fa AS (SELECT account_id, followers_count, coalesce(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000.0), 365)::BIGINT AS account_age_days FROM accounts),
factor AS (SELECT account_id, account_age_days, CASE WHEN account_age_days < 30 AND followers_count < 100 THEN 0.7::DOUBLE WHEN account_age_days < 30 THEN 0.5
  WHEN followers_count < 100 THEN 0.3 ELSE 0.1 END AS account_factor FROM fa)"""


@query("t9_account_factor", views="accounts", sql="WITH " + FACTOR_SQL.strip() + " SELECT * FROM factor")
def t9(t: Tables):
    return P.account_factor(t.accounts(), as_of()).select("account_id", "account_age_days", "account_factor")


VELOCITY_SQL = f"""
v0 AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 3600000000.0::DOUBLE AS age FROM posts),
v1 AS (SELECT *, CASE WHEN age >= 1 THEN (likes_count + reposts_count * 2 + replies_count * 3) / greatest(1.0, age) END AS rate FROM v0),
velocity AS (SELECT post_id, coalesce(rate > 100, false) AS suspicious_velocity, CASE WHEN rate IS NOT NULL THEN {x3('rate', 2)} END AS engagement_rate_per_hour,
  {x3('age', 1)} AS age_hours FROM v1)"""


@query("t7_engagement_velocity", views="posts", sql="WITH " + VELOCITY_SQL.strip() + " SELECT * FROM velocity")
def t7(t: Tables):
    return P.engagement_velocity(t.posts(False), as_of()).select("post_id", "suspicious_velocity", "engagement_rate_per_hour", "age_hours")


COMMENT_SQL = f"""
k0 AS (SELECT reply_to_post_id AS parent, {any_of('lower(content)', L.COMMENT_PATTERNS)} AS hit,
  row_number() OVER (PARTITION BY reply_to_post_id ORDER BY published_at, post_id) AS rn FROM posts WHERE reply_to_post_id IS NOT NULL),
comments AS (SELECT parent AS post_id, count(*) AS total_comments, count(*) FILTER (WHERE rn <= 50 AND hit) AS manipulated_comments,
  {x3('count(*) FILTER (WHERE rn <= 50 AND hit)::DOUBLE / count(*)')} AS manipulation_ratio FROM k0 WHERE rn <= 100 GROUP BY 1)"""


@query("t8_comment_manipulation", views="posts", sql="WITH " + COMMENT_SQL.strip() + " SELECT * FROM comments")
def t8(t: Tables):
    return P.comment_manipulation(t.posts(), CHECKED, KEPT)


def stored_coordination(t: Tables):
    """Counts of similar posts kept from an earlier run: here by reach of the account."""
    return t.posts(False).select("post_id", (F.col("likes_count") % 11).alias("similar_count"), (F.col("reposts_count") % 5).alias("unique_accounts"))


def composite_sql(reach: str, joined: str = "", first: str = "") -> str:
    """`reach` gives sim, ua and coordinated of a post, from the posts or from what is `joined`."""
    return "WITH " + first + ",".join(
    x.strip() for x in (CONTENT_SQL, BEHAVIOUR_SQL, FACTOR_SQL, VELOCITY_SQL, COMMENT_SQL)) + f""",
r AS (SELECT p.post_id, p.account_id, c.*, b.suspicious, b.reason, b.total_posts_analyzed, f.account_factor, v.suspicious_velocity, v.engagement_rate_per_hour,
  coalesce(k.manipulation_ratio, 0) AS cr, coalesce(k.total_comments, 0) AS tc, {reach}
  FROM posts p JOIN content_scores c ON c.post_id = p.post_id JOIN behaviour b ON b.account_id = p.account_id JOIN factor f ON f.account_id = p.account_id
  JOIN velocity v ON v.post_id = p.post_id LEFT JOIN comments k ON k.post_id = p.post_id{joined}),
s AS (SELECT *, CASE WHEN suspicious THEN 0.7::DOUBLE ELSE 0.2 END AS sb, CASE WHEN coordinated THEN 0.9::DOUBLE WHEN ua > 1 THEN 0.5 ELSE 0.1 END AS so,
  CASE WHEN suspicious_velocity THEN 0.8::DOUBLE ELSE 0.2 END AS se FROM r),
m AS (SELECT *, content_score * 0.35::DOUBLE + sb * 0.20::DOUBLE + so * 0.25::DOUBLE + cr * 0.10::DOUBLE + se * 0.05::DOUBLE + account_factor * 0.05::DOUBLE AS ms,
  least(0.95, 0.5::DOUBLE + least(0.4, CASE WHEN sim > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN tc > 0 THEN 0.2::DOUBLE ELSE 0 END
   + CASE WHEN total_posts_analyzed > 5 THEN 0.2::DOUBLE ELSE 0 END)) AS cf FROM s)
SELECT post_id, account_id, {x3('ms')} AS manipulation_score, {x3('cf')} AS confidence_score,
  CASE WHEN ms > 0.7 AND cf > 0.7 THEN 1 WHEN ms > 0.5 OR coordinated THEN 2 ELSE 3 END AS escalation_priority,
  so AS coordination_contribution, se AS temporal_contribution, content_score AS narrative_contribution, coordinated,
  coalesce(nullif(rtrim(CASE WHEN content_score > 0.5 AND emotional_score > 0.4 THEN '🎭 Эмоциональная манипуляция (оценка: ' || format('{{:.0f}}', emotional_score * 100) || '%); ' ELSE '' END
   || CASE WHEN content_score > 0.5 AND fallacies_score > 0.3 THEN '🔍 Логические ошибки в аргументации (' || format('{{:.0f}}', fallacies_score * 100) || '%); ' ELSE '' END
   || CASE WHEN content_score > 0.5 AND exclamation_count > 3 THEN '❗ Агрессивная пунктуация (' || exclamation_count || ' восклицаний); ' ELSE '' END
   || CASE WHEN suspicious THEN '🤖 Подозрительное поведение аккаунта: ' || reason || '; ' ELSE '' END
   || CASE WHEN coordinated THEN '🔄 Скоординированная кампания (' || ua || ' аккаунтов); ' ELSE '' END
   || CASE WHEN cr > 0.3 THEN '💬 Манипуляции в комментариях (' || format('{{:.0f}}', cr * 100) || '%); ' ELSE '' END
   || CASE WHEN suspicious_velocity THEN '⚡ Аномально высокая скорость вовлечения (' || engagement_rate_per_hour || '/час); ' ELSE '' END, '; '), ''),
   '✅ Явных признаков манипуляции не обнаружено') AS key_evidence,
  coalesce(nullif(rtrim(CASE WHEN emotional_score > 0.5 THEN '🎯 Апелляция к эмоциям; ' ELSE '' END || CASE WHEN fallacies_score > 0.4 THEN '🎯 Логическая уловка; ' ELSE '' END
   || CASE WHEN coordinated THEN '🎯 Скоординированная атака; ' ELSE '' END || CASE WHEN suspicious THEN '🎯 Автоматизированная активность; ' ELSE '' END
   || CASE WHEN caps_ratio > 0.3 THEN '🎯 Кричащий заголовок (CAPS LOCK); ' ELSE '' END || CASE WHEN exclamation_count > 5 THEN '🎯 Эмоциональное давление; ' ELSE '' END, '; '), ''),
   '🎯 Слабовыраженные признаки') AS tactics,
  CASE WHEN ms > 0.8 THEN 1 WHEN ms > 0.6 THEN 2 WHEN ms > 0.4 OR coordinated THEN 3 ELSE 4 END AS advice FROM m"""


STORED_REACH = "likes_count % 11 AS sim, reposts_count % 5 AS ua, reposts_count % 5 >= 3 AND likes_count % 11 >= 5 AS coordinated"


@query("t10_composite_scores", views="posts accounts", sql=composite_sql(STORED_REACH))
def t10(t: Tables):
    return composite_rows(P.composite_scores(t.posts_table(), t.accounts(), as_of(), stored_coordination(t), NEWEST, CHECKED, KEPT))


def composite_rows(out):
    mark = F.substring("recommendation", 1, 1)
    return out.select(
        "post_id", "account_id", "manipulation_score", "confidence_score", "escalation_priority", "coordination_contribution",
        "temporal_contribution", "narrative_contribution", "coordinated", F.array_join("key_evidence", "; ").alias("key_evidence"),
        F.array_join("tactics", "; ").alias("tactics"),
        F.when(mark == "🔴", 1).when(mark == "🟠", 2).when(mark == "🟡", 3).otherwise(4).alias("advice"))


SIMILAR_SQL = r"""
own AS (SELECT post_id, content, min(post_id) OVER (PARTITION BY content) AS text_id FROM posts WHERE coalesce(content, '') <> ''),
copies AS (SELECT text_id, count(*) AS n FROM own GROUP BY 1),
ws AS (SELECT post_id AS text_id, regexp_extract_all(lower(content), '[\p{L}\p{M}\p{N}_]{2,}') AS w FROM own WHERE post_id = text_id),
grams AS (SELECT text_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS term FROM ws),
counts AS (SELECT text_id, term, count(*) AS uses FROM grams GROUP BY 1, 2),
seen AS (SELECT term, sum(n) AS df FROM counts JOIN copies USING (text_id) GROUP BY 1),
weighted AS (SELECT text_id, term, df, uses * (ln((1.0::DOUBLE + (SELECT sum(n) FROM copies)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS raw FROM counts JOIN seen USING (term)),
norms AS (SELECT text_id, sqrt(sum(raw * raw)) AS norm FROM weighted GROUP BY 1),
vectors AS MATERIALIZED (SELECT text_id, term, df, raw / norm AS w FROM weighted JOIN norms USING (text_id)),
ahead AS MATERIALIZED (SELECT text_id, term FROM (SELECT text_id, term, sum(w * w) OVER (PARTITION BY text_id ORDER BY df DESC, term DESC ROWS UNBOUNDED PRECEDING) AS rest FROM vectors)
  WHERE rest >= 0.7::DOUBLE * 0.7::DOUBLE - 1e-9),
pairs AS (SELECT DISTINCT x.text_id AS a, y.text_id AS b FROM ahead x JOIN ahead y USING (term) WHERE x.text_id < y.text_id),
close AS (SELECT a, b, round(sum(x.w * y.w), 6) AS similarity FROM pairs JOIN vectors x ON x.text_id = a JOIN vectors y ON y.text_id = b AND y.term = x.term
  GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 6) > 0.7),
alike AS (SELECT a AS text_id, b AS other, similarity FROM close UNION ALL SELECT b, a, similarity FROM close UNION ALL SELECT text_id, text_id, 1.0::DOUBLE FROM copies),
similar_posts AS (SELECT p.post_id AS post_id, o.post_id AS similar_post_id, similarity,
  row_number() OVER (PARTITION BY p.post_id ORDER BY similarity DESC, o.post_id DESC)::INTEGER AS rank
  FROM own p JOIN alike USING (text_id) JOIN own o ON o.text_id = other WHERE p.post_id <> o.post_id QUALIFY rank <= 10)"""


@query("j13_similar_posts", views="posts", sql="WITH " + SIMILAR_SQL.strip() + " SELECT * FROM similar_posts")
def j13(t: Tables):
    return S.similar_posts(t.posts_table())


@query("t6_coordination_network", views="posts", sql="WITH " + SIMILAR_SQL.strip() + """
SELECT s.post_id AS post_id, count(*) AS similar_count, count(DISTINCT account_id) AS unique_accounts, count(DISTINCT account_id) >= 3 AND count(*) >= 5 AS coordinated
FROM similar_posts s JOIN posts p ON p.post_id = s.similar_post_id GROUP BY 1""")
def t6(t: Tables):
    posts = t.posts_table()
    return S.coordination_network(S.similar_posts(posts), t.posts(False))


NETWORK = """, net AS (SELECT s.post_id AS post_id, count(*) AS similar_count, count(DISTINCT account_id) AS unique_accounts FROM similar_posts s JOIN posts p ON p.post_id = s.similar_post_id GROUP BY 1), """
NETWORK_REACH = """coalesce(net.similar_count, 0) AS sim, coalesce(net.unique_accounts, 0) AS ua,
  coalesce(net.unique_accounts >= 3 AND net.similar_count >= 5, false) AS coordinated"""


@query("t10_composite_with_similarity", views="posts accounts", sql=composite_sql(
    NETWORK_REACH, " LEFT JOIN net ON net.post_id = p.post_id", SIMILAR_SQL.strip() + NETWORK))
def t10_full(t: Tables):
    posts = t.posts_table()
    network = S.coordination_network(S.similar_posts(posts), t.posts(False))
    return composite_rows(P.composite_scores(posts, t.accounts(), as_of(), network, NEWEST, CHECKED, KEPT))


TRG = r"""list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


@query("j14_trigram_lookup", views="posts", sql=f"""
WITH g AS (SELECT post_id, account_id, {TRG.format('content')} AS t FROM posts),
q AS (SELECT t AS qt FROM g WHERE post_id = (SELECT post_id FROM posts ORDER BY published_at DESC, post_id DESC LIMIT 1)),
s AS (SELECT post_id, account_id, len(list_intersect(t, qt)) AS sh, len(t) AS a, len(qt) AS b FROM g, q)
SELECT post_id, account_id, round(sh::DOUBLE / (a + b - sh), 6) AS similarity FROM s WHERE sh::DOUBLE / (a + b - sh) >= 0.3
ORDER BY sh::DOUBLE / (a + b - sh) DESC, post_id LIMIT 100""")
def j14(t: Tables):
    posts = t.posts()
    newest = S.newest_texts(posts, 1).select(X.trigrams(F.col("content")))
    out = S.trigram_lookup(posts.select("post_id", "account_id", "content"), newest.scalar())
    return out.select("post_id", "account_id", r6("similarity").alias("similarity"))


@query("j14_trigram_matches_of_a_case", views="posts", sql=f"""
WITH g AS (SELECT post_id, case_id, {TRG.format('content')} AS t FROM posts),
e AS MATERIALIZED (SELECT post_id, len(t) AS n, unnest(t) AS w FROM g), q AS MATERIALIZED (SELECT post_id AS target_id, len(t) AS m, unnest(t) AS w FROM g WHERE case_id = 7),
s AS (SELECT target_id, post_id, count(*) AS sh, any_value(n) AS a, any_value(m) AS b FROM e JOIN q USING (w) GROUP BY ALL),
j AS (SELECT target_id, post_id, sh::DOUBLE / (a + b - sh) AS similarity FROM s)
SELECT target_id, post_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY target_id ORDER BY j.similarity DESC, post_id)::INTEGER AS rank
FROM j WHERE j.similarity >= 0.3 QUALIFY rank <= 100""")
def j14_case(t: Tables):
    """All posts of a case at once, looked up among all posts."""
    posts = t.posts_table()
    out = S.trigram_matches(posts, posts.where("case_id = 7").select(F.col("post_id").alias("target_id"), "content"))
    return out.withColumn("similarity", r6("similarity"))


@query("n1_normal_forms", views="posts", sql=rf"""
WITH n AS (SELECT post_id, trim(regexp_replace(lower(content), '(?:https?://[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+|[^\p{{L}}\p{{N}}_@])+', ' ', 'g')) AS a,
 trim(regexp_replace(regexp_replace(lower(content), '[^\p{{L}}\p{{Nd}}\t-\r\x1c-\x20\x{{85}}\p{{Z}}]', '', 'g'), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g')) AS b,
 trim(regexp_replace(content, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g')) AS c, content FROM posts)
SELECT post_id, md5(a) AS normal_md5, md5(b) AS strict_md5, md5(c) AS collapsed_md5,
 len(list_distinct(list_filter(string_split(a, ' '), lambda w: length(w) > 2 AND NOT starts_with(w, '@')))) AS tokens,
 len(regexp_extract_all(content, '@[A-Za-z0-9_]+')) AS mentions, sha256(content) AS content_sha256 FROM n""")
def n1(t: Tables):
    c = F.col("content")
    return t.posts().select(
        "post_id", F.md5(X.normalise(c)).alias("normal_md5"), F.md5(X.normalise_strict(c)).alias("strict_md5"),
        F.md5(X.collapse_spaces(c)).alias("collapsed_md5"), F.size(X.tokens(X.words(c))).cast("bigint").alias("tokens"),
        X.mention_count(c).cast("bigint").alias("mentions"), F.sha2(c, 256).alias("content_sha256"))


@query("n4_link_hosts", views="post_links", sql=r"""
SELECT regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)', 1) AS net_location, domain, count(*) AS links,
  format('{:.1f}', count(*) / 7.0::DOUBLE) AS sevenths FROM post_links GROUP BY 1, 2""")
def n4(t: Tables):
    out = t.post_links().groupBy(X.net_location(F.lower("url")).alias("net_location"), "domain").agg(F.count("*").alias("links"))
    return out.withColumn("sevenths", fixed(F.col("links") / 7.0, 1))
