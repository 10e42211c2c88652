"""Thread features: one wide row per case, computed for all cases at once.

Every post is met by the few facts about its case it is compared with (root, first
event); this moves its token ids, once. Where the two meet, the posts of a case lie
together, so markers, overlaps and distinct tokens are summed there, and only small
long rows (case, kind, key) are moved again: one per author, parent and text of a post.
Two sums over those rows give all ratios. No step holds a whole thread in one task: the
meeting of post and case is salted for giant threads, whose distinct tokens are long rows
as well, and the time windows run over minutes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import lexicons as L, text as X
from tidemark.functions.scores import (
    clamp_sql, fixed, fixed3_sql, level_sql, ratio_sql, risk_level, round_exact, weighted_sql,
)
from tidemark.operators.reports import resolved_links
from tidemark.operators.skew import salted_join, totals_before
from tidemark.session import staged

FEATURE_VERSION, SCORE_VERSION = "case-features-v4", "case-score-v4"
FEATURE_VERSION_V1, SCORE_VERSION_V1 = "case-features-v1", "case-score-v1"

MINUTE = 60_000_000  # all times below are microseconds
COPY_OVERLAP, LEXICAL_JACCARD = 0.60, 0.40
FEW_ROOTS = 100_000  # ids that may be broadcast: under a megabyte

MARKERS = {
    "urgency": L.URGENCY_MARKERS,
    "claim": L.CLAIM_MARKERS,
    "denial": L.DENIAL_MARKERS,
    "question": L.QUESTION_MARKERS,
    "uncertainty": L.UNCERTAINTY_MARKERS,
}

# -- roots ----------------------------------------------------------------------------------------


def root_posts(posts: DataFrame) -> DataFrame:
    """Root and span of every case: the first post flagged as root, else the first post."""
    at = F.struct(F.unix_micros("published_at").alias("us"), "post_id", "account_id")
    first = F.min(at)
    flagged = F.min(F.when(F.col("is_case_root"), at))
    ends = posts.groupBy("case_id").agg(
        F.count("*").alias("event_count"), F.count_if(~F.col("is_case_root")).alias("reactions"),
        first.alias("first"), flagged.alias("flagged"),
        F.max(F.unix_micros("published_at")).alias("last_us"),
    )
    root = F.coalesce("flagged", "first")
    return ends.select(
        "case_id", "event_count", "reactions", F.col("first.us").alias("first_us"), "last_us",
        F.col("first.post_id").alias("first_post_id"), root["post_id"].alias("root_post_id"),
        root["us"].alias("root_us"), root["account_id"].alias("root_account_id"),
        F.col("flagged").isNotNull().alias("root_is_flagged"),
    )


def _with_root_texts(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots with tokens and markers of their texts (`in_roots`), and tokens of about SAMPLED_POSTS posts (`sampled`), in one reading.

    Flagged roots come from a filter pushed down to the posts. Cases without one are
    counted first: mostly there are none, and their texts are not looked for; a few
    are broadcast; many are met in a shuffled join. The sample goes by a hash of the post.
    """
    n = roots.agg(F.sum("event_count")).first()[0] or 1
    sampled = F.pmod(F.xxhash64("post_id", F.lit("sample")), F.lit(2**30)) < int(min(1.0, SAMPLED_POSTS / n) * 2**30)
    flagged = roots.where("root_is_flagged").select("case_id", F.col("root_post_id").alias("post_id"), F.lit(True).alias("is_lead"))
    read = posts.where(F.col("is_case_root") | sampled).select("case_id", "post_id", "is_case_root", "content", sampled.alias("sampled"))
    met = read.join(flagged.withColumn("is_case_root", F.lit(True)), ["case_id", "post_id", "is_case_root"], "left")
    texts = met.where("is_lead OR sampled").select("case_id", "content", "is_lead", "sampled")
    others = roots.where(~F.col("root_is_flagged")).select(F.col("root_post_id").alias("post_id"))
    n = others.count()
    if n:
        few = F.broadcast(others) if n <= FEW_ROOTS else others
        texts = texts.unionByName(posts.join(few, "post_id", "left_semi").select("case_id", "content", F.lit(True).alias("is_lead"), F.lit(False).alias("sampled")))
    lowered = texts.withColumn("lowered", F.lower(F.coalesce("content", F.lit(""))))
    known = lowered.select(
        "case_id", "is_lead", "sampled", X.token_ids(X.words_of_lowered(F.col("lowered"))).alias("root_tokens"),
        *[X.contains_any(F.col("lowered"), MARKERS[m]).cast("double").alias(f"root_{m}_flag")
          for m in ("question", "uncertainty", "claim", "denial")],
    )
    return roots.withColumns({"is_lead": F.lit(True), "in_roots": F.lit(True)}).join(known, ["case_id", "is_lead"], "full")


# -- times ----------------------------------------------------------------------------------------


def time_profile(posts: DataFrame, roots: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Most posts in any trailing window, and the median reaction time, per case.

    A post enters at its time and leaves one microsecond after its window. The
    running balance of entries and leaves at a time is the number of posts in the
    window that ends there. Running sums go by minute first, so a thread with a
    third of all posts is as many small groups as it has busy minutes.
    """
    us = F.unix_micros("published_at")
    names = list(windows)
    zero = [F.lit(0).alias(n) for n in names]
    enter = F.struct(us.alias("at"), (~F.col("is_case_root")).cast("int").alias("reaction"), *[F.lit(1).alias(n) for n in names])
    leaves = [
        F.struct((us + (size + 1)).alias("at"), F.lit(0).alias("reaction"),
                 *[F.lit(-1).alias(n) if n == name else z for n, z in zip(names, zero)])
        for name, size in windows.items()
    ]
    steps = (
        posts.select("case_id", F.explode(F.array(enter, *leaves)).alias("e")).select("case_id", "e.*")
        .withColumn("minute", F.floor(F.col("at") / MINUTE))
        # moved once: the sums by time and by minute and the windows of a minute need no other order
        .repartition("case_id", "minute")
        .groupBy("case_id", "minute", "at")
        .agg(*[F.sum(c).alias(c) for c in ["reaction", *names]])
    )
    running = totals_before(steps, ["case_id"], [["minute"], ["at"]], ["reaction", *names])
    placed = salted_join(
        running, roots.select("case_id", "reactions"), ["case_id"], "at",
        counts=roots.select("case_id", F.col("event_count").alias("__n")),
    )
    reached = F.col("reaction__before") + F.col("reaction")
    holds = lambda k: F.max(F.when((F.col("reaction__before") < k) & (reached >= k), F.col("at")))
    low, high = F.floor((F.col("reactions") + 1) / 2), F.floor(F.col("reactions") / 2) + 1
    peaks = placed.groupBy("case_id").agg(
        *[F.max(F.col(f"{n}__before") + F.col(n)).alias(n) for n in names],
        holds(low).alias("low_at"), holds(high).alias("high_at"),
    )
    delay = lambda c: F.greatest(F.col(c) - F.col("root_us"), F.lit(0))
    return peaks.join(roots.select("case_id", "root_us"), "case_id").select(
        "case_id", *names,
        F.coalesce((delay("low_at") + delay("high_at")) / 2 / 1e6, F.lit(0.0)).alias("median_reaction_delay_seconds"),
    )


# -- long rows ------------------------------------------------------------------------------------


# Kinds are numbers in the rows: a fixed-width key makes the sums over them much cheaper.
KINDS = [
    "token", "account", "early_account", "parent", "to_root", "deep", "reply", "text", "first_10m", "first_30m", "first_60m",
    "by_root_author", "retweet", "jaccard", "overlap", "copy", "lexical", "tag", "url", "domain", "token_uses", "token_kinds", "common_token", *MARKERS,
    "common_token_2", "common_token_3", "common_token_4",
]
#: Posts of a case that one task may hold at a time, as small facts and token ids.
POSTS_PER_PART = 2_000
#: Tokens of a page; those of PAGES pages are moved as two bytes, all others keep their 64-bit ids.
COMMON_TOKENS = 2**16
PAGES = 4
#: Posts whose tokens are counted to find the frequent ones.
SAMPLED_POSTS = 10_000


def token_pages(tokens: Column, df: DataFrame, pages: int = PAGES) -> list[list[int]]:
    """Tables of frequent token ids. A token's slot is its lowest 16 bits; the first table has the most frequent token of each slot, the second
    the next one, and so on; 0 or 1, which has another slot, where there is none.

    Whatever they hold, `split_tokens` loses nothing: they only decide how many bytes a token takes.
    """
    slot = F.col("token").bitwiseAND(F.lit(COMMON_TOKENS - 1)).alias("slot")
    counted = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("slot").orderBy(F.desc("n"), F.desc("token"))
    best = counted.select("token", "n", slot).withColumn("page", F.row_number().over(order)).where(F.col("page") <= pages)
    out = [[1] + [0] * (COMMON_TOKENS - 1) for _ in range(pages)]
    for page, at, token in best.select("page", "slot", "token").collect():  # pages x COMMON_TOKENS rows at most
        out[page - 1][at] = token
    return out


def common_tokens(tokens: Column, df: DataFrame) -> list[int]:
    """The first of `token_pages`."""
    return token_pages(tokens, df, 1)[0]


def page_names(pages: int) -> list[str]:
    return ["common", *[f"common_{k}" for k in range(2, pages + 1)]][:pages]


def split_tokens(tokens: Column, *pages: list[int]) -> Column:
    """Token ids as slots of each page's tokens and ids of the rest. Equal tokens stay equal, others different; null stays null."""
    names = [*page_names(len(pages)), "rare"]

    @F.arrow_udf(", ".join([*[f"{name} array<smallint>" for name in names[:-1]], "rare array<bigint>"]))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        known = np.array(pages, dtype=np.int64)
        size = known.shape[1]
        for batch in batches:
            ids = batch.flatten().to_numpy(zero_copy_only=False)
            slots = ids & (size - 1)
            ends = np.concatenate([[0], np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            mask = batch.is_null() if batch.null_count else None
            rest = np.ones(len(ids), dtype=bool)
            parts = []

            def add(which, values):
                at = np.concatenate([[0], np.cumsum(which)])[ends]
                parts.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values[which]), mask=mask))

            for page in known:
                found = page[slots] == ids
                rest &= ~found
                add(found, (slots - size // 2).astype(np.int16))
            add(rest, ids)
            yield pa.StructArray.from_arrays(parts, names)

    return split(tokens)


def _code(kind: str) -> str:
    return f"{KINDS.index(kind)}Y"


def _row(kind: str, key: str = "0", n: str = "1", reactions: str = "0", total: str = "null", top: str = "null") -> str:
    """One long row as SQL text."""
    return (f"struct({_code(kind)} AS kind, cast({key} AS bigint) AS key, cast({n} AS bigint) AS n, cast({reactions} AS bigint) AS reactions, "
            f"cast({total} AS double) AS total, cast({top} AS double) AS top)")


def _part_rows(met: DataFrame, keys: dict[str, tuple[str, str]], counts: dict[str, str], reaction: str, values: dict[str, tuple[str, str]],
               tokens: str | dict[str, str] | None = None) -> DataFrame:
    """Long rows of the posts of each (case, __salt), which lie together after the join.

    `keys` (kind -> key, condition) are a row per post; `counts` (kind -> condition) and `values` (kind -> value, condition)
    are summed here. `tokens` (kind -> ids) are made distinct here, so only those of a case in several parts become rows.
    """
    heads = ", ".join(f"CASE WHEN {when} THEN {key} END AS k_{kind}, coalesce({when}, false) AS h_{kind}" for kind, (key, when) in keys.items())
    sums = [F.expr(f"collect_list(struct({heads}))").alias("heads"), F.max("__salts").alias("parts")]
    out = []
    for kind, when in counts.items():
        sums += [F.expr(f"count_if({when})").alias(f"n_{kind}"), F.expr(f"count_if(({when}) AND {reaction})").alias(f"r_{kind}")]
        out.append(_row(kind, n=f"n_{kind}", reactions=f"r_{kind}"))
    for kind, (value, when) in values.items():
        held = f"CASE WHEN {when} THEN {value} END"
        sums += [F.expr(f"{what}").alias(f"{c}_{kind}") for c, what in (("n", f"count_if({when})"), ("s", f"sum({held})"), ("t", f"max({held})"))]
        out.append(_row(kind, n=f"n_{kind}", total=f"s_{kind}", top=f"t_{kind}"))
    if isinstance(tokens, str):
        tokens = {"token": tokens}
    if tokens:
        sums.append(F.expr(f"sum({' + '.join(f'size({ids})' for ids in tokens.values())})").alias("token_uses"))
        sums += [F.collect_list(ids).alias(f"l_{kind}") for kind, ids in tokens.items()]
    parts = met.groupBy("case_id", "__salt").agg(*sums)
    items = [f"array({', '.join(out)})"]
    items += [f"transform(filter(heads, h -> h.h_{kind}), h -> {_row(kind, f'h.k_{kind}')})" for kind in keys]
    if tokens:
        parts = parts.withColumns({f"d_{kind}": F.array_distinct(F.flatten(f"l_{kind}")) for kind in tokens})
        kinds = " + ".join(f"size(d_{kind})" for kind in tokens)
        items[0] = f"array({', '.join([*out, _row('token_uses', n='token_uses'), _row('token_kinds', n=f'CASE WHEN parts = 1 THEN {kinds} ELSE 0 END')])})"
        items += [f"transform(CASE WHEN parts > 1 THEN d_{kind} ELSE slice(d_{kind}, 1, 0) END, t -> {_row(kind, 't')})" for kind in tokens]
    return parts.selectExpr("case_id", f"explode(concat({', '.join(items)})) AS r").select("case_id", "r.*")


def _summed(long: DataFrame) -> DataFrame:
    """(case, kind, key) -> n posts, n reactions, sum and max of the value."""
    return long.groupBy("case_id", "kind", "key").agg(
        F.sum("n").alias("n"), F.sum("reactions").alias("reactions"), F.sum("total").alias("total"), F.max("top").alias("top"))


def _child_rows(posts: DataFrame, tags: DataFrame, links: DataFrame, keep_blank_tag: bool, domains: bool) -> DataFrame:
    """Long rows of the tags and links, taken from the child tables."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    tag = clean(F.col("tag"))
    rows = tags.select("post_id", F.expr(_code("tag")).alias("kind"), tag.alias("value"))
    if not keep_blank_tag:
        rows = rows.where(F.col("value") != "")
    link = clean(F.col("link"))
    linked = resolved_links(links).select("post_id", link.alias("link")).where(F.col("link") != "")
    rows = rows.unionByName(linked.select("post_id", F.expr(_code("url")).alias("kind"), F.col("link").alias("value")))
    if domains:
        host = linked.select("post_id", F.expr(_code("domain")).alias("kind"), X.net_location(F.col("link")).alias("value"))
        rows = rows.unionByName(host.where(F.col("value") != ""))
    hashed = rows.select("post_id", "kind", F.xxhash64("value").alias("key"))
    return hashed.join(posts.select("post_id", "case_id"), "post_id").selectExpr(
        "case_id", "kind", "key", "1L AS n", "0L AS reactions", "cast(null AS double) AS total", "cast(null AS double) AS top")


def _total(kind: str, what: str = "n") -> str:
    return f"coalesce(sum(CASE WHEN kind = {_code(kind)} THEN {what} END), 0)"


def _most(kind: str, what: str = "n") -> str:
    return f"coalesce(max(CASE WHEN kind = {_code(kind)} THEN {what} END), 0)"


def _distinct(kind: str) -> str:
    return f"count_if(kind = {_code(kind)})"


def _per_case(keyed: DataFrame, columns: dict[str, str]) -> DataFrame:
    return keyed.groupBy("case_id").agg(*[F.expr(sql).alias(name) for name, sql in columns.items()])


# -- version 4 ------------------------------------------------------------------------------------


def case_features(posts: DataFrame, tags: DataFrame, links: DataFrame, account_scores: DataFrame | None = None) -> DataFrame:
    """All version 4 features and scores. `account_scores` (case_id, account_id, bot_score) is optional."""
    roots = staged(root_posts(posts), "roots")
    read = staged(_with_root_texts(posts, roots), "root-texts")
    anchor = read.where("in_roots").drop("is_lead", "in_roots", "sampled")
    pages = token_pages(F.col("root_tokens"), read.where("sampled"))
    lists = [*page_names(PAGES), "rare"]
    kinds = dict(zip(["common_token", *[f"common_token_{k}" for k in range(2, PAGES + 1)], "token"], lists))
    facts = anchor.withColumn("split", split_tokens(F.col("root_tokens"), *pages)).select(
        "case_id", "first_us", "first_post_id", "root_post_id", "root_us", "root_account_id", *[F.col(f"split.{c}").alias(f"root_{c}") for c in lists])

    lowered = posts.select(
        "case_id", "post_id", "account_id", "reply_to_post_id", F.col("is_case_root").alias("is_root"),
        F.unix_micros("published_at").alias("us"), F.lower(F.coalesce("content", F.lit(""))).alias("lowered"),
    )
    flags = [m for m in MARKERS]
    prepared = lowered.withColumn("words", X.words_of_lowered(F.col("lowered"))).select(
        "case_id", "post_id", "account_id", "reply_to_post_id", "is_root", "us",
        F.when(F.size("words") > 0, F.xxhash64("words")).alias("text_id"),
        X.token_ids(F.col("words")).alias("tokens"),
        *[X.contains_any(F.col("lowered"), MARKERS[m]).alias(m) for m in flags],
        X.leads_with(F.col("lowered"), L.RETWEET_PREFIXES).alias("retweet"),
    )
    prepared = prepared.withColumn("split", split_tokens(F.col("tokens"), *pages)).select("*", "split.*").drop("tokens", "split")
    counts = roots.select("case_id", F.col("event_count").alias("__n"))
    met = salted_join(prepared, facts, ["case_id"], "post_id", counts=counts, rows_per_salt=POSTS_PER_PART, keep_salts=True)

    added = lambda term: " + ".join(term.format(c) for c in lists)
    measured = met.selectExpr(
        "*", f"{added('size({0})')} AS uses", f"{added('size(root_{0})')} AS root_uses"
    ).selectExpr(
        "*", f"CASE WHEN uses > 0 AND root_uses > 0 THEN {added('size(array_intersect({0}, root_{0}))')} ELSE 0 END AS shared"
    ).selectExpr(
        "*",
        "CASE WHEN shared > 0 THEN shared / (uses + root_uses - shared) ELSE 0D END AS jaccard",
        "CASE WHEN shared > 0 THEN shared / least(uses, root_uses) ELSE 0D END AS overlap",
    )
    compared = "NOT is_root AND root_uses > 0"
    long = _part_rows(measured, {
        "account": ("account_id", "true"),
        "early_account": ("account_id", f"account_id <> 0 AND us <= root_us + {30 * MINUTE}"),
        "parent": ("reply_to_post_id", "reply_to_post_id IS NOT NULL"),
        "text": ("text_id", "text_id IS NOT NULL"),
    }, {
        "to_root": "reply_to_post_id = root_post_id",
        "deep": "reply_to_post_id <> root_post_id",
        **{f"first_{m}m": f"us - first_us <= {m * MINUTE}" for m in (10, 30, 60)},
        "by_root_author": "NOT is_root AND account_id <> 0 AND account_id = root_account_id",
        "retweet": "retweet",
        "copy": f"{compared} AND overlap >= {COPY_OVERLAP}D",
        "lexical": f"root_uses > 0 AND post_id <> first_post_id AND jaccard >= {LEXICAL_JACCARD}D",
        **{m: m for m in flags},
    }, "NOT is_root", {"jaccard": ("jaccard", compared), "overlap": ("overlap", compared)}, kinds)
    keyed = _summed(long.unionByName(_child_rows(posts, tags, links, keep_blank_tag=False, domains=True)))

    counts_per_case = _per_case(keyed, {
        "unique_account_count": _distinct("account"), "unique_url_count": _distinct("url"),
        "unique_domain_count": _distinct("domain"), "unique_hashtag_count": _distinct("tag"),
        "unique_reply_parent_count": _distinct("parent"),
        "max_author_posts": _most("account"), "single_authors": f"count_if(kind = {_code('account')} AND n = 1)",
        "early_accounts": _distinct("early_account"),
        "replies": _total("parent"), "max_parent": _most("parent"),
        "duplicate_posts": f"{_total('text')} - {_distinct('text')}",
        "url_refs": _total("url"), "domain_refs": _total("domain"),
        **{k: _total(k) for k in ("to_root", "deep", "first_10m", "first_30m", "first_60m", "by_root_author", "retweet", "copy", "lexical", *flags)},
        **{f"{k}_n": _total(k) for k in ("jaccard", "overlap")},
        **{f"{k}_total": _total(k, "total") for k in ("jaccard", "overlap")},
        **{f"root_{k}_max": _most(k, "top") for k in ("jaccard", "overlap")},
        **{f"reaction_{m}": _total(m, "reactions") for m in ("question", "uncertainty", "denial")},
        "token_uses": _total("token_uses"), "token_kinds": " + ".join([*map(_distinct, kinds), _total("token_kinds")]),
    })
    times = time_profile(posts, roots, {"peak_10m": 10 * MINUTE, "peak_30m": 30 * MINUTE})
    joined = anchor.selectExpr("* EXCEPT (root_tokens)", "cast(coalesce(size(root_tokens), 0) AS double) AS root_token_count").join(
        counts_per_case, "case_id").join(times, "case_id")
    bots = bot_profile(roots, account_scores) if account_scores is not None else None
    return score_case(joined, bots)


# Span, density and gaps. Gaps of sorted times add up to the span, so no ordering is needed.
SPAN_SQL = {
    "activity_density": clamp_sql("event_count / (greatest(time_span_seconds / 3600D, 1D / 60D) * 10D)"),
    "gap_intensity": clamp_sql(
        "1800D / greatest(CASE WHEN event_count > 1 AND time_span_seconds > 0 THEN time_span_seconds / (event_count - 1) ELSE 3600D END, 60D)"),
}


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def _with_basics(df: DataFrame) -> DataFrame:
    out = _with(df, {
        "time_span_seconds": "greatest((last_us - first_us) / 1000000D, 0D)",
        "others": "greatest(event_count - 1, 1)",
    })
    return _with(out, SPAN_SQL)


V4_WEIGHTS = {
    "temporal_score": {
        "first_window_share": 0.20, "first_30m_share": 0.15, "peak_30m_share": 0.20, "activity_density": 0.20,
        "gap_intensity": 0.15, "median_reaction_delay_score": 0.10,
    },
    "coordination_score": {
        "author_concentration": 0.18, "repeated_author_share": 0.12, "duplicate_text_ratio": 0.18,
        "repeated_url_ratio": 0.10, "repeated_domain_ratio": 0.10, "lexical_similarity_ratio": 0.12,
        "reply_parent_concentration": 0.12, "root_reply_share": 0.10, "early_actor_share": 0.08,
    },
    "content_score": {
        "urgency_marker_ratio": 0.13, "claim_marker_ratio": 0.15, "denial_marker_ratio": 0.10,
        "lexical_repetition_ratio": 0.12, "question_marker_ratio": 0.17, "uncertainty_marker_ratio": 0.17,
        "root_uncertainty_flag": 0.08, "root_claim_flag": 0.08,
    },
    "discussion_score": {
        "reaction_question_ratio": 0.25, "reaction_uncertainty_ratio": 0.25, "reaction_denial_ratio": 0.12,
        "direct_reply_ratio": 0.16, "deep_reply_ratio": 0.10, "thread_branching_factor": 0.12,
    },
    "broadcast_relief": {
        "root_copy_ratio": 0.35, "retweet_style_ratio": 0.20, "repeated_domain_ratio": 0.15,
        "root_jaccard_mean": 0.15, "root_author_reaction_share": 0.15,
    },
}
V4_RISK = {"temporal_score": 0.18, "coordination_score": 0.22, "content_score": 0.33, "discussion_score": 0.27, "broadcast_relief": -0.22}
V4_EVIDENCE = [
    "temporal_score", "coordination_score", "content_score", "discussion_score", "question_marker_ratio",
    "uncertainty_marker_ratio", "reaction_question_ratio", "reaction_uncertainty_ratio", "peak_30m_share",
    "reply_parent_concentration", "root_copy_ratio", "retweet_style_ratio",
]
TEMPORAL_FEATURES = [
    "first_window_share", "first_10m_share", "first_30m_share", "peak_10m_share", "peak_30m_share", "activity_density",
    "gap_intensity", "median_reaction_delay_seconds", "median_reaction_delay_score", "early_actor_share", "reply_ratio",
    "time_span_seconds",
]
COORDINATION_FEATURES = [
    "author_concentration", "author_singleton_share", "repeated_author_share", "direct_reply_ratio", "deep_reply_ratio",
    "root_reply_share", "reply_parent_concentration", "thread_branching_factor", "root_author_reaction_share",
    "duplicate_text_ratio", "lexical_similarity_ratio", "root_jaccard_mean", "root_jaccard_max", "root_overlap_mean",
    "root_overlap_max", "repeated_url_ratio", "repeated_domain_ratio", "root_copy_ratio", "retweet_style_ratio",
    "broadcast_relief",
]
CONTENT_FEATURES = [
    "urgency_marker_ratio", "claim_marker_ratio", "denial_marker_ratio", "question_marker_ratio",
    "uncertainty_marker_ratio", "reaction_question_ratio", "reaction_uncertainty_ratio", "reaction_denial_ratio",
    "lexical_repetition_ratio", "avg_token_count", "root_token_count", "lexical_diversity", "root_question_flag",
    "root_uncertainty_flag", "root_claim_flag", "root_denial_flag", "discussion_score",
]
BOT_FEATURES = [
    "bot_account_count", "bot_score_mean", "bot_score_max", "bot_high_share", "root_author_bot_score",
    "bot_top_score_1", "bot_top_score_2", "bot_top_score_3",
]
COUNT_FEATURES = [
    "event_count", "unique_account_count", "unique_url_count", "unique_domain_count", "unique_hashtag_count",
    "unique_reply_parent_count", "reply_tree_available",
]
SCORES = ["temporal_score", "coordination_score", "content_score"]


def score_case(counts: DataFrame, bots: DataFrame | None = None) -> DataFrame:
    """Ratios, component scores, risk, confidence and evidence from the per-case counts."""
    shares = {
        "first_window_share": ratio_sql("first_60m", "event_count"),
        "first_10m_share": ratio_sql("first_10m", "event_count"),
        "first_30m_share": ratio_sql("first_30m", "event_count"),
        "peak_10m_share": ratio_sql("peak_10m", "event_count"),
        "peak_30m_share": ratio_sql("peak_30m", "event_count"),
        "median_reaction_delay_score": clamp_sql("3600D / greatest(median_reaction_delay_seconds, 60D)"),
        "early_actor_share": ratio_sql("early_accounts", "unique_account_count"),
        "author_concentration": ratio_sql("max_author_posts", "event_count"),
        "author_singleton_share": ratio_sql("single_authors", "unique_account_count"),
        "repeated_author_share": ratio_sql("unique_account_count - single_authors", "unique_account_count"),
        "reply_ratio": ratio_sql("replies", "others"),
        "direct_reply_ratio": ratio_sql("to_root", "others"),
        "deep_reply_ratio": ratio_sql("deep", "others"),
        "root_reply_share": ratio_sql("to_root", "replies"),
        "reply_parent_concentration": ratio_sql("max_parent", "replies"),
        "thread_branching_factor": ratio_sql("unique_reply_parent_count", "others"),
        "root_author_reaction_share": ratio_sql("by_root_author", "others"),
        "duplicate_text_ratio": ratio_sql("duplicate_posts", "event_count"),
        "lexical_repetition_ratio": ratio_sql("duplicate_posts", "event_count"),
        "lexical_similarity_ratio": ratio_sql("lexical", "others"),
        "root_jaccard_mean": "CASE WHEN jaccard_n > 0 THEN jaccard_total / jaccard_n ELSE 0D END",
        "root_overlap_mean": "CASE WHEN overlap_n > 0 THEN overlap_total / overlap_n ELSE 0D END",
        "root_copy_ratio": ratio_sql("copy", "others"),
        "retweet_style_ratio": ratio_sql("retweet", "others"),
        "repeated_url_ratio": ratio_sql("url_refs - unique_url_count", "url_refs"),
        "repeated_domain_ratio": ratio_sql("domain_refs - unique_domain_count", "url_refs"),
        **{f"{m}_marker_ratio": ratio_sql(m, "event_count") for m in MARKERS},
        **{f"reaction_{m}_ratio": ratio_sql(f"reaction_{m}", "others") for m in ("question", "uncertainty", "denial")},
        "avg_token_count": "token_uses / event_count",
        "lexical_diversity": ratio_sql("token_kinds", "token_uses"),
        "reply_tree_available": "CASE WHEN unique_reply_parent_count > 0 THEN 1D ELSE 0D END",
    }
    out = _with(_with_basics(counts), shares)
    out = _with(out, {name: clamp_sql(weighted_sql(terms)) for name, terms in V4_WEIGHTS.items()})
    out = _with(out, {
        "risk_score": clamp_sql(weighted_sql(V4_RISK)),
        "confidence_score": "least(0.95D, 0.5D + 0.18D * " + clamp_sql("event_count / 12D")
                            + " + 0.27D * greatest(content_score, discussion_score, coordination_score))",
    })
    if bots is None:
        out = _with(out, {b: "0D" for b in BOT_FEATURES})
    else:
        out = out.join(bots, "case_id", "left").na.fill(0.0, BOT_FEATURES)
    extra = [("bot_score_max", 0.60), ("bot_high_share", 0.30), ("broadcast_relief", 0.30)]
    more = f"array_compact(array({', '.join(f'CASE WHEN {n} >= {least}D THEN struct({n!r} AS name, {n} AS value) END' for n, least in extra)}))"
    chosen = f"concat({top_values(V4_EVIDENCE, 4, 0.18)}, {more})"
    out = _with(out, {"risk_level": level_sql("risk_score"), "evidence": evidence_lines(chosen)})
    kept = dict.fromkeys([
        "case_id", "root_post_id", *COUNT_FEATURES, *TEMPORAL_FEATURES, *COORDINATION_FEATURES, *CONTENT_FEATURES, *BOT_FEATURES,
        *SCORES, "risk_score", "risk_level", "confidence_score", "evidence",
    ])
    return out.selectExpr(*kept, f"'{FEATURE_VERSION}' AS feature_version", f"'{SCORE_VERSION}' AS score_version")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), fixed(value, 3))


def top_values(names: list[str], limit: int, least: float) -> str:
    """The `limit` largest values in listed order on ties, without those below `least`: array of (name, value)."""
    items = ", ".join(f"struct(-{n} AS rank, {i} AS i, '{n}' AS name, {n} AS value)" for i, n in enumerate(names))
    first = f"slice(sort_array(array({items})), 1, {limit})"
    return f"transform(filter({first}, e -> e.value >= {least}D), e -> struct(e.name AS name, e.value AS value))"


def evidence_lines(items: str) -> str:
    """'name=0.123' for each (name, value)."""
    return f"transform({items}, e -> concat(e.name, '=', {fixed3_sql('e.value')}))"


def bot_profile(roots: DataFrame, account_scores: DataFrame) -> DataFrame:
    """Summary of the account scores per case. The top three come from a row-number filter."""
    w = Window.partitionBy("case_id").orderBy(F.desc("bot_score"), F.asc("account_id"))
    top = (
        account_scores.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
        .groupBy("case_id").agg(*[
            F.coalesce(F.max(F.when(F.col("rank") == k, round_exact(F.col("bot_score"), 6))), F.lit(0.0)).alias(f"bot_top_score_{k}")
            for k in (1, 2, 3)])
    )
    s = F.col("bot_score")
    summary = account_scores.groupBy("case_id").agg(
        F.count("*").cast("double").alias("bot_account_count"), round_exact(F.avg(s), 6).alias("bot_score_mean"),
        round_exact(F.max(s), 6).alias("bot_score_max"), round_exact(F.avg((s >= 0.5).cast("double")), 6).alias("bot_high_share"),
    )
    of_root = roots.where("root_is_flagged").select("case_id", F.col("root_account_id").alias("account_id")).join(
        account_scores, ["case_id", "account_id"]
    ).select("case_id", round_exact(F.col("bot_score"), 6).alias("root_author_bot_score"))
    return summary.join(top, "case_id").join(of_root, "case_id", "left")


# -- version 1 ------------------------------------------------------------------------------------

V1_WEIGHTS = {
    "temporal_score": {"first_window_share": 0.40, "activity_density": 0.35, "gap_intensity": 0.25},
    "coordination_score": {
        "author_concentration": 0.35, "duplicate_text_ratio": 0.25, "repeated_url_ratio": 0.20, "reply_ratio": 0.20},
    "content_score": {
        "urgency_marker_ratio": 0.40, "claim_marker_ratio": 0.30, "denial_marker_ratio": 0.15, "lexical_repetition_ratio": 0.15},
}
V1_RISK = {"coordination_score": 0.40, "temporal_score": 0.35, "content_score": 0.25}
V1_EVIDENCE = [
    "first_window_share", "activity_density", "gap_intensity", "author_concentration", "reply_ratio",
    "duplicate_text_ratio", "repeated_url_ratio", "urgency_marker_ratio", "claim_marker_ratio", "denial_marker_ratio",
    "lexical_repetition_ratio",
]


def case_features_v1(posts: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """The smaller baseline scorer."""
    roots = staged(root_posts(posts), "roots")
    lowered = posts.select(
        "case_id", "post_id", "account_id", "reply_to_post_id", F.unix_micros("published_at").alias("us"),
        F.lower(F.coalesce("content", F.lit(""))).alias("lowered"),
    )
    flags = ("urgency", "claim", "denial")
    prepared = lowered.withColumn("normal", X.strict_of_lowered(F.col("lowered"))).select(
        "case_id", "post_id", "account_id", "reply_to_post_id", "us",
        F.when(F.col("normal") != "", F.xxhash64("normal")).alias("text_id"),
        *[X.contains_any(F.col("lowered"), MARKERS[m]).alias(m) for m in flags],
    )
    met = salted_join(
        prepared, roots.select("case_id", "first_us"), ["case_id"], "post_id",
        counts=roots.select("case_id", F.col("event_count").alias("__n")), rows_per_salt=POSTS_PER_PART, keep_salts=True,
    )
    long = _part_rows(met, {"account": ("account_id", "true"), "text": ("text_id", "text_id IS NOT NULL")}, {
        "reply": "reply_to_post_id IS NOT NULL", "first_60m": f"us - first_us <= {60 * MINUTE}", **{m: m for m in flags}}, "false", {})
    keyed = _summed(long.unionByName(_child_rows(posts, tags, links, keep_blank_tag=True, domains=False)))
    counts = _per_case(keyed, {
        "unique_account_count": _distinct("account"), "unique_url_count": _distinct("url"),
        "unique_hashtag_count": _distinct("tag"), "max_author_posts": _most("account"), "replies": _total("reply"),
        "duplicate_posts": f"{_total('text')} - {_distinct('text')}", "url_refs": _total("url"),
        "first_60m": _total("first_60m"), **{m: _total(m) for m in flags},
    })
    out = _with(_with_basics(roots.join(counts, "case_id")), {
        "first_window_share": ratio_sql("first_60m", "event_count"),
        "author_concentration": ratio_sql("max_author_posts", "event_count"),
        "reply_ratio": ratio_sql("replies", "others"),
        "duplicate_text_ratio": ratio_sql("duplicate_posts", "event_count"),
        "lexical_repetition_ratio": ratio_sql("duplicate_posts", "event_count"),
        "repeated_url_ratio": ratio_sql("url_refs - unique_url_count", "url_refs"),
        **{f"{m}_marker_ratio": ratio_sql(m, "event_count") for m in flags},
    })
    out = _with(out, {name: clamp_sql(weighted_sql(terms)) for name, terms in V1_WEIGHTS.items()})
    out = _with(out, {"risk_score": clamp_sql(weighted_sql(V1_RISK))})
    return out.selectExpr(
        "case_id", "event_count", "unique_account_count", "unique_url_count", "unique_hashtag_count", "time_span_seconds",
        *V1_EVIDENCE, *SCORES, "risk_score", level_sql("risk_score") + " AS risk_level",
        evidence_lines(top_values(V1_EVIDENCE, 3, 0.20)) + " AS evidence",
        f"'{FEATURE_VERSION_V1}' AS feature_version", f"'{SCORE_VERSION_V1}' AS score_version",
    )


# -- views on the features ------------------------------------------------------------------------


def pipeline_hash(version: str, weights: dict[str, dict[str, float]], risk: dict[str, float]) -> Column:
    """A stable hash of the versions and weights a score was made with."""
    parts = [version] + [
        f"{name}=" + ",".join(f"{w:.2f}*{f}" for f, w in terms.items()) for name, terms in {**weights, "risk": risk}.items()
    ]
    return F.sha2(F.lit("|".join(parts)), 256)


FEATURE_GROUPS = {"temporal": TEMPORAL_FEATURES, "coordination": COORDINATION_FEATURES, "content": CONTENT_FEATURES}
MODEL_FEATURES = sorted(dict.fromkeys([
    *COUNT_FEATURES, *TEMPORAL_FEATURES, *COORDINATION_FEATURES, *CONTENT_FEATURES, *BOT_FEATURES, *SCORES]))
NOT_FEATURES = {"case_id", "root_post_id", "external_case_id", "root_username", "scoring_source"}


def feature_rows(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Long form (case_id, name, value): numeric columns only, identifiers and NaN or infinite values dropped."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    chosen = [f.name for f in features.schema.fields
              if f.dataType.simpleString() in numeric and f.name not in NOT_FEATURES and (names is None or f.name in names)]
    long = features.select("case_id", *[F.col(c).cast("double").alias(c) for c in chosen]).unpivot("case_id", chosen, "name", "value")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return long.where(finite)


def top_features(features: DataFrame, limit: int = 8) -> DataFrame:
    """The features of largest absolute value per case, in group order on ties."""
    items = [(g, name) for g, names in FEATURE_GROUPS.items() for name in names]
    rows = ", ".join(
        f"CASE WHEN {n} IS NOT NULL AND NOT isnan({n}) THEN struct(-abs({n}) AS rank, {i} AS i, '{g}' AS feature_group, '{n}' AS name, {n} AS value) END"
        for i, (g, n) in enumerate(items)
    )
    return features.selectExpr("case_id", f"posexplode(slice(sort_array(array_compact(array({rows}))), 1, {limit})) AS (p, e)").selectExpr(
        "case_id", "p + 1 AS position", "e.feature_group", "e.name", "e.value")


SIGNALS = [
    ("first_10m_share", 0.50, "early burst in first 10 minutes"),
    ("first_30m_share", 0.70, "early burst in first 30 minutes"),
    ("peak_10m_share", 0.50, "high peak activity in a 10 minute window"),
    ("author_concentration", 0.30, "activity concentrated among few authors"),
    ("unique_domain_count", 3.0, "multiple linked domains"),
    ("root_jaccard_mean", 0.20, "reaction text overlaps with root claim"),
    ("reply_tree_available", 0.50, "reply tree is available"),
    ("root_uncertainty_flag", 0.50, "root contains uncertainty marker"),
    ("root_claim_flag", 0.50, "root contains claim marker"),
    ("root_denial_flag", 0.50, "root contains denial/debunk marker"),
    ("urgency_marker_ratio", 0.20, "urgency markers are frequent"),
    ("denial_marker_ratio", 0.20, "denial/debunk markers are frequent"),
    ("question_marker_ratio", 0.20, "question markers are frequent"),
]  # fixed values


def evidence_cards(scored: DataFrame, score: str = "oof_probability") -> DataFrame:
    """Signals and counter-signals of scored cases; feature columns may be null where no snapshot exists."""
    c = F.col
    missing = F.col("feature_version").isNull()
    signals = F.array_compact(F.array(*[
        F.when(c(name) >= least, _line(f"{label}: {name}", c(name))) for name, least, label in SIGNALS
    ]))
    small = F.when(F.coalesce("post_count", F.lit(0)) < 5, F.concat(
        F.lit("small case size: post_count="), F.coalesce("post_count", F.lit(0)).cast("string")))
    counter = F.array_compact(F.array(
        small,
        F.when(missing, "feature values are not present in the sampled feature CSV"),
        F.when(c("lexical_diversity") >= 0.75, _line("high lexical diversity: lexical_diversity", c("lexical_diversity"))),
        F.when(c("root_overlap_mean") < 0.10, _line("low direct root overlap: root_overlap_mean", c("root_overlap_mean"))),
    ))
    some = lambda a, otherwise: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(otherwise)))
    return scored.select(
        "case_id", round_exact(c(score), 6).alias("risk_score"), risk_level(c(score), 0.8, 0.5).alias("risk_level"),
        F.when(missing, F.array(F.lit("feature snapshot unavailable in exported sample"))).otherwise(
            some(F.slice(signals, 1, 8), "no single strong threshold signal; ranked by combined model weights")
        ).alias("main_signals"),
        some(counter, "no strong counter-signal in exported feature snapshot").alias("counter_signals"),
        F.when(missing, "unavailable").otherwise("available").alias("feature_snapshot_status"),
    )
