"""Joins, aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.functions.scores import argmax_class as argmax
from fleetlog.operators import bins, corpus, dictionary, evaluate, joins, lookback, vectors
from fleetlog.registered.core import ORIGIN, Tables, query, r6, rounded


@query(
    """SELECT b.sn, b.bin, b.edge, b.last_t, coalesce(m.n, 0)::BIGINT AS mce_n, coalesce(m.k_max, 0)::BIGINT AS mce_k,
      coalesce(e.n, 0)::BIGINT AS kernel_n
    FROM (SELECT sn, bin, edge, max(t) AS last_t FROM binned GROUP BY sn, bin, edge) b
    LEFT JOIN (SELECT sn, bin, edge, count(*) AS n, max(k) AS k_max FROM binned WHERE cat = 'error' GROUP BY sn, bin, edge) m
      USING (sn, bin, edge)
    LEFT JOIN (SELECT sn, bin, edge, count(*) AS n FROM binned WHERE cat = 'view' GROUP BY sn, bin, edge) e
      USING (sn, bin, edge)""",
    "binned",
)
def feature_join(x: Tables):
    key = ["sn", "bin", "edge"]
    b = x.binned()
    base = b.groupBy(*key).agg(F.max("t").alias("last_t"))
    mce = b.where("cat = 'error'").groupBy(*key).agg(
        F.count(F.lit(1)).alias("mce_n"), F.max("k").alias("mce_k")
    )
    kernel = b.where("cat = 'view'").groupBy(*key).agg(F.count(F.lit(1)).alias("kernel_n"))
    return joins.feature_join(base, [mce, kernel], key)


@query(
    """SELECT id, round((f.failure_t // 60 - e.t // 60) / 1440.0, 6) AS days_to_failure,
      round((f.failure_t // 60 - e.t // 60) / 60.0, 6) AS hours_to_failure
    FROM ev e LEFT JOIN fail f ON e.sn = f.sn AND f.failure_t // 60 - e.t // 60 BETWEEN 0 AND 21600""",
    "ev fail",
)
def time_to_failure_label(x: Tables):
    labelled = joins.time_to_failure_label(x.ev().select("id", "sn", "t"), x.fail())
    return rounded(labelled.drop("sn", "t"), ["days_to_failure", "hours_to_failure"])


@query(
    """WITH f AS (SELECT sn, t AS ft FROM ev WHERE cat = 'error')
    SELECT id, round(min(ft // 60 - t // 60) / 60.0, 6) AS hours_to_failure
    FROM ev LEFT JOIN f ON ev.sn = f.sn AND ft // 60 - t // 60 BETWEEN 0 AND 21600 GROUP BY id""",
    "ev",
)
def time_to_failure_nearest(x: Tables):
    """Machines with many failures: only the next one counts."""
    failures = x.ev().where("cat = 'error'").select("sn", F.col("t").alias("failure_t"))
    labelled = joins.time_to_failure_label(x.ev().select("id", "sn", "t"), failures, nearest=True)
    return labelled.select("id", r6("hours_to_failure").alias("hours_to_failure"))


@query(
    """SELECT ticket_id, fault_t, e.id AS id, e.t AS t FROM ticket k LEFT JOIN ev e
    ON k.sn = e.sn AND e.cat <> 'signup' AND e.t > fault_t - 40 * 86400 AND e.t <= fault_t""",
    "ticket ev",
)
def lookback_join(x: Tables):
    logs = x.ev().where("cat <> 'signup'").select("id", "sn", "t")
    found = joins.lookback_join(x.ticket(), logs, days=40)
    return found.select("ticket_id", "fault_t", "id", "t")


@query("SELECT id, sn, t FROM ev WHERE sn IN (SELECT sn FROM fail)", "ev fail")
def faulty_only(x: Tables):
    return joins.faulty_only(x.ev().select("id", "sn", "t"), x.fail())


@query(
    """SELECT id, w.word, round(list_sum(list_transform(vec, lambda z: CAST(z AS DOUBLE))), 6) AS vec_sum
    FROM (SELECT id, CAST(k AS VARCHAR) AS word FROM ev) w JOIN tok_vec USING (word)""",
    "ev tok_vec",
)
def vector_lookup(x: Tables):
    tokens = x.ev().select("id", F.col("k").cast("string").alias("word"))
    found = vectors.vector_lookup(tokens, x.tok_vec())
    total = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return found.select("id", "word", r6(total).alias("vec_sum"))


@query(
    """SELECT id, CASE WHEN failure_t IS NULL THEN 0 ELSE 1 END AS hit, round((failure_t - t) / 60.0, 6) AS true_min
    FROM ev LEFT JOIN fail ON ev.sn = fail.sn AND t > failure_t - 7 * 86400 AND t < failure_t WHERE cat = 'error'""",
    "ev fail",
)
def alarm_failure_match(x: Tables):
    alarms = x.ev().where("cat = 'error'").select("id", "sn", "t")
    return rounded(joins.alarm_failure_match(alarms, x.fail()).drop("sn", "t"), ["true_min"])


@query("SELECT sn, bin, max(t) AS last_t, arg_max(edge, t) AS edge FROM binned GROUP BY sn, bin", "binned")
def bin_last(x: Tables):
    return bins.bin_last(x.binned())


@query(
    """SELECT sn, bin, max(v) AS v_max, round(avg(v), 6) AS v_mean, round(median(v), 6) AS v_median,
    round(stddev_samp(v), 6) AS v_std FROM (SELECT sn, t // 86400 AS bin, v FROM ev) GROUP BY sn, bin""",
    "ev",
)
def bin_stats(x: Tables):
    daily = x.ev().select("sn", F.floor(F.col("t") / 86_400).alias("bin"), "v")
    stats = bins.bin_stats(daily, {"v": ["max", "mean", "median", "std"]})
    return rounded(stats, ["v_mean", "v_median", "v_std"])


CATS = ["click", "error", "purchase", "signup", "view"]


@query(
    "SELECT sn, bin, " + ", ".join(f"count(*) FILTER (cat = '{c}') AS n_{c}" for c in CATS)
    + " FROM binned GROUP BY sn, bin",
    "binned",
)
def bin_category_counts(x: Tables):
    return bins.bin_category_counts(x.binned(), "cat", CATS)


@query(
    """SELECT sn, arg_max(f, t) AS failure_t, arg_max(tag, t) AS tag FROM
      (SELECT sn, t, CASE WHEN k >= 90 THEN t + k END AS f, cat AS tag FROM ev) WHERE f IS NOT NULL GROUP BY sn
    UNION ALL SELECT sn, failure_t, 'known' FROM fail""",
    "ev fail",
)
def failure_from_log(x: Tables):
    t = F.col("t")
    log = x.ev().select("sn", "t", "id", F.when(F.col("k") >= 90, t + F.col("k")).alias("failure_t"), F.col("cat").alias("tag"))
    known = x.fail().withColumn("tag", F.lit("known"))
    return dictionary.failure_from_log(log).unionByName(known)


_REPORT = """SELECT '{c}' AS feature, '{kind}' AS type, count(*) - count({c}) AS missing,
    count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS uniques, count({c}) AS "count",
    round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
    round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
    round(quantile_cont({c}, 0.95), 6) AS p95, round(quantile_cont({c}, 0.99), 6) AS p99 FROM ev_null"""


@query(
    " UNION ALL ".join(_REPORT.format(c=c, kind=k) for c, k in [("v", "double"), ("k", "int"), ("k7", "int")])
    + """ UNION ALL SELECT 'cat', 'string', count(*) - count(cat), count(DISTINCT cat) + CASE WHEN count(*) > count(cat) THEN 1 ELSE 0 END, count(cat),
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT nullif(cat, 'view') AS cat FROM ev_null)""",
    "ev_null",
)
def feature_report(x: Tables):
    log = x.ev_null().withColumn("cat", F.expr("nullif(cat, 'view')"))
    report = dictionary.feature_report(log, ["v", "k", "k7", "cat"])
    return rounded(report, ["mean", "std", "p25", "p50", "p75", "p95", "p99"])


@query(
    """SELECT cat, count(k7) AS n, round(count(k7) / (count(k7) + 10.0) * avg(k7)
      + (1 - count(k7) / (count(k7) + 10.0)) * (SELECT avg(k7) FROM ev_null), 6) AS score FROM ev_null GROUP BY cat""",
    "ev_null",
)
def target_encoding(x: Tables):
    return rounded(dictionary.target_encode(x.ev_null(), "cat", "k7", m=10), ["score"])


@query("SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM docwords) GROUP BY word", "docwords")
def word_count(x: Tables):
    return corpus.word_count(x.docs().select(corpus.words(F.col("text")).alias("tokens")), "tokens")


@query(
    """WITH r AS (SELECT sn, id, t, cat, row_number() OVER (PARTITION BY sn ORDER BY t, id) - 1 AS pos FROM ev)
    SELECT sn, pos // 25 AS block, count(*) AS n, string_agg(cat, ' ' ORDER BY pos) AS text FROM r GROUP BY sn, block""",
    "ev",
)
def sequence_per_entity(x: Tables):
    rows = corpus.sequence_per_entity(x.ev().select("sn", "t", "id", "cat"), ["sn"], ["t", "id"], "cat", 25)
    return rows.drop("tokens")


_LB = """WITH l AS (SELECT ticket_id, fault_t, e.t AS t, e.id AS id, e.v AS v, e.cat AS cat FROM ticket k LEFT JOIN ev e
      ON k.sn = e.sn AND e.t > fault_t - {w} AND e.t <= fault_t AND e.cat <> 'signup')"""


@query(
    _LB.format(w=40 * 86400)
    + """, g AS (SELECT *, t - lag(t) OVER (PARTITION BY ticket_id ORDER BY t, id) AS gap FROM l WHERE t IS NOT NULL),
    s AS (SELECT ticket_id, """
    + ", ".join(
        f"round({fn}, {d}) AS {kind}_{name}"
        for kind, col, d in [("gap", "gap", 6), ("rel", "(t / CAST(fault_t AS DOUBLE))", 9)]
        for name, fn in [
            ("min", f"min(CAST({col} AS DOUBLE))"), ("max", f"max(CAST({col} AS DOUBLE))"),
            ("std", f"stddev_pop({col})"), ("ptp", f"CAST(max({col}) - min({col}) AS DOUBLE)"),
            ("mean", f"avg({col})"), ("median", f"CAST(median({col}) AS DOUBLE)"),
        ]
    )
    + """ FROM g GROUP BY ticket_id)
    SELECT ticket_id, s.* EXCLUDE (ticket_id) FROM ticket LEFT JOIN s USING (ticket_id)""",
    "ticket ev",
)
def lookback_time_stats(x: Tables):
    logs = x.ev().where("cat <> 'signup'")
    stats = lookback.lookback_time_stats(logs, x.ticket(), days=40)
    names = ["min", "max", "std", "ptp", "mean", "median"]
    return stats.select(
        "ticket_id",
        *[r6(f"gap_{n}").alias(f"gap_{n}") for n in names],
        *[(F.round(f"rel_{n}", 9) + 0.0).alias(f"rel_{n}") for n in names],
    )


_ANCHORED = """SELECT ticket_id, {what} FROM ticket k LEFT JOIN ev e
    ON k.sn = e.sn AND e.t >= fault_t - 172800 AND e.t <= fault_t GROUP BY ticket_id"""


@query(_ANCHORED.format(what="count(e.id) AS n"), "ticket ev")
def lookback_count(x: Tables):
    return joins.lookback_count(x.ev().select("id", "sn", "t"), x.ticket(), 172_800).select("ticket_id", "n")


@query(_ANCHORED.format(what=", ".join(f"count(*) FILTER (cat = '{c}') AS n_{c}" for c in CATS)), "ticket ev")
def lookback_histogram(x: Tables):
    logs = x.ev().select("sn", "t", "cat")
    return joins.lookback_histogram(logs, x.ticket(), 172_800, "cat", CATS).select(
        "ticket_id", *[f"n_{c}" for c in CATS]
    )


@query(
    _LB.format(w=40 * 86400)
    + """SELECT ticket_id, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.9), 6) AS q90 FROM l GROUP BY ticket_id""",
    "ticket ev",
)
def lookback_quantile(x: Tables):
    logs = x.ev().where("cat <> 'signup'").select("sn", "t", "v")
    found = lookback.lookback_quantile(logs, x.ticket(), "v", {"q10": 0.1, "q90": 0.9}, days=40)
    return rounded(found.select("ticket_id", "q10", "q90"), ["q10", "q90"])


@query("SELECT id, sn, t FROM ev ORDER BY sn, t, id", "ev")
def order_log(x: Tables):
    return x.ev().select("id", "sn", "t").orderBy("sn", "t", "id")


@query(
    """WITH c AS (SELECT k AS template, count(*) AS size FROM ev GROUP BY k)
    SELECT CAST(template AS BIGINT) AS template, size FROM (SELECT *, rank() OVER (ORDER BY size DESC) AS r FROM c) WHERE r <= 20""",
    "ev",
)
def top_templates(x: Tables):
    sizes = x.ev().groupBy(F.col("k").alias("template")).agg(F.count(F.lit(1)).alias("size"))
    return dictionary.top_by_size(sizes, "size", 20)


@query(
    """WITH c AS (SELECT doc_id, unnest(tokens) AS term FROM docwords),
    s AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM c GROUP BY term),
    b AS (SELECT *, row_number() OVER (ORDER BY total DESC, term) AS r FROM s)
    SELECT term, total, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM b WHERE r <= 200""",
    "docwords",
)
def top_terms(x: Tables):
    parts = x.docs().select("doc_id", corpus.words(F.col("text")).alias("tokens"))
    return corpus.top_terms(corpus.term_counts(parts, "doc_id", "tokens"), 200)


@query(
    """SELECT id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS label FROM
    (SELECT id, k % 7 AS a, k % 5 AS b, k % 11 AS c FROM ev)""",
    "ev",
)
def argmax_class(x: Tables):
    probs = F.array(*[(F.col("k") % m).cast("double") for m in (7, 5, 11)])
    return x.ev().select("id", argmax(probs).alias("label"))


@query("SELECT sn, t, min(bin) AS bin FROM binned GROUP BY sn, t", "binned")
def distinct_event_times(x: Tables):
    return bins.distinct_event_times(x.binned())


@query(
    """WITH m AS (SELECT sn, max(y) AS y, max(proba) AS p FROM scored GROUP BY sn)
    SELECT count(*) FILTER (y = 1) AS faulty, count(*) FILTER (y = 1 AND p > 0.5) AS caught,
    round(count(*) FILTER (y = 1 AND p > 0.5) / CAST(count(*) FILTER (y = 1) AS DOUBLE), 6) AS caught_share FROM m""",
    "scored",
)
def caught_machines(x: Tables):
    return rounded(evaluate.caught_machines(x.scored(), "proba", "y", 0.5), ["caught_share"])
