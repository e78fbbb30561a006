"""Sources, sinks and row-level functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.functions import encode, logtext, timegrid
from fleetlog.operators import dictionary
from fleetlog.registered.core import ORIGIN, Tables, query, r6
from fleetlog.session import shared_dir
from fleetlog.sources import logs

ALL_EV = "SELECT id, sn, t, cat, CAST(k AS BIGINT) AS k, v FROM ev"


@query("SELECT sn, t, CAST(k AS BIGINT) AS k FROM ev", "ev")
def log_source(x: Tables):
    path = shared_dir(x.spark, "log")
    logs.write_csv(x.ev().select("id", "sn", "t", "cat", "k"), path)
    schema = "id bigint, sn bigint, t bigint, cat string, k bigint"
    return logs.read_log(x.spark, path, schema, columns=["sn", "t", "k"])


@query(
    """SELECT id, sn, CAST(k AS BIGINT) AS k, CAST(k % 4 AS BIGINT) AS label FROM ev WHERE cat = 'signup'
    UNION ALL SELECT id, sn, NULL, -1 FROM ev WHERE cat = 'error'""",
    "ev",
)
def union_sources(x: Tables):
    labelled = x.ev().where("cat = 'signup'").select("id", "sn", "k", (F.col("k") % 4).alias("label"), "v")
    unlabelled = x.ev().where("cat = 'error'").select("id", "sn", "v")
    return logs.union_logs([labelled, unlabelled], ["id", "sn", "k", "label"], {"label": -1})


@query("SELECT sn, t, cat, CAST(k AS BIGINT) AS k, CAST(month(ts) AS BIGINT) AS month FROM ev", "ev")
def feature_store(x: Tables):
    path = shared_dir(x.spark, "features")
    rows = x.ev().withColumn("month", F.month(F.timestamp_seconds("t")))
    logs.save_features(rows.select("sn", "t", "cat", "k", "month"), path, ["month"])
    return logs.load_features(x.spark, path)


@query(ALL_EV, "ev")
def csv_sink(x: Tables):
    path = shared_dir(x.spark, "result")
    logs.write_csv(x.ev().select("id", "sn", "t", "cat", "k", "v"), path)
    schema = "id bigint, sn bigint, t bigint, cat string, k bigint, v double"
    return x.spark.read.schema(schema).option("header", True).csv(path)


@query("SELECT id, sn FROM ev", "ev")
def parse_entity_id(x: Tables):
    named = x.ev().withColumn("serial_number", F.concat(F.lit("server_"), "sn"))
    return named.select("id", encode.parse_entity_id(F.col("serial_number")).alias("sn"))


@query(
    """SELECT id, CAST(epoch(strptime(strftime(ts, '%Y/%m/%d %H:%M:%S'), '%Y/%m/%d %H:%M:%S')) AS BIGINT) AS t
    FROM ev""",
    "ev",
)
def parse_time(x: Tables):
    text = F.date_format(F.timestamp_seconds("t"), "yyyy/MM/dd HH:mm:ss")
    return x.ev().select("id", timegrid.parse_time(text).alias("t"))


@query("SELECT id, bin, edge FROM binned", "binned")
def time_bin(x: Tables):
    return x.binned().select("id", "bin", "edge")


@query(
    f"SELECT id, (t - {ORIGIN}) // 86400 AS global_day, (t - {ORIGIN}) // 3600 AS global_hour FROM ev", "ev"
)
def elapsed_units(x: Tables):
    t = F.col("t")
    return x.ev().select(
        "id",
        timegrid.elapsed_days(t, ORIGIN).alias("global_day"),
        timegrid.elapsed_hours(t, ORIGIN).alias("global_hour"),
    )


@query("SELECT id, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute FROM ev", "ev")
def calendar_fields(x: Tables):
    fields = timegrid.calendar_fields(F.col("t"))
    return x.ev().select("id", *[c.alias(n) for n, c in fields.items()])


@query(
    """SELECT id, CASE WHEN k % 5 = 1 THEN 0.0::DOUBLE WHEN k % 5 = 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS vendor_0,
    CASE WHEN k % 5 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS vendor_1,
    CASE WHEN k % 5 = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS vendor_2 FROM ev""",
    "ev",
)
def one_hot(x: Tables):
    return x.ev().select("id", *encode.one_hot(F.col("k") % 5, [0, 1, 2], "vendor"))


@query(
    """WITH d AS (SELECT cat, row_number() OVER (ORDER BY f, cat) - 1 AS code FROM
      (SELECT cat, min(id) AS f FROM ev WHERE id % 2 = 0 AND cat <> 'view' GROUP BY cat))
    SELECT id, coalesce(CAST(code AS VARCHAR), cat) AS code, cat FROM ev LEFT JOIN d USING (cat)""",
    "ev",
)
def dict_encode(x: Tables):
    """Fit without one category, apply to all, and decode again."""
    known = dictionary.fit_dictionary(x.ev().where("id % 2 = 0 and cat <> 'view'"), "cat", "id")
    coded = dictionary.encode(x.ev().select("id", "cat"), known, "cat", "code").select("id", "code")
    return dictionary.decode(coded.withColumn("cat", F.col("code")), known, "cat")


@query("SELECT id, cat AS kind, dense_rank() OVER (ORDER BY cat) - 1 AS code FROM ev", "ev")
def label_encode(x: Tables):
    return dictionary.label_encode(x.ev().select("id", F.col("cat").alias("kind")), "kind", "code")


@query(
    "SELECT id, CAST(ceil(k / 8.0) AS BIGINT) AS row_bin, CAST(NULL AS BIGINT) AS no_bin FROM ev", "ev"
)
def fixed_width_bin(x: Tables):
    k = F.col("k")
    return x.ev().select(
        "id",
        timegrid.fixed_width_bin(k, 0, 2**17 - 1, 2**14).alias("row_bin"),
        timegrid.fixed_width_bin(k, 7, 7, 4).alias("no_bin"),
    )


@query(
    """SELECT id, CASE WHEN x < 0 THEN 0 ELSE least(x // 120 + 1, 5040) END AS gap_bin FROM
    (SELECT id, (k - 10) * 9000 AS x FROM ev)""",
    "ev",
)
def digitize(x: Tables):
    value = (F.col("k").cast("long") - 10) * 9000
    return x.ev().select("id", timegrid.digitize(value, 120, 7 * 86_400).alias("gap_bin"))


@query(
    """SELECT sn, count(DISTINCT (memory, rankid, bankid, row, col)) AS cells, count(DISTINCT (bankid, row)) AS rows_
    FROM addr GROUP BY sn""",
    "addr",
)
def composite_key(x: Tables):
    cell = encode.composite_key("memory", "rankid", "bankid", "row", "col")
    keyed = x.addr().select("sn", cell.alias("cell"), encode.composite_key("bankid", "row").alias("r"))
    cells = keyed.select("sn", "cell").distinct().groupBy("sn").agg(F.count("cell").alias("cells"))
    rows = keyed.select("sn", "r").distinct().groupBy("sn").agg(F.count("r").alias("rows_"))
    return cells.join(rows, "sn")


@query("SELECT id, coalesce(CAST(k7 AS BIGINT), -1) AS k7 FROM ev_null", "ev_null")
def fill_missing(x: Tables):
    return encode.fill_missing(x.ev_null().select("id", "k7"), ["k7"], -1)


@query("SELECT id, array_to_string(segs, '|') AS segs FROM norm", "norm")
def normalize_log_message(x: Tables):
    return x.msg().select("id", F.array_join(logtext.normalize_message(F.col("msg")), "|").alias("segs"))


@query(
    """SELECT id, coalesce(segs[1], '') AS seg_a, coalesce(segs[2], '') AS seg_b,
    CASE WHEN len(segs) = 3 THEN segs[3] ELSE segs[-1] END AS seg_c FROM norm""",
    "norm",
)
def message_segments(x: Tables):
    parts = logtext.message_segments(F.col("segs"))
    return x.msg().select("id", logtext.normalize_message(F.col("msg")).alias("segs")).select(
        "id", *[c.alias(n) for n, c in parts.items()]
    )


@query(
    r"""WITH s AS (SELECT id, i AS seg, list_filter(regexp_split_to_array(replace(lower(trim(p)), '_', ' '),
      '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS ws FROM (SELECT id, unnest(string_split(trim(msg), '|')) AS p,
      generate_subscripts(string_split(trim(msg), '|'), 1) AS i FROM msg)),
    w AS (SELECT id, seg, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
    p AS (SELECT id, seg, i, array_to_string(ws[greatest(i - 2, 1):i - 1], ' ') AS ctx, w AS token FROM w
      WHERE (w LIKE '0%' AND length(w) > 1) OR (contains(w, 'cpu') AND length(w) > 3))
    SELECT id, string_agg(ctx || '=' || token, ';' ORDER BY seg, i) AS meta,
      arg_min(ctx, (seg, i)) AS first_ctx, arg_min(token, (seg, i)) AS first_token FROM p GROUP BY id""",
    "msg",
)
def extract_message_meta(x: Tables):
    meta = x.msg().select("id", logtext.extract_meta(F.col("msg")).alias("m"))
    first = logtext.first_meta(F.col("m"))
    joined = F.array_join(F.transform("m", lambda p: F.concat(p["ctx"], F.lit("="), p["token"])), ";")
    return meta.select(
        "id",
        joined.alias("meta"),
        F.map_keys(first)[0].alias("first_ctx"),
        F.map_values(first)[0].alias("first_token"),
    )


@query()
def mask_log_variables(x: Tables):
    line = F.concat("msg", F.lit(" 10.0.0."), F.col("k"), F.lit(" 0x1f executed cmd \"a "), F.col("k"), F.lit("\""))
    return x.msg().select("id", logtext.mask_variables(line).alias("masked"))


@query(
    r"SELECT id, regexp_replace(msg, '[0-9]+', '<:NUM:>', 'g') AS masked FROM msg", "msg"
)
def mask_log_variables_plain(x: Tables):
    return x.msg().select("id", logtext.mask_variables(F.col("msg"), [("[0-9]+", "NUM")]).alias("masked"))


@query(
    """SELECT id, sn, 'm1' AS module, CAST(k AS BIGINT) AS cod0, 1::BIGINT AS cod1, 255::BIGINT AS addr,
      CAST(NULL AS VARCHAR) AS others FROM modules
    UNION ALL SELECT id, sn, 'm2', -1, -1, -1, 'other' FROM modules""",
    "modules",
)
def explode_module_causes(x: Tables):
    return logtext.explode_modules(x.modules())


@query(
    """SELECT id, split_part(fault_code, '.', 1) AS fault_code_0, split_part(fault_code, '.', 2) AS fault_code_1,
    split_part(fault_code, '.', 3) AS fault_code_2, CAST(k AS BIGINT) AS fault_code_3 FROM code""",
    "code",
)
def split_fault_code(x: Tables):
    parts = logtext.split_fault_code(F.col("fault_code"))
    return x.code().select("id", *[c.alias(n) for n, c in parts.items()])


@query(
    """SELECT id, 3 + greatest((CASE WHEN z > 9 THEN 10 ELSE z END) - 1, 0) * 5 AS minutes FROM
    (SELECT id, CASE WHEN k * 3 <= 15 THEN 0 ELSE CAST(ceil((k * 3 - 15) / 25.0) AS BIGINT) END AS z FROM ev)""",
    "ev",
)
def minutes_from_threshold_labels(x: Tables):
    labels = encode.threshold_labels(F.col("k") * 3)
    return x.ev().select("id", encode.minutes_from_threshold_labels(labels).alias("minutes"))


@query(
    """SELECT id, round(CASE k % 4 WHEN 0 THEN 5 / 11.0 WHEN 1 THEN 4 / 11.0 ELSE 1 / 11.0 END, 6) AS weight
    FROM (SELECT id, CAST(k AS BIGINT) AS k FROM ev)""",
    "ev",
)
def sample_weight(x: Tables):
    return x.ev().select("id", r6(encode.sample_weight(F.col("k") % 4)).alias("weight"))


@query(
    f"SELECT id, (t - {ORIGIN}) // 86400 AS day FROM ev WHERE (t - {ORIGIN}) // 86400 >= 5 AND (t - {ORIGIN}) // 86400 < 12",
    "ev",
)
def day_range_filter(x: Tables):
    day = timegrid.elapsed_days(F.col("t"), ORIGIN)
    return x.ev().select("id", day.alias("day")).where(encode.in_range(F.col("day"), 5, 12))


def _whole(c: str) -> str:
    """SQL for the narrowest whole type, both ends of its range left out."""
    fits = " ".join(
        f"WHEN min({c}) > {-(2 ** (b - 1))} AND max({c}) < {2 ** (b - 1) - 1} THEN '{name}'"
        for name, b in [("tinyint", 8), ("smallint", 16), ("int", 32)]
    )
    return f"'{c}:' || CASE {fits} ELSE 'bigint' END"


@query(
    "WITH s AS (SELECT " + " || ',' || ".join([_whole("id"), _whole("sn"), _whole("t"), "'cat:string'", "'v:float'", _whole("k")])
    + " AS kinds FROM ev) SELECT id, sn, t, cat, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v, CAST(k AS BIGINT) AS k, kinds FROM ev, s",
    "ev",
)
def shrink_types(x: Tables):
    shrunk = encode.shrink_types(x.ev())
    kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in shrunk.schema)
    return shrunk.withColumn("kinds", F.lit(kinds))


@query("SELECT id, CASE WHEN d < 0.25 THEN 1 ELSE 0 END AS positive, round(least(coalesce(d, 0.25), 0.25), 6) AS target "
       "FROM (SELECT id, (nullif(k % 7, 0)) / 20.0 AS d FROM ev)", "ev")
def failure_target(x: Tables):
    days = F.col("k7") / F.lit(20.0)
    target, positive = encode.failure_target(days)
    return x.ev_null().select("id", positive.alias("positive"), r6(target).alias("target"))


@query(
    """SELECT id, array_to_string(list_transform(range(10), lambda i: CASE WHEN k * 3 <= 15 + 25 * i THEN 1 ELSE 0 END), '') AS labels
    FROM ev""",
    "ev",
)
def threshold_labels(x: Tables):
    labels = encode.threshold_labels(F.col("k") * 3)
    return x.ev().select("id", F.array_join(labels.cast("array<string>"), "").alias("labels"))
