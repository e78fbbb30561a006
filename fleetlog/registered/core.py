"""Registration, and the views that let log operators run on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.functions import timegrid
from fleetlog.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ORIGIN = 1_704_067_200  # the first day of the test events


def query(sql: str | None = None, views: str = ""):
    """Register a query under its function's name; ``views`` names the views the SQL uses."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(fn(Tables(configure(spark), sf_dir)))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = with_views(views, sql)
        return fn

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions as double: the types the SQL side returns, too."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) or isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FractionalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


class Tables:
    """The test tables of one folder and the log views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def ev(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("sn"),
            timegrid.unix_time(F.col("ts")).alias("t"),
            F.col("event_type").alias("cat"),
            F.col("value").alias("v"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    def binned(self) -> DataFrame:
        b = timegrid.time_bin(F.col("t"), ORIGIN)
        return self.ev().withColumn("bin", b).withColumn("edge", timegrid.bin_edge(F.col("bin"), ORIGIN))

    def ev_null(self) -> DataFrame:
        return self.ev().withColumn("k7", F.expr("nullif(k % 7, 0)"))

    def addr(self) -> DataFrame:
        return self.binned().select(
            "id", "sn", "t", "bin", "edge",
            (F.col("k") % 4).alias("memory"),
            (F.col("k") % 2).alias("rankid"),
            (F.col("k") % 8).alias("bankid"),
            F.col("k").alias("row"),
            F.floor("v").cast("int").alias("col"),
        )

    def fail(self) -> DataFrame:
        return self.ev().where("cat = 'error' and k >= 95").groupBy("sn").agg(F.max("t").alias("failure_t"))

    def ticket(self) -> DataFrame:
        return self.ev().where("cat = 'signup'").select(
            F.col("id").alias("ticket_id"), "sn", F.col("t").alias("fault_t"), (F.col("k") % 4).alias("label")
        )

    def msg(self) -> DataFrame:
        k = F.col("k")
        text = F.concat(
            F.upper("cat"), F.lit("_"), k, F.lit(" | port"), k % 8, F.lit(" dimm"), k % 4,
            F.lit(" | 0"), k, F.lit(" cpu"), k % 2, F.lit("_x asserted"),
        )
        return self.ev().select("id", "sn", "t", "cat", "k", text.alias("msg"))

    def modules(self) -> DataFrame:
        cause = F.concat(F.lit("m1,cod0:0x"), F.hex("k"), F.lit(",cod1:0x1,addr:0xff,m2,other"))
        return self.ev().where("cat = 'purchase'").select(
            "id", "sn", F.lit("m1,m2").alias("module"), cause.alias("module_cause")
        )

    def code(self) -> DataFrame:
        return self.ev().where("cat = 'click'").select(
            "id", F.concat(F.lit("a.b.c."), F.lower(F.hex("k"))).alias("fault_code")
        )

    def scored(self) -> DataFrame:
        ahead = F.col("failure_t") - F.col("t")
        return self.ev().join(self.fail(), "sn", "left").select(
            "id", "sn", "t", "cat", "k", "v", "failure_t",
            F.least(F.col("v") / 500, F.lit(1.0)).alias("proba"),
            F.when((ahead >= 0) & (ahead < 21_600), 1).otherwise(0).alias("y"),
            F.col("k").cast("double").alias("pred_min"),
        )

    def shapes(self) -> DataFrame:
        """Messages of two shapes that only share their first words, with words that vary and no digits."""
        word = lambda n: F.translate(n.cast("string"), "0123456789", "abcdefghij")
        a, b = word(F.floor(F.col("k") / 10)), word(F.col("k") % 10)
        raised = F.concat_ws(" ", F.lit("unit seven"), "cat", F.lit("raised by"), a, F.lit("while"), b, F.lit("asleep"))
        fan = F.concat_ws(" ", F.lit("unit seven fan speed below"), a, F.lit("limit"), b, F.lit("now"))
        return self.ev().select("id", "sn", "t", "cat", F.when(F.col("cat").isin("click", "error"), raised).otherwise(fan).alias("msg"))

    def lines(self) -> DataFrame:
        """Every line of every document as a message."""
        return self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "msg"))

    def docs(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "lang")

    def tok_vec(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec")
        )


VIEWS = {
    "ev": """SELECT event_id AS id, user_id AS sn, epoch_us(ts) // 1000000 AS t, ts, event_type AS cat,
        value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "binned": f"""SELECT *, CASE WHEN t > {ORIGIN} - 10
        THEN greatest(CAST(ceil((t - {ORIGIN}) / 300.0) AS BIGINT) - 1, 0) END AS bin,
        {ORIGIN} + 300 * (bin + 1) AS edge FROM ev""",
    "ev_null": "SELECT *, nullif(k % 7, 0) AS k7 FROM ev",
    "addr": """SELECT id, sn, t, bin, edge, k % 4 AS memory, k % 2 AS rankid, k % 8 AS bankid,
        k AS row, CAST(floor(v) AS INTEGER) AS col FROM binned""",
    "fail": "SELECT sn, max(t) AS failure_t FROM ev WHERE cat = 'error' AND k >= 95 GROUP BY sn",
    "ticket": "SELECT id AS ticket_id, sn, t AS fault_t, k % 4 AS label FROM ev WHERE cat = 'signup'",
    "msg": """SELECT id, sn, t, cat, k, upper(cat) || '_' || k || ' | port' || (k % 8) || ' dimm' || (k % 4)
        || ' | 0' || k || ' cpu' || (k % 2) || '_x asserted' AS msg FROM ev""",
    "shapes": """SELECT id, sn, t, cat, CASE WHEN cat IN ('click', 'error')
        THEN 'unit seven ' || cat || ' raised by ' || translate(CAST(k // 10 AS VARCHAR), '0123456789', 'abcdefghij')
          || ' while ' || translate(CAST(k % 10 AS VARCHAR), '0123456789', 'abcdefghij') || ' asleep'
        ELSE 'unit seven fan speed below ' || translate(CAST(k // 10 AS VARCHAR), '0123456789', 'abcdefghij')
          || ' limit ' || translate(CAST(k % 10 AS VARCHAR), '0123456789', 'abcdefghij') || ' now' END AS msg FROM ev""",
    "lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS msg FROM documents",
    "modules": """SELECT id, sn, k FROM ev WHERE cat = 'purchase'""",
    "code": "SELECT id, k, 'a.b.c.' || lower(hex(k)) AS fault_code FROM ev WHERE cat = 'click'",
    "scored": """SELECT id, sn, t, cat, k, v, failure_t, least(v / 500, 1.0) AS proba,
        CASE WHEN failure_t - t >= 0 AND failure_t - t < 21600 THEN 1 ELSE 0 END AS y,
        CAST(k AS DOUBLE) AS pred_min FROM ev LEFT JOIN fail USING (sn)""",
    "tok_vec": "SELECT CAST(vec_id AS VARCHAR) AS word, embedding AS vec FROM embeddings",
    "norm": r"""SELECT id, sn, t, cat, k, list_transform(string_split(trim(msg), '|'), lambda s: array_to_string(
        list_transform(list_filter(regexp_split_to_array(replace(lower(trim(s)), '_', ' '), '[^\p{L}\p{N}_]+'), lambda w: w <> ''),
        lambda w: CASE WHEN w LIKE '0%' AND length(w) > 1 THEN 'hex' WHEN contains(w, 'port') THEN 'port'
        WHEN contains(w, 'dimm') THEN 'dimm' ELSE w END), ' ')) AS segs FROM msg""",
    "toks": """SELECT id, sn, t, cat, k, segs, array_to_string(segs, ' ') AS txt,
        string_split(array_to_string(segs, ' '), ' ') AS tokens FROM norm""",
    "docwords": r"""SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS tokens
        FROM documents""",
}
_NEEDS = {
    "binned": "ev", "ev_null": "ev", "addr": "binned", "fail": "ev", "ticket": "ev", "msg": "ev",
    "shapes": "ev", "modules": "ev", "code": "ev", "scored": "ev fail", "norm": "msg", "toks": "norm",
}


def with_views(names: str, sql: str) -> str:
    """Put the named views and what they need in front of the query."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, "").split():
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    if not order:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    lead = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if lead.startswith(start):
            return f"{start}{views},\n{lead[len(start):]}"
    return f"WITH {views}\n{lead}"
