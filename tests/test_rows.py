"""Row-level functions, dictionaries and sources on literals."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetlog.functions import encode, logtext, timegrid
from fleetlog.operators import dictionary
from fleetlog.sources import logs


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_time_bin_edges(spark):
    o = timegrid.ORIGIN_2019
    for t, want in [(-10, None), (-9, 0), (0, 0), (1, 0), (300, 0), (301, 1), (600, 1)]:
        assert one(spark, timegrid.time_bin(F.lit(o + t))) == want
    assert one(spark, timegrid.bin_edge(F.lit(1))) == o + 600


def test_digitize_and_bins(spark):
    for x, want in [(-1, 0), (0, 1), (119, 1), (120, 2), (10**9, 5040)]:
        assert one(spark, timegrid.digitize(F.lit(x), 120, 7 * 86_400)) == want
    assert one(spark, timegrid.fixed_width_bin(F.lit(9), 0, 63, 8)) == 2
    assert one(spark, timegrid.fixed_width_bin(F.lit(9), 5, 5, 8)) is None


def test_parse(spark):
    assert one(spark, timegrid.parse_time(F.lit("2019/01/01 00:00:05"))) == timegrid.ORIGIN_2019 + 5
    assert one(spark, timegrid.parse_time(F.lit("soon"))) is None
    assert one(spark, encode.parse_entity_id(F.lit("server_77"))) == 77


def test_one_hot_unknown(spark):
    df = spark.createDataFrame([(0,), (2,), (9,), (None,)], "v int")
    got = [tuple(r) for r in df.select(*encode.one_hot(F.col("v"), [0, 1, 2], "v")).collect()]
    assert got == [(1, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 0)]


def test_label_vectors(spark):
    for bits, want in [((1, 1), 3), ((0, 1), 3), ((0, 0), 8)]:
        labels = F.array(*[F.lit(b) for b in bits])
        assert one(spark, encode.minutes_from_threshold_labels(labels)) == want
    assert one(spark, encode.threshold_labels(F.lit(None).cast("double"), 3)) == [0, 0, 0]


def test_normalize(spark):
    text = F.lit("CPU0_PORT12 |  Größe 0x1f 0| DIMM_a1,0 ")
    assert one(spark, logtext.normalize_message(text)) == ["cpu0 port", "größe hex 0", "dimm a1 0"]
    assert one(spark, logtext.normalize_message(F.lit(""))) == []
    assert one(spark, logtext.normalize_message(F.lit(None).cast("string"))) == []


def test_meta(spark):
    got = one(spark, logtext.extract_meta(F.lit("error at addr 0x1f | cpu1_status ok")))
    assert [(m.ctx, m.token) for m in got] == [("at addr", "0x1f"), ("", "cpu1")]


def test_masks(spark):
    for text, want in [
        ("from 10.0.0.1 port", "from <:IP:> port"),
        ("id aa:bb:cc:dd end", "id <:ID:> end"),
        ("at 0x1F now", "at <:HEX:> now"),
        ("n=-12, x7", "n=<:NUM:>, x7"),
        ("abcdef 123456 abcdef", "<:SEQ:>"),
        ('executed cmd "rm a" done', "executed cmd <:CMD:> done"),
    ]:
        assert one(spark, logtext.mask_variables(F.lit(text))) == want


def test_modules(spark):
    df = spark.createDataFrame(
        [(1, "a,b,c", "a,cod0:0x1f,cod1:0x2,addr:0xffffffffffffffff,b,free text")],
        "id int, module string, module_cause string",
    )
    got = rows(logtext.explode_modules(df), "module", "cod0", "cod1", "addr", "others")
    assert [(m, int(a), int(b), int(c), o) for m, a, b, c, o in got] == [
        ("a", 31, 2, 2**64 - 1, None),
        ("b", -1, -1, -1, "free text"),
        ("c", -1, -1, -1, None),
    ]


def test_fault_code(spark):
    parts = logtext.split_fault_code(F.lit("a.b.c.1F"))
    assert one(spark, parts["fault_code_3"]) == 31


def test_shrink(spark):
    df = spark.createDataFrame([(126, 127, 40_000, 2**40, 1.5, "x"), (0, 0, 0, 0, 2.0, "y")], "a bigint, b bigint, c bigint, d bigint, e double, f string")
    kinds = [f.dataType.simpleString() for f in encode.shrink_types(df).schema]
    assert kinds == ["tinyint", "smallint", "int", "bigint", "float", "string"]


def test_dictionary(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0)], "c string, o int")
    known = dictionary.fit_dictionary(df, "c", "o")
    assert rows(known) == [("a", 1), ("b", 0)]
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    coded = dictionary.encode(new, known, "c")
    assert {r.c for r in coded.collect()} == {"1", "z", None}
    assert {r.c for r in dictionary.decode(coded, known, "c").collect()} == {"a", "z", None}


def test_top_by_size_keeps_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "t string, size int")
    assert rows(dictionary.top_by_size(df, "size", 2), "t") == [("a",), ("b",), ("c",)]


def test_read_log_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("sn,t\na,1\nb,oops\n")
    df = logs.read_log(spark, str(tmp_path), "sn string, t int", keep_corrupt=True).cache()
    assert {(r.sn, r.t, r[logs.CORRUPT] is None) for r in df.collect()} == {("a", 1, True), ("b", None, False)}
    pruned = logs.read_log(spark, str(tmp_path), "sn string, t int", columns=["sn"], limit=1)
    assert pruned.columns == ["sn"] and pruned.count() == 1


def test_union_fills(spark):
    a = spark.createDataFrame([(1, 2)], "id int, label int")
    b = spark.createDataFrame([(3, "x")], "id int, extra string")
    assert rows(logs.union_logs([a, b], ["id", "label"], {"label": -1})) == [(1, 2), (3, -1)]


def test_failure_from_log_takes_last(spark):
    df = spark.createDataFrame([(1, 10, 1, 99, "a"), (1, 20, 2, 77, "b"), (1, 30, 3, None, "c"), (2, 5, 4, None, "d")], "sn int, t int, id int, failure_t int, tag string")
    assert rows(dictionary.failure_from_log(df)) == [(1, 77, "b")]


@pytest.mark.parametrize("missing", [[], [None, None]])
def test_report_of_empty_column(spark, missing):
    df = spark.createDataFrame([(1.0, m) for m in missing] or [(1.0, 2.0)], "a double, b double")
    report = {r.feature: r for r in dictionary.feature_report(df, ["a", "b"]).collect()}
    assert report["b"].missing == len(missing)


def test_whole_numbers_that_are_one_double_are_two_values(spark):
    from fleetlog.operators import dictionary

    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (None,)], "n bigint")
    assert dictionary.feature_report(df, ["n"]).first().uniques == 3


def test_hex_beyond_64_bits_is_null(spark):
    from fleetlog.functions import logtext

    df = spark.createDataFrame([("0xff",), ("f" * 16,), ("1" + "0" * 16,), ("0" * 20 + "a",), ("xyz",)], "h string")
    found = [r[0] for r in df.select(logtext.hex_value(F.col("h"))).collect()]
    assert [None if v is None else int(v) for v in found] == [255, 2**64 - 1, None, 10, None]


def test_rows_without_a_score_are_left_out(spark):
    from fleetlog.operators import evaluate

    known = [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)]
    df = spark.createDataFrame([*known, (None, 1), (float("nan"), 0)], "s double, y int")
    clean = spark.createDataFrame(known, "s double, y int")
    for f in (evaluate.pr_auc, evaluate.roc_auc):
        assert f(df, "s", "y").collect() == f(clean, "s", "y").collect()


def test_ids_with_a_common_beginning_fall_in_many_chunks(spark):
    from fleetlog.operators import scan

    df = spark.createDataFrame([(f"server_{i}",) for i in range(1000)], "sn string")
    chunked = scan.by_quantile(df, "sn")
    assert chunked.select(scan.CHUNK).distinct().count() > 40
    order = [r.sn for r in chunked.orderBy(scan.CHUNK, "sn").collect()]
    assert order == sorted(order)


def test_machines_go_to_the_lightest_fold(spark):
    from collections import Counter

    from fleetlog.operators import splits

    rows_of = {"big": 1000, None: 70, **{f"m{i}": 10 for i in range(29)}}
    df = spark.createDataFrame([(m,) for m, n in rows_of.items() for _ in range(n)], "sn string")
    folded = splits.group_kfold(df, "sn", 5).collect()
    where = {}
    for r in folded:
        assert where.setdefault(r.sn, r.fold) == r.fold
    assert sorted(Counter(r.fold for r in folded).values()) == [90, 90, 90, 90, 1000]
    loads = [0] * 3
    for size, m in [(50, 1), (20, 7), (3, 100)]:
        for _ in range(m):
            loads[loads.index(min(loads))] += size
    dealt = splits._deal([(50, 1), (20, 7), (3, 100)], 3)
    got = [sum(size * (e[f] - (e[f - 1] if f else 0)) for size, e in dealt) for f in range(3)]
    assert got == loads


def test_bucketed_families_join_without_an_exchange(spark, monkeypatch):
    from fleetlog.operators import joins
    from fleetlog.sources.logs import bucketed

    key = ["sn", "bin"]
    base = spark.range(500).select((F.col("id") % 7).alias("sn"), F.col("id").alias("bin"), F.lit(1).alias("x"))
    families = [base.where(f"bin % {m} = 0").select(*key, (F.col("bin") * m).alias(f"f{m}")) for m in (2, 3, 5)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.feature_join(bucketed(base, "base", key), [bucketed(f, "family", key) for f in families], key)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
        got = {r.bin: (r.f2, r.f3, r.f5) for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: tuple(i * m if i % m == 0 else 0 for m in (2, 3, 5)) for i in range(500)}
