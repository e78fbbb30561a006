"""The operators of this folder as queries on the test tables, with production parameters.

Each query calls its operator over its whole table and derives the digest columns from what the
operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.llm import decontaminate, language, middle, mixing, preference, secrets, setsketch, tokens, topk, toxicity, urlrules, whiten, winnow
from fleetlog.llm.base import held_out, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    """The tokenizer's file where the public package is installed."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = stored(mixing.sized(docs), "sizes")  # a row a document without its text, before the labels are joined
    mixed, names = mixing.mix(stored(mixing.keyed(rows, table(spark, sf_dir, "labels")), "keys"))
    return mixed.select("doc_id", *[F.col(names[c]).alias(c) for c in ("size", "source_size", "target", "taken")])


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    n_words, hits, items = F.col(names["n_words"]), F.size(names["hits"]).cast("long"), F.col(names["items"])
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        hits.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256).alias("items_sha256"),
        ((hits > 0) & (decontaminate.RULE * hits >= n_words)).alias("contaminated"),
    )


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, spans = secrets.scan(docs)
    kinds = [r.kind for r in secrets.BASE]
    of = lambda *some: F.filter(spans, lambda s: s["kind"].isin(*some))
    text = lambda rows: F.concat_ws(",", F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(text(of(*kinds)).cast("binary"), 256).alias("base_sha256"),
        text(F.col(spans)).alias("spans"),
    )


@query
def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_documents(docs, tokenizer_path())


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    out, pred, score, rejected = language.identify(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"), F.col(rejected).alias("rejected")
    )


@query
def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out, score, spans = toxicity.score(docs, model)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.5).cast("int").alias("predicted"),
        F.size(spans).cast("long").alias("n_spans"),
    )


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


ORACLE["op7_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""
ORACLE["op6_decontamination"] = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
    SELECT r, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS win
    FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words) p, (SELECT DISTINCT size FROM windows) s
    WHERE i + s.size - 1 <= len(w)
), hits AS (SELECT r, i, places.size, item_id FROM places JOIN windows ON places.size = windows.size AND places.win = windows.win),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
ORACLE["op4_mixing"] = r"""
WITH known AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
sized AS (
    SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 1.0) / 4503599627370496.0)
            / CASE q WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 1.5 END AS key
    FROM documents d LEFT JOIN known USING (doc_id)
), sources AS (SELECT source, sum(size) AS size FROM sized GROUP BY source),
ranked AS (SELECT source, size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0 * size AS cap FROM sources),
filled AS (
    SELECT *, (sum(size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
    FROM ranked WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (SELECT source, CAST(size AS BIGINT) AS source_size, least(cap, max(level) OVER () * w) AS target FROM filled),
placed AS (
    SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
        CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes,
        coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
    CAST(passes * size + greatest(0, least(size, floor(target) - passes * source_size - used)) AS BIGINT) AS taken
FROM placed
"""


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, names = urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *[F.col(names[c]).alias(c) for c in ("host", "path", "rule", "verdict", "template", "purity")])


@query
def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return preference.format_pairs(*preference.echo_pairs(turns)).withColumnRenamed("pair", "conv_id")


ORACLE["op2_preference"] = r"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
lasts AS (SELECT conv_id, max(turn) AS last FROM rows WHERE role = 'assistant' GROUP BY conv_id),
upto AS (SELECT rows.*, last FROM rows JOIN lasts USING (conv_id) WHERE turn <= last),
echoes AS (SELECT conv_id, arg_max(text, turn) AS echo FROM upto WHERE role = 'user' AND turn < last GROUP BY conv_id),
sides AS (
    SELECT 'chosen' AS side, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM upto
    UNION ALL SELECT 'rejected', conv_id, turn, coalesce(role, 'unknown'), coalesce(text, '') FROM upto WHERE turn < last
    UNION ALL SELECT 'rejected', conv_id, last, 'assistant', coalesce(echo, '') FROM lasts LEFT JOIN echoes USING (conv_id)
), unequal AS (
    SELECT conv_id, min(turn) AS cut FROM (
        (SELECT conv_id, turn, role, text FROM sides WHERE side = 'chosen' EXCEPT SELECT conv_id, turn, role, text FROM sides WHERE side = 'rejected')
        UNION ALL
        (SELECT conv_id, turn, role, text FROM sides WHERE side = 'rejected' EXCEPT SELECT conv_id, turn, role, text FROM sides WHERE side = 'chosen')
    ) GROUP BY conv_id
), placed AS (
    SELECT conv_id, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS side, turn, role, text,
        '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment
    FROM sides LEFT JOIN unequal USING (conv_id) WHERE side = 'chosen' OR NOT (cut IS NULL OR turn < cut)
), spans AS (
    SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, side ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + CASE WHEN side = 'prompt' THEN 0 ELSE coalesce(sum(CASE WHEN side = 'prompt' THEN length(segment) END) OVER (PARTITION BY conv_id), 0) END AS BIGINT) AS start
    FROM placed
)
SELECT conv_id, side, turn, role, segment, start, start + length(segment) AS stop,
    CASE WHEN side <> 'prompt' AND role = 'assistant' THEN start + length(role) + 5 END AS loss_start,
    CASE WHEN side <> 'prompt' AND role = 'assistant' THEN start + length(segment) END AS loss_end
FROM spans
"""


ORACLE["op3_near_copies"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY x, y)
    JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reached AS (
    SELECT doc_id, doc_id AS low FROM words UNION SELECT y, low FROM reached JOIN links ON x = doc_id
)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, low AS component_id, words.doc_id = low AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(low) AS low FROM reached GROUP BY doc_id) USING (doc_id)
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    return rows.select(
        "vec_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query
def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, names = middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col(names["output"]), F.col(names["form"])
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id",
        *[F.col(names[c]).alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        sha(output).alias("output_sha256"),
        sha(middle.restored(output, form)).alias("restored_sha256"),
    )


ORACLE["op12_middle"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
    SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS p, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS q,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS share, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS turn FROM d
), f AS (
    SELECT *, least(p, q) AS a, greatest(p, q) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR share >= 90 THEN 'plain'
            WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM f
"""


@query
def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = winnow.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.spelled(F.col("packed")).alias("fingerprint"),
        winnow.spelled(F.col("edited_packed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
