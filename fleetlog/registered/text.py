"""Templates, corpora and vector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.functions import logtext
from fleetlog.operators import corpus, templates, vectors
from fleetlog.registered.core import Tables, query, r6, rounded
from fleetlog.session import stored

DIM = 64


@query()
def mine_templates(x: Tables):
    found = templates.mine_templates(x.msg())
    return found.select("template_id", "template", "size")


@query(
    r"""SELECT regexp_replace(msg, '[0-9]+', '<:NUM:>', 'g') AS masked, count(*) AS n FROM msg GROUP BY masked""",
    "msg",
)
def masked_message_counts(x: Tables):
    return templates.masked_counts(x.msg(), rules=[("[0-9]+", "NUM")])


def _mined(source: str) -> str:
    """Templates of the view ``source``: bands, their most frequent texts, links, what linked texts have in common."""
    return rf"""WITH RECURSIVE m AS (SELECT masked, count(*) AS n FROM (SELECT regexp_replace(msg, '[0-9]+', '<:NUM:>', 'g') AS masked FROM {source}) GROUP BY masked),
    k AS (SELECT masked, n, CAST('0x' || substr(md5(masked), 1, 15) AS BIGINT) AS node,
      list_filter(regexp_split_to_array(trim(translate(masked, '_|', '  ')), '\s+'), lambda w: w <> '') AS tokens FROM m WHERE masked IS NOT NULL),
    g AS (SELECT *, len(tokens) AS width, CAST(ceil(0.6::DOUBLE * len(tokens)) AS BIGINT) AS need,
      concat_ws(' ', CAST(len(tokens) AS VARCHAR), array_to_string(list_transform(tokens[1:2],
        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ')) AS grp FROM k),
    d AS (SELECT *, least(width - need + 1, greatest(width - 2, 0)) AS bands FROM g),
    b AS (SELECT grp, node, n, -1 AS band, '' AS words FROM d
      UNION ALL SELECT grp, node, n, j, array_to_string(tokens[3 + j * (width - 2) // bands : 2 + (j + 1) * (width - 2) // bands], ' ')
      FROM (SELECT *, unnest(range(0, bands)) AS j FROM d)),
    h AS (SELECT grp, band, words, arg_min(node, (-n, node)) AS head FROM b GROUP BY grp, band, words HAVING count(*) > 1),
    p AS (SELECT DISTINCT b.node, head FROM b JOIN h USING (grp, band, words) WHERE node <> head),
    l AS (SELECT p.node, head FROM p JOIN d x ON x.node = p.node JOIN d y ON y.node = head
      WHERE len(list_filter(list_zip(x.tokens, y.tokens), lambda z: z[1] = z[2])) >= x.need),
    e AS (SELECT node, head FROM l UNION SELECT head, node FROM l),
    reached AS (SELECT node, node AS low FROM d UNION SELECT e.head, low FROM reached JOIN e ON e.node = reached.node),
    roots AS (SELECT node, min(low) AS root FROM reached GROUP BY node),
    c AS (SELECT root, i, CASE WHEN min(w) = max(w) THEN min(w) ELSE '<*>' END AS w
      FROM (SELECT root, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM d JOIN roots USING (node)) GROUP BY root, i),
    s AS (SELECT root, list(w ORDER BY i) AS places FROM c GROUP BY root),
    f AS (SELECT grp, n, masked, node, tokens, width, coalesce(places, []) AS places, coalesce(array_to_string(places, ' '), '') AS template
      FROM d JOIN roots USING (node) LEFT JOIN s USING (root)),
    u AS (SELECT DISTINCT grp, places, template FROM f),
    a AS (SELECT masked, arg_min(u.template, (len(list_filter(u.places, lambda w: w = '<*>')), u.template)) AS template FROM f JOIN u USING (grp)
      WHERE len(list_filter(list_zip(f.tokens, u.places), lambda z: z[2] = '<*>' OR z[1] = z[2])) = width GROUP BY masked)
    """


_DIGITS = [("[0-9]+", "NUM")]
_SIZES = "SELECT template, CAST(sum(n) AS BIGINT) AS size FROM f GROUP BY grp, template"
_FOUND = "SELECT {keys}, template FROM {source} JOIN a ON regexp_replace(msg, '[0-9]+', '<:NUM:>', 'g') = a.masked"


def _assigned(log, *keys):
    mined = templates.mine_templates(log, rules=_DIGITS)
    tagged = templates.assign_template(log.select(*keys, "msg"), mined, rules=_DIGITS)
    return tagged.join(mined.select("template_id", "template"), "template_id").select(*keys, "template")


@query(_mined("msg") + _SIZES, "msg")
def mine_templates_plain(x: Tables):
    return templates.mine_templates(x.msg(), rules=_DIGITS).select("template", "size")


@query(_mined("msg") + _FOUND.format(keys="id", source="msg"), "msg")
def assign_template_plain(x: Tables):
    return _assigned(x.msg(), "id")


@query(_mined("shapes") + _SIZES, "shapes")
def mine_templates_of_shapes(x: Tables):
    return templates.mine_templates(x.shapes(), rules=_DIGITS).select("template", "size")


@query(_mined("shapes") + _FOUND.format(keys="id", source="shapes"), "shapes")
def assign_template_of_shapes(x: Tables):
    return _assigned(x.shapes(), "id")


@query(_mined("lines") + _SIZES, "lines")
def mine_templates_of_lines(x: Tables):
    return templates.mine_templates(x.lines(), rules=_DIGITS).select("template", "size")


@query(_mined("lines") + "SELECT doc_id, template, count(*) AS n FROM lines JOIN a ON regexp_replace(msg, '[0-9]+', '<:NUM:>', 'g') = a.masked GROUP BY doc_id, template", "lines")
def assign_template_of_lines(x: Tables):
    return _assigned(x.lines(), "doc_id").groupBy("doc_id", "template").agg(F.count(F.lit(1)).alias("n"))


@query()
def assign_template(x: Tables):
    log = x.msg()
    mined = templates.mine_templates(log.where("cat <> 'view'"))
    return templates.assign_template(log.select("id", "msg"), mined).select("id", "template_id")


@query(
    """WITH r AS (SELECT sn, txt, row_number() OVER (PARTITION BY sn ORDER BY t, id) - 1 AS pos FROM toks)
    SELECT sn, pos // 1000 AS block, count(*) AS n, string_agg(txt, ' ' ORDER BY pos) AS text FROM r GROUP BY sn, block""",
    "toks",
)
def build_corpus(x: Tables):
    log = x.msg().withColumn("segs", logtext.normalize_message(F.col("msg")))
    return corpus.build_corpus(log, "segs", block=1000).drop("tokens")


@query("SELECT id, sn, txt || ' ' || 'm' || (k % 3) AS text FROM toks", "toks")
def build_corpus_split(x: Tables):
    msg = corpus.with_model(F.col("msg"), F.concat(F.lit("M"), F.col("k") % 3))
    log = x.msg().withColumn("segs", logtext.normalize_message(msg))
    return corpus.build_corpus(log, "segs", mode="split").select("id", "sn", "text")


_TERMS = """WITH g AS (SELECT doc_id, unnest(tokens) AS term FROM docwords
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM docwords),
    c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
    s AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term),
    b AS (SELECT term, df, row_number() OVER (ORDER BY total DESC, term) AS r FROM s),
    vo AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM b WHERE r <= {n})"""


def _doc_terms(x: Tables, best: int):
    parts = x.docs().select("doc_id", corpus.words(F.col("text")).alias("tokens"))
    return corpus.term_counts(parts, "doc_id", "tokens", (1, 2), best=best)


@query(
    _TERMS.format(n=300) + "SELECT doc_id, idx, term, tf FROM c JOIN vo USING (term)", "docwords"
)
def count_features(x: Tables):
    counts = _doc_terms(x, 300)
    return corpus.count_features(counts, corpus.top_terms(counts, 300), "doc_id")


_TFIDF = """, w AS (SELECT doc_id, idx, term, tf * (ln((1 + (SELECT count(*) FROM docwords)) / (1.0 + df)) + 1) AS x
      FROM c JOIN vo USING (term)),
    l AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM w GROUP BY doc_id)
    SELECT doc_id, idx, term, round(x / len, 6) AS x FROM w JOIN l USING (doc_id)"""


@query(_TERMS.format(n=800) + _TFIDF, "docwords")
def tfidf_features(x: Tables):
    counts = _doc_terms(x, 800)
    model = corpus.tfidf_fit(counts, x.docs(), 800)
    return rounded(corpus.tfidf_transform(counts, model, "doc_id"), ["x"])


_TICKET_TERMS = """WITH l AS (SELECT ticket_id, t, id, tokens FROM ticket k JOIN toks m ON k.sn = m.sn
      AND m.t > fault_t - 3456000 AND m.t <= fault_t),
    u AS (SELECT ticket_id, t, id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM l),
    n AS (SELECT ticket_id AS doc, w, lead(w) OVER (PARTITION BY ticket_id ORDER BY t, id, i) AS w2 FROM u),
    g AS (SELECT doc, w AS term FROM n UNION ALL SELECT doc, w || ' ' || w2 FROM n WHERE w2 IS NOT NULL),
    c AS (SELECT doc AS ticket_id, term, count(*) AS tf FROM g GROUP BY doc, term),
    mu AS (SELECT sn, t, id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM toks),
    mn AS (SELECT sn, w, lead(w) OVER (PARTITION BY sn ORDER BY t, id, i) AS w2 FROM mu),
    mg AS (SELECT sn, w AS term FROM mn UNION ALL SELECT sn, w || ' ' || w2 FROM mn WHERE w2 IS NOT NULL),
    mc AS (SELECT sn, term, count(*) AS tf FROM mg GROUP BY sn, term),
    s AS (SELECT term, sum(tf) AS total, count(*) AS df FROM mc GROUP BY term),
    b AS (SELECT term, df, row_number() OVER (ORDER BY total DESC, term) AS r FROM s),
    vo AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM b WHERE r <= 800),
    w AS (SELECT ticket_id, idx, term, tf * (ln((1 + (SELECT count(DISTINCT sn) FROM toks)) / (1.0 + df)) + 1) AS x
      FROM c JOIN vo USING (term)),
    le AS (SELECT ticket_id, sqrt(sum(x * x)) AS len FROM w GROUP BY ticket_id)
    SELECT ticket_id, idx, term, round(x / len, 6) AS x FROM w JOIN le USING (ticket_id)"""


def _message_tokens(x: Tables):
    tokens = logtext.message_tokens(logtext.normalize_message(F.col("msg")))
    # the masks cost far more than the rows: spread over all tasks, however few files there are
    return x.msg().select("sn", "t", "id", "msg").repartition("id").select("sn", "t", "id", tokens.alias("tokens"))


@query(_TICKET_TERMS, "ticket toks")
def tfidf_features_of_tickets(x: Tables):
    """Vocabulary and idf from the machine corpora, applied to the look-back of each ticket."""
    log = stored(_message_tokens(x), "tokens")  # read three times
    grams = stored(corpus.timed_grams(log, ["sn"], "tokens", (1, 2)), "grams")
    machines = corpus.gram_counts(grams)
    model = stored(corpus.tfidf_fit(machines, log.select("sn").distinct(), 800), "vocabulary")
    tickets = corpus.lookback_term_counts(grams, x.ticket(), model, listed=True)
    return rounded(corpus.tfidf_transform(tickets, model, "ticket_id"), ["x"])


@query()
def svd_features(x: Tables):
    parts = x.docs().select("doc_id", corpus.words(F.col("text")).alias("tokens"))
    # read twice by the model and twice by the decomposition
    counts = stored(corpus.term_counts(parts, "doc_id", "tokens", best=400), "counts")
    cells = corpus.tfidf_transform(counts, corpus.tfidf_fit(counts, x.docs(), 400), "doc_id")
    found = vectors.svd_features(cells, "doc_id", "x", 400, 8)
    return found.select("doc_id", *[r6(F.col("vec")[i]).alias(f"svd_{i}") for i in range(8)])


@query()
def word_vectors(x: Tables):
    sentences = corpus.sequence_per_entity(x.ev(), ["sn"], ["t", "id"], "cat", 1000).select("tokens")
    found = vectors.word_vectors(sentences, "tokens", size=16, window=16)
    return found.select("word", *[F.col("vec")[i].alias(f"v_{i}") for i in range(16)])


def _word_counts(x: Tables):
    return x.ev().groupBy("sn", F.col("k").cast("string").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def _flat(df, key, columns):
    return df.select(
        key, *[r6(F.col(c)[i]).alias(f"{c}_{i}") for c in columns for i in range(DIM)]
    )


@query(
    """WITH u AS (SELECT sn, generate_subscripts(vec, 1) - 1 AS i, CAST(unnest(vec) AS DOUBLE) AS z
      FROM (SELECT sn, CAST(k AS VARCHAR) AS word FROM ev) JOIN tok_vec USING (word))
    SELECT sn, """
    + ", ".join(
        f"round({fn}(z) FILTER (i = {i}), 6) AS {name}_{i}"
        for name, fn in [("mean", "avg"), ("min", "min"), ("max", "max")]
        for i in range(DIM)
    )
    + " FROM u GROUP BY sn",
    "ev tok_vec",
)
def pool_embeddings(x: Tables):
    pooled = vectors.pool_embeddings(_word_counts(x), x.tok_vec(), "sn", DIM)
    return _flat(pooled, "sn", ["mean", "min", "max"])


@query(
    """WITH p AS (SELECT word, 0.001 / (0.001 + count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM ev)) AS w
      FROM (SELECT CAST(k AS VARCHAR) AS word FROM ev) GROUP BY word),
    u AS (SELECT sn, generate_subscripts(vec, 1) - 1 AS i, w * CAST(unnest(vec) AS DOUBLE) AS z
      FROM (SELECT sn, CAST(k AS VARCHAR) AS word FROM ev) JOIN p USING (word) JOIN tok_vec USING (word))
    SELECT sn, """
    + ", ".join(f"round(sum(z) FILTER (i = {i}), 6) AS vec_{i}" for i in range(DIM))
    + " FROM u GROUP BY sn",
    "ev tok_vec",
)
def sif_weighted_sums(x: Tables):
    return _flat(vectors.sif_weights(_word_counts(x), x.tok_vec(), "sn", DIM), "sn", ["vec"])


@query()
def sif_embeddings(x: Tables):
    return _flat(vectors.sif_embeddings(_word_counts(x), x.tok_vec(), "sn", DIM), "sn", ["vec"])


def _sequence_sql(first: str, fill: str) -> str:
    return f"""WITH f AS (SELECT w, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM docwords) GROUP BY w),
    vo AS (SELECT w, r + 1 AS code FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM f) WHERE r <= 500),
    k AS (SELECT doc_id, {first} AS kept FROM docwords),
    u AS (SELECT doc_id, unnest(kept) AS w, generate_subscripts(kept, 1) AS i FROM k),
    j AS (SELECT doc_id, string_agg(CAST(coalesce(code, 1) AS VARCHAR), ' ' ORDER BY i) AS ids, count(*) AS n
      FROM u LEFT JOIN vo USING (w) GROUP BY doc_id)
    SELECT doc_id, {fill} AS ids FROM docwords LEFT JOIN j USING (doc_id)"""


def _encoded(x: Tables, padding: str):
    parts = x.docs().select("doc_id", corpus.words(F.col("text")).alias("tokens"))
    vocabulary = corpus.fit_vocabulary(parts, "tokens", 500).select("word", (F.col("id") + 1).alias("id"))
    ids = corpus.encode_sequences(parts, "tokens", vocabulary, 128, ["doc_id"], padding)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    _sequence_sql(
        "tokens[greatest(len(tokens) - 128, 0) + 1:]",
        "trim(repeat('0 ', 128 - coalesce(n, 0)) || coalesce(ids, ''))",
    ),
    "docwords",
)
def encode_sequences(x: Tables):
    return _encoded(x, "pre")


@query(
    _sequence_sql("tokens[:128]", "trim(coalesce(ids, '') || repeat(' 0', 128 - coalesce(n, 0)))"), "docwords"
)
def encode_sequences_post(x: Tables):
    return _encoded(x, "post")


@query(
    """WITH v AS (SELECT CAST(k AS VARCHAR) AS word, row_number() OVER (ORDER BY count(*) DESC, CAST(k AS VARCHAR)) AS id
      FROM ev WHERE k % 3 = 0 GROUP BY k),
    m AS (SELECT id, CASE WHEN CAST(word AS INTEGER) % 2 = 0 THEN vec END AS vec FROM v JOIN tok_vec USING (word) WHERE id <= 40)
    SELECT s.id AS id, """
    + ", ".join(
        f"CASE WHEN m.id IS NULL THEN 0.0::DOUBLE WHEN vec IS NULL THEN 1.0::DOUBLE ELSE round(CAST(vec[{i + 1}] AS DOUBLE), 6) END AS vec_{i}"
        for i in range(DIM)
    )
    + """ FROM (SELECT unnest(range(41)) AS id) s LEFT JOIN m ON s.id = m.id""",
    "ev tok_vec",
)
def embedding_matrix(x: Tables):
    words = x.ev().where("k % 3 = 0").select(F.array(F.col("k").cast("string")).alias("tokens"))
    vocabulary = corpus.fit_vocabulary(words, "tokens")
    known = x.tok_vec().where("cast(word as int) % 2 = 0")
    matrix = vectors.embedding_matrix(vocabulary, known, DIM, 40)
    return matrix.select("id", *[r6(F.col("vec")[i]).alias(f"vec_{i}") for i in range(DIM)])


@query(
    """WITH s AS (SELECT avg(v) AS m, stddev_pop(v) AS s, avg(k) AS mk, stddev_pop(k) AS sk FROM ev WHERE id % 2 = 0)
    SELECT id, round((v - m) / s, 6) AS v, round((k - mk) / sk, 6) AS k FROM ev, s""",
    "ev",
)
def scale_features(x: Tables):
    scaled = vectors.scale_features(x.ev().select("id", "v", "k"), ["v", "k"], F.col("id") % 2 == 0)
    return rounded(scaled, ["v", "k"])
