import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from brute import DOCS, contamination, messy_docs, near_components  # noqa: E402
from test_pair_operators import targets_by_hand  # noqa: E402

import corpus_pipeline  # noqa: E402
from fleetlog.llm.queries import tokenizer_path  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@needs_data
def test_every_stage_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.collect())
        assert name == "tokens" or docs.columns == columns
    raw, known, single, clean, mix, tokens = tables

    assert {r.doc_id for r in raw if not any(c.isalpha() for c in r.text or "")}.isdisjoint(r.doc_id for r in known)
    assert len(known) >= 0.97 * len(raw)

    ordered = sorted(known, key=lambda r: r.doc_id)
    roots, _ = near_components([r.text for r in ordered])
    assert sorted(r.doc_id for r in single) == [r.doc_id for i, r in enumerate(ordered) if roots[i] == i]

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    verdicts = {r.doc_id: contamination(r.text, items) for r in single}
    assert {r.doc_id for r in clean} == {d for d, (n, hit, _) in verdicts.items() if not (hit > 0 and 20 * hit >= n)}

    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += words(r.text)
    for r in mix:
        taken[r.source] += words(r.text)
        assert r.n_chars == len(r.text)
    assert {s: taken[s] for s in sizes} == {s: int(t + 1e-6) for s, t in targets_by_hand(sizes).items()}
    assert max(Counter(r.doc_id for r in mix).values()) <= 3

    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in mix:
        ids = [*reference.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens) == sorted(want)
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


@needs_data
@pytest.mark.parametrize("rows", ["messy", "none"])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, rows):
    docs = messy_docs(spark) if rows == "messy" else spark.createDataFrame([], DOCS)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or docs.columns == columns
    assert (docs.count() == 0) == (rows == "none")
