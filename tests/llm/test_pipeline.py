import re
import zlib

import corpus_pipeline
import numpy as np
from vigilog.llm import decontamination, pii, simhash
from vigilog.llm.decontamination_sql import LEAKS_SQL
from vigilog.llm.quality_sql import QUALITY_SQL

from .test_similarity import slow_components, slow_set
from .test_spans import slow_base
from .test_tokens import check_packing, plain  # noqa: F401


def test_stages_against_brute_force(spark, sf, docs, con, plain):  # noqa: F811
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = sorted(i for i, kept in con.sql(f"SELECT doc_id, kept FROM ({QUALITY_SQL})").fetchall() if kept)
    groups = slow_components([slow_set(texts[i], 5) for i in good])
    first = [i for k, i in enumerate(good) if groups[k] == k]
    leaking = {i for (i,) in con.sql(f"SELECT doc_id FROM ({LEAKS_SQL})").fetchall()}
    left = [i for i in first if i not in leaking]
    clean = {}
    for i in left:
        text = texts[i]
        for k, a, b in sorted(slow_base(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{pii.KINDS[k].upper()}]" + text[b:]
        clean[i] = text
    rows = corpus_pipeline.run(spark, sf).collect()
    # The sample of so few documents calibrates no added spans, so the strict ones are all.
    check_packing(rows, clean, plain)
    assert 0 < len(left) < len(first) < len(good) < len(texts)


def test_stages_keep_columns_and_stand_empty_tables(spark, sf, edges, nothing):
    for frame in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf).columns == frame.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
        assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert simhash.representatives(edges).count() and decontamination.decontaminated(edges, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == edges.count()


def test_no_personal_data_is_left(spark, sf, docs):
    for r in corpus_pipeline.personal_data(spark, docs, sf).collect():
        assert not slow_base(r.text) and r.n_chars == len(r.text)
        assert not re.search(r"@[a-z0-9]+\.example", r.text)


def test_windows_hold_their_ids(spark, sf, edges, nothing, plain):  # noqa: F811
    rows = corpus_pipeline.token_windows(spark, edges, sf).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    long = next(r.text for r in edges.collect() if r.text and len(r.text) > 100_000)
    parts = sorted((r.start, r.ids) for r in rows if r.doc_id == 7 and r.doc_tokens > 2048)
    assert sum((ids for _, ids in parts), []) == [*plain(long), 1] and len(parts) > 1
    assert corpus_pipeline.token_windows(spark, nothing, sf).count() == 0
