"""Each stage of the pipeline on what the one before has kept, against brute force on the small tables."""

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from keystrata.llm import decontaminate, token_files
from keystrata.llm.common import materialize, table
from keystrata.llm.queries import ORACLES, QUERIES
from tests.llm.test_corpus_ops import plain_components, plain_mix
from tests.llm.test_text_ops import plain_tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, DATA, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], DATA), name))
    return docs


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    sizes = [d.count() for d in stages]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5]


def test_quality_follows_the_labels(spark):
    # the next larger tables: the small ones have eleven bad documents and a dozen good ones a language
    folder = DATA.replace("0.001", "0.01")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, table(spark, folder, "documents"), folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    good, bad = ({d for d, q in labels.items() if q == v} for v in (1, 0))
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.25 * len(bad)


def test_one_document_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"] or "") for r in stages[1].collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {rows[r][0] for r in plain_components(len(rows), close)}
    assert {r["doc_id"] for r in stages[2].collect()} == want


def test_documents_with_items_go(spark, stages):
    items = [decontaminate.canonical(r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    held = {r["doc_id"] for r in stages[2].collect() if any(i in decontaminate.canonical(r["text"]) for i in items)}
    before, after = ({r["doc_id"] for r in d.collect()} for d in stages[2:4])
    assert held and before - after >= held and len(before - after - held) <= 1


def test_mix_takes_whole_documents(stages):
    data = [(r["doc_id"], r["text"], r["source"]) for r in stages[3].collect()]
    source = {d: s for d, _, s in data}
    want = {d: (size, taken) for d, size, _, _, taken in plain_mix(data)}
    times = {d: 0 for d in want}
    for r in stages[4].collect():
        times[r["doc_id"]] += 1
    for d, (size, taken) in want.items():
        assert size == 0 or times[d] == int(taken / size + 0.5) or abs(times[d] * size - taken) <= size
    for s in set(source.values()):
        own = [d for d in want if source[d] == s]
        assert abs(sum(times[d] * want[d][0] - want[d][1] for d in own)) <= max(want[d][0] for d in own)


def test_token_files_hold_the_mix_in_training_order(spark, stages):
    from pyspark.sql import functions as F

    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = [(r["doc_id"], r["text"]) for r in stages[4].select("doc_id", "text", part.alias("part"), F.col("_metadata.row_index").alias("row")).orderBy("part", "row").collect()]
    start, want = 0, []
    for (doc, _), ids in zip(rows, plain_tokens([t for _, t in rows]), strict=True):
        want.append((doc, start, len(ids) + 1, zlib.crc32(np.array([*ids, token_files.END_ID], dtype="<u4").tobytes())))
        start += len(ids) + 1
    assert sorted((tuple(r) for r in stages[5].collect()), key=lambda r: r[1]) == want


def test_files_follow_the_schedule(stages):
    data = [(r["doc_id"], r["text"], r["source"]) for r in stages[3].collect()]
    source = {d: s for d, _, s in data}
    ranks = {s: i % 3 for i, s in enumerate(sorted({s for s in source.values()}, key=lambda s: (s is None, s)))}
    order = sorted((tuple(r) for r in stages[5].collect()), key=lambda r: r[1])
    # sources of the first schedule fade out, those of the last fade in
    place = {k: np.mean([i for i, r in enumerate(order) if ranks[source[r[0]]] == k]) / len(order) for k in set(ranks.values())}
    assert place[0] < 0.5 < place[2] and place[0] < place[1] < place[2]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, more columns; and no rows at all."""
    text = "the same words stand here in every row of this small table and in no other one"
    data = [(1, text, "en", "a", 3, 1), (1, text, "en", "a", 3, 1), (None, None, None, None, None, None), (2, "", "de", None, 0, 2), (None, text, None, "b", 1, 3), (3, "quite another text", "en", "b", 1, 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, node int")
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "an item that stands nowhere else"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (docs, docs.where("false")):
        own = materialize(rows, "odd")
        for name, stage in corpus_pipeline.STAGES:
            before, own = own, materialize(stage(spark, own, folder), name)
            assert name == "tokens" or own.columns == docs.columns
        assert own.count() == before.count() and (own.count() > 0) == (rows.count() > 0)


def test_every_operator_has_its_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    order = [df.columns.index(c) for c in want.columns]
    assert sorted(repr([r[i] for i in order]) for r in df.collect()) == sorted(repr(list(r)) for r in want.fetchall())
