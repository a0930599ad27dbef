"""Queries without SQL twins over whole small tables, against plain versions."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

from keystrata.llm import decontaminate, substring_dedup, token_files
from keystrata.llm.queries import QUERIES
from tests.llm.test_corpus_ops import plain_components, plain_fingerprint, plain_quality
from tests.llm.test_text_ops import brute_base, plain_tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]


def test_license_scan(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_substring_dedup(spark, docs):
    coded = {d: (t or "").encode() for d, t, _ in docs}
    pieces = {d: [(int(s), int(e)) for s, e in zip(*substring_dedup.chunks(c), strict=True)] if c else [] for d, c in coded.items()}
    holders, whole = {}, {}
    for d, c in coded.items():
        for s, e in pieces[d]:
            holders.setdefault(c[s:e], set()).add(d)
        if 0 < len(c) < substring_dedup.PASSAGE:
            whole.setdefault(c, set()).add(d)
    want = {}
    for d, c in coded.items():
        runs, at = [], None
        for s, e in [*pieces[d], (len(c), len(c))]:
            if e > s and len(holders[c[s:e]]) > 1:
                at = s if at is None else at
            elif at is not None:
                runs += [s - at] if s - at >= substring_dedup.PASSAGE else []
                at = None
        if len(whole.get(c, ())) > 1:
            runs.append(len(c))
        if runs:
            want[d] = (len(runs), sum(runs))
    got = {r["doc_id"]: (r["n_passages"], r["repeated_bytes"]) for r in QUERIES["op3_substring_dedup"](spark, DATA).collect()}
    assert got == want and want


def test_token_files(spark, docs):
    start, want = 0, []
    for (d, _, _), ids in zip(docs, plain_tokens([t for _, t, _ in docs]), strict=True):
        want.append((d, start, len(ids) + 1, zlib.crc32(np.array([*ids, token_files.END_ID], dtype="<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(tuple(r) for r in QUERIES["op5_token_files"](spark, DATA).collect()) == want


def test_simhash(spark, docs):
    prints = [plain_fingerprint(t) for _, t, _ in docs]
    roots = plain_components(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    want = sorted((d, f"{f:016x}", docs[r][0]) for (d, _, _), f, r in zip(docs, prints, roots, strict=True))
    assert sorted(tuple(r) for r in QUERIES["op8_simhash"](spark, DATA).collect()) == want


def test_quality(spark, docs):
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = plain_quality([(d, lang, t) for d, t, lang in docs], labels)
    got = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    for d, (n, score, most, keep) in want.items():
        assert got[d]["n_symbols"] == n
        assert np.log(got[d]["perplexity"]) == pytest.approx(score, abs=3e-3) and np.log(got[d]["threshold"]) == pytest.approx(most, abs=3e-3)
        assert got[d]["keep"] == keep or abs(score - most) < 5e-3


def test_decontamination(spark, docs):
    """Least edits of each item against any part of each document, by whole tables of alignment."""
    gap = "\0" * 60  # no region within a budget reaches over it
    plain = [decontaminate.canonical(t) for _, t, _ in docs]
    ends = np.cumsum([len(p) + len(gap) for p in plain])
    text = np.frombuffer(gap.join([*plain, ""]).encode("utf-32-le"), dtype=np.uint32)
    steps = np.arange(len(text) + 1, dtype=np.int32)
    want = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        item = decontaminate.canonical(r["text"])
        k = decontaminate.budget(len(item))
        row = np.zeros(len(text) + 1, dtype=np.int32)
        for i, c in enumerate(item, 1):
            last = row
            row = np.empty_like(last)
            row[0] = i
            row[1:] = np.minimum(last[:-1] + (text != ord(c)), last[1:] + 1)
            row = np.minimum.accumulate(row - steps) + steps
        for at in np.nonzero(row <= k)[0]:
            want.add((docs[int(np.searchsorted(ends, at))][0], r["item_id"]))
    found = QUERIES["op10_decontaminate"](spark, DATA).collect()
    items = {r["item_id"]: len(decontaminate.canonical(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in found}
    # beyond whole items there are only parts of long ones
    assert want <= got and all(items[i] > decontaminate.LONG for _, i in got - want)
    assert Counter(d for d, _ in want)
