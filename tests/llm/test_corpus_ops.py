"""Mixing, fingerprints, components, decontamination, passages, quality, language and search against brute force."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keystrata.llm import decontaminate, golay, language_id, near_duplicates, quality, simhash, source_mix, substring_dedup, topk_search, word_model
from keystrata.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, labels int, _place string, n int"
WORDS = [a + b for a in ("ta", "ri", "mo", "se", "lu", "ke") for b in ("na", "vo", "shi", "", "ndra", "x")]


def prose(pick, n):
    return " ".join(pick.choice(WORDS) + pick.choice(["", "", "s", "ed"]) for _ in range(n))


def corpus(spark, texts, ids=None):
    """Documents with nulls and columns whose names clash with the operators' own."""
    data = [(i if ids is None else ids[i], t, ["en", "de", None][i % 3], [None, "a", "b"][i % 3], None, i, None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOC)


# mixing


def plain_mix(data):
    """Targets by rounds of resharing, and words taken in order of the digest."""
    import hashlib

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(data)}
    sources = sorted({s for _, _, s in data}, key=lambda s: (s is None, s))
    whole = {s: sum(size[i] for i, d in enumerate(data) if d[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    open_, target, left = set(sources), {}, 1.5 * sum(whole.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * whole[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 2.0 * whole[s] for s in over})
        left -= sum(2 * whole[s] for s in over)
        open_ -= over
    out = []
    for s in sources:
        rows = sorted((i for i, d in enumerate(data) if d[2] == s), key=lambda i: (hashlib.md5(str("" if data[i][0] is None else data[i][0]).encode()).hexdigest(), size[i]))
        at = 0
        for i in rows:
            goal = int(target[s] + 1e-9)
            out.append((data[i][0], size[i], whole[s], round(target[s], 6), sum(max(0, min(size[i], goal - at - e * whole[s])) for e in (0, 1))))
            at += size[i]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    pick = random.Random(seed)
    data = [(i if pick.random() < 0.95 else None, None if pick.random() < 0.05 else prose(pick, pick.choice([0, 3, 30, 200])), pick.choice(["hot", "hot", "hot", "b", "c", "ß", None])) for i in range(120)]
    data = [(i, t, s) for i, t, s in data if i is not None] + [(None, "a null id", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("target", F.lit(3)).withColumn("bucket", F.lit("x"))
    planned = source_mix.plan_mix(docs)
    got = sorted(((r["doc_id"], r["_mix_size"], r["_mix_source_size"], round(r["_mix_target"], 6), r["_mix_taken"]) for r in planned.collect()), key=repr)
    assert got == plain_mix(data)
    order = source_mix.training_order(planned)
    assert order.columns == docs.columns
    taken = {}
    for r in order.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    goal = {r["source"]: r["_mix_target"] for r in planned.collect()}
    assert all(abs(taken.get(s, 0) - t) <= 200 for s, t in goal.items())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mix.plan_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["_mix_taken"] for r in source_mix.plan_mix(blank).collect()} == {0}


def test_positions_follow_the_schedule(spark):
    fractions = [i / 20 for i in range(21)]
    for schedule in source_mix.SCHEDULES:
        got = spark.createDataFrame([(f,) for f in fractions], "f double").select(source_mix.inverse(schedule, F.col("f"))).collect()
        for f, r in zip(fractions, got, strict=True):
            u = r[0]
            steps = np.linspace(0, u, 20_001)
            area = np.trapezoid(np.interp(steps, [k for k, _ in schedule], [w for _, w in schedule]), steps)
            assert area / source_mix.integral(schedule) == pytest.approx(f, abs=1e-6)


# fingerprints and components


def test_keys_meet_up_to_three_bits():
    pick = np.random.default_rng(5)
    base = pick.integers(0, 2**64, 300, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        other = base.copy()
        for i in range(len(other)):
            for b in pick.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        a, b = ({(k, r) for k, r in zip(*(x.tolist() for x in golay.keys(f)), strict=True)} for f in (base, other))
        assert {r for _, r in a & b} == set(range(300))


def test_golay_code_is_perfect_and_near_words_share_a_codeword():
    table, counts = golay.patterns()
    assert sorted(set(counts.tolist())) == [1, 6]
    word = np.random.default_rng(1).integers(0, 2**23, 2000).astype(np.uint32)
    for bit in range(23):
        (a, n), (b, m) = golay.indices(word), golay.indices(word ^ np.uint32(1 << bit))
        assert all(set(x[:i]) & set(y[:j]) for x, i, y, j in zip(a.tolist(), n, b.tolist(), m, strict=True))


def plain_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    s = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def near_copies(pick, n, length, edits):
    base = prose(pick, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[pick.randrange(len(w))] = pick.choice(WORDS) + "q"
        out.append(" ".join(w))
    return out


def test_simhash_query(spark):
    pick = random.Random(7)
    texts = [None, "", " \t\n", "one", "one", "One", "one two", "É\x0bé x", "x" * 100_000, "long " * 30_000]
    texts += [prose(pick, pick.choice([1, 2, 3, 50, 400])) for _ in range(80)] + near_copies(pick, 150, 300, 2) + near_copies(pick, 20, 40, 1) + ["same text here now"] * 40
    ids = [1000 - i for i in range(len(texts))]
    docs = corpus(spark, texts, ids)
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, 10**9), ids[i])
    found = simhash.linked_components(simhash.with_fingerprint(docs, 3), 3).select("doc_id", simhash.hexadecimal("fp").alias("fp"), "component_id").collect()
    assert {r["doc_id"]: (r["fp"], r["component_id"]) for r in found} == {d: (f"{f:016x}", least[r]) for d, f, r in zip(ids, fps, roots, strict=True)}
    assert simhash.linked_components(simhash.with_fingerprint(docs.where("false"), 3), 3).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words stand here")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.linked_components(simhash.with_fingerprint(docs, 3), 3).collect()), key=repr)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=repr)


def test_forest_connects_what_all_pairs_connect():
    pick = np.random.default_rng(2)
    fp = pick.integers(0, 2**64, 1, dtype=np.uint64) ^ (np.uint64(1) << pick.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << pick.integers(0, 64, 300, dtype=np.uint64))
    fp = np.unique(np.concatenate([fp, pick.integers(0, 2**64, 100, dtype=np.uint64)]))
    a, b = simhash.forest(fp, 2)
    want = plain_components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2])
    assert plain_components(len(fp), zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(fp) - len(set(want))
    for run in (10, 31, 200):
        key = np.arange(len(fp)) // run
        x, y = simhash.links_of_runs(key, fp, 2, False)
        inside = plain_components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= 2])
        assert plain_components(len(fp), zip(x.tolist(), y.tolist(), strict=True)) == inside


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 1), (3, 3), (2, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(i * 7 % 60, i * 11 % 60) for i in range(45)]])
def test_components(spark, links):
    df = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    want = plain_components(100, links)
    assert got == {x: want[x] for pair in links for x in pair if pair[0] != pair[1]}


def test_near_duplicates(spark):
    pick = random.Random(3)
    texts = [prose(pick, 120) for _ in range(40)]
    for g in range(12):
        texts += near_copies(pick, 4, 150, 1)
    texts += ["exact copy of this text"] * 30 + [None, "", "  "] + near_copies(pick, 60, 200, 2)
    docs = corpus(spark, texts)
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    sets = [{tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = plain_components(len(texts), close)
    # every group keeps its first document, and hardly any other of it stays
    assert set(roots) <= ids and len(ids) <= 1.03 * len(set(roots))
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y"), (None, "x y"), (1, "quite another text")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates.drop_near_duplicates(twice).collect()), key=repr) == sorted([(1, "a b c d e f"), (None, "x y"), (1, "quite another text")], key=repr)
    assert near_duplicates.drop_near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_with_text_appended_or_a_block_replaced(spark):
    pick = random.Random(17)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    drawn = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    texts = []
    for i in range(60):
        base = drawn(300)
        texts += [base, base + drawn(66) if i % 2 else base[:140] + drawn(24) + base[164:]]
    docs = corpus(spark, [" ".join(t) for t in texts])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert all(0.8 <= x <= 0.87 for x in like)
    assert {r["doc_id"] for r in near_duplicates.drop_near_duplicates(docs).collect()} == set(range(0, 120, 2))


def test_near_duplicates_of_a_large_family(spark):
    pick = random.Random(18)
    texts = []
    for _ in range(2):
        base = prose(pick, 200).split()
        texts.append(" ".join(base))
        for _ in range(150):
            w = list(base)
            for at in pick.sample(range(200), 4):
                w[at] = pick.choice(WORDS) + "q"
            texts.append(" ".join(w))
    assert {r["doc_id"] for r in near_duplicates.drop_near_duplicates(corpus(spark, texts)).collect()} == {0, 151}


def plain_groups(texts, size=5, least=0.8):
    """Each text's first text of its group, by all pairs that share a shingle."""
    sets, where = [], {}
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    first = {}
    of = [first.setdefault(frozenset(s), i) for i, s in enumerate(sets)]
    close = [(i, f) for i, f in enumerate(of) if f != i]
    for i in sorted(set(of)):
        shared = Counter(j for s in sets[i] for j in where.get(s, ()))
        close += [(i, j) for j, n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    return plain_components(len(texts), close)


def test_near_duplicates_of_a_family_about_the_bound(spark):
    pick = random.Random(21)
    base = prose(pick, 150).split()
    texts = [" ".join(base)]
    for _ in range(300):
        w = list(base)
        for at in pick.sample(range(150), pick.choice([1, 2, 3, 4, 5])):
            w[at] = pick.choice(WORDS) + pick.choice("qzy")
        texts.append(" ".join(w))
    texts += near_copies(pick, 40, 90, 3)
    want = plain_groups(texts)
    assert {r["doc_id"] for r in near_duplicates.drop_near_duplicates(corpus(spark, texts)).collect()} == set(want)


def test_joining_connects_what_all_pairs_connect():
    pick = random.Random(22)
    texts = near_copies(pick, 60, 100, 4) + near_copies(pick, 20, 100, 3)
    sets = near_duplicates.shingle_sets(texts)
    least = near_duplicates.minima(*near_duplicates.shingles(*near_duplicates.byte_words(texts), 5)).astype(np.uint8)
    root = np.arange(len(texts)) // 3
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if near_duplicates.similarity(sets[a], sets[b]) >= 0.8 and near_duplicates.alike(least[a], least[b]) >= near_duplicates.LIKELY]
    same = [(a, b) for a in range(len(texts)) for b in range(a) if root[a] == root[b]]
    got = near_duplicates.joining(root, np.arange(len(texts)), least, sets)
    assert plain_components(len(texts), same + got) == plain_components(len(texts), same + pairs) and len(got) < len(texts)


@pytest.mark.parametrize("sf", ["0.01"])
def test_near_duplicates_of_a_whole_table(spark, sf):
    path = f"/root/testdata/sf{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {rows[r][0] for r in plain_groups([t for _, t in rows])}
    assert {r["doc_id"] for r in near_duplicates.drop_near_duplicates(docs).collect()} == want


def test_near_duplicates_carry_any_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other")], "doc_id long, text string")
    names = ["node", "keeper", "id", "one", "two", "root", "key", "fp", "sketch", "w_id"]
    odd = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    kept = near_duplicates.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 3}


# decontamination


def plain_edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            row[j] = min(last[j - 1] + (c != text[j - 1]), last[j] + 1, row[j - 1] + 1)
    return min(row)


def mutated(pick, text, edits):
    c = list(text)
    for _ in range(edits):
        p, kind = pick.randrange(1, len(c) - 1), pick.randrange(3)
        if kind == 0:
            c[p] = "ж"
        elif kind == 1:
            c.insert(p, "ж")
        elif c[p - 1] != " ":
            del c[p]
    return "".join(c)


def test_decontamination_finds_what_full_alignment_finds():
    pick = random.Random(11)
    items = [(i, prose(pick, pick.choice([4, 8, 15, 30]))) for i in range(25)] + [(90, None), (91, "short"), (92, "")]
    index = decontaminate.Index.build(items)
    texts = [None, "", "x"]
    for n in range(60):
        _, item = items[pick.randrange(25)]
        k = decontaminate.budget(len(decontaminate.canonical(item)))
        texts.append(prose(pick, 20) + ".\n" + mutated(pick, item, pick.choice([0, 1, k, k + 1, 2 * k + 3])).upper() + "! " + prose(pick, 15))
    found = index.regions(texts)
    for text, regions in zip(texts, found, strict=True):
        plain = decontaminate.canonical(text)
        got = {i: min(e for j, _, _, e in regions if j == i) for i, *_ in regions}
        for i, item in items[:25]:
            c = decontaminate.canonical(item)
            edits = plain_edits(c, plain)
            assert got.get(i) == (edits if edits <= decontaminate.budget(len(c)) else None)
        for i, start, end, edits in regions:
            assert plain_edits(decontaminate.canonical(dict(items)[i]), plain[start:end]) == edits


def test_decontamination_tables(spark):
    pick = random.Random(2)
    items = [(i, prose(pick, 12)) for i in range(6)]
    bench = spark.createDataFrame([*items, items[0], (None, None)], "item_id long, text string")
    texts = [None, "", prose(pick, 50), items[0][1], "x " + items[1][1] + " y " + items[1][1], items[2][1].upper() + " " + items[3][1], "long " * 40_000 + items[4][1]]
    docs = corpus(spark, texts)
    for chars in (4_000_000, 100):  # one slice of the benchmark, and several
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, slice_chars=chars).collect())
        assert got == [(3, 0), (4, 1), (4, 1), (5, 2), (5, 3), (6, 4)]
        kept = decontaminate.drop_contaminated(docs, bench, slice_chars=chars)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == len(texts)
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_short_items_and_parts_of_long_ones():
    pick = random.Random(12)
    long = decontaminate.canonical(prose(pick, 90))
    index = decontaminate.Index.build([(1, "the cat"), (2, "Abcdefgh"), (3, "!?"), (4, long), (5, "the cat")])
    half = long[len(long) // 4 : 3 * len(long) // 4]
    texts = ["So the CAT, the cat!", "xabcdefgh abcdefghx", "abcdefgh", "", None, f"before {half} after", f"before {long} after", prose(pick, 40) + " " + long[100:270], prose(pick, 40) + " " + long[:90]]
    found = index.regions(texts)
    assert sorted(found[0]) == [(1, 3, 10, 0), (1, 11, 18, 0), (5, 3, 10, 0), (5, 11, 18, 0)]
    assert found[1] == found[3] == found[4] == [] and found[2] == [(2, 0, 8, 0)]
    assert [r[0] for r in found[5]] == [4] and found[5][0][2] - found[5][0][1] >= 150
    assert found[6] == [(4, 7, 7 + len(long), 0)] and [r[0] for r in found[7]] == [4] and found[8] == []
    assert decontaminate.windows(long[:300]) == [] and all(len(w) >= 100 and w in long for w in decontaminate.windows(long))


# passages


def test_passages_are_found_wherever_they_stand(spark):
    pick = random.Random(6)
    shared = prose(pick, 60)
    line = "A short line that many share."
    texts = [prose(pick, 80) + " " + shared + " " + prose(pick, 30), "Start. " + shared + "\n" + prose(pick, 20), prose(pick, 3) + shared]
    texts += [line + "\n" + prose(pick, 150) for _ in range(30)] + [None, "", "x" * 50_000, shared + " " + shared]
    docs = corpus(spark, texts)
    found = {r["doc_id"]: r for r in substring_dedup.repeated_documents(docs).collect()}
    assert set(found) == {0, 1, 2, len(texts) - 1}
    for i, r in found.items():
        coded = texts[i].encode()
        assert any(coded[s["start"] : s["end"]].decode() in shared for s in r["spans"])
    assert found[0]["removable_bytes"] == 0 and found[1]["removable_bytes"] > 200
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(docs).collect()}
    assert left[0] == texts[0] and len(left[1]) < len(texts[1]) - 200 and len(left) == len(texts)
    assert substring_dedup.repeated_documents(docs.where("false")).count() == 0
    same = spark.createDataFrame([(1, shared), (1, shared), (None, shared)], "doc_id long, text string")
    assert substring_dedup.repeated_documents(same).count() == 0


def test_passages_of_short_words_and_short_equal_texts(spark):
    pick = random.Random(16)
    shared = [" ".join("".join(pick.choice("etaoinshrdlu") for _ in range(pick.choice([2, 3, 4]))) for _ in range(51)) for _ in range(60)]
    texts = [f"{prose(pick, 30)} {s} {prose(pick, 30)}" for s in shared for _ in range(2)]
    found = {r["doc_id"] for r in substring_dedup.repeated_documents(corpus(spark, texts)).collect()}
    assert len(found) >= 0.95 * len(texts)
    short = ["Just this.", "Just this.", "Just this. And more of it.", "Alone.", "Just this."]
    got = {r["doc_id"]: (r["n_passages"], r["repeated_bytes"], r["removable_bytes"]) for r in substring_dedup.repeated_documents(corpus(spark, short)).collect()}
    assert got == {0: (1, 10, 0), 1: (1, 10, 10), 4: (1, 10, 10)}


def test_passages_of_repeated_words(spark):
    pick = random.Random(17)
    word = lambda least: "".join(pick.choice("etaoinshrdluü") for _ in range(pick.randint(least, 9)))
    shared = [" ".join([word(2)] * 51) for _ in range(60)] + [" ".join([word(4)] * 26 + [word(4)] * 25) for _ in range(60)]
    texts = [f"{prose(pick, 30)} {s} {prose(pick, 30)}" for s in shared for _ in range(2)]
    found = {r["doc_id"] for r in substring_dedup.repeated_documents(corpus(spark, texts)).collect()}
    assert len(found) >= 0.95 * len(texts)
    for t in ["x" * 5000, "ab " * 2000, "", "x", "long word " * 300]:
        starts, ends = substring_dedup.chunks(t.encode())
        assert ends[-1] == len(t) and (starts[1:] == ends[:-1]).all() and (ends - starts).max(initial=0) <= substring_dedup.MOST


def test_cut_repeats_carries_any_column(spark):
    shared = prose(random.Random(6), 60)
    docs = spark.createDataFrame([(1, shared), (2, "Start. " + shared), (None, None)], "doc_id long, text string")
    odd = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["_sd_id", "_sd_spans", "start", "end", "removable", "digest", "whole"])))
    cut = substring_dedup.cut_repeats(odd)
    assert cut.columns == odd.columns and {r["doc_id"]: len(r["text"] or "") for r in cut.collect()}[2] < len(shared)


def test_chunks_cover_the_text_and_move_with_it():
    pick = random.Random(8)
    text = prose(pick, 500).encode()
    starts, ends = substring_dedup.chunks(text)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] == ends[:-1]).all() and (ends - starts).max() <= substring_dedup.MOST
    cut = {text[s:e] for s, e in zip(starts, ends, strict=True)}
    s2, e2 = substring_dedup.chunks(b"inserted bytes before " + text)
    assert len(cut - {(b"inserted bytes before " + text)[s:e] for s, e in zip(s2, e2, strict=True)}) <= 2


def test_passages_equal_a_plain_version(spark):
    pick = random.Random(9)
    texts = near_copies(pick, 6, 90, 2) + [prose(pick, 60) for _ in range(5)]
    texts.append(texts[0][:300] + texts[7][50:350])
    where = {}
    for i, t in enumerate(texts):
        for s, e in zip(*substring_dedup.chunks(t.encode()), strict=True):
            where.setdefault(t.encode()[s:e], set()).add(i)
    want = set()
    for i, t in enumerate(texts):
        at = None
        for s, e in [*zip(*substring_dedup.chunks(t.encode()), strict=True), (len(t.encode()), len(t.encode()))]:
            if len(where.get(t.encode()[s:e], ())) > 1:
                at = s if at is None else at
            elif at is not None:
                want |= {(i, int(at), int(s))} if s - at >= substring_dedup.PASSAGE else set()
                at = None
    got = {(r["doc_id"], r["start"], r["end"]) for r in substring_dedup.passages(corpus(spark, texts)).collect()}
    assert got == want and want


# quality


def plain_words(text):
    """Words, the repeats of a word by how often it has stood there, and the end."""
    out, before, again = [], None, 0
    for w in re.findall(r"\w+|[^\w\s]+", text or ""):
        again = again + 1 if w == before else 0
        out.append(("again", (again - 1).bit_length()) if again else w)
        before = w
    return [*out, "END"] if out else []


class PlainModel:
    """Interpolated modified Kneser-Ney of word pairs by dictionaries."""

    def __init__(self, texts):
        self.pairs = Counter(p for t in texts for p in zip(["BEGIN", *plain_words(t)], plain_words(t), strict=False))
        befores = Counter(c for _, c in self.pairs)
        self.d2, d1 = self.discounts(self.pairs.values()), self.discounts(befores.values())
        self.whole, self.given = Counter(), Counter()
        for (b, _), n in self.pairs.items():
            self.whole[b] += n
            self.given[b] += self.off(self.d2, n)
        total = sum(befores.values())
        self.rest = sum(self.off(d1, k) for k in befores.values()) / total / (len(befores) + 1)
        self.chance = {c: (k - self.off(d1, k)) / total + self.rest for c, k in befores.items()}

    @staticmethod
    def discounts(numbers):
        n = [sum(x == i for x in numbers) for i in range(1, 5)]
        if not all(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(i, max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]

    @staticmethod
    def off(d, n):
        return min(d[min(n, 3) - 1], n)

    def p(self, b, c):
        low = self.chance.get(c, self.rest)
        if not self.whole[b]:
            return low
        n = self.pairs[b, c]
        return ((n - self.off(self.d2, n) if n else 0) + self.given[b] * low) / self.whole[b]

    def cost(self, text):
        w = plain_words(text)
        return len(w), -sum(math.log(self.p(b, c)) for b, c in zip(["BEGIN", *w], w, strict=False))


def test_plain_model_is_a_probability():
    pick = random.Random(5)
    plain = PlainModel([prose(pick, 50) for _ in range(30)])
    for b in ["BEGIN", "ta", "tana", "never seen"]:
        assert sum(plain.p(b, c) for c in plain.chance) + plain.p(b, "unseen") == pytest.approx(1)


@pytest.mark.parametrize("heavy", [1, 1 << 17])
def test_costs_by_joins_equal_the_plain_model(spark, monkeypatch, heavy):
    pick = random.Random(1)
    learned = [[prose(pick, 60) + pick.choice([".", " !!", " $$$", ""]) for _ in range(25)] + ["A. B! 12", "ab ab ab ab ab cd", ""] for _ in range(2)]
    texts = spark.createDataFrame([(m + 7, t) for m in (0, 1) for t in learned[m]], "model long, text string")
    monkeypatch.setattr(word_model.WordModel.heavy, "__defaults__", (heavy,))
    model = word_model.WordModel(word_model.count_tables(texts))
    asked = [*learned[0][:5], *learned[1][:5], None, "", "x", "cd cd ab. B B B B", prose(pick, 3000), "!!" * 5000]
    rows = spark.createDataFrame([(i, -i, ["a", "b", None][i % 3], i % 2, t) for i, t in enumerate(asked)] * 2, "k1 long, k2 long, lang string, half int, text string")
    of = {"a": [7], "b": [8], None: [7, 8]}
    unseen = {r["model"]: r["unseen"] for r in model.unseen.collect()}
    got = {(r["k1"], r["model"]): (r["n"], r["cost"] + r["n"] * unseen[r["model"]]) for r in word_model.costs(rows, model, lambda lang, half: of[lang]).collect()}
    plain = {7: PlainModel(learned[0]), 8: PlainModel(learned[1])}
    assert set(got) == {(i, m) for i in range(len(asked)) for m in of[["a", "b", None][i % 3]]}
    for (i, m), (n, cost) in got.items():
        want = plain[m].cost(asked[i])
        assert n == want[0] and cost == pytest.approx(want[1], abs=0.001 * (2 * n + 1))


def test_keys_are_sql_digests_and_cells_come_back():
    values = np.sort(np.random.default_rng(1).integers(0, 2**62, 1000, dtype=np.uint64))
    for kind in ("<u2", "<i2"):
        back, beside = word_model.unpacked(word_model.packed(values, np.arange(1000) - (500 if kind == "<i2" else 0), kind), kind)
        assert (back == values).all() and (beside == np.arange(1000) - (500 if kind == "<i2" else 0)).all()
    assert len(word_model.unpacked(word_model.packed(values[:0], np.zeros(0), "<u2"), "<u2")[0]) == 0


def test_digests_equal_the_function(spark):
    rows = spark.createDataFrame([(5, -3), (2**62, 0), (-1, 1)], "a long, b long").selectExpr("a", "b", "xxhash64(a, b) AS h").collect()
    for r in rows:
        first = word_model.digest(np.array([r["a"]]).view(np.uint64), np.array([42], dtype=np.uint64))
        assert word_model.digest(np.array([r["b"]]).view(np.uint64), first).view(np.int64)[0] == r["h"]


def test_numbers_are_dealt_one_to_a_partition(spark):
    numbers = word_model.dealt(spark, 13)
    parts = spark.createDataFrame([(n,) for n in numbers], "v int").repartition(13, "v").select(F.spark_partition_id().alias("p")).collect()
    assert sorted(r["p"] for r in parts) == list(range(13))


def quality_corpus(spark):
    pick = random.Random(4)
    good = [prose(pick, pick.choice([5, 40, 150])) for _ in range(240)]
    bad = [" ".join(w + "$$$" for w in prose(pick, 40).split()) for _ in range(20)] + ["Kena " * 60 for _ in range(5)] + [prose(pick, 60).upper().replace(" ", "!! ") for _ in range(20)]
    texts = good + bad + [None, "", " "]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", None, None, i, None, 1) for i, t in enumerate(texts)] + [(999, prose(pick, 40), None, "s", 1, 1, "p", 1), (998, prose(pick, 40), "xx", "s", 1, 1, "p", 1)], DOC)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(200, 0, 0), (None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels, set(range(240)), set(range(240, 285))


def test_quality(spark):
    docs, labels, good, bad = quality_corpus(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & bad) <= 2 and len(good - ids) <= 8 and {285, 286, 287, 999, 998} <= ids
    everything = quality.keep_good(docs, labels.where("false"))
    assert everything.count() == docs.count()
    assert quality.keep_good(docs.where("false"), labels).count() == 0


def plain_quality(docs, labels, quantile=0.99, prior=10.0):
    """Each document's perplexity, threshold and whether it is kept, by dictionaries."""
    from tests.llm.plain_hash import half_of

    trusted = {d for d, _, _ in labels} - {d for d, q, t in labels if q != 1 or t}
    own = [(d, lang, t, half_of(d)) for d, lang, t in docs if d in trusted and lang is not None and t is not None]
    models = {k: PlainModel([t for _, lang, t, h in own if (lang, h) == k]) for k in {(lang, h) for _, lang, _, h in own}}
    langs = sorted({lang for lang, _ in models})
    use = lambda lang, h: (lang, 1 - h) if (lang, 1 - h) in models else (lang, h)
    costs = {k: [m.cost(t) for _, lang, t, h in own if use(lang, h) == k] for k, m in models.items()}
    mean = {k: sum(c for _, c in x) / sum(n for n, _ in x) for k, x in costs.items() if x}

    def score(d, lang, t):
        h = half_of(d) or 0
        found = [(models[k].cost(t), mean[k]) for k in ([use(lang, h)] if lang in langs else [use(x, h) for x in langs])]
        return min((c + prior * m) / (n + prior) for (n, c), m in found), found[0][0][0]

    limit = {lang: sorted(score(d, x, t)[0] for d, x, t, _ in own if x == lang) for lang in langs}
    limit = {lang: x[max(0, math.ceil(quantile * len(x)) - 1)] for lang, x in limit.items()}
    out = {}
    for d, lang, t in docs:
        s, n = score(d, lang, t)
        most = limit.get(lang, max(limit.values()))
        out[d] = n, s, most, s <= most or n == 0
    return out


def test_quality_equals_a_plain_version(spark):
    docs, labels, _, _ = quality_corpus(spark)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    want = plain_quality([(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()], [tuple(r) for r in labels.collect() if r["doc_id"] is not None])
    assert got.keys() == want.keys()
    for d, (n, score, most, keep) in want.items():
        assert got[d]["n"] == n and got[d]["score"] == pytest.approx(score, abs=3e-3) and got[d]["threshold"] == pytest.approx(most, abs=3e-3)
        assert got[d]["keep"] == keep or abs(score - most) < 5e-3


def test_quality_carries_any_column_and_odd_rows(spark):
    docs, labels, _, _ = quality_corpus(spark)
    odd = docs.select("doc_id", "text", "lang", *(F.lit(i).alias(c) for i, c in enumerate(["k1", "k2", "n", "score", "keep", "half", "model", "trusted_id", "of", "limit", "_q_n", "threshold"])))
    odd = odd.unionByName(odd).unionByName(odd.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    kept = quality.keep_good(odd, labels)
    once = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept.columns == odd.columns
    found = Counter(r["doc_id"] for r in kept.collect())
    assert found.pop(None) == 3 and set(found) == once and set(found.values()) == {2}


def test_quality_tells_word_salad_and_unfolded_letters(spark):
    pick = random.Random(14)
    # Cyrillic words, and others whose letters fall into the same classes by code % 14
    plain = ["".join(chr(0x430 + pick.randrange(18)) for _ in range(pick.choice([3, 5, 7]))) for _ in range(60)]
    follow = {w: pick.sample(plain, 3) for w in plain}

    def told(n):
        w = [pick.choice(plain)]
        while len(w) < n:
            w.append(pick.choice(follow[w[-1]]))
        return w

    good = [told(80) for _ in range(200)]
    salad = [pick.sample(w, len(w)) for w in good[150:170]]
    other = [["".join(chr(ord(c) + 14) for c in w) for w in g] for g in good[170:190]]
    texts = [" ".join(w) for w in good + salad + other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("ru"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert len(kept & set(range(200))) >= 190 and not kept & set(range(200, 240))


# language


def language_corpus(n):
    pick = random.Random(12)
    syllables = {"aa": ["sch", "ung", "ein", "lich"], "ab": ["sch", "ung", "een", "lijk"], "ba": ["ção", "mente", "lho", "que"], "bb": ["ción", "mente", "llo", "que"]}
    return [(i, " ".join("".join(pick.choice(syllables[lang]) for _ in range(3)) for _ in range(pick.choice([3, 20, 80]))), lang) for i, lang in enumerate(pick.choice(sorted(syllables)) for _ in range(n))]


def test_language_id(spark):
    import zlib

    data = language_corpus(400)
    docs = spark.createDataFrame([*data, (None, "schung", "aa"), (5000, None, "aa"), (5001, "123 !", None), (5002, "", "bb"), (5003, "ção " * 40_000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out()))
    assert sorted(map(sorted, [[model.languages[i] for i in g] for g in model.groups])) == [["aa", "ab"], ["ba", "bb"]]
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in data) and got[None]["held_out"] is False
    held = [(i, lang) for i, _, lang in data if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert {got[i]["lang_pred"] for i in (5000, 5001, 5002)} == {"und"} and got[5003]["lang_pred"] == "ba"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_of_odd_rows(spark):
    data = [("schung lich ein", "aa"), ("ção mente que", "ba")] * 30
    docs = spark.createDataFrame([(7, t, lang) for t, lang in data] + [(8, "½ ² Ⅷ 12", None), (9, "日本", None), (10, "_ ¾", "aa")], "doc_id long, text string, lang string")
    first = language_id.fit(docs.repartition(5), train_rows=10)
    again = language_id.fit(docs.repartition(2), train_rows=10)
    assert all((first.pairs[k] == again.pairs[k]).all() for k in first.pairs) and (first.family == again.family).all()
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, first).collect()}
    assert {(7, "aa"), (7, "ba"), (8, "und"), (10, "und")} <= got and (9, "und") not in got
    assert language_id.predict(docs.where("false"), first).count() == 0


def test_every_language_is_learned(spark):
    pick = random.Random(3)
    docs = spark.createDataFrame([(i * 400 + n, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)} {pick.choice(WORDS)}", f"l{i}") for i in range(300) for n in range(2)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.limit(40))
    assert len(model.languages) == docs.limit(40).select("lang").distinct().count()
    counted = docs.groupBy("lang").count().count()
    assert counted == 300 and not hasattr(language_id, "MAX_LANGUAGES")


def plain_language(texts, model):
    """Predictions one text at a time: the family with the largest margin, then votes of the pairs."""
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append("und")
            continue
        x = np.append(language_id.features([t])[0], 1.0)
        group = model.groups[int(np.argmax([x @ w for w in model.family]))] if len(model.groups) > 1 else model.groups[0]
        votes = {m: 0.0 for m in group}
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                p = 1 / (1 + math.exp(-4 * max(-15, min(15, float(x @ model.pairs[a, b])))))
                votes[a] += (p >= 0.5) + p / (2 * len(group))
                votes[b] += (p < 0.5) + (1 - p) / (2 * len(group))
        out.append(model.languages[max(group, key=lambda m: (votes[m], -m))])
    return out


def test_language_id_equals_a_plain_version_on_a_whole_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    model = language_id.fit(docs.where(~language_id.held_out()))
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], plain_language([r["text"] for r in rows], model), strict=True))
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()} == want


def test_language_id_of_little(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.predict(none, language_id.fit(none)).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(1, "abc def", "xx")], "doc_id long, text string, lang string")
    assert tuple(language_id.predict(one, language_id.fit(one)).select("lang_pred", "score").first()) == ("xx", 1.0)


# search


def plain_top_k(data, k, step):
    ok = [(i, [np.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % step == 0:
            scored = sorted((-int(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in ok if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    pick = np.random.default_rng(0)
    data = [(i, pick.normal(0, 1 + (i % 7), 6).astype(np.float32).tolist()) for i in range(300)]
    data += [(300 + i, data[3][1]) for i in range(30)]  # ties
    data += [(400, None), (405, [1.0, None, 2.0]), (410, [float("nan")] * 6), (415, [float("inf")] * 6), (420, []), (425, [1.0, 2.0]), (None, data[0][1])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    want = plain_top_k(data, 5, 5)
    for pivots, block in ((64, 16384), (4, 20), (1, 50)):
        found = topk_search.top_k(vectors, F.col("vec_id") % 5 == 0, 5, pivots=pivots, data_block=block)
        assert sorted(map(tuple, found.collect())) == want


def test_top_k_of_clusters_leaves_cells_out(spark):
    pick = np.random.default_rng(3)
    heart = pick.normal(0, 3, (20, 8))
    data = [(i, (heart[i % 20] + pick.normal(0, 0.05, 8)).astype(np.float32).tolist()) for i in range(800)]
    data += [(i % 100 + 1000, data[i][1]) for i in range(600)]  # every id six times
    vectors, tally = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3), {}
    found = topk_search.top_k(vectors, F.col("vec_id") % 40 == 0, 5, data_block=64, tally=tally)
    best = {}
    ok = [(i, np.floor(256 * np.float64(np.float32(v)))) for i, v in data]
    for q, a in ok:
        if q % 40 == 0:
            for i, b in ok:
                if i != q:
                    best.setdefault(q, {})[i] = max(best.get(q, {}).get(i, -(10**18)), int(a @ b))
    want = sorted((q, n, i, s) for q, found_ in best.items() for n, (s, i) in enumerate(sorted(((s, i) for i, s in found_.items()), key=lambda x: (-x[0], x[1]))[:5], 1))
    assert sorted(map(tuple, found.collect())) == want
    assert tally["queries_kept"] < 0.35 * tally["queries"] and tally["groups_kept"] < 0.6 * tally["groups"]


def test_top_k_of_few_rows_and_repeated_ids(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (1, [0.5]), (2, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(few, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 256 * 512), (0, 2, 2, 65536)]
    assert topk_search.top_k(few.where("false"), F.lit(True)).count() == 0
    assert topk_search.top_k(few.where("vec_id = 0"), F.lit(True)).count() == 0


def test_top_k_with_an_id_repeated_among_the_pivots(spark):
    data = [(0, [1.0, 0.0])] + [(1, [100.0, float(i)]) for i in range(8)] + [(i, [20.0 - i, 0.0]) for i in range(2, 12)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["vec_id"]) for r in topk_search.top_k(vectors, F.col("vec_id") == 0, 5, pivots=len(data)).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
