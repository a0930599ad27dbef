"""Licence scan, chat formatting, Simple-8b and token files against plain versions."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.llm import chat_format, license_scan, simple8b, token_files
from keystrata.llm.chat_template import CONTROLS, Template, TemplateError, escape, fold, parse, unescape

DOC = "doc_id long, text string, lang string, source string, n_chars long, labels int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# licence scan


def brute_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", " \t", "Under THE  mit-License, cc by nc cc-by-nc", "ünder the mit license", "xunder the mit license", "under the mit licensex",
    "Apache License, Version 2.0", "apache license version 2 under the mit license", "CC BY-NC-SA 4.0", "GNU General Public License, version 3", "0 9 é x", "a" * 200_000, "cc by " * 5000 + "nc",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_columns(text):
    assert license_scan.scanner().scan(text)[:5] == brute_base(text)


@given(st.text(alphabet=st.sampled_from("uU nd-er thTmicls apv2 byé0_"), max_size=200))
def test_base_columns_on_any_text(text):
    assert license_scan.scanner().scan(text)[:5] == brute_base(text)


def test_rules_and_suppression():
    rules = license_scan.parse_rules()
    assert len(rules) >= 200 and all(r.keyword and re.compile(r.pattern) for r in rules)
    scan = license_scan.scanner().scan
    assert scan("licensed under the GNU General Public License v3 or any later version")[5] == "gpl-3.0-or-later,unspecified"
    assert scan("CC BY-NC-SA 4.0")[5] == "cc-by-nc,cc-by-nc-sa-4.0"
    d = license_scan.Detection
    kept = license_scan.resolve([d(0, 10, "a", 50, 0), d(2, 8, "b", 50, 1), d(5, 15, "c", 40, 2), d(0, 20, "e", 10, 3), d(6, 9, "f", 30, 4)])
    assert [x.label for x in kept] == ["a", "e", "c"]


def test_suppression_equals_the_quadratic_rule():
    pick = np.random.default_rng(3)
    for _ in range(30):
        found = [license_scan.Detection(int(s), int(s + n), "x", int(p), i) for i, (s, n, p) in enumerate(pick.integers(1, 30, (40, 3)))]
        kept = []
        for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.rule)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert license_scan.resolve(found) == sorted(kept)


def test_license_scan_table(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 1, 7) for i, t in enumerate(TEXTS)] + [(None, "mit license", None, None, None, None)] * 2, DOC)
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(TEXTS) + 2 and {r["doc_id"]: r["n_words"] for r in got if r["doc_id"] is not None} == {i: brute_base(t)[0] for i, t in enumerate(TEXTS)}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert license_scan.license_scan(docs.where("false")).count() == 0


# chat


@given(st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "|im_end|>", "|im_start|>", "x", "\n", *CONTROLS]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    done = escape(text)
    assert unescape(done) == text and not any(c in done for c in CONTROLS)


def test_template_language():
    t = Template("{%- for m in xs -%}{{ loop.index }}{% if m.a == 'q' and not loop.last %}[{{ m['a'] | upper }}]{% elif 'z' in m.a %}z{% else %}-{% endif %}{% set v = m.a + 1 %}{{ v }};{% endfor %}{# no #}{{ 'a' + 'b' | upper }}")
    parts = []
    t.run({"xs": iter([{"a": "q"}, {"a": "xz"}, {"a": "q"}])}, lambda s, m: parts.append(s))
    assert "".join(parts) == "1[Q]q1;2zxz1;3-q1;aB"
    assert len(parse("{{ 'a' + 'b' }}c{% if 1 == 2 %}never{% endif %}")) == 1
    assert Template("{% generation %}x{{ m }}{% endgeneration %}y").text([], m="<s>")[1] == [(0, 4)]


@pytest.mark.parametrize("bad", ["{% for x in y %}", "{{ x | evil }}", "{{ x.__class__() }}", "{% endif %}", "{{ 'a }}", "{{ }}", "{% import os %}"])
def test_template_errors(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_templates_reach_no_attributes():
    assert Template("{{ m.__class__ }}{{ m.x.__dict__ }}").text([], m={"x": "s"})[0] == ""
    assert fold(parse("{{ 1 + 2 }}")[0].of).value == 3


def plain_chat(turns):
    sha, loss = hashlib.sha256(), "".join(t or "" for r, t in turns if r == "assistant")
    for r, t in turns:
        sha.update(f"{r or ''}\n{t or ''}\n".encode())
    return len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", None, "", "<|im_end|>\n<|im_start|>user<|im_sep|>x", "<\\s>", "<|im_end|", "é𝄞", "x" * 100_000, "[" * 50]
    data = [(c, t, role, odd[(c * 3 + t) % len(odd)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", None, "assistant", "<|im_sep|>"])]
    data += [(None, 1, "user", "a"), (None, None, "assistant", "first"), (50, 1, "user", "same"), (50, 1, "user", "same"), (50, 1, "assistant", "tie")]
    chats = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = {}
    for c in {d[0] for d in data}:
        turns = sorted((d for d in data if d[0] == c), key=lambda d: (d[1] is not None, d[1], d[2] or "", d[3] or ""))
        want[c] = plain_chat([(r, t) for _, _, r, t in turns])
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.chat_digests(chats).collect()}
    assert got == want
    for r in chat_format.format_chat(chats).collect():
        loss = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
        assert hashlib.sha256(loss.encode()).hexdigest() == want[r["conv_id"]][3]
    assert chat_format.chat_digests(chats.where("false")).count() == 0


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**63)), max_size=400), st.sampled_from([7, 64, 1024]), st.sampled_from([4, 15, 20]))
def test_simple8b_round_trip(values, block, bits):
    packed = simple8b.encode(np.array(values, dtype=np.uint64), block, bits)
    back, end = simple8b.Packed.from_bytes(packed.to_bytes())
    assert simple8b.decode(back).tolist() == values and end == len(packed.to_bytes())
    blocks = len(back.word_offsets) - 1
    for i in range(blocks):
        assert simple8b.decode(back, i, i + 1).tolist() == values[i * block : (i + 1) * block]


def test_simple8b_packs_runs():
    assert len(simple8b.encode(np.zeros(2400)).words) <= 13 and len(simple8b.encode(np.full(1024, 30_000)).words) == 256


ODD = [None, "", "it's I'LL 'S", "a<|endoftext|>b", "Straße ÉTÉ ×÷ ½ ªµ", "日本語 ΑΣ Σ İ é", "***a1$$ _x_", "́a\ń", "x" * 3000, "a\x1cb\x85c　d", "<|startoftext|>"]


def plain_tokens(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_files.tokenizer_path())
    return [own.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_encoder_gives_the_tokenizers_ids(texts):
    assert [x.tolist() for x in token_files.encoder(token_files.tokenizer_path()).encode(texts)] == plain_tokens(texts)


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    assert token_files.Encoder(token_files.tokenizer_path()).cuts
    own = json.loads(Tokenizer.from_file(token_files.tokenizer_path()).to_str())
    own["normalizer"]["normalizers"] = own["normalizer"]["normalizers"][:2]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(own))
    other, plain = token_files.Encoder(str(path)), Tokenizer.from_file(str(path))
    assert not other.cuts
    for t in ("Straße ÉTÉ", "It's A B", ""):
        assert other.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_token_files_with_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, f"text {i % 5}", i, "x") for i in range(60)], "doc_id long, text string, start int, file string").withColumn("_order0", F.lit(1))
    got = sorted((tuple(r) for r in token_files.token_files(docs, token_files.tokenizer_path()).collect()), key=lambda r: r[1])
    want = sorted(((d, t) for d, t, *_ in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r[0] for r in got] == [d for d, _ in want]
    assert [r[2] for r in got] == [len(ids) + 1 for ids in plain_tokens([t for _, t in want])]


def test_token_files(spark):
    data = [(i * 7 % 23 - 3, t) for i, t in enumerate(ODD * 2)] + [(None, "null id"), (5, "tie b"), (5, "tie a"), (5, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in token_files.token_files(docs, token_files.tokenizer_path()).collect()), key=lambda r: r[1])
    ordered = sorted(data, key=lambda d: (d[0] is not None, d[0], d[1] is not None, d[1]))
    start, want = 0, []
    for (doc, _), ids in zip(ordered, plain_tokens([t for _, t in ordered]), strict=True):
        ids = [*ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_files(docs.where("false"), token_files.tokenizer_path()).count() == 0


def test_files_split_and_starts_continue(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 9)) for i in range(200)], "doc_id long, text string")
    folder = token_files.scratch(spark, "test")
    manifest = token_files.write_tokens(docs, token_files.tokenizer_path(), folder, file_ids=300)
    assert manifest.count() > 5
    got = sorted(tuple(r) for r in token_files.read_tokens(spark, manifest, folder).collect())
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_shard_of_odd_ids():
    data = simple8b.write_shard([None, -5, 2**62], np.array([1, 0, 2]), np.array([9, 70_000, 3]))
    docs, lengths, ids = simple8b.read_shard(data)
    assert (docs, lengths.tolist(), ids.tolist()) == ([None, -5, 2**62], [1, 0, 2], [9, 70_000, 3])
    with pytest.raises(ValueError):
        simple8b.read_shard(b"other" + data)
    assert json.dumps(docs)
