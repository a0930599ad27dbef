"""Licence scan: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

A document becomes canonical text: A-Z in lower case, everything of ASCII that is no letter or digit a space, words
joined by one space. One Aho-Corasick pass finds the rules' keywords; only the rules whose keyword occurs run their
regex. Detections are taken in order of priority, then length, then rule; one that lies inside an interval already
taken is suppressed. Base phrases are found at every place and are never suppressed.

Defined results: a null or empty text has no words, no labels and score 0; a null id is carried; repeated rows give
repeated results; columns of the input other than the id and the text are not read. The work is one pass over the
rows without a shuffle: no key groups rows, so there is none to skew.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices
from .license_rules import BASE, RULES


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    rule: int


#: ASCII to canonical bytes: upper case to lower, what is no letter or digit to a space; other bytes stay.
CANON = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def parse_rules(text: str = RULES) -> tuple[Rule, ...]:
    found = []
    for line in text.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        found.append(Rule(label, int(priority), keyword, pattern))
    return tuple(found)


class Scanner:
    """The compiled rules. One instance is kept in each Python worker."""

    def __init__(self, rules: tuple[Rule, ...], base: tuple[tuple[str, str], ...] = BASE):
        import ahocorasick

        self.rules, self.base = rules, base
        self.compiled: dict[int, re.Pattern] = {}
        keyed: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            keyed.setdefault(rule.keyword, []).append(i)
        self.gate = ahocorasick.Automaton()
        for keyword, members in keyed.items():
            self.gate.add_word(keyword, tuple(members))
        self.gate.make_automaton()

    def pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(rf"(?<!\S)(?:{self.rules[i].pattern})(?!\S)")
        return self.compiled[i]

    def detect(self, canon: str) -> list[Detection]:
        """What the rules leave after suppression, in order of place."""
        active = sorted({i for _, members in self.gate.iter(canon) for i in members})
        found = [Detection(m.start(), m.end(), self.rules[i].label, self.rules[i].priority, i) for i in active for m in self.pattern(i).finditer(canon)]
        return resolve(found)

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(CANON).split()
        canon = b" ".join(words)
        places, base = [], set()
        padded = b" " + canon + b" "
        for phrase, label in self.base:
            needle, at = b" " + phrase.encode() + b" ", -1
            while (at := padded.find(needle, at + 1)) >= 0:
                places.append(at)
                base.add(label)
        kept = self.detect(canon.decode("utf-8", "surrogatepass"))
        first, last = (padded.count(b" ", 0, min(places)), padded.count(b" ", 0, max(places))) if places else (None, None)
        score = max([1.0 if base else 0.0, *(min(1.0, d.priority / 100 + 0.1) for d in kept)])
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {d.label for d in kept})), score, kept


def resolve(found: list[Detection]) -> list[Detection]:
    """Takes detections by priority, then length, place and rule; drops those inside an interval already taken.

    Intervals taken are kept as a running union of maximal ones, so long texts stay near-linear.
    """
    import bisect

    kept: list[Detection] = []
    starts: list[int] = []  # of the maximal intervals taken, ascending; their ends ascend too
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.rule)):
        at = bisect.bisect_right(starts, d.start) - 1
        if at >= 0 and ends[at] >= d.end:
            continue
        kept.append(d)
        at = bisect.bisect_left(starts, d.start)
        upto = at
        while upto < len(starts) and ends[upto] <= d.end:
            upto += 1
        starts[at:upto], ends[at:upto] = [d.start], [d.end]
    return sorted(kept)


@functools.cache
def scanner(rules: tuple[Rule, ...] | None = None) -> Scanner:
    return Scanner(parse_rules() if rules is None else rules)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,priority:int>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """A row for each document: word and base counts, labels, score, and the detections' spans in canonical text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for piece in text_slices(batches):
            ids = piece.column("doc_id")
            rows = [own.scan(t) for t in piece.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True))
            spans = [[{"start": d.start, "end": d.end, "label": d.label, "priority": d.priority} for d in kept] for kept in cols[7]]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, k) for c, k in zip(cols[:7], kinds, strict=True)), pa.array(spans, span)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
