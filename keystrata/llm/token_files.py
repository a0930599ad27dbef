"""Token-id output: texts encoded by a public tokenizer and written as Simple-8b files in order of document id.

Documents are range-partitioned by id and sorted inside their partition; each task writes files of a bounded number of
ids into the shared folder, under names no other attempt uses, and reports them. The reports are written by Spark's
commit protocol, so files of failed or repeated attempts are named nowhere and never read. Starts are prefix sums: over
a partition's files, and over one number a partition. Reading back goes through Spark's binary reader.

The encoder relies on this tokenizer treating white space as a boundary. Texts of plain letters are cut into words as
the tokenizer cuts them, and words that a bounded cache doesn't hold go to the library's model; pieces of all other
texts go to the library's tokenizer. Ids are those of the tokenizer over the whole text (the tests compare them).

Defined results: null text is empty and has only the end id; a null document id comes first; repeated ids are ordered
by text, null first, and each keeps its own row; an empty table writes no file and gives no rows; other columns are not
read. With an ``order``, such as that of the rows in the files they come from (``as_read``), files follow it instead. A
hot source or group of copies doesn't matter: rows are dealt by document id.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch, table, text_slices
from .simple8b import read_shard, write_shard

#: The id that ends a document; ids of a file; words kept, and characters of one at most.
END_ID, FILE_IDS, CACHE_WORDS, CACHE_CHARS = 1, 1 << 20, 300_000, 48


#: Texts of these characters alone are cut into the tokenizer's words here: lower case and cutting are plain for them.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \\n\\t\\r]*")
PLAIN_WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9 \\n\\t\\r]+")


# How the tokenizer that these rules hold for normalizes and cuts texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others by
    the letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Words(dict):
    """Ids of words, each asked of the library's model once; long words are not kept."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts by the tokenizers library, with a bounded cache of the ids of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cuts = self._cuts_so()
        self.words = Words(self.model)
        self.pieces: dict[str, bytes] = {"": b""}

    def _cuts_so(self) -> bool:
        """Whether this tokenizer lower-cases and cuts texts as ``PLAIN_WORDS`` does; of others, whole texts are encoded."""
        own = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in own["added_tokens"]]
        return own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == PRE_TOKENIZER and all(a.startswith("<|") for a in added) and own["model"].get("type") == "BPE"

    def plain(self, text: str) -> bytes:
        """Ids of a plain text."""
        return b"".join(map(self.words.__getitem__, PLAIN_WORDS.findall(text.lower())))

    def other(self, texts: list[str]) -> list[bytes]:
        """Ids of other texts: their pieces between spaces go to the library's tokenizer."""
        known = self.pieces
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = list(set().union(*split).difference(known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update((p, array("I", f.ids).tobytes()) for p, f in zip(part, found, strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del known[piece]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids, without an end id."""
        if len(self.words) > CACHE_WORDS:
            self.words = Words(self.model)
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {"": b""}
        texts = [t or "" for t in texts]
        if not self.cuts:
            return [np.array(f.ids, dtype="<u4") for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        easy = ["<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        other = iter(self.other([t for t, e in zip(texts, easy, strict=True) if not e]))
        return [np.frombuffer(self.plain(t) if e else next(other), dtype="<u4") for t, e in zip(texts, easy, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS, order: Sequence[Column] = ()) -> DataFrame:
    """Writes the files into ``folder``, by document id or in another order; gives a row a file: file, part, place, n_docs,
    n_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(_uri(folder))
        part, place = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], dtype="<u4")

        def flush() -> pa.RecordBatch:
            nonlocal place, size
            name = f"{uuid.uuid4().hex}.ks8b"
            store.create_dir(top, recursive=True)
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(write_shard(ids, np.array([len(t) + 1 for t in tokens]), np.concatenate([x for t in tokens for x in (t, end)])))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([size], pa.int64())})
            ids.clear()
            tokens.clear()
            place, size = place + 1, 0
            return row

        for piece in text_slices(batches):
            for doc, got in zip(piece.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(piece.column("text").to_pylist()), strict=True):
                ids.append(doc)
                tokens.append(got)
                size += len(got) + 1
                if size >= file_ids:
                    yield flush()
        if ids:
            yield flush()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(f"_order{i}") for i, c in enumerate(order)))
    # of the text, its beginning deals out repeated ids as well; it sorts as the text does
    keys = [f"_order{i}" for i in range(len(order))] or ["doc_id", F.substring("text", 1, 64)]
    ordered = own.repartitionByRange(*keys).sortWithinPartitions(*(keys if order else ["doc_id", "text"])).select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "file string, part int, place int, n_docs long, n_ids long"), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files that the manifest names."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                docs, lengths, ids = read_shard(content.as_py())
                flat = ids.astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(docs)), pa.array(docs, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInArrow(run, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    in_part = Window.partitionBy("part").orderBy("place")
    starts = manifest.withColumn("inner", F.sum("n_ids").over(in_part) - F.col("n_ids")).join(parts, "part")
    starts = starts.select("file", (F.col("before") + F.col("inner")).alias("file_start"))
    return rows.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def as_read(docs: DataFrame) -> tuple[Column, ...]:
    """The order of the rows in the files that ``docs`` was read from: numbers of part and file, and place in it."""
    name, row = docs["_metadata.file_name"], docs["_metadata.row_index"]
    part, file = (F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0).cast("long")) for p in (r"^part-(\d+)", r"-c(\d+)"))
    return part, file, name, row


def token_files(docs: DataFrame, tokenizer_path: str, order: Sequence[Column] = ()) -> DataFrame:
    """Writes all documents to files in the shared folder and reads them back."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer_path, folder, order=order), folder)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())
