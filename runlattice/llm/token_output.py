"""Token-id output as ORC: stripes of integer run-length encoded ids, row indexes, and Bloom filters on document ids.

Files hold (doc_id, ids) in ascending doc_id order, so stripe and row-group minima and maxima prune searches by id, the Bloom filter
answers lookups within a stripe, and readers take one stripe each.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlattice.llm.common import ensure_workers_import, shared_dir, stored

#: Options of Spark's ORC writer.
ORC_OPTIONS = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
#: Distinct words beyond which a worker forgets some before the next part; those that most parts held stay, half of them at most.
MEMO = 400_000
#: Most bytes of a word that stays then.
LONG = 64
#: Bytes of words and ids beyond which it does so too.
MEMO_BYTES = 64 << 20
#: Text bytes that a worker encodes at once.
PART_BYTES = 16 << 20
END_ID = 1


#: Letters that every version of Unicode's tables knows as such and that compose with nothing before them.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
LETTERS = f"^{LETTER}$"
#: Marks that are one piece after a word; none of them starts another pattern or an added token.
MARKS = ".,;:!?%&*#$"
#: Words that are given to the library as one text.
TOGETHER = 256
#: Vocabularies with this normalizer and this pattern, then bytes, can be given words instead of texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def gather(ids: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of rows, one after the other, and where each row's ids end; row r of a table holds ids[edges[r] : edges[r + 1]]."""
    starts = edges[rows]
    sizes = edges[rows + 1] - starts
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], ends


def of_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), dtype="<i4"), np.cumsum(np.fromiter(map(len, lists), dtype=np.int64))


class Memo:
    """Words and their ids; row r of the table is words[r], and used[r] the number of parts that held it."""

    def __init__(self) -> None:
        self.empty()

    def empty(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.edges, self.used = np.empty(0, "<i4"), np.zeros(1, np.int64), np.empty(0, np.int32)

    def add(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """Words are those held and, behind them, new ones, whose ids end at ends."""
        self.words = words
        self.edges = np.concatenate([self.edges, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.zeros(len(ends), np.int32)])

    def shrink(self) -> None:
        """Forgets long words and those that the fewest parts held."""
        n, half = len(self.words), MEMO // 2
        least = np.partition(self.used, n - half - 1)[n - half - 1] if n > half else 0
        kept = np.flatnonzero((self.used > least) & (np.asarray(pc.binary_length(self.words)) <= LONG))
        words, used, (ids, ends) = self.words.take(pa.array(kept)), self.used[kept] // 2, gather(self.ids, self.edges, kept)
        self.empty()
        if words.nbytes + ids.nbytes <= MEMO_BYTES // 2:
            self.add(words, ids, ends)
            self.used = used

    def rows(self, words: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The row of each word; learn gives the ids of distinct new ones. Rows hold until the next call."""
        if len(self.words) > MEMO or self.words.nbytes + self.ids.nbytes > MEMO_BYTES:
            self.shrink()
        n = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()
        rows = np.asarray(coded.indices)
        if not np.array_equal(rows[:n], np.arange(n)):
            raise ValueError("distinct words must be numbered in their order")
        rows = rows[n:]
        if len(coded.dictionary) > n:
            self.add(coded.dictionary, *learn(coded.dictionary.slice(n)))
        held = np.zeros(len(self.used), dtype=bool)
        held[rows] = True
        self.used += held
        return rows

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.ids, self.edges, rows)


class WordEncoder:
    """Encodes texts with the tokenizers library, which sees only words that aren't remembered.

    A text is cut at blanks and line feeds, which the vocabulary's normalizer and pattern drop: no token, no composition and no added token
    reaches across them, so the ids of the pieces in a row are the ids of the text. Arrow cuts the texts and finds the distinct words. Words of
    plain letters go to the library many to a text, without the marks behind them (a piece of their own), in lower case and past the normalizer
    and the pattern, which would leave them as they are; other words go alone. Vocabularies with another normalizer or pattern get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.cuts = bool(suffix) and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [PIECES, BYTES]}
        self.cuts = self.cuts and all(t["content"].startswith("<") and not {" ", "\n"} & set(t["content"]) for t in spec["added_tokens"])
        if self.cuts:
            vocab = self.lib.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            self.letters = Tokenizer(self.lib.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.words, self.stems = Memo(), Memo()

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return of_lists([x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)])

    def together(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters in lower case."""
        cuts = np.append(np.arange(0, len(stems), TOGETHER, dtype=np.int32), np.int32(len(stems)))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), stems), " ").to_pylist()
        ids, _ = of_lists([x.ids for x in self.letters.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(stems):
            raise ValueError("a word of letters must end in one last token")
        return ids, ends

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of unseen words: each is two rows of a table, its letters and its marks or, as another word, itself and nothing."""
        stem = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(stem, LETTERS)
        of = np.asarray(plain)
        stems = self.stems.rows(pc.utf8_lower(stem.filter(plain)), self.together)
        marks = pc.replace_substring_regex(words.filter(plain), f"^{LETTER}", "").dictionary_encode()
        rest = [*marks.dictionary.to_pylist(), "", *words.filter(pc.invert(plain)).to_pylist()]
        ids, ends = self.alone(rest)
        none = len(self.stems.words) + len(marks.dictionary)
        pairs = np.empty((len(words), 2), dtype=np.int64)
        pairs[of, 0], pairs[of, 1] = stems, len(self.stems.words) + np.asarray(marks.indices)
        pairs[~of, 0], pairs[~of, 1] = np.arange(none + 1, none + 1 + len(words) - len(stems)), none
        ids, ends = gather(np.concatenate([self.stems.ids, ids]), np.concatenate([self.stems.edges, len(self.stems.ids) + ends]), pairs.ravel())
        return ids, ends[1::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end; null is an empty text."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.cuts:
            return self.alone(texts.to_pylist())
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ids, ends = self.words.ids_of(self.words.rows(pieces.flatten(), self.learn))
        offsets = np.asarray(pieces.offsets)
        return ids, np.concatenate([[0], ends])[offsets[1:] - offsets[0]]


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of PART_BYTES of text or little more; a longer text is a part of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(1)).fill_null(0))
        at = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > PART_BYTES:
                yield pa.concat_batches([*held, batch.slice(at, i - at)])
                held, size, at = [], 0, i
            size += n
        if batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Writes (doc_id, ids) to ORC files in out, documents in ascending id order over all files, end_id after each document.

    One range shuffle of the texts, whose splitters Spark samples; ids are made after it and go straight to the file. Null and empty
    texts hold the end id only; repeated ids stand side by side; other columns are left out; an empty table gives no rows.
    """
    ensure_workers_import(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in parts(batches):
            ids, ends = enc.encode(part.column(1))
            ids = np.insert(ids, ends, end_id)
            ends = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            rows = pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])
            for at in range(0, len(rows), 500):
                yield rows.slice(at, 500)

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encoded, "doc_id bigint, ids array<int>").write.options(**ORC_OPTIONS).orc(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files: doc_id, ids; filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema("doc_id bigint, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each document's ids lie in the whole sequence: doc_id, start, n_tokens, ids_crc32.

    The files are read once, a stripe or more to a task; only counts and checksums leave the readers, as a small stored table. The window over all is one of one row a file. Each file's rows are summed in id order within the file and moved on by the total of the
    files before it; rows with the same id are ordered by checksum.
    """
    ensure_workers_import(spark)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = np.asarray(lists.values, dtype="<u4"), np.asarray(lists.offsets)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids").mapInArrow(measured, "file string, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    rows = stored(rows, "token_index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"))
    base = files.select("file", (F.sum("total").over(Window.orderBy(F.col("first").asc_nulls_first(), "file")) - F.col("total")).alias("base"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("n_tokens").over(within)).join(base, "file").select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def written_index(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs to a new folder of the shared store and returns the index read back from there; the folder goes once it is read."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, tokenizer)
    index = token_index(spark, out)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return index
