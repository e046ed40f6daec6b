"""Byte-level BPE encoding and decoding.

Each short word is merged over a contiguous rank array: the boundaries of its parts and, beside each, the rank of
the pair that starts there. The least rank is found by scanning, its inner boundary deleted and the two
neighbouring ranks looked up anew. A worker remembers the ids of the words it has seen.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import ensure_workers_import

#: The white space of Unicode, as the public pattern's \s takes it, and the pattern itself.
SPACE = r"\t\n\x0b\f\r \x85\xa0  -     　"
#: Letters and numbers of Unicode 16 and 17 that the tokenizers library doesn't yet know as such (hexadecimal code points).
NEWER = (
    '558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB '
    '11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 '
    '191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 '
    '1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F '
).split()
NEW = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER)
LETTER, NUMBER, OTHER = rf"[\p{{L}}--[{NEW}]]", rf"[\p{{N}}--[{NEW}]]", rf"[[^{SPACE}\p{{L}}\p{{N}}]||[{NEW}]]"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The coarser pieces that no token crosses: a run of other characters with the space before it, or white space.
PIECES = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Most pieces are a word of plain letters and perhaps marks after it; these need no general pattern.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%&$*#]*)").fullmatch
#: Words longer than this many bytes are merged over a heap instead of by scanning.
SCAN_BYTES = 256
#: Most words a worker remembers; beyond it the memory is emptied.
MEMO = 500_000
NO_RANK = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PieceIds(dict):
    """Packed ids of each piece, worked out once; emptied when large."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        ids = self[piece] = self.bpe.piece_ids(piece)
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(to_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for s, i in vocab.items():
            self.bytes_of[i] = s
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.words = regex.compile(PATTERN, regex.V1).findall
        self.pieces = re.compile(PIECES).findall
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo = PieceIds(self)

    def word_ids(self, word: bytes) -> list[int]:
        return self._scan(word) if len(word) <= SCAN_BYTES else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        ids, rank_of, merged = self.byte_ids, self.pairs.get, self.merged
        parts = [ids[b] for b in word]
        ranks = [rank_of(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)
            new = parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(new << 32 | parts[i + 1], NO_RANK)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        """The same merges for long words: a heap of (rank, place), links between living parts."""
        parts = [self.byte_ids[b] for b in word]
        n, rank_of = len(parts), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] < 0 or (j := after[i]) >= n or rank_of(parts[i] << 32 | parts[j]) != rank:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := rank_of(parts[a] << 32 | parts[b], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def piece_ids(self, piece: str) -> bytes:
        if (m := PLAIN(piece)) and not m[2]:
            ids = self.word_ids(piece.encode())
        elif m:
            return self.memo[m[1]] + self.memo[m[2]]
        else:
            ids = [i for w in self.words(piece) for i in self.word_ids(w.encode())]
        return array("I", ids).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; the strings of added tokens stand for those tokens."""
        ids_of = self.memo.__getitem__
        if not (self.splitter and any(s in text for s in self.added)):
            return b"".join(map(ids_of, self.pieces(text)))
        out = []
        for part in self.splitter.split(text):
            out += [self.added[part].to_bytes(4, "little")] if part in self.added else map(ids_of, self.pieces(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, added tokens included; broken UTF-8 gives U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def list_array(packed: list[bytes]) -> pa.Array:
    """Packed ids as a list<int32> array."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_column(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>); a null or empty text gives an empty array.

    Other columns stay, whatever their names; a column named out is replaced. A map over rows without a shuffle: it keeps Spark's partitions and
    holds one Arrow batch at a time.
    """
    ensure_workers_import(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for col in batches:
            yield list_array([bpe.packed(t.as_py() or "") for t in col])

    return docs.withColumn(out, ids(F.col(f"`{text}`")))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text of a column of token ids; null ids give an empty text."""
    ensure_workers_import(df.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for col in batches:
            yield pa.array([bpe.decode(x or []) for x in col.to_pylist()], type=pa.string())

    return df.withColumn(out, text(F.col(f"`{ids}`")))


def round_trip_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text and returns digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encoding and decoding run in one map, so that ids never leave the worker. Null and empty texts have no tokens. Repeated rows
    give repeated results.
    """
    ensure_workers_import(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        table = np.array(bpe.bytes_of, dtype=object)
        sha = hashlib.sha256
        for col in batches:
            n, a, b = [], [], []
            for t in col:
                packed = bpe.packed(t.as_py() or "")
                ids = np.frombuffer(packed, dtype="<u4")
                n.append(len(ids))
                a.append(sha(packed).hexdigest())
                b.append(sha(b"".join(table[ids].tolist()).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), digests(F.col(f"`{text}`")).alias("d"))
    return d.select("doc_id", "d.*")
