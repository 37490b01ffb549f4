"""Best-two-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialise, parts_for, with_ids
from .sharding import with_rank

CAPACITY = 2048
CACHE = 250_000  # parts of texts a worker remembers the ids of, in each generation
BATCH = 500  # texts a task holds at once
ROWS_PER_BUCKET = 20_000


# How the tokenizer splits a text, for the letters and digits of Latin-1, where case and composition are plain.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_DIGITS}]+")  # letters first: most parts are
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
_WORD_END = "</w>"
_OTHER = iter(range(256, 512))
_BYTES = {b: b if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else next(_OTHER) for b in range(256)} | {0x20: 0x20}  # how a byte is written in the vocabulary; blanks part words
_KNOWN = {  # the parts of a tokenizer's description that the above stands for
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class WordIds:
    """Ids of a text, remembered by the parts that the tokenizer never joins. A tokenizer that isn't described as _KNOWN
    gets whole texts.

    A text of plain characters is split as the tokenizer splits it, any other at ASCII white space alone. Two
    generations of remembered parts keep the frequent ones within bounded memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # the same model, for words that are normalised and split already
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(_WORD_END)]] = True
        told = json.loads(self.tokenizer.to_str())
        self.whole = any(told.get(k) != v for k, v in _KNOWN.items()) or told["model"].get("end_of_word_suffix") != _WORD_END or any(t["content"][:2] != "<|" for t in told["added_tokens"])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, parts: list[str], plain: bool) -> list[bytes]:
        if plain:  # each is one word to the tokenizer, so all can go in one call; the fast one keeps no offsets
            text = " ".join(parts)
            text = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(parts):
                flat, at = ids.tobytes(), (4 * cuts).tolist()
                return [flat[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        plain = _PLAIN.fullmatch(text) is not None and "<|" not in text
        parts = _SPLIT.findall(text.lower()) if plain else [" " + w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]  # the blank tells them from plain parts
        found = list(map(self.young.get, parts))
        if None in found:
            new = {p for p, f in zip(parts, found, strict=True) if f is None}
            if len(self.young) + len(new) > CACHE:
                self.old, self.young = self.young, {}
                new = set(parts)
            known = {p: self.old[p] for p in new if p in self.old}
            lacking = [p for p in new if p not in known]
            self.young.update(known)
            self.young.update(zip(lacking, self._encode(lacking, plain), strict=True) if lacking else ())
            found = list(map(self.young.__getitem__, parts))
        return b"".join(found)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker, as a tokenizer takes longer to read than many a task's texts. Texts go one by one,
    so threads of its own would only wait."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and a final 0, cut where longer than capacity: _id, piece, start, length, ids (binary)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids = word_ids(tokenizer_path)
        for pdf in it:
            for at in range(0, len(pdf), BATCH):
                out = []
                for i, text in zip(pdf["_id"].iloc[at : at + BATCH], pdf["_text"].iloc[at : at + BATCH], strict=True):
                    ids = to_ids(text if isinstance(text, str) else None) + b"\0\0\0\0"
                    out += [(i, k, k * capacity, len(part) // 4, part) for k, part in enumerate(ids[b : b + 4 * capacity] for b in range(0, len(ids), 4 * capacity))]
                yield pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids"])

    out = with_ids(docs, id_col, text_col).mapInPandas(batches, "_id string, piece int, start long, length long, ids binary")
    return out.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType))


@dataclass(frozen=True)
class Plan:
    """Slots sorted by (length, first rank): a piece's length and rank give its slot, and so its sequence and offset."""

    key: np.ndarray  # length << 44 | first rank
    first: np.ndarray  # sequence of that rank; each next rank takes the next sequence
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) | rank, side="right") - 1
        return self.first[at] + rank - (self.key[at] & ((1 << 44) - 1)), self.offset[at]


def _fill(left: np.ndarray, capacity: int) -> list[int]:
    """One bin from what is left: greedy, largest first; then, as long as it gets fuller, its smallest piece is
    replaced by the two unpacked ones that fit the gap best."""
    present = np.where(left > 0, np.arange(capacity + 1), 0)
    below = np.maximum.accumulate(present)  # largest length present that is not over the index
    bin_, gap = [], capacity
    while gap and (take := int(below[gap])):
        bin_.append(take)
        left[take] -= 1
        gap -= take
        if not left[take]:
            below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    while gap and len(bin_) > 0:
        smallest = bin_[-1]
        room = gap + smallest
        a = np.flatnonzero(left[: room + 1])
        b = below[room - a] if len(a) else a
        b = np.where((b == a) & (left[a] < 2), below[np.maximum(b - 1, 0)], b) if len(a) else b
        both = np.where(b > 0, a + b, 0)
        if not len(both) or both.max() <= smallest:
            break
        k = int(both.argmax())
        bin_.pop()
        left[smallest] += 1
        left[a[k]] -= 1
        left[b[k]] -= 1
        bin_ = sorted([*bin_, int(a[k]), int(b[k])], reverse=True)
        gap = room - int(both[k])
        below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    return bin_


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pieces of one length are alike, so a bin found once is used as often as its lengths last. The work and the
    result depend on how many lengths there are (capacity at most), not on how many pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    rows, sequences = [], 0
    while left.any():
        bin_ = _fill(left, capacity)
        lengths, each = np.unique(bin_, return_counts=True)
        more = int((left[lengths] // each).min())
        left[lengths] -= more * each
        at = 0
        for length in bin_:
            rows.append((length << 44 | int(used[length]), sequences, at))
            used[length] += more + 1
            at += length
        sequences += more + 1
    rows.sort()
    key, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return Plan(key, first, offset, sequences)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: stored rows with _id, piece, length (1 to capacity) and a number _row of their own. Adds sequence_id and offset.

    The driver sees one count for each length. A length's pieces are ranked in buckets by a hash of their number, so a
    length, or an id, that a third of all pieces have is ranked by many tasks.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    made = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    buckets = parts_for(sum(counts.values()), ROWS_PER_BUCKET, 16)
    dealt = cut.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    ranked = with_rank(dealt, ["length"], "_b", [F.col("_row")], "_rank")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = made.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64) - 1)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("_p", place("length", "_rank")).select("*", "_p.sequence_id", "_p.offset").drop("_p", "_b", "_rank", "_row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Null or wordless text: one piece, the id 0 alone. Repeated rows or ids: packed once each. Null ids: packed like any
    other. Very long texts: encoded whole, piece by piece in the result. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    cut = pieces(docs, tokenizer_path, capacity, id_col, text_col).withColumn("ids_crc32", F.crc32("ids")).drop("ids").withColumn("_row", F.monotonically_increasing_id())
    with batches_of(docs.sparkSession, BATCH):
        cut = materialise(cut)
    return pack(cut, capacity).select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
