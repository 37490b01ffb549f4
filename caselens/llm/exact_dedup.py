"""Removal of 50-byte repeats across documents by bucket-pointer refinement.

Refinement itself (`refine_buckets`) is the classic one: suffixes start in buckets of their first q bytes, a bucket's pointer
is the rank at which it begins, and a bucket is refined by sorting its suffixes on the pointers that hold q bytes further
on; the refined pointers are what the next round, with twice the offset, sorts on. It goes on until 50 bytes are told
apart, compares bytes alone, and leaves out suffixes that are alone in their bucket.

It can't hold all suffixes at once, so they are dealt out by content first. Each start of a 50-byte string is owned by a
sample in it: of its 26 strings of 25 bytes the one with the least name. Neighbouring starts mostly own the same sample,
and a run of them is one entry. Equal strings own equal samples, so entries of one sample are refined in one place.
Documents are dealt into batches, and two questions go from batches to name ranges (parts) and back:

1. Which samples are in two documents or more? A batch sends each sample's short name once, packed.
2. Which starts of the runs that own such a sample also begin in an earlier document? A batch sends each different run's
   bytes once with its least id; the part refines them. Where no earlier document than that id holds a start, that id is
   itself the earliest, so a later document of the batch loses the start without a further question.

A sample with very many different runs (where a passage that many documents share meets what differs) is hot: its starts
are sent one by one, dealt by all of their 50 bytes, so no part gathers them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts_for, utf8

LENGTH = 50
Q = LENGTH // 2
OWNERS = LENGTH - Q + 1
FIRST = 8  # bytes that a bucket starts with in the refinement
ROUNDS = ((8, 16), (16, 32), (18, 50))  # offset whose pointers a round sorts on, bytes told apart after it
BATCH_BYTES = 6 << 20  # text that a batch of documents is meant to hold; raise it with the executors' memory
PART_BYTES = 12 << 20  # text whose names a part is meant to hold
BLOCK = 1 << 16  # starts named at once
CHUNK = 1 << 20  # bytes of entries refined at once, whole samples
HOT_RUNS = 1024  # different runs of a sample, beyond one for each batch, that a part still takes
_U = np.uint64


def _names(data: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """A name for every Q-byte string, or for those that start where told. Names deal and sample; they decide nothing."""
    n = len(data) - Q + 1
    every = slice(None) if start is None else start
    wide = lambda at: np.ndarray((n,), "<u8", data, at, (1,))[every].astype(np.uint64)  # noqa: E731  8 bytes from each
    x = wide(0) * _U(0x9E3779B97F4A7C15)
    for at, by in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93) + wide(at) * _U(by)
    return mix64(x ^ (data[Q - 1 :][every].astype(np.uint64) * _U(0xFF51AFD7ED558CCD)))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(32))) * _U(0xC2B2AE3D27D4EB4F))


def _firsts(ascending: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(len(ascending), 1), bool), ascending[1:] != ascending[:-1])))


def _steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


# --- refinement ----------------------------------------------------------------------------------------------------


def refine_buckets(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes with LENGTH bytes or more before their string's end, and the pointers of their LENGTH-byte buckets.

    data: strings in a row; left: bytes from each place to the end of its string.
    """
    pointer = np.zeros(len(data), np.int64)
    at = np.flatnonzero(left >= FIRST)
    _point(pointer, at, np.ndarray((max(len(data) - FIRST + 1, 0),), ">u8", data, 0, (1,))[at].astype(np.uint64), np.zeros(len(at), np.int64))
    for offset, told in ROUNDS:
        at = at[left[at] >= told]
        own = pointer[at]
        size = np.bincount(own, minlength=1)
        open_ = size[own] > 1  # alone in its bucket: its pointer is its own already
        moved, own = at[open_], own[open_]
        _point(pointer, moved, own.astype(np.uint64) << _U(32) | pointer[moved + offset].astype(np.uint64), own)
    return at, pointer[at]


def _point(pointer: np.ndarray, at: np.ndarray, key: np.ndarray, bucket: np.ndarray) -> None:
    """Sort suffixes on key and point each at the first rank of its new bucket, counted from its old bucket's rank."""
    order = np.argsort(key)
    key, bucket = key[order], bucket[order]
    rank = np.arange(len(at))
    opens = lambda x: np.maximum.accumulate(np.where(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])), rank, 0)) if len(x) else rank
    pointer[at[order]] = bucket + opens(key) - opens(bucket)


def earliest(entries: list[bytes], ids: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """For each start of each (different) entry, one entry after another, the least id of an entry that holds its string.

    sample: the place of the entry's sample, or 255 for an entry of one start that is dealt by its whole string. Only
    entries that share a sample with another are refined.
    """
    size = np.array([len(e) for e in entries], np.int64)
    n = size - LENGTH + 1
    out = np.repeat(ids, n)
    run = np.flatnonzero(sample < 255)
    if not len(run):
        return out
    data, begin = np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size
    name = _names(data, (begin + sample)[run])
    order = np.argsort(name, kind="stable")
    run, first = run[order], _firsts(name[order])
    many = np.repeat(np.diff(np.concatenate((first, [len(run)]))), np.diff(np.concatenate((first, [len(run)]))))
    group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(run)]))))
    run, group = run[many > 1], group[many > 1]
    if not len(run):
        return out
    ends = np.append(_firsts(group)[1:], len(run)) - 1  # of each sample's entries
    bytes_so_far = np.cumsum(size[run])
    cuts = np.unique(ends[np.searchsorted(bytes_so_far[ends], np.arange(CHUNK, bytes_so_far[-1] + CHUNK, CHUNK)).clip(max=len(ends) - 1)]) + 1
    start = np.cumsum(n) - n
    for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        part = run[lo:hi]
        take = np.repeat(begin[part], size[part]) + _steps(size[part])
        left = np.repeat(size[part], size[part]) - _steps(size[part])
        _, pointer = refine_buckets(data[take], left)  # its suffixes are the entries' starts, in order
        own = np.repeat(ids[part], n[part])
        least = np.full(int(pointer.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, pointer, own)
        out[np.repeat(start[part], n[part]) + _steps(n[part])] = least[pointer]
    return out


@dataclass(frozen=True)
class Entries:
    """Runs (start, length, id, and the number of their entry) and the different entries with their least ids."""

    start: np.ndarray
    length: np.ndarray
    ids: np.ndarray
    which: np.ndarray
    held: list[bytes]
    part: np.ndarray
    least: np.ndarray
    at: np.ndarray


# --- batches -------------------------------------------------------------------------------------------------------


class Batch:
    """What a batch asks, and what it makes of the answers. Documents are numbered by ascending id.

    Runs of starts that own the same sample: doc; start, length: the run's starts in the joined texts; at: the sample's
    place in the run; sample: its name; shape: a name of the whole run, which only counts how many differ.
    """

    def __init__(self, pdf: pd.DataFrame):
        self.ids = pdf["_id"].to_numpy(np.int64)
        order = np.argsort(self.ids, kind="stable")
        self.ids = self.ids[order]
        self.texts = [utf8(t if isinstance(t, str) else None) for t in pdf["_text"].to_numpy(object)[order]]
        self.joined = b"".join(self.texts)
        self.data = np.frombuffer(self.joined, np.uint8)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        n = len(self.data) - LENGTH + 1
        # A run cut by a block's end is two runs. Small blocks stay in the cache.
        parts = [self._block(at, min(BLOCK, n - at)) for at in range(0, n, BLOCK)]
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.doc, self.start, self.length, self.at = (join(k, np.int64) for k in range(4))
        self.sample, self.shape = join(4, np.uint64), join(5, np.uint64)

    def _block(self, start: int, n: int) -> tuple[np.ndarray, ...]:
        names = _names(self.data[start : start + n + LENGTH - 1])
        # The least name of the OWNERS in each start's string; the place makes ties fall to the first.
        low = (names & ~_U(0xFFFFFF)) | np.arange(len(names), dtype=np.uint64)
        span = 1
        while 2 * span <= OWNERS:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[OWNERS - span : OWNERS - span + n])
        place = (low & _U(0xFFFFFF)).astype(np.int64)
        opens = self.begin[np.searchsorted(self.begin, start) : np.searchsorted(self.begin, start + n)] - start
        first = np.unique(np.concatenate((np.zeros(1, np.int64), opens, np.flatnonzero(place[1:] != place[:-1]) + 1)))
        last = np.concatenate((first[1:], [n])) - 1
        doc = np.searchsorted(self.begin, first + start, "right") - 1
        last = np.minimum(last, self.begin[doc + 1] - start - LENGTH)  # a string lies within its document
        keep = first <= last
        first, last, doc = first[keep], last[keep], doc[keep]
        at = place[first]
        shape = ((last - first) * 64 + (at - first)).astype(np.uint64)
        ends = _pair(names[first], names[last + Q]) + shape * _U(0x165667B19E3779F9)
        # Least names crowd at the low end, so a sample's name is mixed once more before it's dealt.
        return doc, first + start, last - first + 1, at - first, mix64(names[at] ^ _U(0xA0761D6478BD642F)), ends

    def ask_samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Names (ascending, once each) and, twice, how many more runs than one differ, plus 1 if documents do."""
        order = np.lexsort((self.shape, self.sample))
        name, shape, ids = self.sample[order], self.shape[order], self.ids[self.doc[order]]
        first = _firsts(name)
        if not len(first):
            return name, np.zeros(0, np.uint16)
        new = np.concatenate(([False], (shape[1:] != shape[:-1]) & (name[1:] == name[:-1])))
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        return name[first], (np.minimum(np.add.reduceat(new.astype(np.int64), first), 32767) * 2 + several).astype(np.uint16)

    def state(self, answer: np.ndarray, names: np.ndarray) -> np.ndarray:
        """For each run what question 1 says of its sample: 0 in one document, 1 in several, 2 hot."""
        return answer[np.searchsorted(names, self.sample)] if len(names) else np.zeros(0, np.int8)

    def entries(self, state: np.ndarray, parts: int) -> Entries:
        """The different runs that question 2 is about, and the single starts of hot samples, by part."""
        run = np.flatnonzero(state == 1)
        hot = np.flatnonzero(state == 2)
        n = self.length[hot]
        start = np.concatenate((self.start[run], np.repeat(self.start[hot], n) + _steps(n)))
        doc = np.concatenate((self.doc[run], np.repeat(self.doc[hot], n)))
        length = np.concatenate((self.length[run], np.ones(len(start) - len(run), np.int64)))
        lone = start[len(run) :]
        name = np.concatenate((self.sample[run], _pair(_names(self.data, lone), _names(self.data, lone + Q)) if len(lone) else np.zeros(0, np.uint64)))
        at = np.concatenate((self.at[run], np.full(len(lone), 255)))
        part = _part_of(name, parts)
        order = np.lexsort((start, doc, part))  # ids ascend, so the first of equal ones has the least
        start, length, doc = start[order], length[order], doc[order]
        number: dict[bytes, int] = {}
        which = [number.setdefault(self.joined[a:b], len(number)) for a, b in zip(start.tolist(), (start + length + LENGTH - 1).tolist(), strict=True)]
        which = np.array(which, np.int64)
        first = np.unique(which, return_index=True)[1]
        return Entries(start, length, self.ids[doc], which, list(number), part[order][first], self.ids[doc[first]], at[order][first].astype(np.uint8))


def _part_of(names: np.ndarray, parts: int) -> np.ndarray:
    """Part of a name: equal ranges of its upper 32 bits, so that parts ascend with the names."""
    return (((names >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


# --- letters -------------------------------------------------------------------------------------------------------

LETTER = "part long, batch long, step int, data binary"


def _packed(*columns: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c if isinstance(c, bytes) else c.tobytes() for c in columns))


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _sample_letters(batch: int, parts: int, names: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """A row for each part that a batch has names in. What a name has beyond its part is cut to 32 bits and sent as steps:
    two names that agree so far are only looked at in vain."""
    cuts = np.searchsorted(_part_of(names, parts), np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    short = ((names * _U(parts)) >> _U(32)).astype(np.uint32)
    packed = [_packed(np.diff(short[a:b], prepend=np.uint32(0)), counts[a:b]) for a, b in zip(cuts[full], cuts[full + 1], strict=True)]
    return pd.DataFrame({"part": full, "batch": batch, "step": 1, "data": packed})


def _answer_samples(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to all sample letters of a part: a state for each name of each letter, in its order."""
    pdf = pdf.sort_values("batch", kind="stable")
    opened = [_open(d) for d in pdf["data"]]
    sizes = np.array([len(d) // 6 for d in opened])
    names = np.concatenate([np.cumsum(np.frombuffer(d, np.uint32, n), dtype=np.uint32) for d, n in zip(opened, sizes, strict=True)])
    counts = np.concatenate([np.frombuffer(d, np.uint16, n, 4 * n) for d, n in zip(opened, sizes, strict=True)])
    order = np.argsort(names, kind="stable")
    first = _firsts(names[order])
    held = np.diff(np.concatenate((first, [len(names)])))
    counts = counts[order]
    several = (held > 1) | (np.bitwise_or.reduceat(counts, first) & 1 > 0)
    hot = np.add.reduceat(counts.astype(np.int64) >> 1, first) > HOT_RUNS
    out = np.zeros(len(names), np.int8)
    out[order] = np.repeat(np.where(several, np.where(hot, 2, 1), 0), held)
    cuts = np.cumsum(sizes)
    return pdf.drop(columns="data").assign(data=[_packed(x) for x in np.split(out, cuts[:-1])])


def _entry_letters(batch: int, entries: Entries) -> pd.DataFrame:
    cuts = np.append(_firsts(entries.part), len(entries.part))
    packed = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = np.array([len(e) - LENGTH for e in entries.held[a:b]], np.uint8)
        packed.append(_packed(np.array([b - a], np.int64), entries.least[a:b], n, entries.at[a:b], *entries.held[a:b]))
    return pd.DataFrame({"part": entries.part[cuts[:-1]], "batch": batch, "step": 2, "data": packed})


def _answer_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each entry of each letter a mask: the starts that a document earlier than the letter's least id holds."""
    pdf = pdf.sort_values("batch", kind="stable")
    number: dict[bytes, int] = {}
    which, ids, at, sizes = [], [], [], []
    for data in pdf["data"]:
        d = _open(data)
        n = int(np.frombuffer(d, np.int64, 1)[0])
        ids.append(np.frombuffer(d, np.int64, n, 8))
        ends = np.cumsum(np.frombuffer(d, np.uint8, n, 8 + 8 * n).astype(np.int64) + LENGTH) + 8 + 10 * n
        at.append(np.frombuffer(d, np.uint8, n, 8 + 9 * n))
        ends = ends.tolist()
        which += [number.setdefault(d[a:b], len(number)) for a, b in zip([8 + 10 * n, *ends], ends)]  # noqa: B905  the starts are longer
        sizes.append(n)
    held, which, ids, at = list(number), np.array(which, np.int64), np.concatenate(ids), np.concatenate(at)
    least = np.full(len(held), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    first = np.unique(which, return_index=True)[1]
    by_start = earliest(held, least, at[first])
    n = np.array([len(e) - LENGTH + 1 for e in held], np.int64)
    begin = np.cumsum(n) - n
    mask = np.zeros(len(which), np.uint32)
    for a in range(0, len(which), BLOCK):
        w = which[a : a + BLOCK]
        earlier = by_start[np.repeat(begin[w], n[w]) + _steps(n[w])] < np.repeat(ids[a : a + BLOCK], n[w])
        mask[a : a + BLOCK] = np.bitwise_or.reduceat(earlier.astype(np.uint32) << _steps(n[w]).astype(np.uint32), np.cumsum(n[w]) - n[w])
    return pdf.drop(columns="data").assign(data=[_packed(x) for x in np.split(mask, np.cumsum(sizes)[:-1])])


def _replies(pdf: pd.DataFrame, step: int, kind: type) -> np.ndarray:
    rows = pdf[pdf["step"] == step].sort_values("part", kind="stable")
    return np.frombuffer(b"".join(map(_open, rows["data"])), kind)


def _settle(batch: Batch, entries: Entries, mask: np.ndarray) -> pd.DataFrame:
    """_id, kept, n_bytes, n_removed, n_spans of a batch's documents."""
    size = len(batch.data)
    gone = np.zeros(size + 1, bool)
    for a in range(0, len(entries.start), BLOCK):
        part = slice(a, a + BLOCK)
        n, which = entries.length[part], entries.which[part]
        j = _steps(n)
        lost = (np.repeat(mask[which], n) >> j.astype(np.uint32) & 1 > 0) | np.repeat(entries.ids[part] > entries.least[which], n)
        gone[(np.repeat(entries.start[part], n) + j)[lost]] = True
    so_far = np.concatenate((np.zeros(LENGTH, np.int32), np.cumsum(gone[:size], dtype=np.int32)))
    off = so_far[LENGTH:] > so_far[:-LENGTH]  # a string that goes starts at most LENGTH - 1 bytes before
    out = []
    for k, text in enumerate(batch.texts):
        lo, hi = batch.begin[k], batch.begin[k + 1]
        own = off[lo:hi]
        n = int(own.sum())
        kept = batch.data[lo:hi][~own].tobytes() if n else text
        out.append((batch.ids[k], kept, len(text), n, int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0))
    return pd.DataFrame(out, columns=["_id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id_col, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id; strings are judged on the whole
    input. Null or short text: nothing goes. Null id: takes no part and keeps its text. Rows that repeat an id are
    documents of one id: neither is earlier. Empty table: no rows. Other columns are ignored, whatever their names.

    A text is held by one task, so it must fit a worker's memory a few times over. Letters are at most as many as batches
    times parts, and never more than the names in them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    none = rows.where("_id is null").select(F.col("_id").alias(id_col), F.encode(F.coalesce("_text", F.lit("")), "UTF-8").alias("kept")).select("*", F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0]
    batches = parts_for(total, batch_bytes, 12)
    parts = parts_for(total, PART_BYTES * batch_bytes / BATCH_BYTES, 12)
    dealt = rows.where("_id is not null").select(F.pmod(F.xxhash64("_id", "_text"), F.lit(batches)).alias("batch"), F.col("_id").cast("long").alias("_id"), "_text").repartition(batches, "batch")

    def samples(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _sample_letters(key[0], parts, *Batch(pdf).ask_samples())

    def told_samples(pdf: pd.DataFrame, told: pd.DataFrame) -> tuple[Batch, Entries]:
        b = Batch(pdf)
        return b, b.entries(b.state(_replies(told, 1, np.int8), b.ask_samples()[0]), parts)

    def entries(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _entry_letters(key[0], told_samples(pdf, told)[1])

    def finish(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _settle(*told_samples(pdf, told), _replies(told, 2, np.uint32))

    by_batch = dealt.groupBy("batch")
    by_part = lambda letters: letters.repartition(parts, "part").groupBy("part")  # noqa: E731  as many tasks as parts, at any size
    first = by_part(by_batch.applyInPandas(samples, LETTER)).applyInPandas(lambda pdf: _answer_samples(pdf), LETTER)
    second = by_part(by_batch.cogroup(first.groupBy("batch")).applyInPandas(entries, LETTER)).applyInPandas(lambda pdf: _answer_entries(pdf), LETTER)
    out = by_batch.cogroup(first.union(second).groupBy("batch")).applyInPandas(finish, "_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.select(F.col("_id").cast(kind).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans").union(none)


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """remove_repeats() with the SHA-256 of what stays in its place."""
    return remove_repeats(docs, id_col, text_col, batch_bytes).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
