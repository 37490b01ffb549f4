"""How two tokenizers cut the same bytes, and how often their ids meet in the corpus.

The ends of both tokenizers' tokens cut a text into elementary intervals. Each lies in one token of each side, and is
the one overlap of the two; ends that both share close a group.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BATCH_BYTES = 2_000_000  # of text whose documents share a table of their id pairs
CALL_BYTES = 200_000  # of text that go to a tokenizer in one call
HELD, LONG = 200_000, 1_000  # parts of texts that a worker remembers, and the characters of the longest one
PAIR = 1 << 32  # an id pair is a * PAIR + b


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order
    the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the `tokenizers` library. Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte, names = byte_of(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        told = json.loads(self.tokenizer.to_str())
        # Its words are a blank at most and then no white space, or white space alone.
        self.by_blank = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not told["model"]["dropout"] and all(t["special"] for t in told["added_tokens"])
        self.fast = self._ranked(told) if self.by_blank else None

    def _ranked(self, told: dict) -> object | None:
        """The same vocabulary as ranks, where its ids are in the order of its merges: a faster way to the same ids."""
        import tiktoken

        ids, merges = told["model"]["vocab"], told["model"]["merges"]
        special = {t["content"] for t in told["added_tokens"]}
        if len(ids) - len(special & set(ids)) != 256 + len(merges) or any(ids[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks={self.bytes[i]: i for name, i in ids.items() if name not in special}, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """texts begin with a blank."""
        if self.fast is not None and all(map(_PLAIN.fullmatch, texts)):
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which adds the leading blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.by_blank = not any("▁" in x.lstrip("▁") for x in names)  # no piece goes on from other characters to a blank

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """texts begin with a blank."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


# Fixed value: how a byte-level tokenizer splits a text into words.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A blank and a text in Latin letters that ends where another blank may follow; what is a letter or white space is plain.
_PLAIN = re.compile(" [\t\n\r\x20-\x7e\xa1-\u024f]*[\x21-\x7e\xa1-\u024f]")
# A blank after a character that no tokenizer takes for white space or drops.
_PART = re.compile("(?<=[^\\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff])(?= )")


@dataclass
class Cut:
    """Parts of texts as one run of tokens on either side; both end at every part's end."""

    a: np.ndarray  # ids
    b: np.ndarray
    ends_a: np.ndarray  # bytes up to each token's end, parts one after the other
    ends_b: np.ndarray

    def __post_init__(self) -> None:
        self.ends = np.union1d(self.ends_a, self.ends_b)  # an interval ends at each
        self.own_a, self.own_b = np.searchsorted(self.ends_a, self.ends), np.searchsorted(self.ends_b, self.ends)  # the tokens it lies in
        self.shared = self.ends[(self.ends_a[self.own_a] == self.ends) & (self.ends_b[self.own_b] == self.ends)]
        self.group_a, self.group_b = np.searchsorted(self.shared, self.ends_a), np.searchsorted(self.shared, self.ends_b)

    def pairs(self) -> np.ndarray:
        """The id pair of each interval."""
        return self.a[self.own_a] * PAIR + self.b[self.own_b]

    def products(self) -> np.ndarray:
        """Token index pairs (a, b) of all tokens that share a group, whether or not they overlap."""
        na, nb = np.bincount(self.group_a, minlength=len(self.shared)), np.bincount(self.group_b, minlength=len(self.shared))
        first_b = np.concatenate(([0], np.cumsum(nb)))[:-1]
        times = nb[self.group_a]
        a = np.repeat(np.arange(len(self.a)), times)
        step = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        return np.column_stack([a, first_b[self.group_a[a]] + step])

    def written(self, strings: list[str], n_a: int, n_b: int) -> tuple[list[str], np.ndarray]:
        """The tokens of all groups, A before B, each with the sign that follows it; and how many of them lie before each
        group's end."""
        upto = lambda g: np.searchsorted(g, np.arange(len(self.shared)), "right")
        ends_a, ends_b = upto(self.group_a), upto(self.group_b)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[ends_a - 1] = last_b[ends_b - 1] = True
        out = np.empty(len(self.a) + len(self.b), np.int64)
        starts_b = np.concatenate(([0], ends_b))[:-1]
        out[np.arange(len(self.a)) + starts_b[self.group_a]] = self.a + n_a * last_a
        out[np.arange(len(self.b)) + ends_a[self.group_b]] = 2 * n_a + self.b + n_b * last_b
        return [strings[i] for i in out.tolist()], ends_a + ends_b


def _signed_strings(n_a: int, n_b: int) -> list[str]:
    """Every id of A with `,` and with `|`, every id of B with `,` and with `;`."""
    return [f"{i}{sign}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for sign in signs for i in range(n)]


@dataclass
class Parts:
    """What is known of parts of texts: one row for each."""

    good: np.ndarray  # both tokenizers give it back
    sums: np.ndarray  # n_a, n_b, n_groups, n_links
    written: list[str]  # its groups
    first: np.ndarray  # its id pairs are pairs[first : first + links]
    pairs: np.ndarray


class Aligner:
    """Both tokenizers and what they make of parts of texts.

    Where no token of either goes on from other characters to a blank, a text's parts between such places are cut
    independently of each other, so each different part is looked at once; else the part is the whole text. Up to HELD
    parts are remembered, and none if one is longer than LONG.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.strings = _signed_strings(len(self.a.bytes), len(self.b.bytes))
        self.by_blank = self.a.by_blank and self.b.by_blank
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.known = Parts(np.zeros(0, bool), np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64))

    def split(self, text: str) -> list[str]:
        return _PART.split(f" {text}") if self.by_blank else [f" {text}"]

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of A and B of all parts as one text, and how many of them each part has; None if any doesn't come back."""
        text = "".join(parts)
        x, y = self.a([text])[0], self.b([text])[0]
        want = text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a.bytes.__getitem__, x)) != want or b"".join(map(self.b.bytes.__getitem__, y)) != want:
            return None
        x, y = np.array(x, np.int64), np.array(y, np.int64)
        ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
        out = []
        for ids, size in ((x, self.size_a), (y, self.size_b)):
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return None
            out += [ids, np.diff(last + 1, prepend=0)]
        return tuple(out)

    def look(self, parts: list[str]) -> Parts:
        """Cut parts, each on its own. Those that end where a text could be split go to the tokenizers together."""
        plain = [i for i, p in enumerate(parts) if self.by_blank and _PLAIN.fullmatch(p)]
        taken, runs = set(plain), []
        at = held = 0
        for end in range(len(plain)):
            held += len(parts[plain[end]])
            if held > CALL_BYTES or end == len(plain) - 1:
                runs.append(plain[at : end + 1])
                at, held = end + 1, 0
        runs += [[i] for i in range(len(parts)) if i not in taken]
        order, got = [], []
        while runs:
            run = runs.pop()
            found = self._joined([parts[i] for i in run])
            if found is not None:
                order += run
                got.append(found)
            elif len(run) > 1:
                runs += [run[: len(run) // 2], run[len(run) // 2 :]]
        good, sums = np.zeros(len(parts), bool), np.zeros((len(parts), 4), np.int64)
        written, first = [""] * len(parts), np.zeros(len(parts), np.int64)
        if not got:
            return Parts(good, sums, written, first, np.zeros(0, np.int64))
        x, n_x, y, n_y = (np.concatenate([g[k] for g in got]) for k in range(4))
        which = np.array(order)
        good[which], sums[which, 0], sums[which, 1] = True, n_x, n_y
        cut = Cut(x, y, np.cumsum(self.size_a[x]), np.cumsum(self.size_b[y]))
        ends = cut.ends_a[np.cumsum(n_x) - 1]  # where each part ends
        links = np.searchsorted(cut.ends, ends, "right")
        closed = np.searchsorted(cut.shared, ends, "right")  # groups up to there
        sums[which, 2], sums[which, 3] = np.diff(closed, prepend=0), np.diff(links, prepend=0)
        first[which] = np.concatenate(([0], links))[:-1]
        signed, upto = cut.written(self.strings, len(self.a.bytes), len(self.b.bytes))
        at = 0
        for i, end in zip(order, upto[closed - 1].tolist(), strict=True):
            written[i] = "".join(signed[at:end])[:-1]
            at = end
        return Parts(good, sums, written, first, cut.pairs())

    def learn(self, parts: list[str]) -> None:
        new = self.look(parts)
        old = self.known
        self.places |= {p: i for i, p in enumerate(parts, len(old.written))}
        self.known = Parts(np.concatenate([old.good, new.good]), np.concatenate([old.sums, new.sums]), old.written + new.written, np.concatenate([old.first, new.first + len(old.pairs)]), np.concatenate([old.pairs, new.pairs]))

    def __call__(self, batch: int, ids: list[str | None], texts: list[str]) -> pa.RecordBatch:
        """A row for each document, with the places of its id pairs in the batch's list and how often it has them, and last
        one without n_a for the batch, with that list and how many of its documents have each pair."""
        split = [self.split(t) if t else [] for t in texts]
        fresh = {p for parts in split for p in parts if p not in self.places}
        if len(self.places) + len(fresh) > HELD:
            self.forget()
            fresh = {p for parts in split for p in parts}
        self.learn(sorted(fresh))
        places = [list(map(self.places.__getitem__, parts)) for parts in split]
        bad = [i for i, p in enumerate(places) if not self.known.good[p].all()]
        whole = [i for i in bad if len(split[i]) > 1]
        if whole:  # parts that don't come back may still do so together
            start = len(self.known.written)
            self.learn([f" {texts[i]}" for i in whole])
            for k, i in enumerate(whole):
                places[i] = [start + k]
            bad = [i for i in bad if not self.known.good[places[i]].all()]
        for i in bad:
            places[i] = []
        known, n = self.known, len(texts)
        doc = np.repeat(np.arange(n), [len(p) for p in places])
        part = np.concatenate([np.zeros(0, np.int64), *(np.array(p, np.int64) for p in places)])
        sums = np.zeros((n, 4), np.int64)
        np.add.at(sums, doc, known.sums[part])
        shas = [hashlib.sha256(";".join(map(known.written.__getitem__, p)).encode()).hexdigest() if p else "" for p in places]
        both, times = np.unique(doc * len(known.written) + part, return_counts=True)  # a part of a document, and how often
        doc, part = np.divmod(both, max(1, len(known.written)))
        size = known.sums[part, 3]
        at = np.repeat(known.first[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
        kinds, kind = np.unique(known.pairs[at], return_inverse=True)
        both, kind = np.unique(np.repeat(doc, size) * len(kinds) + kind, return_inverse=True)
        times = np.bincount(kind, np.repeat(times, size), len(both)).astype(np.int64)
        doc, kind = np.divmod(both, max(1, len(kinds)))
        bounds = np.searchsorted(doc, np.arange(n + 1))
        held = len(self.places)
        if max(map(len, fresh), default=0) > LONG or whole or held > HELD:
            self.forget()
        add = lambda x, last, f: pa.concat_arrays([pa.array(x, f.type), pa.array([last], f.type)])
        lists = lambda x, ends, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
        cols = [pa.array([batch] * (n + 1), pa.int64()), add(ids, None, _ROW.field("_id")), *(add(sums[:, k], None, _ROW.field("n_a")) for k in range(4)), add(shas, None, _ROW.field("groups_sha256"))]
        cols += [lists(kind, [*bounds, len(both)], pa.int32()), lists(np.concatenate([times, np.bincount(kind, minlength=len(kinds))]), [*bounds, len(both) + len(kinds)], pa.int32()), lists(kinds, [0] * (n + 1) + [len(kinds)], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, schema=_ROW)


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


_ROW = pa.schema([("batch", pa.int64()), ("_id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("codes", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64()))])
_DDL = "batch long, _id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<int>, pairs array<long>"


def _counted(key: tuple, docs: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of a batch's documents, from the corpus-wide counts of the batch's id pairs."""
    met = met.sort_values("code")
    n, best = met["n"].to_numpy(np.int64), met["best"].to_numpy(np.int64)
    size = docs["codes"].map(len).to_numpy(np.int64)
    of = np.repeat(np.arange(len(docs)), size)
    codes, times = (np.concatenate([np.zeros(0, np.int64), *docs[c]]).astype(np.int64) for c in ("codes", "times"))
    sums = np.zeros((len(docs), 2), np.int64)
    np.add.at(sums, of, np.column_stack([times * best[codes], times * n[codes]]))
    return docs.drop(columns=["batch", "codes", "times"]).assign(n_best=sums[:, 0], count_sum=sums[:, 1])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_a, n_b (tokens), n_groups, n_links (overlapping pairs of tokens), n_best (links whose id pair is in as
    many documents as any pair of its A id), count_sum (documents that hold a link's pair, over links), groups_sha256.

    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens: zeros and ''.
    Rows are documents, also where they repeat or share an id; null ids stay. Ties are all best. Empty table: no rows.
    Other columns are ignored, whatever their names. A text is held whole by one task, with some hundred bytes a token.

    Each text is looked at once, by parts (see Aligner). Its links are written with the id pairs of its batch of about BATCH_BYTES of text; pairs
    are counted over batches, and each batch is sent the counts of its own pairs. So a pair that every document holds
    moves once for each batch, and what meets in a task is a batch's documents and different pairs.
    """
    kind = docs.schema[id_col].dataType

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(path_a, path_b)
        aligned.forget()
        batch, ids, texts, held = TaskContext.get().partitionId() << 33, [], [], 0
        for rows in it:
            for i, text in (pair for at in range(0, rows.num_rows, 256) for pair in zip(*(c.to_pylist() for c in rows.slice(at, 256).columns), strict=True)):
                ids.append(i)
                texts.append(text or "")
                held += len(texts[-1]) + 64
                if held >= BATCH_BYTES:
                    yield aligned(batch, ids, texts)
                    batch, ids, texts, held = batch + 1, [], [], 0
        if ids:
            yield aligned(batch, ids, texts)
        aligned.forget()

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    cut = materialise(rows.mapInArrow(encode, _DDL))
    uses = cut.where("n_a is null").select(F.col("batch").alias("_to"), "times", F.posexplode("pairs").alias("code", "pair")).select("_to", "code", "pair", F.col("times")[F.col("code")].alias("n"))
    counts = materialise(uses.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {PAIR}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most, so it can be broadcast
    judged = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    met = uses.drop("n").join(judged, "pair").select("_to", "code", "n", "best")
    whole = cut.where("n_a is not null").drop("pairs")
    out = "_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    done = whole.groupBy("batch").cogroup(met.groupBy("_to")).applyInPandas(_counted, out)
    return done.select(F.col("_id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
