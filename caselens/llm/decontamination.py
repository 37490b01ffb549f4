"""Benchmark decontamination: a hash join of canonical template windows, with a check that slots are filled consistently.

Items and documents become templates (typed placeholders for numbers, names and units), and their windows are hashed. A
bitmap of the items' hashes, of bounded size, lets documents send the windows alone that may meet one. An item counts at
a share of its windows, so it can't do without all of its rarest ones: only those are joined on their hash, and the
pairs of document and item that they give are then joined with all windows of the item. A window that many items share,
such as a common opening, is no key of any of them as long as they have rarer ones.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, mix64, skewed_join, utf8

WINDOW = 8
MIN_LITERAL = 4  # words of a window that are no placeholder
MIN_COVERAGE = 0.4  # of an item's windows
BITMAP_BITS = (24, 29)  # least and most address bits of the bitmap, so it has 2 to 64 MB
CACHE = 400_000
TEMPLATE, EXACT, LINE = 0, 1, 2  # how an item is found: by template windows, as a run of its words, as a line of its own
# Units of measure and money that a number may carry.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilogram kilograms gram grams mile miles foot feet inch inches pound pounds liter liters litre litres dollar dollars euro euros cent cents percent % $ € £ °c °f degrees".split())
NUM, NAME, UNIT = "\x01num", "\x01name", "\x01unit"
_NUMBER = re.compile(r"^[$€£]?[+-]?\d[\d.,:/]*\d?(st|nd|rd|th)?%?$|^[$€£]?\d+$")
_EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w%°]+$")


def _literal(word: str) -> int:
    return xxhash.xxh64_intdigest(utf8(word), 7)


SLOTS = {k: _literal(k) for k in (NUM, NAME, UNIT)}


class Canon(dict):
    """Raw word -> (hash of its template word, kind): 0 word, 1 number, 2 capitalised, 3 unit; 4 on top if it ends a
    sentence. Remembered for speed alone."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        word = raw.decode("utf-8", "surrogatepass")
        bare = _EDGE.sub("", word) or word
        kind = 1 if _NUMBER.match(bare) else 3 if bare.lower() in UNITS else 2 if bare[:1].isupper() and bare[1:].islower() else 0
        out = self[raw] = (_literal(NUM) if kind == 1 else _literal(bare.lower())) & ~7 | kind | (4 if word[-1:] in ".!?:" else 0)
        return out


@dataclass
class Template:
    words: list[bytes]
    hashes: np.ndarray
    slot: np.ndarray
    other: np.ndarray  # hashes with each capitalised word read the other way, as a name or as a word
    firsts: list[int]  # places of the words that open a line


def templates(text: str | None, canon: Canon) -> list[Template]:
    """Numbers, units right after a number, and capitalised words inside a sentence become typed placeholders. A line
    start is read as opening a sentence and, since a sentence may run on, as not: a second template where they differ."""
    words, firsts = [], []
    for line in utf8(text).split(b"\n"):
        if part := line.split():
            firsts.append(len(words))
            words += part
    code = np.fromiter(map(canon.__getitem__, words), np.uint64, len(words))
    kind = (code & np.uint64(3)).astype(np.int8)
    before = np.concatenate(([False], kind[:-1] == 1)) if len(code) else np.zeros(0, bool)
    name, plain = kind == 2, code & ~np.uint64(7)
    fixed = np.where(kind == 1, 1, np.where((kind == 3) & before, 3, 0))
    opens = np.concatenate(([True], (code[:-1] & np.uint64(4)) > 0)) if len(code) else np.zeros(0, bool)
    by_line = opens.copy()
    by_line[firsts] = True
    out = []
    for begins in [by_line, opens] if (name & (by_line != opens)).any() else [by_line]:
        slot = np.where(name & ~begins, 2, fixed)
        hashes = plain.copy()
        for k, placeholder in ((1, NUM), (2, NAME), (3, UNIT)):
            hashes[slot == k] = SLOTS[placeholder]
        out.append(Template(words, hashes, slot, np.where(name, np.where(slot == 2, plain, np.uint64(SLOTS[NAME])), hashes), firsts))
    return out


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def rolled(hashes: np.ndarray, width: int, *firsts: np.ndarray) -> list[np.ndarray]:
    """Hash of each window; then, for each of firsts, with its first word's hash from there."""
    n = len(hashes) - width + 1
    if n < 1:
        return [np.zeros(0, np.uint64)] * (1 + len(firsts))
    spread = lambda x: x ^ (x >> np.uint64(29))
    mixed = spread(hashes)
    tail, power = np.zeros(n, np.uint64), np.uint64(1)
    for i in range(1, width):
        tail = tail * _MULTIPLIER + mixed[i : i + n]
    with np.errstate(over="ignore"):
        for _ in range(width - 1):
            power = power * _MULTIPLIER
    return [mix64(first[:n] * power + tail) for first in (mixed, *map(spread, firsts))]


def fit_windows(t: Template, width: int) -> np.ndarray:
    """Whether each window holds enough words that are no placeholder."""
    plain = np.concatenate(([0], np.cumsum(t.slot == 0)))
    return plain[width:] - plain[:-width] >= min(MIN_LITERAL, width)


class Exact(dict):
    """Raw word -> hash of it in lower case, without the marks at its ends."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        word = raw.decode("utf-8", "surrogatepass")
        out = self[raw] = _literal((_EDGE.sub("", word) or word).lower())
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


SALT = {TEMPLATE: np.uint64(0), EXACT: np.uint64(0x2545F4914F6CDD1D), LINE: np.uint64(0x9FB21C651E98DF25)}


@dataclass
class Item:
    """kind, the words, and the windows: hash, place. `need` of `total` windows must be met."""

    kind: int
    words: list[bytes]
    template: Template
    width: int
    windows: list[tuple[int, int]]
    total: int
    need: int


def item_of(text: str, canon: Canon, exact: Exact) -> Item | None:
    """How an item is looked for; None if it has no word.

    With a window of MIN_LITERAL plain words: by template. Other items of MIN_LITERAL words or more (numbers and names
    alone): by all their words in a row. Shorter ones: by a line that holds nothing else.
    """
    t = templates(text, canon)[0]
    width = min(WINDOW, len(t.words))
    if not width:
        return None
    fit = fit_windows(t, width)
    if width >= MIN_LITERAL and fit.any():
        # A window that a capitalised word opens is held with it as a word and as a name.
        both = rolled(t.hashes, width, t.other)
        windows = sorted({(h, j) for hashes in both for j, h in enumerate(hashes.tolist()) if fit[j]})
        return Item(TEMPLATE, t.words, t, width, windows, int(fit.sum()), math.ceil(MIN_COVERAGE * int(fit.sum()) - 1e-9))
    kind = EXACT if width >= MIN_LITERAL else LINE
    windows = list(enumerate((rolled(exact.of(t.words), width)[0] ^ SALT[kind]).tolist()))
    return Item(kind, t.words, t, width, [(h, j) for j, h in windows], len(windows), len(windows))


def _bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?()")


class Scan:
    """The windows of a text that the bitmap lets through. shapes: kind and width of the items' windows."""

    def __init__(self, shapes: list[tuple[int, int]], bitmap: np.ndarray):
        self.bitmap, self.shift = bitmap, np.uint64(64 - (len(bitmap) * 8 - 1).bit_length())
        self.widths = {kind: [w for k, w in shapes if k == kind] for kind in SALT}
        self.canon, self.exact = Canon(), Exact()

    def _may_meet(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return np.flatnonzero(self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)

    def windows(self, text: str) -> list[tuple[int, int, str]]:
        """Place, hash and words of each."""
        readings = templates(text, self.canon)
        t, found = readings[0], set()
        for width in self.widths[TEMPLATE]:
            for own in (x for r in readings for x in rolled(r.hashes, width, r.other)):
                found |= {(i, int(own[i]), width) for i in self._may_meet(own).tolist()}
        if self.widths[EXACT] or self.widths[LINE]:
            codes = self.exact.of(t.words)
            for width in self.widths[EXACT]:
                own = rolled(codes, width)[0] ^ SALT[EXACT]
                found |= {(i, int(own[i]), width) for i in self._may_meet(own).tolist()}
            starts = np.array(t.firsts, np.int64)
            size = np.diff(np.append(starts, len(t.words)))
            for width in self.widths[LINE]:
                alone = starts[size == width]
                if len(alone):
                    own = rolled(codes, width)[0][alone] ^ SALT[LINE]
                    found |= {(int(alone[i]), int(own[i]), width) for i in self._may_meet(own).tolist()}
        return [(i, h, b" ".join(t.words[i : i + width]).decode("utf-8", "surrogatepass")) for i, h, width in sorted(found)]


def judge(item: Item, met: list[tuple[int, int, bytes]]) -> tuple[int, float, int, int] | None:
    """n_windows, coverage, n_slots, n_changed if the windows met (place in item, place in text, words) make the item."""
    lanes: dict[int, dict[int, list[bytes]]] = defaultdict(dict)
    for j, at, words in met:
        lanes[at - j][j] = words.split()
    ours = item.template
    if item.kind != TEMPLATE:
        same = lambda js: len(js) == item.total and all([*map(_plain, w)] == [*map(_plain, item.words[j : j + item.width])] for j, w in js.items())
        return (item.total, 1.0, 0, 0) if any(map(same, lanes.values())) else None
    seen: set[int] = set()
    changed: dict[int, bool] = {}
    for js in lanes.values():
        theirs = {j + k: w for j, words in js.items() for k, w in enumerate(words)}
        spots = sorted({j + k for j in js for k in range(item.width) if ours.slot[j + k]} | {j for j in js if _bare(ours.words[j].lower()) != _bare(theirs[j].lower()) and ours.other[j] != ours.hashes[j]})
        given: dict[bytes, bytes] = {}
        if all(given.setdefault(_bare(ours.words[p]), got) == got for p in spots for got in [_bare(theirs[p])]):
            seen.update(js)
            changed.update((p, _bare(ours.words[p]) != _bare(theirs[p])) for p in spots)
    return (len(seen), len(seen) / item.total, len(changed), sum(changed.values())) if len(seen) >= item.need else None


def _plain(word: bytes) -> str:
    text = word.decode("utf-8", "surrogatepass")
    return (_EDGE.sub("", text) or text).lower()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit for each leading part of a hash. It's made in pieces of 8 KB, so the driver gets BITMAP_BITS at most."""
    n = windows.select("h").distinct().count()
    bits = min(max((max(n, 1) - 1).bit_length() + 11, BITMAP_BITS[0]), BITMAP_BITS[1])

    def piece(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << 16, np.uint8)
        held[pdf["at"].to_numpy(np.int64) & 0xFFFF] = 1
        return pd.DataFrame({"piece": [key[0]], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    at = windows.select(F.shiftrightunsigned("h", 64 - bits).alias("at")).distinct().withColumn("piece", F.shiftright("at", 16))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in at.groupBy("piece").applyInPandas(piece, "piece long, bits binary").toLocalIterator():
        out[r["piece"] << 13 : (r["piece"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def _item_windows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    canon, exact = Canon(), Exact()
    for pdf in it:
        rows = []
        for name, text in zip(pdf["item"], pdf["_text"], strict=True):
            if item := item_of(text, canon, exact):
                rows += [(name, item.kind, item.width, j, h - (1 << 64) if h >> 63 else h, item.total - item.need + 1) for h, j in item.windows]
        yield pd.DataFrame(rows, columns=["item", "kind", "width", "j", "h", "n_keys"])


def _judged(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    canon, exact = Canon(), Exact()
    for pdf in it:
        rows, known = [], {}
        for i, name, item, text, met in zip(pdf["_id"], pdf["_t"], pdf["item"], pdf["_text"], pdf["met"], strict=True):
            held = known[item] = known.get(item) or item_of(text, canon, exact)
            if got := judge(held, [(m["j"], m["at"], utf8(m["words"])) for m in met]):
                rows.append((i, name, item, *got))
        yield pd.DataFrame(rows, columns=["_id", "_t", "item", "n_windows", "coverage", "n_slots", "n_changed"])


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """_id (as text), _t (of the row's text), item_id and what judge() says."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("_text"))
    items = materialise(items.withColumn("item", F.xxhash64("_text")))  # equal items are looked for once
    texts = items.groupBy("item").agg(F.min("_text").alias("_text"))
    windows = materialise(texts.mapInPandas(_item_windows, "item long, kind int, width int, j int, h long, n_keys int"))
    shapes = [(r["kind"], r["width"]) for r in windows.select("kind", "width").distinct().collect()]  # 14 at most
    held = docs.sparkSession.sparkContext.broadcast((shapes, _bitmap(windows)))

    def hits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scan(*held.value)
        for pdf in it:
            rows = [(i, t, at, h - (1 << 64) if h >> 63 else h, w) for i, t, text in zip(pdf["_id"], pdf["_t"], pdf["_text"], strict=True) for at, h, w in scan.windows(text)]
            yield pd.DataFrame(rows, columns=["_id", "_t", "at", "h", "words"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_text"))
    met = materialise(rows.mapInPandas(hits, "_id string, _t long, at long, h long, words string").join(windows.select("h").distinct(), "h", "left_semi"))
    # The rarest windows of each item, as many as leave too few for it to count without one of them.
    spread = windows.groupBy("h").agg(F.count_distinct("item").alias("_items"))
    of_place = windows.join(spread, "h").groupBy("item", "j").agg(F.max("_items").alias("_items"), F.first("n_keys").alias("n_keys"), F.collect_set("h").alias("hs"))
    ranked = of_place.groupBy("item", "n_keys").agg(F.array_sort(F.collect_list(F.struct("_items", "j", "hs"))).alias("p"))  # an item's own windows
    keys = ranked.select("item", F.explode(F.slice("p", F.lit(1), F.col("n_keys"))).alias("k")).select("item", F.explode("k.hs").alias("h"))
    often = materialise(met.groupBy("h").agg(F.count("*").alias("_n")))
    total = often.agg(F.sum("_n")).first()[0] or 0
    facts = keys.groupBy("h").agg(F.collect_set("item").alias("items")).join(often, "h")
    pairs = skewed_join(met.select("_id", "_t", "h"), facts, ["h"], "_n", total, ["_id", "_t"]).select("_id", "_t", F.explode("items").alias("item")).distinct()
    lanes = pairs.join(windows.select("item", "j", "h"), "item").join(met, ["_id", "_t", "h"])
    lanes = lanes.groupBy("_id", "_t", "item").agg(F.collect_set(F.struct("j", "at", "words")).alias("met")).join(texts, "item")
    out = lanes.select("_id", "_t", "item", "_text", "met").mapInPandas(_judged, "_id string, _t long, item long, n_windows long, coverage double, n_slots long, n_changed long")
    return out.join(items.select("item", "item_id"), "item").drop("item")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: id_col, item_id, n_windows, coverage, n_slots, n_changed.

    n_changed counts slots filled with other values than the item's; 0 is a copy, more a re-parameterised question.
    A text counts if it holds MIN_COVERAGE of an item's template windows, and each value of the item is replaced by one
    value throughout. An item of which no window holds MIN_LITERAL plain words counts where a text holds all its words in
    a row, values included, whatever their case (n_slots 0); one of under MIN_LITERAL words where they are a line of their
    own. Null or empty texts hold nothing; null items, wordless items and null item ids are left out. Items that repeat
    return a row for each id. Null ids return null. Rows that repeat an id are judged by their own texts; equal rows
    return once. Very long texts: held one at a time, whole. Empty tables: no rows. Other columns are ignored.
    """
    out = _found(docs, benchmark, id_col, text_col, item_col, item_text)
    return out.select(F.nullif("_id", F.lit("null")).cast(docs.schema[id_col].dataType).alias(id_col), "item_id", "n_windows", "coverage", "n_slots", "n_changed")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item. Null ids stay; rows that repeat an id are judged by their
    own texts. Extra columns stay, whatever their names."""
    name = fresh(docs, "_name")
    gone = _found(docs, benchmark, id_col, text_col, "item_id", "text").where("_id <> 'null'")
    gone = gone.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("_t").alias(name)).distinct()
    return docs.withColumn(name, F.xxhash64(text_col)).join(gone, [id_col, name], "left_anti").select(*docs.columns)
