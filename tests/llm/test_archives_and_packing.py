import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from caselens.llm import packing, warc

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark):
    R = random.Random(1)
    big = "".join(R.choice("abc<>é\r\n") for _ in range(300))
    pages = [(i, f"http://h/{i}", R.choice([big, "tiny", "", None, f"{i}" * 60])) for i in range(60)] + [(100, None, big), (101, "http://h/é\r\n x", big), (102, "u", "x" * 200_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, archive string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    first = {}
    for i, _, html in sorted(pages):
        first.setdefault(html, i)
    for i, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html] != i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None)
        assert again or bytes(got[i].payload) == data
    assert len(got) == len(pages) and warc.round_trip(df.limit(0)).isEmpty()


def test_archives_of_null_and_repeated_ids(spark):
    a, b, big = "a" * 200, "b" * 200, (1 << 60) + 1
    pages = [(1, a), (None, a), (None, "n" * 200), (None, None), (2, b), (2, a), (big, "c" * 150), (big + 1, "c" * 150)]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    to = {(2, a): 1, (big + 1, "c" * 150): big}
    want = [(i, hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if (i, h) in to else "response", to.get((i, h))) for i, h in pages]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_files(spark, tmp_path):
    """Archives as files, read back as binaryFile gives them."""
    pages = spark.createDataFrame([(i, "u", "p" * (i * 40)) for i in range(20)], "page_id long, url string, html string")
    rows = warc.export_archives(warc.write_archives(pages), f"file://{tmp_path}/a").collect()
    assert rows and sorted(r.path.rpartition("/")[2] for r in rows) == sorted(p.name for p in (tmp_path / "a").iterdir())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(str(tmp_path / "a"))
    assert sorted((r.page_id, r.payload_bytes, bytes(r.payload)) for r in warc.read_archives(files).collect()) == [(i, i * 40, b"p" * (i * 40)) for i in range(20)]


def test_bad_archives():
    good = warc.archive_bytes([warc.record_bytes(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 200, None)])
    assert [warc.parse_record(f)["payload_bytes"] for f in warc.split_frames(good)[1]] == [200]
    for bad in (b"", b"junk" * 9, good[8:], good[:-3], good + b"tail"):
        with pytest.raises(warc.BadArchive):
            list(warc.split_frames(bad)[1])
    record = warc.record_bytes(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 200, None)
    for bad in (record.replace(b"xx", b"yx", 1), record[:-1], record.replace(b"Content-Length: 200", b"Content-Length: 201"), record.replace(b"WARC-Date", b"Date")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)


def test_ids_are_the_tokenizer_s(monkeypatch):
    R = random.Random(5)
    whole = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "CACHE", 200)
    ours = packing.WordIds(PATH)
    plain = list("abcXYZ'st'll 12½²éÉßµª×÷.,!!#$\n\t\r <|>") + ["'ve", " I'm "]
    odd = [*plain, "<|endoftext|>", "\xa0", "\x85", "\x1c", "İ", "é", "日本", "Σ ", "\x0b", "😀"]
    for n in range(2000):
        text = "".join(R.choice(plain if n % 2 else odd) for _ in range(R.randint(0, 40)))
        assert ours(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, whole = packing.WordIds(path), Tokenizer.from_file(path)
    for text in ("Some plain text, twice.  Some plain text.", "Ünïcode\ttoo", " "):
        assert ours(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark):
    R = random.Random(3)
    docs = [(i, " ".join(R.choice(["alpha", "beta", "gamma."]) for _ in range(R.randint(0, 90)))) for i in range(150)] + [(900, None), (901, " "), (None, "alpha beta"), (3, "alpha")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int")
    rows = packing.pack_documents(df, PATH, capacity=64).collect()
    whole, want = Tokenizer.from_file(PATH), []
    for i, t in docs:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i is None, i or 0, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    bins = []  # no worse than first fit, longest first
    for n in sorted((r.length for r in rows), reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= n), None)
        bins = [*bins, 64 - n] if k is None else [room - n * (j == k) for j, room in enumerate(bins)]
    assert len(by) <= len(bins)
    assert packing.pack_documents(df.limit(0), PATH).isEmpty()


def test_plan_depends_on_lengths_alone():
    small = packing.plan({700: 30, 650: 30, 300: 40, 40: 10})
    large = packing.plan({700: 30_000_000, 650: 30_000_000, 300: 40_000_000, 40: 10_000_000})
    assert len(large.key) < 200 and large.sequences <= 1.01 * small.sequences * 1_000_000


def test_two_replace_the_smallest():
    left = np.zeros(101, np.int64)
    left[[60, 35, 22, 18]] = 1  # greedy: 60 + 35; then 35 gives way to 22 + 18
    assert packing._fill(left, 100) == [60, 22, 18]


def test_a_worker_reads_its_tokenizer_once_and_few_texts_at_a_time(spark, monkeypatch):
    from caselens.llm.common import batches_of

    assert packing.word_ids(PATH) is packing.word_ids(PATH)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with batches_of(spark, 7):
        sizes = spark.range(0, 50, 1, 1).mapInPandas(lambda it: (p.assign(id=len(p)) for p in it), "id long").toPandas()["id"].max()
    assert sizes == 7 and spark.conf.get(name) == before
    seen = []
    monkeypatch.setattr(packing, "materialise", lambda df: seen.append(spark.conf.get(name)) or df)
    packing.pack_documents(spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), PATH)
    assert seen == [str(packing.BATCH)] and spark.conf.get(name) == before
