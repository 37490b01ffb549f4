import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from caselens.llm import alignment
from caselens.llm.alignment import Cut, align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(tokens):
    ends = np.cumsum([len(b) for _, b in tokens]).tolist()
    return [(e - len(b), e, i) for (i, b), e in zip(tokens, ends, strict=True)]


def brute(docs):
    """Every pair of tokens compared by its byte range."""
    t, sp, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_of()
    t.encode_special_tokens = True
    done = []
    for i, text in docs:
        x = [(k, bytes(byte[c] for c in t.id_to_token(k))) for k in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(k, bytes.fromhex(sp.id_to_piece(k)[3:5]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in (sp.encode(text) if text else [])]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(b for _, b in x) != whole or b"".join(b for _, b in y) != whole:
            done.append((i, None))
            continue
        x, y = spans(x), spans(y)
        pairs = [(p[2], q[2]) for p in x for q in y if p[0] < q[1] and q[0] < p[1]]
        cuts = [0, *sorted({p[1] for p in x} & {q[1] for q in y})]
        inside = lambda ts, lo, hi: ",".join(str(k) for s, e, k in ts if lo <= s and e <= hi)
        groups = [f"{inside(x, lo, hi)}|{inside(y, lo, hi)}" for lo, hi in zip(cuts, cuts[1:], strict=False)]
        done.append((i, (len(x), len(y), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    n = Counter(p for _, d in done if d for p in set(d[3]))
    most = Counter()
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    return [(i, 0, 0, 0, 0, 0, 0, "") if d is None else (i, *d[:3], len(d[3]), sum(n[p] == most[p[0]] for p in d[3]), sum(n[p] for p in d[3]), d[4]) for i, d in done]


def key(rows):
    return sorted(tuple(r) for r in rows if r[0] is not None), sorted(tuple(r)[1:] for r in rows if r[0] is None)


@pytest.mark.parametrize("size", [700, 2_000_000])
def test_against_all_pairs_of_tokens(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "BATCH_BYTES", size)
    texts = ["Hello world, hello   world!", "the cat", "the cat", "The catastrophe of Überträger 日本語 🎉", "<|endoftext|> is <s> text </s> <0x41>", "▁", "a▁b", None, "", " ", "\n\n", "x\ty\r\n", "é", "ﬁ", " ", "\x00", "aaaa" * 500, "nul\x00l", "  two"]
    rng = np.random.default_rng(1)
    texts += [" ".join(["the", "tokenizer", "unbelievably", "Zürich", "1234", "ßß", "—"][k] for k in rng.integers(0, 7, 40)) for _ in range(20)] + ["the cat sat " * 3000]
    docs = [*enumerate(texts), (None, "the cat"), (None, None), (3, "again with id three")]
    frame = spark.createDataFrame([(i, t, 5, 7) for i, t in docs], "doc_id long, text string, batch long, n_a long").repartition(3)
    got, want = align(frame, A, B), brute(docs)
    assert key(got.collect()) == key(want)
    assert sum(w[1] == 0 for w in want) >= 5 and any("▁" in (t or "") and w[1] == 0 for (_, t), w in zip(docs, want, strict=True))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert align(frame, A, B).collect() == []


def test_only_nulls(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, align(frame, A, B).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_products_expand_groups():
    cut = Cut(np.arange(4), np.arange(3), np.array([2, 4, 6, 7]), np.array([3, 6, 7]))
    assert cut.products().tolist() == [[a, b] for a in range(3) for b in range(2)] + [[3, 2]]
    assert np.column_stack([cut.own_a, cut.own_b]).tolist() == [[0, 0], [1, 0], [1, 1], [2, 1], [3, 2]]


def test_every_byte_has_a_character():
    got = alignment.byte_of()
    assert sorted(got.values()) == list(range(256)) and got["Ġ"] == 32 and got["Ċ"] == 10
