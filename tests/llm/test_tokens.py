import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfline.llm import pretokens
from shelfline.llm.best_fit_packing import fullest, packed, plan
from shelfline.llm.pretokens import vocabulary as vocabulary_file
from shelfline.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_file())


def texts(messy):
    return messy + [(2000 + i, t) for i, t in enumerate([
        "  leading", "a  b   c\n\n d", "x" * 5000, "tab\tand\x1cseparator", "don't we'll I'm '", "²³½ ¼", "naïve Ünï ok", "a b c",
        "\U0001f600 emoji", "<|endoftext|>", "12 345 6789", "_under_score__", "trailing   "])]


def test_counts_equal_the_library(spark, frame, messy, tokenizer):
    rows = texts(messy)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(spark, frame(rows)).collect())
    want = []
    for d, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((d or -1, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts(spark, frame([])).collect() == []


def test_packing_round_trip(spark, frame, messy, tokenizer):
    rows = [(i, t) for i, (_, t) in enumerate(texts(messy))]
    got = packed(spark, frame(rows), capacity=64).collect()
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_bin) <= -(-sum(map(len, ids.values())) // 64) + 2
    assert packed(spark, frame([])).collect() == []
    twice = packed(spark, frame([(1, "same"), (1, "same"), (None, "x")])).collect()
    assert len(twice) == 3 and len({r.offset for r in twice}) == 3


def test_only_the_first_piece_is_shorter(spark, frame, tokenizer):
    rows = [(i, "word " * n + "end") for i, n in enumerate((0, 5, 6, 7, 12, 13, 14, 20, 61))] + [(100, None)]
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    assert {len(x) % 8 for x in ids.values()} >= {0, 1, 7}
    want = set()
    for d, x in ids.items():
        ends = list(range(len(x), 0, -8))[::-1]
        for k, (start, end) in enumerate(zip([0, *ends], ends)):
            want.add((d, k, start, end - start, zlib.crc32(np.array(x[start:end], "<u4").tobytes())))
    got = packed(spark, frame(rows), capacity=8).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_fullest_is_optimal():
    from itertools import product
    counts = {7: 2, 5: 1, 4: 3, 3: 1}
    for slack in range(0, 30):
        best = max(s for take in product(*(range(c + 1) for c in counts.values()))
                   if (s := sum(n * k for n, k in zip(counts, take))) <= slack)
        used = fullest(counts, slack)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    counts = {int(n): int(rng.integers(1, 500)) for n in rng.integers(1, 1025, 300)}
    seen = defaultdict(int)
    for length, first, bins, copies, _, _ in plan(counts, 1024):
        assert seen[length] == first
        seen[length] += bins * copies
    assert dict(seen) == counts


def test_new_pretokens_share_library_calls(messy, tokenizer, monkeypatch):
    """Thousands of unseen pre-tokens cost the library a few texts, not one each, and have its ids; also when the cache overflows."""
    sent = []
    ids = pretokens.Encoder.ids
    monkeypatch.setattr(pretokens.Encoder, "ids", lambda self, texts: sent.extend(texts) or ids(self, texts))
    many = [" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}x{w}" for w in ("word", "'s", "_", "12", "#,")) + "\n\n \tend'll" for i in range(600)]
    rows = [*many, *(t for _, t in texts(messy)), "\n", " ", "", None, "a\xa0 b\nc"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in rows]
    encoder = pretokens.Encoder(vocabulary_file(), list)
    sent.clear()
    assert [sum(map(list, x), []) for x in encoder.encode(many)] == want[:600]
    assert len(sent) < 100
    monkeypatch.setattr(pretokens, "CACHE", 40)
    small = pretokens.Encoder(vocabulary_file(), list, {" the": tokenizer.encode(" the", add_special_tokens=False).ids})
    for at in range(0, len(rows), 7):
        assert [sum(map(list, x), []) for x in small.encode(rows[at:at + 7])] == want[at:at + 7]
    assert " the" in small.cache
