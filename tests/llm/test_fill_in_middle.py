import hashlib
import re
from collections import Counter

import pytest
import zstandard

from shelfline.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """The same rows by cutting the whole text."""
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, out, lengths = "plain", text, (None, None)
    elif h4 % 100 < 80:
        form, out, lengths = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", (len(prefix), len(middle))
    else:
        form, out, lengths = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", (len(prefix), len(middle))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (out, text)]
    return doc_id, len(tokens), form, *lengths, *sha, out


@pytest.fixture(scope="module")
def rows(messy):
    long = "wörd \t\n x" * 30_000
    return messy + [(2000 + k, long[k:]) for k in range(12)] + [(3000 + k, t) for k, t in enumerate(
        ["<P> a", "a<M>b c", "< P>", "a <", "a <P", "  ", "x  ", "  x", "   ", "<S", " <S> ", "9" * 200_000, " " * 200_000, "a" * 65_536 + " b",
         "a" * 65_535 + " b", " " * 65_536 + "b <M", "ü" * 40_000 + " ü"] * 4)]


def test_equals_whole_texts(spark, frame, rows):
    got = fim.fill_in_middle(spark, fim.store(spark, frame(rows)), with_output=True).collect()
    assert Counter(map(tuple, got)) == Counter(plainly(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(
        sorted(got, key=lambda r: (str(r.doc_id), r.restored_sha256)),
        sorted(rows, key=lambda r: (str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest())), strict=True))
    assert fim.fill_in_middle(spark, fim.store(spark, frame([]))).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_frames_of_any_size(monkeypatch, size):
    monkeypatch.setattr(fim, "FRAME", size)
    compress = zstandard.ZstdCompressor().compress
    for text in ["", " ", "a", " a", "a ", "a b", "äö  ü\n\nß x ", "<P <S <M", "one two  three\tfour"]:
        tokens = TOKEN.findall(text)
        found = fim.Frames.of(text.encode(), compress)
        assert (found.units[-1] if text else 0) == len(tokens)
        for u in range(len(tokens) + 1):
            place = found.cut(u)
            assert b"".join(found.stream((0, 0, 0), place)).decode() == "".join(tokens[:u]) and place[2] == len("".join(tokens[:u]))
            assert b"".join(found.stream(place, found.end)).decode() == "".join(tokens[u:])
            for form in ("psm", "spm"):
                assert b"".join(fim.restored(fim.output(found, form, found.cut(u // 2), place), form, compress)).decode() == text


def test_a_cut_opens_one_frame():
    text = " ".join(f"w{i}" for i in range(200_000)).encode()
    found = fim.Frames.of(text, zstandard.ZstdCompressor().compress)
    opened = []
    real = found.open
    found.open = lambda data: opened.append(1) or real(data)
    assert len(found.frames) > 10 and found.cut(150_000)[2] > 0 and len(opened) == 1
