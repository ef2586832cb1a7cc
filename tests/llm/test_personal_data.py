import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from shelfline.llm import personal_data as pd

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
LOCAL, DOMAIN = r"[\p{L}\p{N}._%+!#$&*~-]", r"[\p{L}\p{N}-]"
LOOSE = [(0, rf"{LOCAL}+(?:@|\x20?[\[(](?:at|AT)[\])]\x20?){DOMAIN}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?){DOMAIN}+)*"),
         (1, r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"), (2, r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+"), (3, r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        doubled = [int(c) * 2 for c in digits[-2::-2]]
        return 12 <= len(digits) <= 19 and (sum(d - 9 if d > 9 else d for d in doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(m.start(), k, m.end()) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if valid(name, m[0])]


def mentions(text):
    """Base spans and looser mentions with their patterns, by plain searches."""
    out = []
    for known, kind, pattern in [*((True, k, p) for k, p in enumerate(PLAIN.values())), *((False, k, p) for k, p in LOOSE)]:
        last = 0
        for m in regex.finditer(pattern, text):
            before, start, last = text[last:m.start()], last, m.end()
            digits = len(re.sub("[^0-9]", "", m[0]))
            if known:
                keep = valid(list(PLAIN)[kind], m[0])
            else:
                free = not regex.search(r"[\p{L}\p{N}_@]$", before[-1:]) and not regex.match(r"[\p{L}\p{N}_@]", text[m.end():m.end() + 1])
                keep = kind == 0 or free and (kind == 1 and re.search("[0-9A-Fa-f]{2}", m[0]) and len(m[0]) >= 6 or kind == 2 and 12 <= digits <= 19 or kind == 3 and 7 <= digits <= 15)
            if not keep:
                continue
            tail, patterns = before[-200:], []
            if tail and WORD.sub("", tail[-1]):
                words = WORD.findall(tail.lower())
                if (start or len(before) > 200) and WORD.match(tail):
                    words = words[1:]
                patterns = [p for p in (words[-1:] and words[-1], len(words) > 1 and " ".join(words[-2:])) if p and len(p) <= 80]
            out.append((kind, m.start(), m.end(), known, m[0].lower(), patterns))
    sure = [(s, e) for _, s, e, known, _, _ in out if known]
    return [m for m in out if m[3] or not any(s < m[2] and m[1] < e for s, e in sure)]


def plainly(rows):
    found = [mentions(t or "") for _, t in rows]
    seeds = {(k, v) for ms in found for k, _, _, known, v, _ in ms if known}
    edges = Counter((k, p, v) for ms in found for k, _, _, _, v, ps in ms for p in ps)
    occ = Counter()
    for _, t in rows:
        words = WORD.findall((t or "").lower())
        occ.update(words)
        occ.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
    by_pattern = defaultdict(list)
    for (k, p, v), n in edges.items():
        by_pattern[k, p].append((v, n))
    by_pattern = {(k, p): e for (k, p), e in by_pattern.items() if len(e) >= 3 and any((k, v) in seeds for v, _ in e)}
    conf, high = {x: 1000 for x in seeds}, {}
    for _ in range(4):
        high = {}
        for (k, p), e in by_pattern.items():
            score = min(1000, 2 * sum(n * conf.get((k, v), 0) for v, n in e) // (2 * occ[p] + 1))
            if score >= 600 and sum(conf.get((k, v), 0) >= 600 for v, _ in e) >= 3:
                high[k, p] = score
        for (k, p), score in high.items():
            for v, _ in by_pattern[k, p]:
                conf[k, v] = max(conf.get((k, v), 0), score)
    out = []
    for (doc_id, _), ms in zip(rows, found, strict=True):
        added = {}
        for k, s, e, known, _, ps in ms:
            scores = [high[k, p] for p in ps if (k, p) in high]
            if not known and scores:
                added[s, e] = min(added.get((s, e), (1, 0)), (-max(scores), k))
        out.append((doc_id, tuple(sorted([(s, k, e, True) for k, s, e, known, _, _ in ms if known] + [(s, k, e, False) for (s, e), (_, k) in added.items()]))))
    return Counter(out)


@pytest.fixture(scope="module")
def rows(messy):
    rng = random.Random(11)
    card = [c for c in (f"4{rng.randrange(10**14):014}{d}" for _ in range(60) for d in range(10)) if valid("card", c)]
    rows = list(messy)
    for i in range(8):
        rows.append((4000 + i, f"Please call me at +1 (555) 010-{1000 + i} or mail user.{i}@mail{i}.example.com now, from host 10.0.{i}.{i * 30}; card number {card[i]}."))
        rows.append((4100 + i, "the 12 of the +1 222 333 44%02d and the %s" % (i, card[i + 8])))
    rows += [(4200, "You may call me at (555) 010-7777 tomorrow"), (4201, "please CALL me\tat 555.010.8888"), (4202, "or mail jürgen@exämple.de now"),
             (4203, "from host 2001:db8::1; or mail joe (at) site (dot) org"), (4204, "the 555 010 9999 of"), (4205, "card number 4111 1111 1111 1112 or"),
             (4206, "reach him on 555.010.8888 then"), (4207, "reach him on 555-010-4242 then"), (4208, "reach him on +44 20 7946 0000 then"),
             (4209, "reach him on +44 20 7946 0001 then"), (4210, "reach him on +44 20 7946 0002 then"), (4211, "reach him on 5550104243"),
             (4212, "x" * 300 + " at 555.010.8889"), (4213, "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 a@b a@b.c_d@e.f..g@h.i +1 +12 (3) 4444 5-5 @"), (4214, "12:30:45 host 10.0.0.1,host 10.0.0.2")]
    return rows


def got(df):
    return Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in df.collect())


def test_equals_plain_version_and_discovers(spark, frame, rows):
    expected = plainly(rows)
    found = got(pd.personal_data(spark, frame(rows).repartition(4)))
    assert found == expected
    added = {d: [(pd.KINDS[k], s, e) for s, k, e, base_ in spans if not base_] for d, spans in found if any(not x[3] for x in spans)}
    assert set(added) >= {4200, 4201, 4202, 4203, 4205, 4206, 4207, 4211} and not set(added) & {4204, 4213, 900, 901}
    assert added[4205] == [("card", 12, 31)] and added[4200][0][0] == "phone"
    # the copies of an entity are one instance
    copies = [(i, "see ref +1 555 010 1234 there") for i in range(50)] + [(99, "see ref 555 010 1234 there")]
    assert all(x[3] for _, spans in got(pd.personal_data(spark, frame(copies))) for x in spans)
    for few in ([], [(1, None)], [(1, "+1 555 010 1234")]):
        assert got(pd.personal_data(spark, frame(few))) == plainly(few)


def test_base_patterns_on_random_strings(spark, frame):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("012.@ab-+_ (é\n") for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(2000 + i, "".join(rng.choice(["1", "25", "300", "4111111111111111", ".", "-", " ", "+", "a@b.c", "@", ".x", "(", ")", "é😀"]) for _ in range(25))) for i in range(1500)]
    assert got(pd.personal_data(spark, frame(rows).repartition(8))) == plainly(rows)


def runs(n):
    return ["a" * n, "1" * n, "1 " * n, "1." * n, "+1" * n, "+1" + "(" * n, "a@" + "b." * n, "a@b" * n, ":" * n, "12-" * n, "a1 " * n, "((((1" * n, "@" * n,
            "a@" + "b." * n + "c", "x" * n + " 10.0.0.1 " * (n // 40), "é" * n + " a@b.co"]


def test_long_runs_take_one_pass(spark, frame):
    n = 2000
    found = dict(got(pd.personal_data(spark, frame(list(enumerate(runs(n)))).repartition(4))).keys())
    for i, text in enumerate(runs(n)):
        assert [x[:3] for x in found[i] if x[3]] == sorted(base(text)), text[:20]
    n = 100_000  # the plain patterns would take minutes each
    found = dict(got(pd.personal_data(spark, frame(list(enumerate(runs(n)))).repartition(4))).keys())
    assert [len([x for x in found[i] if x[3]]) for i in range(16)] == [0, 0, 0, n // 4, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, n // 40, 1]
    assert found[15][-1][:3] == (n + 1, 0, n + 7) and found[14][0][:3] == (n + 1, 1, n + 9)


def test_digest(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got_rows = pd.op12_personal_data(spark, str(tmp_path)).collect()
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add(t or "")
    assert len(got_rows) == len(rows)
    for r in got_rows:
        spans = [",".join(f"{pd.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base(t))) for t in texts[r.doc_id]]
        assert r.base_sha256 in [hashlib.sha256(s.encode()).hexdigest() for s in spans]
        assert r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == len(r.spans.split(",") if r.spans else [])
