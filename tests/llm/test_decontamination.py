import random
import re
from collections import Counter, defaultdict

from shelfline.llm.decontamination import _least_run, leaks, without_leaks


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def brute(docs, items):
    """The best window over all that a shared shingle places."""
    shingles, places = {}, defaultdict(set)
    for i, t in items:
        w = words(t)
        if len(w) >= 5:
            shingles[i] = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
            for k in range(len(w) - 4):
                places[tuple(w[k:k + 5])].add((i, k, len(w)))
    best = {}
    for d, t in docs:
        w = words(t)
        spots = {(i, max(0, min(j - k, len(w) - n)), min(n, len(w))) for j in range(len(w) - 4) for i, k, n in places.get(tuple(w[j:j + 5]), ())}
        for i, a, n in spots:
            c = Counter(tuple(w[k:k + 5]) for k in range(a, a + n - 4))
            both = sum((c & shingles[i]).values())
            union = sum(c.values()) + sum(shingles[i].values()) - both
            if 100 * both >= 75 * union:
                best[d, i] = max(best.get((d, i), (0, 0)), (both / union, -a))
    return {k: (s, -a) for k, (s, a) in best.items()}


def fixture(vocabulary):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60)))) for i in range(30)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        if d % 3 == 0:
            leak = rng.choice(items)[1].split(" ")
            if d % 2:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else "\n".join(w)))
    docs += [(500, None), (501, ""), (502, "too short"), (503, items[0][1]), (503, items[0][1]), (None, items[1][1]),
             (504, (items[2][1] + " ") * 300)]
    return docs, items + [(None, items[3][1]), (77, None), (78, "a b c")]


def test_equals_brute_force(spark, frame, vocabulary, tmp_path):
    docs, items = fixture(vocabulary)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in leaks(spark, frame(docs), bench).collect()}
    assert got == brute(docs, items)
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = without_leaks(spark, frame(docs), str(tmp_path))
    hit = {d for d, _ in got}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in docs if d not in hit)
    assert kept.columns == frame([]).columns


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert leaks(spark, frame([]), bench).collect() == []
    assert leaks(spark, frame([(1, "a b c d e f g")]), bench.limit(0)).collect() == []


def test_run_bound():
    """Every way of losing a quarter of a passage's shingles by edits leaves a run of the bound's length."""
    rng = random.Random(9)
    for n in range(1, 60):
        bound = _least_run(n, 75)
        for _ in range(200):
            hit = [True] * n
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(n + 4) - 4
                hit[max(0, at):max(0, at + rng.choice((4, 5)))] = [False] * len(hit[max(0, at):max(0, at + 5)])
                hit = hit[:n]
            if sum(hit) * 100 >= 75 * n and len(hit) == n:
                longest = max(map(len, "".join("x" if h else " " for h in hit).split()), default=0)
                assert longest >= bound


def test_cut_and_edited_passages(spark, frame):
    """Passages near the threshold, cut at one edge or edited several times, are all found."""
    rng = random.Random(21)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 120)))) for i in range(40)]
    docs = []
    for d in range(400):
        w = rng.choice(items)[1].split(" ")
        lost = rng.randint(0, (len(w) - 4) // 7)
        w = w[lost:] if d % 4 == 0 else w[:len(w) - lost] if d % 4 == 1 else w
        if d % 4 == 2:  # a document that is three quarters of an item
            n = -(-(len(w) - 4) * 3 // 4) + 4
            at = rng.randint(0, len(w) - n)
            docs.append((d, " ".join(w[at:at + n])))
            continue
        if d % 4 == 3:
            for _ in range(rng.randint(2, 3)):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = [f"x{d}"]
        before, after = ([f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 150))] for _ in range(2))
        docs.append((d, " ".join(before + w + after)))
    want = brute(docs, items)
    assert len(want) > 250
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in leaks(spark, frame(docs), bench).collect()}
    assert set(got) == set(want)  # recall 1


def test_every_position_places_windows(spark, frame):
    """Insertions and deletions: the best start may come from any shared run, however short."""
    rng = random.Random(33)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 70)))) for i in range(30)]
    docs = []
    for d in range(400):
        w = rng.choice(items)[1].split(" ")
        for _ in range(2):
            at = rng.choice((rng.randrange(2, 9), len(w) - rng.randrange(2, 9)))
            w[at:at + rng.randint(0, 2)] = [f"x{d}"] * rng.randint(0, 2)
        docs.append((d, " ".join([f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))] + w + [f"z{k}" for k in range(d % 30)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in leaks(spark, frame(docs), bench).collect()}
    assert got == brute(docs, items)


def test_clean_rows_of_a_leaking_id_stay(spark, frame, tmp_path):
    item = " ".join(f"w{k}" for k in range(40))
    rows = [(None, item), (None, "clean text without any id here"), (None, None), (5, item), (5, "another clean text of id five"), (6, item + " end")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = Counter((r.doc_id, r.text) for r in without_leaks(spark, frame(rows), str(tmp_path)).collect())
    assert kept == Counter([rows[1], rows[2], rows[4]])
