import random
import zlib

from shelfline.llm.toxicity import Automaton, features, score, train, without_toxic


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    entries = ["idiot", "moronic", "trash", "losers"]
    automaton = Automaton(entries, [], set(entries))
    for _ in range(3000):
        w = list(rng.choice(entries))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            kind = rng.random()
            if kind < .4:
                w.insert(at, rng.choice("aiot"))
            elif w and kind < .7:
                w[at - 1] = rng.choice("aiot")
            elif w:
                del w[at - 1]
        word = "".join(w)
        best = min(distance(word, e) for e in entries)
        found = automaton.find(word)
        assert (found[0] if found else 2) == min(best, 2), word


def test_full_tables_start_anew_between_words(monkeypatch):
    from shelfline.llm import toxicity

    rng = random.Random(6)
    entries = ["".join(rng.choice("abcde") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 10))) for _ in range(800)] + entries
    words += [e[:k] + "x" + e[k:] for e in entries for k in (0, 3, len(e))]
    stems = [e[:4] for e in entries[:5]]
    whole = Automaton(entries, stems, set(entries))
    expected = [whole.find(w) for w in words]
    monkeypatch.setattr(toxicity, "STATES", 40)
    small = Automaton(entries, stems, set(entries))
    assert [small.find(w) for w in words] == expected and any(expected) and len(small.states) < len(whole.states)


def test_stems_and_quotation():
    automaton = Automaton(["idiot"], ["lowei"], {"idiot"})
    assert automaton.find("loweischaft") == (0, "lowei") and automaton.find("lowe") is None
    assert features(automaton, "you idiot") == (1, 0, 0)
    assert features(automaton, "an idoit, an idiott") == (0, 1, 0)  # a swap is two edits
    assert features(automaton, 'he wrote "what an idiot" to them') == (0, 0, 1)
    assert features(automaton, 'he wrote "you idiot" to them') == (1, 0, 0)
    assert features(automaton, None) == features(automaton, "") == (0, 0, 0)


def corpus(vocabulary, n=600):
    rng = random.Random(11)
    bad = ["grumbler", "snarfle", "blighted"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            w[5], w[40] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, frame, vocabulary):
    rows, labels = corpus(vocabulary)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(5000, None), (5001, ""), (None, "a snarfle"), (5002, "word " * 100_000), (5002, "word " * 100_000)]
    docs = frame(rows + extra)
    model = train(spark, docs, known)
    got = score(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= .5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == truth.get(r.doc_id, 0)
        else:
            assert not r.held_out and r.predicted == 1
    known.createOrReplaceTempView("labels_view")


def test_stage_and_no_labels(spark, frame, vocabulary, tmp_path):
    rows, labels = corpus(vocabulary, 400)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(rows)
    kept = without_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, t in labels if not t}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in score(docs, train(spark, docs, none)).collect()} == {0}
    assert score(frame([]), train(spark, frame([]), none)).collect() == []
