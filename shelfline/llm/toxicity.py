"""Toxic documents: fuzzy lexicon matching with context windows.

The lexicon is learned from the labels: words, and stems with open endings, that occur in far more toxic than
clean training texts.  Its trie is intersected with the Levenshtein automaton of one edit: a state is the set of
(trie node, edits so far) that a prefix of a word can reach, and states are made deterministic as words need
them, so a word costs one dictionary step per character however long the lexicon is.  Each hit is judged in a
window of words around it: inside quotation marks or after a reporting word, and not aimed at "you", it counts
as quotation, otherwise as abuse.  A small logistic model weighs exact abuse, misspelled abuse and quotation.

Training uses at most ``per_class`` labelled rows of each class (those with the smallest hash of their id; a
documented bound), and only rows whose crc32(doc_id as text) modulo 5 is not 0.  Scores depend on the text alone.

Defined results: a null or empty text scores as one without hits.  Repeated rows score alike.  A null doc_id is
not held out.  Labels of one doc_id that disagree count as toxic.  Without toxic labels the lexicon is empty and
all texts get the same score.  Texts are read whole.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .pretokens import forget

PER_CLASS, LEXICON = 4000, 2000
MIN_EVIDENCE, MIN_RATIO = 30.0, math.log(8)
STEM_LENGTHS = (4, 5, 6, 7)
STEM_ENDINGS = 5
EXPLAINED = 4
FUZZY_FROM = 5
WINDOW = 8
CACHE, STATES = 300_000, 50_000  # words; states of the automaton, about 1 kB each, in every worker
WORD = re.compile(r"\w+")
QUOTES = re.compile("[\"“”„«»‹›]")
# Words that report speech, and words that address the reader.
REPORTING = frozenset("said says say called calls call quote quoted quotes wrote writes word words term slur insult dit disait "
                      "mot sagte sagt nannte wort dijo dice llamó palabra".split())
ADDRESS = frozenset("you your yours u ur du dich dir dein euch ihr tu te toi vous usted tú ti".split())


class Automaton:
    """The lexicon's trie under at most one edit, made deterministic state by state.

    ``find(word)`` gives 0 for an entry met exactly, 1 for one met with an edit, None for neither.  A stem is met
    by any word that begins with it; entries outside ``fuzzy`` are met exactly only.
    """

    def __init__(self, words: list[str], stems: list[str], fuzzy: set[str]) -> None:
        self.words, self.stems, self.fuzzy = words, stems, fuzzy
        self._open()

    def __reduce__(self):
        return Automaton, (self.words, self.stems, self.fuzzy)

    def _open(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        self.tolerant = [False]  # an entry below allows an edit
        for entries, is_stem in ((self.words, False), (self.stems, True)):
            for entry in entries:
                node, may = 0, entry in self.fuzzy
                self.tolerant[0] |= may
                for c in entry:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.ends.append(None)
                        self.tolerant.append(False)
                    node = self.children[node][c]
                    self.tolerant[node] |= may
                self.ends[node] = (entry, is_stem)
        self.states: dict[tuple, int] = {}
        self.contents: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self._state({(0, 0)}, None)
        self.cache: dict[str, tuple[int, str] | None] = {}

    def _state(self, nodes: set[tuple[int, int]], met: tuple[int, str] | None) -> int:
        reached = set(nodes)
        for node, edits in nodes:  # an entry's letter is missing from the word
            if not edits and self.tolerant[node]:
                reached.update((x, 1) for x in self.children[node].values() if self.tolerant[x])
        for node, edits in reached:
            if (end := self.ends[node]) and end[1] and (not edits or end[0] in self.fuzzy):
                met = min(met or (2, ""), (edits, end[0]))
        key = (frozenset(reached), met)
        if key not in self.states:
            self.states[key] = len(self.contents)
            self.contents.append(key)
            self.steps.append({})
            whole = [(e, self.ends[n][0]) for n, e in reached if self.ends[n] and (not e or self.ends[n][0] in self.fuzzy)]
            self.accepts.append(min([*whole, *([met] if met else [])], default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        nodes, met = self.contents[state]
        after = set()
        for node, edits in nodes:
            if (x := self.children[node].get(c)) is not None and (not edits or self.tolerant[x]):
                after.add((x, edits))
            if not edits and self.tolerant[node]:
                after.add((node, 1))  # the word has a letter more
                after.update((x, 1) for x in self.children[node].values() if self.tolerant[x])  # another letter
        self.steps[state][c] = out = self._state(after, met)
        return out

    def find(self, word: str) -> tuple[int, str] | None:
        if word in self.cache:
            return self.cache[word]
        state, steps, contents = self.start, self.steps, self.contents
        for c in word:
            state = steps[state].get(c)
            if state is None:
                break
        if state is None:
            if len(self.states) > STATES:  # between words only: a word keeps the states it goes through
                self._open()
                contents = self.contents
            state = self.start
            for c in word:
                known = self.steps[state].get(c)
                state = self._step(state, c) if known is None else known
                if not contents[state][0]:
                    break
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = out = self.accepts[state]
        return out


def quoted(text: str, start: int, end: int, before: list[str], after: list[str]) -> bool:
    """Whether the hit at [start, end) is quotation: within marks or reported, and not aimed at the reader."""
    if not ADDRESS.isdisjoint(before[-4:]) or not ADDRESS.isdisjoint(after[:2]):
        return False
    left, right = text[max(0, start - 60):start], text[end:end + 60]
    opened = len(QUOTES.findall(left)) % 2 == 1 and QUOTES.search(right) is not None
    return opened or not REPORTING.isdisjoint(before[-4:])


def features(model: Automaton, text: str | None) -> tuple[int, int, int]:
    """Numbers of exact abusive, misspelled abusive and quoted hits."""
    low = (text or "").lower()
    words = WORD.findall(low)
    found = {w: m for w in set(words) if (m := model.find(w))}
    if not found:
        return 0, 0, 0
    counts = [0, 0, 0]
    spots = None
    for i, w in enumerate(words):
        if m := found.get(w):
            spots = spots or [x.span() for x in WORD.finditer(low)]
            is_quote = quoted(low, *spots[i], words[max(0, i - WINDOW):i], words[i + 1:i + 1 + WINDOW])
            counts[2 if is_quote else m[0]] += 1
    return tuple(counts)


class Scorer:
    """The lexicon and the weights of [1, exact, misspelled, quoted]; counts enter by log(1 + n)."""

    def __init__(self, automaton: Automaton, weights: np.ndarray) -> None:
        self.automaton, self.weights = automaton, weights

    def __call__(self, texts: pa.Array) -> pa.Array:
        forget()
        x = np.array([features(self.automaton, t) for t in texts.to_pylist()], float).reshape(-1, 3)
        z = self.weights[0] + np.log1p(x) @ self.weights[1:]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def column(self, text: Column) -> Column:
        score = self

        def run(texts: pa.Array) -> pa.Array:
            return score(texts)

        return F.arrow_udf(run, "double")(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to texts per word and per stem: (item, is_stem, toxic, clean)."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        items = sorted(set(counts[0]) | set(counts[1]))
        out = pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in items], pa.string()), pa.array([x[1] for x in items], pa.bool_()),
             pa.array([counts[1][x] for x in items], pa.int64()), pa.array([counts[0][x] for x in items], pa.int64())],
            names=["item", "is_stem", "toxic", "clean"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            counts[label].update((w, False) for w in words)
            counts[label].update((s, True) for s in {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n})
            if len(counts[0]) + len(counts[1]) > CACHE:
                yield flush()
    yield flush()


def _same(x: tuple[str, bool], pick: tuple[str, bool]) -> bool:
    """Whether an entry says what the picked one says: it goes on from a picked stem, or is a stem of the picked entry."""
    return pick[1] and x[0].startswith(pick[0]) or x[1] and pick[0].startswith(x[0])


def _cover(rows: DataFrame, listed: list[tuple[str, bool]], n1: int, n0: int) -> tuple[list[str], list[str]]:
    """Of the listed entries, the few that explain the toxic training texts, strongest first.

    Texts that EXPLAINED accepted entries explain no longer speak for others, so words that only share near copies of a
    text with a toxic word fall away.  Of entries that are nearly as strong the longest is taken, a word before a
    stem.  Works on the (text, entry) incidence of the bounded training sample.
    """
    known = frozenset(listed)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(WORD.findall((text or "").lower()))
                items = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEM_LENGTHS if len(w) >= n}
                out += [(doc, label, *x) for x in items & known]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(
                (pa.int64(), pa.int32(), pa.string(), pa.bool_()))], names=["doc_id", "toxic", "item", "is_stem"])

    toxic: dict[tuple[str, bool], set[int]] = {x: set() for x in listed}
    clean = Counter()
    for doc, label, item, is_stem in rows.mapInArrow(met, "doc_id long, toxic int, item string, is_stem boolean").toLocalIterator():
        if label:
            toxic[item, is_stem].add(doc)
        else:
            clean[item, is_stem] += 1

    def evidence(x: tuple[str, bool]) -> float:
        t, c = len(toxic[x]), clean[x]
        share = (t + c) / (n1 + n0)
        if not t or math.log((t + .5) / (n1 + 1)) - math.log((c + .5) / (n0 + 1)) < MIN_RATIO:
            return 0.0
        return 2 * (t * math.log(t / (share * n1)) + (c * math.log(c / (share * n0)) if c else 0.0))

    words, stems, met_by = [], [], Counter()
    while toxic:
        by = {x: evidence(x) for x in toxic}
        best = max(by.values())
        if best < MIN_EVIDENCE:
            break
        pick = max((x for x in by if by[x] >= 0.95 * best), key=lambda x: (not x[1], len(x[0]), x[0]))
        (stems if pick[1] else words).append(pick[0])
        met_by.update(toxic.pop(pick))
        for x in [x for x in toxic if _same(x, pick) and (pick[1] or by[x] <= 1.2 * by[pick])]:
            del toxic[x]
        done = {d for d, k in met_by.items() if k >= EXPLAINED}
        for x in toxic.values():
            x -= done
    return sorted(words), sorted(stems)


def _fitted(x: np.ndarray, y: np.ndarray, kept: tuple[float, float]) -> np.ndarray:
    """Logistic regression with a Gaussian prior, by Newton steps; the intercept undoes the sampling of classes."""
    prior, strength = np.array([-4.0, 4.0, 1.0, 0.0]), np.array([0.01, 0.2, 0.5, 0.5])
    x, w = np.column_stack([np.ones(len(x)), np.log1p(x)]), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[0] -= math.log(kept[1] / kept[0])
    return w


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Scorer:
    """Learns the lexicon and the weights from the labelled rows that are not held out."""
    scratch = Scratch(spark, "toxicity")
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows of 12 bytes at most
    rows = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
                        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
                        .groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
                        .select("toxic", "text", "doc_id"))
    found = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = found.get(1, 0), found.get(0, 0)
    words, stems = [], []
    if n1 and n0:
        stats = scratch.keep(rows.mapInArrow(_counted, "item string, is_stem boolean, toxic long, clean long")
                             .groupBy("item", "is_stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
        ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
        # the likelihood-ratio statistic of the two rates
        share = (F.col("toxic") + F.col("clean")) / float(n1 + n0)
        evidence = 2 * (F.col("toxic") * F.log(F.greatest(F.col("toxic"), F.lit(0.5)) / (share * n1))
                        + F.col("clean") * F.log(F.greatest(F.col("clean"), F.lit(0.5)) / (share * n0)))
        strong = (stats.withColumn("ratio", ratio).withColumn("evidence", evidence)
                  .where((F.col("ratio") >= MIN_RATIO) & (F.col("evidence") >= MIN_EVIDENCE))
                  .orderBy(F.desc("evidence"), "item", "is_stem").limit(LEXICON))
        listed = [(r["item"], r["is_stem"]) for r in strong.collect()]
        if listed:
            heads = F.broadcast(spark.createDataFrame(listed, "item string, is_stem boolean"))  # LEXICON rows at most
            longer = (stats.where("not is_stem and toxic > 0 and toxic > clean")
                      .select(F.explode(F.array(*(F.substring("item", 1, n) for n in STEM_LENGTHS))).alias("stem"), "item")
                      .distinct().join(heads.where("is_stem").select(F.col("item").alias("stem")), "stem"))
            endings = {r["stem"]: r["count"] for r in longer.groupBy("stem").count().collect()}
            listed = [x for x in listed if len(x[0]) > 2 and (not x[1] or endings.get(x[0], 0) >= STEM_ENDINGS)]
            words, stems = _cover(rows, listed, n1, n0)
    fuzzy = {x for x in words + stems if len(x) >= FUZZY_FROM}
    # an entry whose misspellings are ordinary words of clean texts is met exactly only
    if fuzzy:
        probe = Automaton(words, stems, fuzzy)

        def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    met = map(probe.find, set(WORD.findall((text or "").lower())))
                    out += [(entry, label) for entry in {m[1] for m in met if m and m[0]}]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())],
                                                 names=["entry", "toxic"])

        near = rows.mapInArrow(misses, "entry string, toxic int").groupBy("entry").agg(
            F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).collect()
        fuzzy -= {r["entry"] for r in near
                  if r["clean"] > 0.0005 * n0 and math.log((r["toxic"] + .5) / (n1 + 1)) - math.log((r["clean"] + .5) / (n0 + 1)) < MIN_RATIO}
    automaton = Automaton(words, stems, fuzzy)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(automaton, t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(3))], names=["toxic", "a", "b", "c"])

    # distinct outcomes with their counts: small numbers, not texts
    seen = rows.mapInArrow(measured, "toxic int, a long, b long, c long").collect()
    x, y = np.array([r[1:] for r in seen], float).reshape(-1, 3), np.array([r[0] for r in seen], float)
    if n1 and n0:
        weights = _fitted(x, y, (n0 / totals[0], n1 / totals[1]))
    else:
        weights = np.array([4.0 if n1 else -4.0, 0, 0, 0])
    scratch.close()
    return Scorer(automaton, weights)


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    return (docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that score under 0.5, with their columns as they are."""
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    [mark] = fresh(docs, "toxicity")
    return docs.withColumn(mark, model.column(F.col("text"))).where(F.col(mark) < 0.5).select(docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(spark, docs, table(spark, sf_dir, "labels")))
