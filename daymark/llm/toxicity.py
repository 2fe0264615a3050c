"""Toxicity scores from a lexicon learnt from labelled texts, matched with one letter wrong.

1. Terms come from labelled rows: words, and stems that several words share, far more frequent
   in toxic texts than in others.  How often a term has to come does not depend on the number of
   texts: it may not be chance.
2. The terms form a trie.  Its intersection with the Levenshtein automata of distance 0 and 1,
   a swap of neighbours being one error, is made deterministic, and every distinct word of a text runs through that table, all words of
   a chunk side by side.
3. Around each hit a window of the text is read: quotation marks on both sides, or a word of
   reporting, speak for a quotation, several hits near one another for abuse.
4. A logistic model on the hits, trained on labelled rows, gives the score.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import chunks, first_texts, texts_of, trimmed
from .logistic import Logistic

SAMPLE = 20_000  # labelled rows of either class that are learnt from, at most
LEAST = 3  # toxic texts that have a term
CHANCE = 0.001  # that a word as common in all texts comes so often in toxic ones, at most
SHORTEST, LONGEST = 4, 9  # letters of a stem; shorter words are terms as they are
FUZZY_WORD, FUZZY_STEM = 5, 5  # letters from which one may be wrong
WINDOW = 48  # letters on each side of a hit that are read
WORD = re.compile(r"\w+")
SLICE = 1 << 20  # bytes of text whose words a task holds at once
QUOTES = "\"'“”„«»‘’‹›`"
REPORTS = frozenset("said says called calls quote quoted wrote word term insult sagte nannte dit dijo".split())


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any letters may follow


class TermAutomaton:
    """A deterministic automaton that accepts the terms with at most one edit where they allow it.

    With ``swaps``, two neighbouring letters in each other's place are one edit, not two.
    """

    def __init__(self, terms: list[Term], swaps: bool = False):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, term in enumerate(terms):
            node = 0
            for letter in term.text:
                if letter not in children[node]:
                    children.append({})
                    ends.append([])
                    children[node][letter] = len(children) - 1
                node = children[node][letter]
            ends[node].append(k)
        fuzzy = [len(t.text) >= (FUZZY_STEM if t.stem else FUZZY_WORD) for t in terms]
        letters = sorted({c for t in terms for c in t.text})
        self.codes = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other letter
        # Below which nodes a term lies that may have an error.
        open_ = [False] * len(children)
        for node in range(len(children) - 1, -1, -1):
            open_[node] = any(fuzzy[k] for k in ends[node]) or any(open_[c] for c in children[node].values())

        # A state is a node and the errors so far, or a node and the letter that has to come to
        # reach it, after a swap, with one error.
        def closed(states: set[tuple[int, int | str]]) -> frozenset:
            for node, wrong in list(states):
                if wrong == 0:  # a letter left out
                    states.update((c, 1) for c in children[node].values() if open_[c])
            return frozenset((n, w) for n, w in states if w != 1 or (n, 0) not in states)

        def told_apart(states: frozenset) -> set[str]:
            """The letters that lead elsewhere than any other letter does."""
            found = set()
            for node, wrong in states:
                if isinstance(wrong, str):
                    found.add(wrong)
                    continue
                found.update(children[node])
                if swaps and wrong == 0:
                    found.update(*(children[c] for c in children[node].values() if open_[c]))
            return found

        def accepted(states: frozenset, stems: bool) -> int:
            """1 + twice the term + the errors; 0 for none."""
            found = [
                (wrong, k)
                for node, wrong in states
                if not isinstance(wrong, str)
                for k in ends[node]
                if (not wrong or fuzzy[k]) and (terms[k].stem or not stems)
            ]
            return 1 + 2 * min(found)[1] + min(found)[0] if found else 0

        start = closed({(0, 0)})
        number, queue = {frozenset(): 0, start: 1}, deque([start])
        rows, accepts, stems = [np.zeros(len(letters) + 1, np.int32)], [0], [0]

        def reached(states: frozenset, letter: str | None) -> int:
            after = set()
            for node, wrong in states:
                if isinstance(wrong, str):
                    if letter == wrong:
                        after.add((node, 1))
                    continue
                if letter in children[node]:
                    after.add((children[node][letter], wrong))
                if wrong == 0 and open_[node]:
                    after.add((node, 1))  # one letter too many
                    for first, c in children[node].items():
                        if open_[c]:
                            after.add((c, 1))
                            if swaps and letter != first and letter in children[c] and open_[children[c][letter]]:
                                after.add((children[c][letter], first))
            after = closed(after)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            return number[after]

        while queue:
            states = queue.popleft()
            accepts.append(accepted(states, False))
            stems.append(accepted(states, True))
            row = np.full(len(letters) + 1, reached(states, None), np.int32)
            for letter in sorted(told_apart(states)):
                row[self.codes[letter]] = reached(states, letter)
            rows.append(row)
        self.table, self.accepts, self.stems = np.array(rows), np.array(accepts), np.array(stems)

    def match(self, words: list[str]) -> np.ndarray:
        """For each word ``1 + 2 * term + errors`` of its best term, or 0."""
        result = np.zeros(len(words), np.int64)
        if not words or not self.terms:
            return result
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(lengths) - lengths
        lookup = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
        for letter, code in self.codes.items():
            if ord(letter) < len(lookup):
                lookup[ord(letter)] = code
        flat = lookup[flat]
        alive, state, at = np.arange(len(words)), np.ones(len(words), np.int32), 0
        while len(alive):
            # A stem is accepted as soon as it is read; the fewest errors win.
            hit = self.stems[state]
            better = (hit > 0) & ((result[alive] == 0) | ((hit - 1) % 2 < (result[alive] - 1) % 2))
            result[alive[better]] = hit[better]
            ended = lengths[alive] == at
            hit = self.accepts[state]
            better = ended & (hit > 0) & ((result[alive] == 0) | ((hit - 1) % 2 < (result[alive] - 1) % 2))
            result[alive[better]] = hit[better]
            on = ~ended
            alive, state = alive[on], self.table[state[on], flat[begin[alive[on]] + at]]
            alive, state, at = alive[state > 0], state[state > 0], at + 1
        return result


FEATURES = 7


def features(text: str, hits: dict[str, tuple[int, int]]) -> list[float]:
    """What is known of a text with words ``hits`` (to term and errors) among its own."""
    text = text.lower()
    found = [(m.start(), m.end(), *hits[m.group()]) for m in WORD.finditer(text) if m.group() in hits]
    counts = [[0, 0], [0, 0]]  # abuse, quotation; by errors
    near, before = 0, None
    for low, high, _, wrong in found:
        left, right = text[max(0, low - WINDOW) : low], text[high : high + WINDOW]
        marked = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
        reported = bool(REPORTS.intersection(WORD.findall(left)[-3:]))
        counts[marked or reported][wrong] += 1
        near += before is not None and low - before <= 4 * WINDOW
        before = high
    terms = len({k for _, _, k, _ in found})
    (plain, fuzzy), (quoted, fuzzy_quoted) = counts
    return [np.log1p(x) for x in (plain, fuzzy, quoted, fuzzy_quoted, terms, near)] + [float(plain > 0)]


@dataclass
class ToxicityModel:
    automaton: TermAutomaton
    logistic: Logistic

    def chunk_features(self, texts: list[str]) -> np.ndarray:
        # The distinct words of the slice; sets for each text would take many times its memory.
        words: set[str] = set()
        for text in texts:
            words.update(WORD.findall(text.lower()))
        listed = list(words)
        matched = self.automaton.match(listed)
        hits = {listed[i]: divmod(int(matched[i]) - 1, 2) for i in np.flatnonzero(matched).tolist()}
        rows = np.zeros((len(texts), FEATURES))
        if hits:
            for i, text in enumerate(texts):
                if not hits.keys().isdisjoint(WORD.findall(text.lower())):
                    rows[i] = features(text, hits)
        return rows

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.logistic.chance(self.chunk_features(texts))


@trimmed
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and in how many toxic and other texts of the task they are."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in chunks(batches, "text", SLICE):
        for text, label in zip(texts_of(batch.column("text")), batch.column("label").to_pylist()):
            for word in set(WORD.findall(text.lower())):
                counts[word][1 - label] += 1
    words = list(counts)
    columns = [pa.array([counts[w][k] for w in words], pa.int64()) for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], ["word", "toxic", "other"])


def unlikely(toxic: int, other: int):
    """Whether that a term is in ``toxic`` and ``other`` texts so unevenly is no chance.

    By Chernoff's bound for a term that comes in both classes alike.
    """
    share, here = toxic / (toxic + other), F.col("toxic") / (F.col("toxic") + F.col("other"))

    def part(count: str, rate, expected: float):
        return F.when(F.col(count) > 0, F.col(count) * F.log(rate / expected)).otherwise(0.0)

    evidence = part("toxic", here, share) + part("other", 1 - here, 1 - share)
    return (here > share) & (evidence >= float(-np.log(CHANCE)))


def lexicon(sample: DataFrame, toxic: int, other: int) -> list[Term]:
    """Words and stems that toxic texts have and others mostly lack, the most frequent first."""
    counts = sample.mapInArrow(_word_counts, "word string, toxic long, other long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    size = F.length("word")
    sizes = F.sequence(F.least(size, F.lit(SHORTEST)), F.least(size, F.lit(LONGEST)))
    prefixes = F.transform(sizes, lambda n: F.left("word", n))
    # With a space behind it, a word by itself.
    stems = counts.withColumn("stem", F.explode(F.array_append(prefixes, F.concat("word", F.lit(" ")))))
    stems = stems.groupBy("stem").agg(
        F.sum("toxic").alias("toxic"),
        F.sum("other").alias("other"),
        F.max(F.struct("toxic", "word")).alias("top"),
    )
    rate = max(1, other) / max(1, toxic)
    rare = (F.col("toxic") >= LEAST) & (F.col("other") <= F.col("toxic") * (0.03 * rate))
    pure = {r.stem: r for r in stems.filter(rare & unlikely(toxic, other)).toLocalIterator()}
    words = {r.top.word: r.toxic for s, r in pure.items() if s.endswith(" ")}
    pure = {s: r for s, r in pure.items() if not s.endswith(" ")}
    longer = defaultdict(list)
    for stem in sorted(pure):
        if len(stem) > SHORTEST:
            longer[stem[:-1]].append(stem)
    terms: dict[str, tuple[int, Term]] = {}
    # From the shortest stems on; a longer one says as much.
    open_ = [s for s in pure if len(s) <= SHORTEST or s[:-1] not in pure]
    while open_:
        stem = open_.pop()
        r = pure[stem]
        if r.top.toxic >= 0.9 * r.toxic:
            terms[r.top.word] = (r.toxic, Term(r.top.word, False))
            # Less frequent words of the stem stand for themselves.
            path = [stem]
            while path:
                for s in longer[path.pop()]:
                    (path if r.top.word.startswith(s) else open_).append(s)
            continue
        while same := [s for s in longer[stem] if pure[s].toxic >= 0.9 * r.toxic]:
            open_ += [s for s in longer[stem] if s != same[0]]
            stem = same[0]
        terms[stem] = (r.toxic, Term(stem, True))
    stems = {term.text for _, term in terms.values() if term.stem}
    for word, times in words.items():
        if word not in terms and not any(word[:n] in stems for n in range(1, len(word) + 1)):
            terms[word] = (times, Term(word, False))
    ordered = sorted(terms.values(), key=lambda x: (-x[0], x[1].text))
    return [term for _, term in ordered]


def _feature_rows(automaton: TermAutomaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(automaton, Logistic.blank(FEATURES))
        for batch in chunks(batches, "text", SLICE):
            rows = model.chunk_features(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.tolist(), pa.list_(pa.float64())), batch.column("label")], ["features", "label"]
            )

    return trimmed(run)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from rows ``text, label``; of each class at most ``sample`` distinct texts.

    The sample is what comes first by a hash of the text.  Null labels are left out, null text
    is empty.  Without rows of both classes every score is the share of toxic rows, or 0.
    """
    rows = labelled.filter("label IN (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = materialised(rows, "toxicity-labelled")
    parts = [first_texts(rows.filter(F.col("label") == k), sample) for k in (1, 0)]
    chosen = parts[0].unionByName(parts[1]).select("text", F.col("label").cast("int").alias("label"))
    width = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the counts, the lexicon and the features below all read it.
    chosen = materialised(chosen.repartition(min(width, 64)), "toxicity-rows")
    numbers = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    toxic, other = numbers.get(1, 0), numbers.get(0, 0)
    if not toxic or not other:
        return ToxicityModel(TermAutomaton([]), Logistic.constant(FEATURES, float(toxic > 0)))
    automaton = TermAutomaton(lexicon(chosen, toxic, other), swaps=True)
    table = chosen.mapInArrow(_feature_rows(automaton), "features array<double>, label int").toPandas()
    x = np.array(table["features"].tolist()).reshape(-1, FEATURES)
    return ToxicityModel(automaton, Logistic.fit(x, table["label"].to_numpy(float)))


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE):
            scores = model.scores(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return trimmed(run)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of each row; null text counts as empty, other columns are not looked at."""
    return docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")


def _clean(model: ToxicityModel, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE):
            yield batch.filter(pa.array(model.scores(texts_of(batch.column("text"))) < limit))

    return trimmed(run)


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the limit."""
    return docs.mapInArrow(_clean(model, limit), docs.schema)
