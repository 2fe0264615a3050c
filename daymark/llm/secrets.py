"""Secret scans: candidates by pattern, false positives taken out by a random forest.

A candidate is a run of key-like letters with a digit in it or a known prefix before it, what is
assigned to a name, and the whole value, whatever it is, behind a name that speaks of a secret.
The forest sees its length, its character transitions, how much of it dictionary words cover,
whether it lies in a path or address, and the words beside it.  It is trained from labelled
findings: secrets of common formats, and look-alikes, each set into text of the corpus.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, first_texts, texts_of, trimmed
from .forest import Forest

SAMPLE = 2_000  # texts that lend words to the labelled findings, at most
WORDS = 50_000  # words they lend, at most
FINDINGS = 6_000  # labelled findings
SHARE = 10_000  # a dictionary word is in one document of so many, and in two at least
HELD = 200_000  # words that a task counts at once
BESIDE = 32  # letters read on each side
LIMIT = 0.5

CANDIDATE = re.compile(
    r"""(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{8,}={0,2}"""
    r"""|(?<![A-Za-z0-9])(?:A[KS]IA|gh[opusr]_|github_pat_|xox[abeprs]-|sk-|[sr]k_(?:live|test)_|AIza)[A-Za-z0-9+/_\-]{8,}={0,2}"""
    r"""|(?:(?<=[A-Za-z_]=)|(?<=[A-Za-z_]=["'])|(?<=[A-Za-z_]:["'])|(?<=[A-Za-z_] = ["'])|(?<=[A-Za-z_]: ["']))[^\s"'<>]{6,}"""
)
# A name and what may stand between it and its value, and the value: quoted, or as far as white space.
NAMED = re.compile(
    r"""(?<![\w.\-])[\w.\-]++\\*+["'`]?+\]?+[ \t]*+(?:=>|:=|={1,3}|:)[ \t]*+(?:(?i:bearer|basic)[ \t]++)?+"""
)
VALUE = re.compile(
    r"""(["'`])(?P<quoted>(?:\\.|(?!\1)[^\\\n])+)\1|\\(["'`])(?P<escaped>[^\n]+?)\\\3|\\*["'`]?(?P<bare>[^\s"'<>]+)"""
)
WORD = re.compile(r"[^\W\d_]{3,}")
MADE_OF = re.compile(r"[A-Za-z]{4,12}")  # words that labelled findings are made of
SECRET_WORDS = ("passw", "passphrase", "pwd", "token", "secret", "key", "auth", "credential", "bearer", "private", "aws")
PLAIN_WORDS = (
    "commit", "md5", "sha", "checksum", "hash", "uuid", "guid", "phone", "tel", "version", "date", "color",
    "colour", "order", "invoice", "isbn", "example", "build", "rev", "digest", "etag", "card", "call", "id",
)
SECRET_NAMES = (
    "password", "passwd", "pwd", "passphrase", "token", "secret", "api key", "auth token", "access key",
    "client secret", "private key", "credential",
)
FEATURES = 18


def least_documents(documents: int) -> int:
    """In how many a word has to be for the dictionary."""
    return max(2, math.ceil(documents / SHARE))


def word_counts(texts: Iterable[str], held: int = HELD) -> Iterator[tuple[dict[str, int], dict[int, int]]]:
    """Partial counts: in how many texts the words are, and of pairs of letters in all words."""
    own, times = Counter(), Counter()
    for text in texts:
        found = WORD.findall(text.lower())
        times.update(found)
        own.update(set(found))
        if len(times) >= held:
            yield own, _steps(times)
            own, times = Counter(), Counter()
    yield own, _steps(times)


def _steps(times: dict[str, int]) -> dict[int, int]:
    letters = np.minimum(np.frombuffer("".join(times).encode("utf-32-le"), np.uint32), 127).astype(np.int64)
    lengths = np.fromiter(map(len, times), np.int64, len(times))
    weights = np.repeat(np.fromiter(times.values(), np.int64, len(times)), lengths)
    weights[np.cumsum(lengths) - 1] = 0  # the last letter of a word has none behind it
    counts = np.zeros(128 * 128, np.int64)
    np.add.at(counts, letters[:-1] * 128 + letters[1:], weights[:-1])
    return {i: int(counts[i]) for i in np.flatnonzero(counts).tolist()}


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = (t for batch in batches for part in chunks([batch], "text") for t in texts_of(part.column("text")))
    for words, steps in word_counts(texts):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*words, *[None] * len(steps)], pa.string()),
                pa.array([*[None] * len(words), *steps], pa.int32()),
                pa.array([*words.values(), *steps.values()], pa.int64()),
            ],
            ["word", "step", "n"],
        )


@dataclass
class Context:
    """What is ordinary in the corpus: its words, and the chances of one letter after another."""

    words: frozenset[str]
    steps: np.ndarray

    def __post_init__(self) -> None:
        self.lengths = sorted({len(w) for w in self.words}, reverse=True)

    @classmethod
    def counted(cls, words: dict[str, int], steps: dict[int, int], documents: int) -> Context:
        """From the documents that have each word, and how often each pair of letters comes."""
        least = least_documents(documents)
        table = np.ones(128 * 128)
        table[list(steps)] += list(steps.values())
        table = table.reshape(128, 128)
        common = frozenset(w for w, n in words.items() if n >= least)
        return cls(common, np.log(table / table.sum(1, keepdims=True)))

    @classmethod
    def of(cls, texts: list[str]) -> Context:
        words, steps = Counter(), Counter()
        for own, pairs in word_counts(texts):
            words.update(own)
            steps.update(pairs)
        return cls.counted(words, steps, len(texts))

    @classmethod
    def of_all(cls, docs: DataFrame) -> Context:
        """From every text; the driver gets the dictionary's words and at most 128 * 128 pairs."""
        documents = docs.count()
        counts = docs.select("text").mapInArrow(_context_counts, "word string, step int, n long")
        counts = counts.groupBy("word", "step").agg(F.sum("n").alias("n"))
        words, steps = {}, {}
        for r in counts.filter(F.col("word").isNull() | (F.col("n") >= least_documents(documents))).toLocalIterator():
            if r.word is None:
                steps[r.step] = r.n
            else:
                words[r.word] = r.n
        return cls.counted(words, steps, documents)

    def covered(self, value: str) -> float:
        """The share of letters that dictionary words cover, the longest first from the left."""
        value, at, done = value.lower(), 0, 0
        while at < len(value):
            rest = len(value) - at
            size = next((s for s in self.lengths if s <= rest and value[at : at + s] in self.words), 0)
            done += size
            at += size or 1
        return done / len(value)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def described(text: str, low: int, high: int, context: Context) -> list[float]:
    """The features of the candidate ``text[low:high]``."""
    value = text[low:high]
    left, right = text[max(0, low - BESIDE) : low].lower(), text[high : high + BESIDE].lower()
    kinds = [_kind(c) for c in value]
    n = len(value)
    counts = Counter(value)
    steps = [context.steps[min(ord(a), 127), min(ord(b), 127)] for a, b in zip(value.lower(), value.lower()[1:])]
    near = left.rsplit("\n", 1)[-1][-20:]
    return [
        float(n),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        float(np.mean(steps)) if steps else 0.0,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        float(all(c in "0123456789abcdef" for c in value.lower())),
        float(value[:4].isupper()) + float(value[3:4] == "_" or value[4:5] in ("_", "-")),
        context.covered(value),
        float(value.count("/") + value.count("-") + value.count(".")),
        float(left[-1:] in ("/", "\\", ".", "@", "#", "+") or "://" in left),
        float(right[:1] in ("/", "\\", "@", ".") and right[1:2].isalnum()),
        float(left.rstrip(" \"'")[-1:] in ("=", ":")),
        float(sum(w in near for w in SECRET_WORDS)),
        float(sum(w in near for w in PLAIN_WORDS)),
        float(bool(re.search(r"(.)\1{5}|01234|12345|abcdef|xxxx|change|your|here|sample|test|dummy", value.lower()))),
    ]


# ---- labelled findings


def _some(rng: Random, letters: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choices(letters, k=rng.randrange(low, (high or low) + 1)))


def _named(rng: Random, core: str, words: list[str]) -> tuple[str, str]:
    """What stands before a value and what behind: a name in any style, and quotes or none."""
    parts = [*rng.choices(words, k=rng.randrange(2)), *core.split(), *rng.choices(words, k=rng.random() < 0.2)]
    parts = [p.lower() for p in parts]
    name = rng.choice(
        ["_".join(parts), "-".join(parts), ".".join(parts), "".join(parts), "_".join(parts).upper()]
        + [parts[0] + "".join(p.capitalize() for p in parts[1:])]
    )
    quote, around = rng.choice(["", "", '"', "'"]), rng.choice(["", "", "", '"', "'"])
    sign = rng.choice(["=", " = ", ": ", ":", " : ", " => ", ":="])
    return f"{around}{name}{around}{sign}{quote}", quote


def _secret(rng: Random, words: list[str]) -> tuple[str, str, str]:
    """What stands before, the value, and what stands behind."""
    alnum = string.ascii_letters + string.digits
    before, behind = _named(rng, rng.choice(SECRET_NAMES), words)
    kind = rng.randrange(4)
    if kind == 0:  # formats that their prefix gives away, with a name or without
        value = rng.choice(
            [
                rng.choice(["AKIA", "ASIA"]) + _some(rng, string.ascii_uppercase + "234567", 16),
                f"gh{rng.choice('opusr')}_{_some(rng, alnum, 30, 60)}",
                f"github_pat_{_some(rng, alnum + '_', 40, 90)}",
                f"xox{rng.choice('abeprs')}-{_some(rng, string.digits, 8, 14)}-{_some(rng, alnum, 16, 36)}",
                f"{rng.choice('sr')}k_{rng.choice(['live', 'test'])}_{_some(rng, alnum, 16, 60)}",
                f"sk-{_some(rng, alnum, 20, 60)}",
                f"AIza{_some(rng, alnum + '_-', 30, 40)}",
            ]
        )
        return rng.choice([(before, value, behind), ("", value, "")])
    if kind == 1:  # keys
        letters = rng.choice(["0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567"])
        return before, _some(rng, letters, 12, 80), behind
    if kind == 2:
        letters = rng.choice([alnum, alnum + "+/", alnum + "_-", string.ascii_lowercase + string.digits])
        return before, _some(rng, letters, 12, 80), behind
    if rng.random() < 0.7:  # passwords
        return before, _some(rng, alnum + "!#%&*", 8, 30), behind
    return before, rng.choice(words) + _some(rng, "!#%&*_", 1) + rng.choice(words) + _some(rng, string.digits, 2, 4), behind


def _look_alike(rng: Random, words: list[str]) -> tuple[str, str, str]:
    def hexa(n: int) -> str:
        return "".join(rng.choices("0123456789abcdef", k=n))

    def digits(n: int) -> str:
        return "".join(rng.choices(string.digits, k=n))

    word, other = rng.choice(words), rng.choice(words)
    kind = rng.randrange(16)
    if kind == 0:
        return rng.choice(["", "", "card ", "order "]), digits(rng.choice([8, 10, 13, 16, 16])), ""
    if kind == 1:
        return rng.choice(["+1 (555) ", "tel: ", ""]), f"{digits(3)}-{digits(4)}", ""
    if kind == 2:
        before, behind = _named(rng, rng.choice(PLAIN_WORDS), words) if rng.random() < 0.5 else (rng.choice(PLAIN_WORDS) + " ", "")
        return before, hexa(rng.randrange(8, 81)), behind
    if kind == 3:
        return rng.choice(["id=", "uuid: ", "guid ", ""]), str(uuid.UUID(int=rng.getrandbits(128))), ""
    if kind == 4:
        return "", f"{rng.randrange(1990, 2030)}-{digits(2)}-{digits(2)}", rng.choice(["", "T10"])
    if kind == 5:
        return rng.choice(["", "see "]), f"{word}{other}{digits(rng.randrange(1, 4))}", ""
    if kind == 6:
        return "https://www.example.com/", f"{word}/{other}-{digits(4)}", ""
    if kind == 7:
        before, behind = _named(rng, rng.choice(SECRET_NAMES), words)
        return before, rng.choice(
            ["changeme123", "your_token_here1", "xxxxxxxxxxxx1", "test1234test", "0000000000000000", "example-key-1"]
        ), behind
    if kind == 8:
        return rng.choice(["class=\"", "name=", "title='", "href='"]), f"{word}_{other}{rng.choice(['', digits(2)])}", ""
    if kind == 9:
        return "version ", f"{word}-{digits(1)}_{digits(2)}-{word}", ""
    if kind == 10:
        return "/", f"usr/share/{word}/{other}{digits(2)}", ".txt"
    if kind == 11:
        return "", f"{word}-{other}-{word}{digits(1)}", ""
    if kind == 12:
        return rng.choice(["mail ", ""]), f"{word}{digits(3)}{other}", "@mail.example.com"
    if kind == 14:  # prose behind a name that speaks of secrets
        return rng.choice(["token: ", "the key: ", "secret: ", "authors: ", "password: ", "keyword = ", "monkey: "]), rng.choice(
            [word, word, word[: rng.randrange(1, 5)], digits(rng.randrange(1, 4))]
        ), ""
    if kind == 15:
        return rng.choice(['key: "', "secret = '", 'token="']), " ".join([word, other, *rng.choices(words, k=rng.randrange(6))]), ""
    return rng.choice([f"{word}=", f"{word}: '"]), rng.choice([f"{other}{word}", f"{other}{digits(2)}"]), ""


def labelled_findings(texts: list[str], count: int = FINDINGS, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """``text, start, end, label`` of secrets (1) and look-alikes (0) set into pieces of the texts."""
    rng = Random(seed)
    words = sorted({w for t in texts for w in MADE_OF.findall(t)}) or ["alpha", "beta", "gamma"]
    result = []
    for k in range(count):
        before, value, behind = _secret(rng, words) if k % 2 else _look_alike(rng, words)
        left, right = (" ".join(rng.choices(words, k=4)) for _ in range(2))
        head = f"{left} {before}"
        result.append((f"{head}{value}{behind} {right}", len(head), len(head) + len(value), k % 2))
    return result


# ---- the scan


def assigned(text: str) -> list[tuple[int, int]]:
    """The whole values behind names that speak of secrets, in order and apart from each other.

    Sentence signs and brackets opened elsewhere, at the end of a value without quotes, are none
    of it.  A value that is such a name with its own value counts as the latter.
    """
    found: list[tuple[int, int]] = []
    whole = -1  # where the last value ends with the signs behind it; if within quotes, -1
    for m in NAMED.finditer(text):
        inner = bool(found) and m.start() == found[-1][0]
        if found and m.start() < found[-1][1] and not inner:
            continue
        name = m.group().lower()
        if not any(w in name for w in SECRET_WORDS):
            continue
        if inner and whole < 0 and m.end() >= found[-1][1]:
            continue  # within quotes, the sign ends the value
        if inner and m.end() < whole:
            low, high = m.end(), found[-1][1]  # without quotes, it ends where the outer one does
        elif value := VALUE.match(text, m.end()):
            low, high = value.span(value.lastgroup)
            whole = high if value.lastgroup == "bare" else -1
            if whole >= 0:
                keep = {c for c, o in zip(")]}", "([{") if text.find(o, low, high) >= 0}
                while high > low and text[high - 1] in ".,;`)]}" and text[high - 1] not in keep:
                    high -= 1
        else:
            continue
        if high > low:
            if inner:
                found.pop()
            found.append((low, high))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """The places to be judged, in order and apart from each other."""
    named = assigned(text)
    result, k = list(named), 0
    for m in CANDIDATE.finditer(text):
        while k < len(named) and named[k][1] <= m.start():
            k += 1
        if k == len(named) or m.end() <= named[k][0]:
            result.append(m.span())
    return sorted(result)


@dataclass
class SecretModel:
    context: Context
    forest: Forest

    def findings(self, texts: list[str]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """Candidates as ``text, start, end``, and their scores."""
        spans = [(i, low, high) for i, t in enumerate(texts) for low, high in candidates(t)]
        rows = [described(texts[i], low, high, self.context) for i, low, high in spans]
        return spans, self.forest.chance(np.array(rows).reshape(-1, FEATURES))


def fit(findings: list[tuple[str, int, int, int]], texts: list[str]) -> SecretModel:
    return fit_in(findings, Context.of(texts))


def fit_in(findings: list[tuple[str, int, int, int]], context: Context) -> SecretModel:
    x = np.array([described(t, low, high, context) for t, low, high, _ in findings])
    return SecretModel(context, Forest.fit(x, np.array([f[3] for f in findings], float)))


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        found = {w for t in texts_of(batch.column("text")) for w in MADE_OF.findall(t)}
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])


def fit_on(docs: DataFrame, sample: int = SAMPLE, findings: int = FINDINGS) -> SecretModel:
    """A model that knows the words and pairs of letters of all texts.

    The findings it learns from are made of words from at most ``sample`` texts, the first by a
    hash; of those words come at most ``WORDS``, also by a hash, and no text, to the driver.
    """
    rows = first_texts(docs.select(F.coalesce("text", F.lit("")).alias("text")), sample)
    words = rows.select("text").mapInArrow(_own_words, "word string").distinct()
    words = [r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(WORDS).collect()]
    return fit_in(labelled_findings(words, findings), Context.of_all(docs))


RESULT = "doc_id long, start long, end long, value_sha256 string, score double, is_secret boolean"


def _scanned(model: SecretModel, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in chunks(batches, "text", 1 << 20):
            texts = texts_of(batch.column("text"))
            spans, scores = model.findings(texts)
            owner, start, end = np.array(spans, np.int64).reshape(-1, 3).T
            digests = [sha256(texts[i][low:high].encode()).hexdigest() for i, low, high in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(end)]
                + [pa.array(digests, pa.string()), pa.array(scores), pa.array(scores >= limit)],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return trimmed(run)


def scan(docs: DataFrame, model: SecretModel, limit: float = LIMIT) -> DataFrame:
    """Every candidate in every text: its place in code points, and whether it is kept as a secret.

    Null text has none.  Rows that repeat have their findings each.
    """
    return docs.select("doc_id", "text").mapInArrow(_scanned(model, limit), RESULT)


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    out, done = [], 0
    for low, high in spans:
        out += [text[done:low], "[secret]"]
        done = high
    return "".join([*out, text[done:]])


def _redacted(model: SecretModel, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            spans, scores = model.findings([t or "" for t in texts])
            kept: dict[int, list[tuple[int, int]]] = {}
            for (i, low, high), chance in zip(spans, scores.tolist()):
                if chance >= limit:
                    kept.setdefault(i, []).append((low, high))
            for i, found in kept.items():
                texts[i] = redacted(texts[i], found)
            names, columns = batch.schema.names, list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names and kept:
                lengths = batch.column("n_chars").to_pylist()
                for i in kept:
                    lengths[i] = None if lengths[i] is None else len(texts[i])
                columns[names.index("n_chars")] = pa.array(lengths, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return trimmed(run)


def without_secrets(docs: DataFrame, model: SecretModel, limit: float = LIMIT) -> DataFrame:
    """All rows and columns of ``docs``, each secret in a text replaced by ``[secret]``.

    A non-null ``n_chars`` of a text so changed becomes its new length.
    """
    return docs.mapInArrow(_redacted(model, limit), docs.schema)
