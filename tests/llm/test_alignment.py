import hashlib
from collections import Counter

import pytest
import sentencepiece
from daymark.llm import alignment
from daymark.llm.alignment import MEASURES, align
from daymark.llm.bytelevel import ByteEncoder, byte_letters
from daymark.llm.tokens import default_path
from tokenizers import Tokenizer

ODD = [
    (None, "no id, some words"),
    (1, None),
    (2, ""),
    (3, " \t\n  two  spaces "),
    (4, "Don't <|endoftext|> stop <s>, é ´ ﬁ x\x00y"),
    (5, "same text"),
    (5, "same text"),
    (6, "same text"),
    (7, "日本語 テスト, “q” 🙂 a.b,c …"),
    (8, "a▁b gives no bytes back"),
    (9, "long " * 4000 + "x" * 3000),
    (10, "the the the"),
]


class Plain:
    """Alignment as the definition has it, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(default_path(alignment.A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=default_path(alignment.B_FILE))
        self.letters = byte_letters()

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        right = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return left, right

    def spans(self, tokens):
        at, found = 0, []
        for i, data in tokens:
            found.append((i, at, at + len(data)))
            at += len(data)
        return found

    def text(self, text):
        """Tokens of both, groups as text, and the pairs of all links."""
        if not text:
            return None
        both = self.tokens(text)
        if any(b"".join(d for _, d in side) != f" {text}".encode() for side in both):
            return None
        a, b = map(self.spans, both)
        ends = sorted({end for *_, end in a} & {end for *_, end in b})
        groups, links, low = [], [], 0
        at = [0, 0]
        for end in ends:
            here = []
            for k, side in enumerate((a, b)):
                first = at[k]
                while at[k] < len(side) and side[at[k]][2] <= end:
                    at[k] += 1
                here.append(side[first : at[k]])
            groups.append("|".join(",".join(str(i) for i, *_ in part) for part in here))
            links += [(i, j) for i, s, e in here[0] for j, u, v in here[1] if s < v and u < e]
            low = end
        return len(a), len(b), ";".join(groups), links

    def rows(self, rows):
        known = {t: self.text(t) for _, t in rows}
        counts = Counter()
        for _, t in rows:
            counts.update(known[t][3] if known[t] else ())
        top = Counter()
        for (_, j), n in counts.items():
            top[j] = max(top[j], n)
        result = []
        for i, t in rows:
            if known[t] is None:
                result.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            a, b, groups, links = known[t]
            best = sum(counts[x] == top[x[1]] for x in links)
            total = sum(counts[x] for x in links)
            digest = hashlib.sha256(groups.encode()).hexdigest()
            result.append((i, a, b, groups.count(";") + 1, len(links), best, total, digest))
        return result, counts, top


@pytest.fixture(scope="module")
def plain():
    return Plain()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_brute_force(spark, sf_dir, plain):
    import __spark_entry__ as contract

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = contract.queries()["op11_alignment"](spark, sf_dir)
    assert found.columns == ["doc_id", *MEASURES, "groups_sha256"]
    assert ordered(found.collect()) == ordered(plain.rows(rows)[0])


def test_odd_rows_and_small_blocks(frame, plain, monkeypatch):
    # Blocks of single texts, and a text that three rows have counts as hot.
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20)
    monkeypatch.setattr(alignment, "HOT_ROWS", 2)
    result = align(frame(ODD))
    expected, counts, top = plain.rows(ODD)
    assert ordered(result.documents.collect()) == ordered(expected)
    pairs = {(r.a_id, r.b_id): (r.links, r.best) for r in result.pairs.collect()}
    assert pairs == {p: (n, n == top[p[1]]) for p, n in counts.items()}
    zeros = {r[0] for r in expected if r[1] == 0}
    assert zeros >= {1, 2, 8} and not zeros & {3, 4, 7}


def test_no_rows(frame):
    result = align(frame([]).limit(0))
    assert result.documents.count() == 0 and result.pairs.count() == 0
    assert align(frame([(1, None)])).documents.collect()[0].n_a == 0


def test_wide_codes_hold_more_pairs():
    import numpy as np

    for many in (1 << 16, (1 << 16) + 1):
        codes = np.array([0, many - 1, 5])
        assert alignment._unpacked(alignment._packed(codes, many), many).tolist() == codes.tolist()


def test_quick_encoder_equals_the_library():
    """Every code point, beside letters, digits, signs, spaces and itself."""
    path = default_path(alignment.A_FILE)
    encoder, library = ByteEncoder(path, plain=True), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    assert encoder.quick is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    step = 16
    for low in range(0, len(points), 40_000):
        part = points[low : low + 40_000]
        texts = [
            "".join(f"a{x}b {x}{x} 1{x}2 .{x}. \n{x} {x}x  {x}" for x in map(chr, part[k : k + step]))
            for k in range(0, len(part), step)
        ]
        theirs = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [encoder.encode(t) for t in texts] == theirs


@pytest.mark.parametrize("text", [" " * 100_000, "\n" * 100_000, " \n\t" * 50_000 + "x", "a" * 50_000, "^" * 50_000])
def test_long_runs(text):
    path = default_path(alignment.A_FILE)
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert ByteEncoder(path).encode(text) == expected
    assert b"".join(map(ByteEncoder(path).bytes_of.get, expected)) == text.encode()


def test_special_tokens_as_the_library_takes_them():
    path = default_path(alignment.A_FILE)
    text = "a  <|endoftext|> b"
    library = Tokenizer.from_file(path)
    assert ByteEncoder(path).encode(text) == library.encode(text, add_special_tokens=False).ids
    assert 50256 in ByteEncoder(path).encode(text) and 50256 not in ByteEncoder(path, plain=True).encode(text)
