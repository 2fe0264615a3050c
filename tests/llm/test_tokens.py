import zlib

import numpy as np
import pytest
from daymark.llm import coder, packing, pieces
from daymark.llm.common import crc_of
from daymark.llm.packing import pack, plan, with_digest
from daymark.llm.tokenfiles import read_token_files, token_files, write_token_files
from daymark.llm.tokens import default_path
from tokenizers import Tokenizer

ODD = [
    (None, "no id"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Don't stop, it's <|endoftext|>fine!? ́x é ÀÉ ß İ 12'34"),
    (5, "same"),
    (5, "same"),
    (6, "word " * 5000),
    (7, "日本語 テスト, “q”, a.b,c …,"),
    (8, "x" * 9000),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(found, rows, tokenizer, window=2048):
    """Each id in exactly one piece, and windows without gaps or overlaps."""
    wanted = sorted((str(i), ids_of(tokenizer, t, 1)) for i, t in rows)
    pieces_, windows = {}, {}
    for r in found:
        pieces_.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for (doc, n), parts in pieces_.items():
        texts = [ids for i, ids in wanted if i == doc and len(ids) == n]
        expected = sorted(parts)
        starts = sorted({(s, k) for s, k, _ in parts})
        assert len(texts) * n == sum(k for _, k, _ in parts)
        for s, k in starts:
            assert sorted(c for a, b, c in expected if (a, b) == (s, k))[0] in {crc(t[s : s + k]) for t in texts}
        if len(texts) == 1:
            at = 0
            for s, k, c in expected:
                assert s == at and c == crc(texts[0][s : s + k])
                at += k
    assert {(d, n) for d, n in pieces_} == {(d, len(ids)) for d, ids in wanted}
    return sum(len(ids) for _, ids in wanted) / (len(windows) * window)


def test_packing_holds_every_id_once(spark, sf_dir, tokenizer):
    import __spark_entry__ as contract

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = contract.queries()["op1_pack_windows"](spark, sf_dir).collect()
    assert check_packing(found, rows, tokenizer) > 0.98


def test_packing_odd_rows(frame, tokenizer):
    check_packing(with_digest(pack(frame(ODD))).collect(), ODD, tokenizer)
    assert pack(frame([]).limit(0)).count() == 0


def test_packing_of_one_length_in_many_groups(frame, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rows = [(i, "one two three") for i in range(700)] + [(1000 + i, "word " * 1200) for i in range(9)]
    check_packing(with_digest(pack(frame(rows))).collect(), rows, tokenizer)


@pytest.mark.parametrize("kind", ["mixed", "long", "short", "one", "none"])
def test_plan_places_every_remainder(kind):
    rng = np.random.default_rng(4)
    histogram = {
        "mixed": np.bincount(rng.integers(1, 2048, 30_000), minlength=2048),
        "long": np.bincount(rng.integers(1100, 2048, 3000), minlength=2048),
        "short": np.bincount(rng.integers(1, 40, 30_000), minlength=2048),
        "one": np.eye(1, 2048, 5, dtype=int)[0],
        "none": np.zeros(2048, int),
    }[kind]
    made = plan(histogram)
    held = {n: np.zeros((histogram[n], n), int) for n in np.flatnonzero(histogram)}
    windows = np.zeros(made.windows, int)
    for origin, start, low, high, size, first, offset in made.rows:
        held[origin][low:high, start : start + size] += 1
        windows[first : first + high - low] += size
    assert all((x == 1).all() for x in held.values())
    total = int((histogram * np.arange(2048)).sum())
    assert windows.sum() == total and (windows <= 2048).all()
    assert made.windows <= -(-total // 2048) * 1.02 + 1


def test_least_squares_comes_near_the_histogram():
    histogram = np.zeros(2048, int)
    histogram[[1000, 1048, 504, 544]] = [80, 50, 30, 30]
    combos = packing.combinations(np.flatnonzero(histogram), 2048)
    x = packing.repeats(combos, histogram, 500)
    used = np.zeros(2048)
    for (a, times, b, c), n in zip(combos.tolist(), x):
        for length, k in ((a, times), (b, 1), (c, 1)):
            used[length] += n * k
    assert (x >= 0).all() and np.abs(used - histogram)[1:].max() < 1


def check_files(found, rows, tokenizer):
    expected, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(tokenizer, t, 2)
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_token_files_equal_the_library(spark, sf_dir, tokenizer):
    import __spark_entry__ as contract

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_files(contract.queries()["op7_token_files"](spark, sf_dir).collect(), rows, tokenizer)


def test_token_files_odd_rows_and_many_files(frame, tokenizer):
    check_files(token_files(frame(ODD)).collect(), ODD, tokenizer)
    rows = [(i, f"text {i} " * (i % 7)) for i in range(300)]
    folder, files = write_token_files(frame(rows), file_ids=50, chunk=100)
    assert files.count() > 20
    check_files(read_token_files(folder, files).collect(), rows, tokenizer)
    assert token_files(frame([]).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_coder_round_trip(block):
    rng = np.random.default_rng(block)
    phrase = rng.integers(0, 500, 60)
    for ids in (
        np.zeros(0, int),
        np.array([0]),
        np.zeros(300, int),
        rng.integers(0, 49_408, 500),
        rng.integers(0, 2**31 - 2, 300),
        np.concatenate([np.tile(phrase, 9), rng.integers(0, 9, 77)]),
    ):
        image = coder.write_file(np.arange(len(ids)) * 3 - 5, np.ones(len(ids), int), ids, block)
        docs, lengths, back = coder.read_file(image)
        assert (back == ids).all() and (docs == np.arange(len(ids)) * 3 - 5).all() and lengths.sum() == len(ids)


def test_coder_learns_and_notices_damage():
    phrase = np.random.default_rng(1).integers(0, 49_408, 100)
    ids = np.tile(phrase, 60)
    image = coder.write_file(np.array([1]), np.array([len(ids)]), ids)
    assert len(image) < 0.4 * len(ids)
    for at in (10, 40, len(image) // 2, len(image) - 9):
        broken = bytearray(image)
        broken[at] ^= 0x55
        with pytest.raises(Exception):
            coder.read_file(bytes(broken))


def test_coder_format_stays_and_counts_add_up():
    k = np.arange(60_000)
    ids = np.where(k % 5 < 3, k * k % 97, k * 7919 % 49_408)
    for block, crc_ in ((64, 1191900906), (2048, 3490568456)):
        assert zlib.crc32(b"".join(coder.encode_blocks(ids, block))) == crc_
    model = coder._Model(50, 34)
    model.count[:] = np.random.default_rng(2).integers(1, 500, model.count.shape)
    assert (model.ends(20) == np.cumsum(model.count[:, :20], 0)).all()


def test_coder_reaches_order_0_and_reads_the_first_form():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 1_000_000), 5000) * 3
    counts = np.unique(ids, return_counts=True)[1]
    entropy = -(counts * np.log2(counts / len(ids))).sum() / 8
    image = coder.write_file(np.array([1]), np.array([len(ids)]), ids)
    assert len(image) < 1.1 * entropy  # 1.38 in the first form
    few = ids[:5000]
    blocks = coder.encode_blocks(few, 512)
    table = [(len(b), zlib.crc32(few[k * 512 : k * 512 + 512].astype("<u4").tobytes())) for k, b in enumerate(blocks)]
    tables = zlib.compress(np.array([7, 5000], "<i8").tobytes() + np.array(table, "<u4").tobytes())
    head = coder._HEAD.pack(coder.FIRST_MAGIC, 512, 1, 5000, int(few.max()), len(tables))
    image = head + zlib.crc32(head + tables).to_bytes(4, "little") + tables + b"".join(blocks)
    docs, lengths, back = coder.read_file(image)
    assert (docs.tolist(), lengths.tolist()) == ([7], [5000]) and (back == few).all()


def test_coder_takes_less_time_than_the_first_form():
    import time

    ids = np.minimum(np.random.default_rng(6).zipf(1.3, 1_000_000), 40_000)
    times = []
    for run in (
        lambda: coder.read_file(coder.write_file(np.array([1]), np.array([len(ids)]), ids))[2],
        lambda: coder.decode_blocks(coder.encode_blocks(ids), np.minimum(2048, len(ids) - np.arange(489) * 2048), 40_000),
    ):
        begun = time.process_time()
        assert (run() == ids).all()
        times.append(time.process_time() - begun)
    assert times[0] < 0.6 * times[1]


@pytest.mark.parametrize("block", [1, 5, 300, None])
def test_coder_rare_ids_and_skewed_ones(block, monkeypatch):
    from daymark.llm import mixing

    rng = np.random.default_rng(8)
    skewed = np.where(rng.random(3000) < 0.999, 17, rng.integers(0, 60_000, 3000))
    runs = np.repeat(rng.integers(0, 9, 30), 100)
    cases = [skewed, runs, rng.integers(0, 5000, 3000), rng.integers(0, 2**31, 3000), np.array([2**31 - 1, 0] * 40)]
    for symbols, lookup in ((60_000, 1 << 22), (50, 1 << 22), (50, 10), (1, 10)):
        monkeypatch.setattr(mixing, "SYMBOLS", symbols)
        monkeypatch.setattr(mixing, "LOOKUP", lookup)
        for ids in cases:
            shares = mixing.symbols_of(ids)[1]
            assert shares.sum() == 1 << mixing.bits_of(len(shares) - 1) and shares.min() > 0
            image = coder.write_file(np.array([4]), np.array([len(ids)]), ids, block)
            assert (coder.read_file(image)[2] == ids).all()


def test_coder_notices_damage_anywhere():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 70_000, 90_000)
    image = coder.write_file(np.array([1]), np.array([len(ids)]), ids)
    for at in [*range(0, 40), *rng.integers(40, len(image), 6).tolist()]:
        broken = bytearray(image)
        broken[at] ^= 1 << int(rng.integers(8))
        try:
            back = coder.read_file(bytes(broken))[2]
        except Exception:
            continue
        assert at >= 40 and (back == ids).all()  # the last bits of a block may not matter
    for size in (3, 30, 100, len(image) // 2, len(image) - 1):
        with pytest.raises(Exception):
            coder.read_file(image[:size])


# ---- pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))


def best_by_hand(library, text):
    """The greatest sum of scores over a whole text, one prefix after the other."""
    word = "▁" + text.replace(" ", "▁")
    known = {library.id_to_piece(i): i for i in range(library.get_piece_size()) if not library.is_byte(i) and i > 2}
    floor = min(library.get_score(i) for i in known.values()) - 10
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for size in range(min(16, end), 0, -1):
            part = word[end - size : end]
            before = best[end - size]
            if part in known:
                options.append((before[0] + library.get_score(known[part]), before[1] + [known[part]]))
            elif size == 1:
                spelt = [library.piece_to_id(f"<0x{b:02X}>") for b in part.encode()]
                options.append((before[0] + floor, before[1] + spelt))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1] if text else []


TEXTS = ["The quick brown fox", "", " ", "  a  b\nc ", "héllo \U0001f600 x\t日本", "a" * 70, "Schönheitskönigin, stupid!", "1 + 1 = 2\r\n"]


def test_pieces_equal_brute_force(frame, library):
    rows = list(enumerate(TEXTS)) + [(100, None)]
    found = {r.doc_id: r.ids for r in pieces.encode(frame(rows)).collect()}
    assert found == {i: best_by_hand(library, t or "") for i, t in rows}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame(rows))).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert all(library.decode(ids) == t for ids, t in zip((found[i] for i in range(len(TEXTS))), TEXTS) if t.strip(" ") == t)


def test_pieces_round_trip_of_all_documents(spark, sf_dir, library):
    import __spark_entry__ as contract

    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = contract.queries()["op6_sentencepiece"](spark, sf_dir).collect()
    assert len(found) == len(texts) and all(r.round_trip for r in found)
    short = sorted((r for r in found if len(texts[r.doc_id] or "") < 400), key=lambda r: r.doc_id)[:40]
    for r in short:
        ids = best_by_hand(library, texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), crc_of(np.array(ids)))


def test_pieces_odd_rows(frame):
    found = sorted((r.n_tokens, r.round_trip) for r in pieces.coded(frame(ODD)).collect())
    assert len(found) == len(ODD) and all(ok for _, ok in found)
    sign = pieces.coded(frame([(1, "a▁b")])).first()
    assert not sign.round_trip
    assert pieces.coded(frame([]).limit(0)).count() == 0


def test_sparse_lengths_have_all_triples():
    rng = np.random.default_rng(6)
    for count in (3, 40, 300):
        lengths = np.unique(np.concatenate([[101, 303, 1644], rng.integers(1, 1024, count) * 2 - 1, rng.integers(1, 1024, count) * 2]))
        lengths = lengths[lengths % 8 != 0]
        here = set(lengths.tolist())
        wanted = {(a, b, 2048 - a - b) for a in here for b in here if a < b < 2048 - a - b and 2048 - a - b in here}
        found = packing.combinations(lengths, 2048)
        found = {(a, b, c) for a, times, b, c in found.tolist() if c}
        assert found == wanted and (101, 303, 1644) in found


def test_dense_lengths_have_triples_of_a_bounded_number():
    combos = packing.combinations(np.arange(1, 2048), 2048)
    triples = combos[combos[:, 3] > 0]
    assert (triples[:, [0, 2, 3]].sum(1) == 2048).all() and 30_000 < len(triples) <= packing.TRIPLES
    assert len(np.unique(triples[:, 0])) > 100


def texts_and_ids(tokenizer, texts):
    import pyarrow as pa

    column = pa.array(texts, pa.string())
    return column, [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(encoder, column):
    ids, at = encoder.encode(column)
    return [ids[low:high].tolist() for low, high in zip(at[:-1], at[1:])]


def test_word_encoder_over_generations(tokenizer, monkeypatch):
    """Words that come back after two changes of generation, and signs behind known stems."""
    from daymark.llm import tokens

    monkeypatch.setattr(tokens, "WORDS", 20)
    encoder = tokens.WordEncoder(default_path())
    for k in range(12):
        texts = [f"word{k} word{k}, Word{k - 1}!? it's é{k}. same", None, "same, SAME 12.5%", f"new{k * 7}\x0bx\ty"]
        column, expected = texts_and_ids(tokenizer, texts)
        assert encoded(encoder, column) == expected
        assert len(encoder.now.first) <= 10 + 4 * 20


def test_word_encoder_where_hashes_meet(tokenizer, monkeypatch):
    """With a first hash that words of one length share the texts are still encoded rightly."""
    from daymark.llm import tokens

    real = tokens.span_hashes

    def by_length(raw, starts, ends, *base):
        return real(raw, starts, ends, *base) if base else (ends - starts).astype(np.uint64)

    monkeypatch.setattr(tokens, "span_hashes", by_length)
    encoder = tokens.WordEncoder(default_path())
    for texts in (["one three", ""], ["two, two one", "ten, six."], ["six, ten", "three"]):
        column, expected = texts_and_ids(tokenizer, texts)
        assert encoded(encoder, column) == expected


AWKWARD = [
    "İstanbul İİ i̇ ǅ ß ẞ ΑΣ ΣΑΣ, क़ क़ا é é ﬁ ½ ² ⅷ a²,",
    "word., word.,;:!? word.,;:!?%$ word.,;:!?%$& word.,;:!?%$&*#|| ,;:. ...... ............",
    "x" * 63 + " " + "X" * 64 + " " + "x" * 65 + " " + "Yx" * 600 + ", " + "é" * 32 + " " + "É" * 33,
    "don't DON'T it's'll 've a's, s't <|endoftext|> <|startoftext|>, </w> a</w>, w>",
    "日本語 日本語。 한국어, ไทย हिन्दी العربية\u200d a\u00adb A\u0301b \U0001f600 \U00010400x \u2028y\xa0z\x85w",
]


def test_word_encoder_on_awkward_words(tokenizer, monkeypatch):
    from daymark.llm import tokens

    rng = np.random.default_rng(3)
    signs = list("abzAZ09.,;'#é É İ日ß\u0301\u0345 \t\n<|>Σς")
    texts = AWKWARD + ["".join(rng.choice(signs, 40)) for _ in range(400)]
    column, expected = texts_and_ids(tokenizer, texts)
    for slots in (20, 3):
        monkeypatch.setattr(tokens, "SLOTS", slots)
        encoder = tokens.WordEncoder(default_path())
        assert encoder.joins
        for _ in range(2):
            assert encoded(encoder, column) == expected
            assert encoded(encoder, column.slice(3, 50)) == expected[3:53]
    encoder = tokens.WordEncoder(default_path())
    encoder.joins = False
    assert encoded(encoder, column) == expected


def test_words_of_letters_are_encoded_in_rows():
    from daymark.llm import tokens

    encoder = tokens.WordEncoder(default_path())
    library, given = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(5000)]
    _, expected = texts_and_ids(library, [" ".join(words) + ". " + ", ".join(words)])
    import pyarrow as pa

    assert encoded(encoder, pa.array([" ".join(words) + ". " + ", ".join(words)])) == expected
    assert sum(given) < len(words) / 20
