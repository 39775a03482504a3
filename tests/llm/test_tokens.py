import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from permlens.llm import bpe, files, token_files as tf
from permlens.llm.queries import tokenizer_path
from tests.llm.conftest import key, rows_of

ODD = "a b the in ing an é É İ Σ ς ß ́ 's ' 'll ! ? 1 23 ٣ 中 文 日 😀 ‍ < <|endoftext|> <|startoftext| A Ⅷ ǅ ½ ² ª _ - \xad ſ ŉ".split(" ") + [" ", "\n", "\xa0", "\x85", "\x1c", "\0", " "]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def texts(n, length):
    rng = random.Random(n)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, length))) for _ in range(n)]


def test_ids_equal_the_library_for_odd_texts_and_unbounded_words(library):
    tokenizer, encoder = bpe.load(tokenizer_path()), tf.encoder(tokenizer_path())
    rng = random.Random(4)
    long = ["".join(rng.choice("abcdeinthrstaeiou") for _ in range(9_000)), "=" * 5000, "an" * 3000, "".join(rng.choice(["ab", "an", "in", "aaa", "ing", "nn"]) for _ in range(2000))]
    for text in texts(1500, 40) + long:
        want = library.encode(text, add_special_tokens=False).ids
        assert tokenizer.encode(text) == want, repr(text[:80])
        assert encoder.encode(text).tolist() == want, repr(text[:80])


def test_the_transducer_holds_a_bounded_window():
    """No window grows with the word, and every cut of the input gives the same tokens."""
    merges = bpe.Merges([(0, 1, 2), (2, 0, 3), (1, 1, 4), (3, 4, 5), (2, 2, 6)], {0: 1, 1: 1})
    rng = random.Random(8)
    for n in (1, 5, 40, 400):
        word = [rng.randrange(2) for _ in range(n)]
        run, out, held = bpe.Transducer(merges), [], 0
        for s in word:
            out += run.feed([s])
            held = max(held, len(run.open))
        assert out + run.finish() == merges.apply(word[:]) and held <= run.window


def test_every_word_goes_through_the_transducer_and_holds_little(library, monkeypatch):
    tokenizer = bpe.Tokenizer(tokenizer_path())
    fed, most = [], [0]
    whole = bpe.Transducer.feed

    def feed(self, symbols):
        symbols = list(symbols)
        fed.append(len(symbols))
        out = whole(self, symbols)
        most[0] = max(most[0], len(self.open))
        return out

    monkeypatch.setattr(bpe.Transducer, "feed", feed)
    words = ["a", "international", "don't", "x" * 70, "".join(random.Random(5).choice("abcdefghij") for _ in range(20_000)), "=-" * 4000]
    for w in words:
        before = len(fed)
        assert tokenizer.encode(w) == library.encode(w, add_special_tokens=False).ids
        assert len(fed) > before
    assert most[0] < 2 * tokenizer.merges.lookahead
    assert not {(a, b) for a, b in zip(tokenizer.inner, tokenizer.inner[1:])} <= tokenizer.merges.beside  # some boundaries are certain at once


def test_decoding_in_any_pieces(library):
    tokenizer = bpe.load(tokenizer_path())
    for text in texts(200, 30):
        ids = tokenizer.encode(text)
        for step in (1, 3, 1000):
            d = bpe.Decoder(tokenizer)
            assert "".join(d.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + d.finish() == library.decode(ids, skip_special_tokens=False)


def test_round_trip_of_odd_rows(odd, none, library):
    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    expected = sorted((want(r.doc_id, r.text) for r in odd.collect()), key=key)
    path = tokenizer_path()
    assert rows_of(bpe.round_trip(odd, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    got = [(r.doc_id, r.n_tokens, hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in bpe.tokenized(odd, path).collect()]
    assert sorted(got, key=key) == expected
    assert bpe.round_trip(none, path).count() == 0 and bpe.tokenized(none, path).count() == 0


def test_files_hold_the_corpus_in_order(odd, none, library):
    path = tokenizer_path()
    table = tf.write(odd, path)
    rows = sorted(((2**63 - 1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd.collect()))
    want, start, corpus = [], 0, []
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((None if i == 2**63 - 1 else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        corpus += ids
    got = sorted((tuple(r) for r in tf.read(table).collect()), key=lambda r: r[1])
    assert [r[1:3] for r in got] != [] and sorted(got, key=key) == sorted(want, key=key)
    assert tf.read(tf.write(none, path)).count() == 0
    for f in table.collect():
        with files.open_random(f.path) as source:
            reader = tf.Reader(source)
            for a, n in ((0, 1), (f.n_ids // 3, f.n_ids // 2), (f.n_ids - 1, 1)):
                assert reader.ids(a, n).tolist() == corpus[f.start + a : f.start + a + n]


@pytest.mark.parametrize("width", [1, 5, 13, 16, 17, 31])
def test_packing_and_random_access(tmp_path, width, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 64)
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, np.uint32)
    assert (tf.unpack(tf.pack(ids, width), width, 1000) == ids).all()
    uri, sink = files.create(str(tmp_path), "x", "tok")
    writer = tf.Writer(sink, 1 << width)
    for i, at in enumerate(range(0, 1000, 130)):
        writer.add(i, ids[at : at + 130])
    writer.close()
    assert writer.width == width and os.path.getsize(uri.removeprefix("file://")) < 1000 * width / 8 + 700
    with files.open_random(uri) as source:
        reader = tf.Reader(source)
        for a, n in ((0, 1000), (63, 2), (64, 64), (999, 1), (5, 0)):
            assert reader.ids(a, n).tolist() == ids[a : a + n].tolist()
