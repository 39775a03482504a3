"""Operator 10: language identification of every word and document.

A word's script (Unicode ranges) narrows the languages it can belong to; hashed letter n-grams give each candidate a log-likelihood; the
Viterbi path over a document's words, with a penalty for every change of language, labels spans, so mixed texts are told apart. A
document's language is the one with most letters in its spans, its score that share.

The model is fitted by a distributed count of n-grams in at most about TRAIN_DOCS labelled documents, drawn by a hash of the id (a bounded
sample; everything else reads all rows). It is a table of 2**BUCKET_BITS rows and one column per language, whatever the input's size.
Prediction is per document and shuffles nothing; Viterbi runs over many documents at once, a word position per step.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.llm.common import Out, kept, rows, sequence_hashes
from permlens.session import written

TRAIN_DOCS = 20_000
BUCKET_BITS = 16
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
SWITCH = 15.0  # nats a change of language costs
SCRIPT_SHARE = 0.01  # of a language's letters
OTHER_SCRIPT = -40.0  # score of a word for a language that does not use its script
CACHE_WORDS = 120_000
CHUNK_BYTES = 3 << 20
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")

# First and last code points of the Unicode ranges of common scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


def script_of(letter: str) -> str:
    code = ord(letter)
    if code < 0x250:
        return "latin"
    return next((name for name, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), "other")


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every length in GRAMS: the buckets of all letter n-grams of the words (each between a start and an end mark), and the place of the
    word each is from."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(m) for m in marked])
    for k in GRAMS:
        if len(codes) >= k:
            inside = of[: len(of) - k + 1] == of[k - 1 :]
            yield (sequence_hashes(codes, k)[inside] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), of[: len(inside)][inside]


def letters_only(word: str) -> str:
    """What WORD finds may hold numerals that are not digits; only letters count."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages
    scripts: list[set[str]]  # of each language

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row of scores for each word of letters, and whether any language uses the word's script (else its scores are zeros)."""
        k = len(self.languages)
        found = np.zeros((len(words), k))
        for buckets, of in grams([w.lower() for w in words]):
            for i in range(k):
                found[:, i] += np.bincount(of, self.logs[buckets, i], len(words))
        kinds: dict[str, np.ndarray] = {}
        uses = np.array([kinds[s] if (s := script_of(w[0])) in kinds else kinds.setdefault(s, np.array([s in own for own in self.scripts])) for w in words]).reshape(-1, k)
        best = np.where(uses, found, -np.inf).max(1, keepdims=True)
        found = np.where(uses, np.maximum(found - best, OTHER_SCRIPT), OTHER_SCRIPT)
        known = uses.any(1)
        return np.where(known[:, None], found, 0).astype(np.float32), known


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Counts n-grams per language in a bounded, evenly drawn sample of the rows that have text and language. No such row: an empty model,
    under which every document is unknown."""
    known = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    n = known.count()
    part = 1 << 30
    share = part if n <= train_docs else int(part * train_docs / n)
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("language")), F.lit(part)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        tables: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()

        def add() -> None:
            for lang, own in words.items():
                letters = [(w, n) for word, n in own.items() if (w := letters_only(word))]
                for w, n in letters:
                    scripts[lang, script_of(w[0])] += n * len(w)
                times = np.array([n for _, n in letters], np.float64)
                table = tables.setdefault(lang, np.zeros(1 << BUCKET_BITS))
                for buckets, of in grams([w.lower() for w, _ in letters]):
                    table += np.bincount(buckets, times[of], len(table))
            words.clear()

        for batch in batches:
            for start, texts in chunks(batch, 0):
                for text, lang in zip(texts, batch.column(1).slice(start, len(texts)).to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(WORD.findall(text))
                add()
        data = [(lang, b, None, int(t[b])) for lang, t in tables.items() for b in np.flatnonzero(t).tolist()] + [(lang, None, s, c) for (lang, s), c in scripts.items()]
        for i in range(0, len(data), 50_000):
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "bucket", "script", "n"), d, strict=True)) for d in data[i : i + 50_000]], schema=COUNTS)

    chosen = drawn.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    counted = chosen.mapInArrow(count, "lang string, bucket int, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n"))
    found = written(counted, "language-counts").toArrow().to_pylist()  # at most 2**BUCKET_BITS rows and a few scripts per language
    languages = sorted({r["lang"] for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
    letters: list[Counter] = [Counter() for _ in languages]
    for r in found:
        if r["bucket"] is None:
            letters[place[r["lang"]]][r["script"]] += r["n"]
        else:
            table[r["bucket"], place[r["lang"]]] += r["n"]
    logs = np.log(table / table.sum(0)).astype(np.float32) if languages else table.astype(np.float32)
    return Model(languages, logs, [{s for s, n in c.items() if n >= SCRIPT_SHARE * c.total()} for c in letters])


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("script", pa.string()), ("n", pa.int64())])


def viterbi(scores: np.ndarray, docs: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Per document the best language of each word: the path with the highest sum of scores less `switch` for every change. scores: words x
    languages; docs: places in it, word by word. Ties go to the earlier language and to staying."""
    order = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
    lengths = np.array([len(docs[d]) for d in order])
    total = int(lengths.sum())
    paths = [np.empty(len(d), np.uint16) for d in docs]
    if not total:
        return paths
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # documents longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(total, np.int64)  # word by word over all documents
    for i, d in enumerate(order):
        flat[at[: len(docs[d])] + i] = docs[d]
    k = scores.shape[1]
    back = np.empty((total, k), np.uint8 if k < 256 else np.uint16)
    own = np.arange(k, dtype=back.dtype)
    state = np.zeros((len(docs), k), np.float32)
    for t in range(steps):
        n, low = active[t], at[t]
        now = state[:n]
        change = now.max(1, keepdims=True) - np.float32(switch)
        stay = now >= change
        back[low : low + n] = np.where(stay, own, now.argmax(1)[:, None])
        state[:n] = np.maximum(now, change) + scores[flat[low : low + n]]
    here = state.argmax(1)
    label = np.empty(total, back.dtype)
    for t in range(steps - 1, -1, -1):
        n, low = active[t], at[t]
        label[low : low + n] = here[:n]
        here[:n] = back[low + np.arange(n), here[:n]]
    for i, d in enumerate(order):
        paths[d] = label[at[: len(docs[d])] + i]
    return paths


class Labeller:
    """Labels texts in chunks; scores of words are remembered within a task, up to a bound that changes no result."""

    def __init__(self, model: Model) -> None:
        self.model, self.place = model, {}
        self.table, self.size = np.empty((0, len(model.languages)), np.float32), np.empty(0, np.int64)

    def label(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text the languages of its words and their numbers of letters (0 for a word no language could have)."""
        if len(self.place) > CACHE_WORDS:
            self.place, self.table, self.size = {}, self.table[:0], self.size[:0]
        new = list(set().union(*texts).difference(self.place))
        letters = [letters_only(w) for w in new]
        scores, known = self.model.scores([w or "." for w in letters])
        known &= np.array([bool(w) for w in letters], bool)
        scores[~known] = 0
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.table = np.concatenate([self.table, scores])
        self.size = np.concatenate([self.size, np.where(known, [len(w) for w in letters], 0).astype(np.int64)])
        docs = [np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)) for words in texts]
        return viterbi(self.table, docs), [self.size[d] for d in docs]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [WORD.findall(t) if t else [] for t in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        paths, sizes = self.label(words)
        out = []
        for own, path, size in zip(words, paths, sizes, strict=True):
            if not any(map(str.isalpha, own)) and not any(map(letters_only, own)):
                out.append((UNKNOWN, 0.0))
                continue
            share = np.bincount(path, size, len(self.model.languages))
            best = int(share.argmax())
            out.append((self.model.languages[best], float(share[best] / share.sum()) if share.sum() else 0.0))
        return out


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of a batch whose texts together have a bounded number of bytes (a single longer text is its own run). Only one run's
    texts are Python objects at a time."""
    texts = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + CHUNK_BYTES, "right")))
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


def identify(docs: DataFrame, model: Model, text_column: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Every row and column as it was, with lang_pred (a learned language, or `und` where the text is null or has no letter) and score (0 to
    1: the language's share of the letters). Columns of these names are replaced, so a table that has them passes other names; repeated rows
    are judged alike; no rows give no rows."""
    passed = docs.drop(lang_out, score_out)
    names = passed.columns
    at = names.index(text_column)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        kept("language", object)  # the words of other operators go
        for batch in batches:
            for start, texts in chunks(batch, at):
                lang, score = zip(*labeller.judge(texts), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, lang_out, score_out])

    return passed.mapInArrow(run, _with(passed, f"`{lang_out}` string, `{score_out}` double"))


def lettered(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows whose text has a letter, as they were: what `identify` does not call unknown under a model of any language."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _with(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


SPANS = pa.schema([("doc_id", pa.int64()), ("span", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64())])


def spans(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spans of one language in each text: doc_id, span (from 0), start and end (code points, end exclusive), lang, n_words. Texts
    without letters have none."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, out = Labeller(held.value), Out(SPANS)
        for doc_id, text in rows(batches, "doc_id", "text"):
            found = [m for m in WORD.finditer(text or "") if letters_only(m.group())]
            if not found or not held.value.languages:
                continue
            path = labeller.label([[m.group() for m in found]])[0][0]
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if out.add(doc_id, i, found[a].start(), found[b - 1].end(), held.value.languages[path[a]], b - a):
                    yield out.take()
        yield from out.rest()

    wanted = docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"cast(`{text_column}` as string) as text")
    return wanted.mapInArrow(run, "doc_id long, span int, start long, end long, lang string, n_words long")


def held_out(id_column: str = "doc_id") -> Column:
    """The rows that no model may learn from: crc32 of the id's digits leaves 2 when divided by 4 (a null id is not one of them)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2
