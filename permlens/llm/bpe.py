"""Operator 7: byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Every word's symbols are read from left to right by one transducer that holds a short window. Two rules make tokens final. A token is stable
once no merge can still take its right edge: where the next symbol stands beside the last one in no token at all, everything before it is
emitted. And merging the window gives the right tokens except near its open end: what is still to come can change a boundary only through
a chain of merges in which each later-ranked merge loses its right part to the one before it. The longest such chain, in symbols, follows
from the merge list alone (`lookahead`). A token that ends at least that far before the window's open end is final and is emitted; the
rest stays. Memory per word is therefore constant, however long the word. Words met often are remembered with the tokens they gave.

Why the chain bounds it: compare the merges of two continuations in rank order. The leftmost place where they differ moves left only when
some merge (A, B) happens in one of them and B touches the difference, and then by A's length. The next such merge (A', B') has a later
rank, and its B' starts where A starts, so A lies on the left spine of B'. `lookahead` is the largest sum of lengths over such chains.

Decoding appends each token's bytes to an incremental UTF-8 decoder, so text leaves as soon as it is determined.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from permlens.llm.common import Out, kept, rows

CACHE_WORDS = 200_000
REMEMBERED_BYTES = 64  # longer words are not kept
PIECE_BYTES = 1 << 15
SPACE = re.compile(rb"[\x20\x09-\x0D]")
WHITE = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from
    U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """A merge list over token ids: which pairs merge, in which order, and how far a decision can depend on what follows."""

    def __init__(self, pairs: list[tuple[int, int, int]], size: dict[int, int]) -> None:
        """pairs: (left, right, merged) in rank order; size: symbols of each token that is not a merge's result."""
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(pairs)}
        self.merged = [c for _, _, c in pairs]
        if len(set(self.merged)) < len(pairs):
            raise ValueError("two merges make one token")
        self.size = dict(size)
        for a, b, c in pairs:
            self.size[c] = self.size[a] + self.size[b]
        first, last = {s: s for s in size}, {s: s for s in size}  # outer symbols of every token
        for a, b, c in pairs:
            first[c], last[c] = first[a], last[b]
        self.beside = {(last[a], first[b]) for a, b, _ in pairs}  # symbols that stand beside each other in some token
        self.lookahead = self._lookahead(pairs)

    def _lookahead(self, pairs: list[tuple[int, int, int]]) -> int:
        first: dict[int, int] = {}  # a merged token's left part
        longest: dict[int, int] = {}  # by left part: the longest chain that ends in a merge with it, of the ranks so far
        most = 0
        for a, b, c in pairs:
            before, spine = longest.get(b, 0), b
            while (spine := first.get(spine, -1)) >= 0:
                before = max(before, longest.get(spine, 0))
            longest[a] = max(longest.get(a, 0), self.size[a] + before)
            most = max(most, longest[a])
            first.setdefault(c, a)
        return most + max(self.size.values(), default=1)  # the first merge of a chain may reach over the window's open end

    def apply(self, ids: list[int]) -> list[int]:
        """Merges the lowest-ranked pair, leftmost first, until none is left."""
        get, merged, none = self.rank.get, self.merged, len(self.merged)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        ranks.append(none)  # the last id has no right neighbour
        while (low := min(ranks)) < none:
            i = ranks.index(low)
            new = ids[i] = merged[low]
            del ids[i + 1], ranks[i + 1]
            ranks[i] = get((new, ids[i + 1]), none) if i + 1 < len(ids) else none
            if i:
                ranks[i - 1] = get((ids[i - 1], new), none)
        return ids


class Transducer:
    """Takes the symbols of one word in pieces and gives out tokens once they are stable."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.open = merges, []
        self.window = 2 * merges.lookahead

    def feed(self, symbols: Iterable[int]) -> list[int]:
        """The tokens that became stable with these symbols."""
        out, beside, held, window = [], self.merges.beside, self.open, self.window
        for s in symbols:
            if held and (held[-1], s) not in beside:
                out += self.merges.apply(held)
                self.open = held = []
            held.append(s)
            if len(held) >= window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        end, limit, size, out = 0, len(self.open) - self.merges.lookahead, self.merges.size, []
        for token in self.merges.apply(list(self.open)):
            if end + size[token] > limit:
                break
            end += size[token]
            out.append(token)
        del self.open[:end]
        return out

    def finish(self) -> list[int]:
        done, self.open = self.merges.apply(self.open), []
        return done


class Tokenizer:
    """Reads a tokenizer file of the byte-level kind with word ends: NFC, white space runs as one space, lower case, words by a pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"not a tokenizer of this kind: {path}")
        self.suffix = model["end_of_word_suffix"] or ""
        inner, last = byte_symbols(), [s + self.suffix for s in byte_symbols()]
        self.inner, self.last = [vocab[s] for s in inner], [vocab[s] for s in last]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dict.fromkeys({*self.inner, *self.last}, 1))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.decoder = spec["decoder"]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        ascii_only = self.pattern.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.plain = re.compile(ascii_only.encode())  # the pattern where a lower-case stretch is ASCII
        self._known: dict[bytes, list[int]] = {}
        self._pretokens: dict[bytes, list[int]] = {}

    def word(self, word: bytes) -> list[int]:
        """The ids of a stretch without ASCII white space. No token reaches over white space, so stretches are independent."""
        if word.isalpha():  # ASCII letters only: one word of the pattern
            found = [word.lower()]
        elif word.isascii() and b"<" not in word:
            found = self.plain.findall(word.lower())
        else:
            return self._remember(word, [i for part in self._parts(word.decode()) for i in part])
        if len(found) == 1:
            return self._remember(word, self._pretoken(found[0]))
        return self._remember(word, [i for f in found for i in self._pretoken(f)])

    def _remember(self, word: bytes, ids: list[int]) -> list[int]:
        if len(word) <= REMEMBERED_BYTES:
            if len(self._known) >= CACHE_WORDS:
                self._known.clear()
            self._known[word] = ids
        return ids

    def _parts(self, text: str) -> Iterator[list[int]]:
        for part in self.special.split(text) if self.special and "<" in text else [text]:
            if part in self.added:
                yield [self.added[part]]
                continue
            if part.isascii():
                part = part.lower()
            else:
                part = "".join(c.lower() for c in WHITE.sub(" ", unicodedata.normalize("NFC", part)))
            for found in self.pattern.finditer(part):
                yield self._pretoken(found.group().encode())

    def _pretoken(self, data: bytes) -> list[int]:
        ids = self._pretokens.get(data)
        if ids is None:
            run = Transducer(self.merges)
            ids = run.feed(map(self.inner.__getitem__, memoryview(data)[:-1]))
            ids += run.feed((self.last[data[-1]],))
            ids += run.finish()
            if len(data) <= REMEMBERED_BYTES:
                if len(self._pretokens) >= CACHE_WORDS:
                    self._pretokens.clear()
                self._pretokens[data] = ids
        return ids

    def pieces(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, some thousand words at a time. Null is the empty text."""
        data, start = (text or "").encode(), 0
        while start < len(data):
            gap = SPACE.search(data, start + PIECE_BYTES)
            end = gap.start() if gap else len(data)
            ids: list[int] = []
            for w in data[start:end].split():
                ids += self._known.get(w) or self.word(w)
            yield ids
            start = end

    @cached_property
    def bytes_of(self) -> tuple[dict[int, bytes], bytes]:
        """Every token's bytes, and those between two tokens."""
        return _token_bytes(self)

    def encode(self, text: str | None) -> list[int]:
        return [i for piece in self.pieces(text) for i in piece]


class Decoder:
    """Token ids to text, incrementally. Without a decoder in the tokenizer file the token strings are joined by one space, as its library
    does; with one, tokens are bytes and the word end is a space. Incomplete bytes wait for the next token."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.table, self.between = tokenizer.bytes_of
        self.started = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.between.join(map(self.table.__getitem__, ids))
        data, self.started = (self.between + data if self.started else data), True
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def _token_bytes(tokenizer: Tokenizer) -> tuple[dict[int, bytes], bytes]:
    if tokenizer.decoder is None:
        return {i: t.encode() for i, t in tokenizer.token.items()}, b" "
    value = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
    end, added = tokenizer.suffix, set(tokenizer.added.values())

    def plain(i: int, t: str) -> bytes:
        if i in added:
            return t.encode()
        body, tail = (t[: -len(end)], b" ") if end and t.endswith(end) else (t, b"")
        return b"".join(value[c] for c in body) + tail

    return {i: plain(i, t) for i, t in tokenizer.token.items()}, b""


def load(path: str) -> Tokenizer:
    """One tokenizer per process, until another operator runs there."""
    return kept(("bpe", path), lambda: Tokenizer(path))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(text: str | None, tokenizer: Tokenizer, decimal: dict[int, str]) -> tuple[int, str, str]:
    ids_hash, text_hash, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder(tokenizer)
    for piece in tokenizer.pieces(text):
        if piece:
            ids_hash.update(((" " if n else "") + " ".join(map(decimal.__getitem__, piece))).encode())
            n += len(piece)
            text_hash.update(decoder.feed(piece).encode())
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. A null or empty text has no tokens (both digests are those of
    the empty string); a null id stays null; repeated rows give repeated rows; other columns are not looked at; no rows give no rows.
    The work is per row: no shuffle. `path` is a tokenizer file that every executor can read."""

    def run(batches):
        tokenizer, out = load(path), Out(DIGESTS)
        decimal = {i: str(i) for i in tokenizer.token}
        for doc_id, text in rows(batches, "doc_id", "text"):
            if out.add(doc_id, *digest(text, tokenizer, decimal)):
                yield out.take()
        yield from out.rest()

    wanted = docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"cast(`{text_column}` as string) as text")
    return wanted.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids (an array of ints) and decoded (what the decoder makes of them) of every document; nulls and empty texts as in
    `round_trip`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, out = load(path), Out(TOKENS)
        for doc_id, text in rows(batches, "doc_id", "text"):
            decoder, parts, ids = Decoder(tokenizer), [], []
            for piece in tokenizer.pieces(text):
                parts.append(decoder.feed(piece))
                ids += piece
            decoded = "".join([*parts, decoder.finish()])
            if out.add(doc_id, len(ids), ids, decoded, weight=4 * len(ids) + len(decoded)):
                yield out.take()
        yield from out.rest()

    wanted = docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"cast(`{text_column}` as string) as text")
    return wanted.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, decoded string")


TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.string())])
