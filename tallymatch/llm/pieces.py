"""SentencePiece encoding and decoding of BPE models by a prefix table.

Read from the model file: pieces, scores, byte fallback and the normaliser's flags. Spaces become U+2581 and split a text into
chunks that no piece crosses. Of a chunk, a table holds for each prefix the last token of the prefix's encoding, which is
unique: of the tokens that an automaton finds to end there, the one that is compatible with the last token of the prefix before
it, that is, BPE over the two would leave their border alone. The ids are recovered backwards through the table. A chunk's ids
are kept in a bounded cache, as words repeat. Runs of U+2581 merge at one score, so their result depends on nothing but the
length and comes from a heap over the run.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty
from .shingles import parts

SPACE = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks that a worker remembers, in each of two generations, and characters of such a chunk at most: longer ones seldom repeat.
CACHE, REMEMBERED = 100_000, 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            x = data[i]
            i += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            value: object = varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Pieces:
    """Encodes and decodes as the library does with this model (BPE, no normalisation map, no user-defined pieces)."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        flags: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                flags = dict(_fields(value))
        if trainer.get(3) != 2 or flags.get(2) or USER in self.kinds or flags.get(4, 1) or not flags.get(5, 1) or not flags.get(3, 1):
            raise ValueError("only BPE models without a normalisation map, user-defined pieces or white space removal are read here")
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, UNUSED)}
        self.long = {p: self.scores[i] for p, i in self.ids.items() if len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a space")
        inner = {c for p in self.long for c in p}
        self.cut = "\n" if "\n" not in inner else None
        self.halves: dict[str, tuple[str, str]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, ...] | list[int]] = {}
        self.older: dict[str, tuple[int, ...] | list[int]] = {}
        self.final: dict[str, tuple[int, ...]] = {}
        self.auto = ahocorasick.Automaton()
        for p in self.long:
            if SPACE * 2 not in p and self._split(p)[0]:  # others are never the last token of anything
                self.auto.add_word(p, p)
        self.auto.make_automaton()
        self.runs: dict[int, tuple[int, ...]] = {}
        self.shown = [str(i) for i in range(len(self.pieces))]
        self.text = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else (" \u2047 " if k == UNKNOWN else p.replace(SPACE, " ")).encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def merge(self, symbols: list[str]) -> list[tuple[str, str]]:
        """Merges of BPE over the symbols, in order (highest score first, then leftmost); symbols becomes the result."""
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap = [(-self.long[x + y], i, x, y) for i, (x, y) in enumerate(itertools.pairwise(symbols)) if x + y in self.long]
        heapq.heapify(heap)
        own: list[str | None] = list(symbols)
        merges = []
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if own[i] != x or j >= len(own) or own[j] != y:
                continue
            merges.append((x, y))
            own[i], own[j] = x + y, None
            after[i] = after[j]
            if after[i] < len(own):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(own) and own[a] + own[b] in self.long:
                    heapq.heappush(heap, (-self.long[own[a] + own[b]], a, own[a], own[b]))
        symbols[:] = [s for s in own if s is not None]
        return merges

    def _split(self, token: str) -> tuple[str, str]:
        """The pair that the last merge of the token's own encoding joins; empty if its encoding is not the token."""
        if token not in self.halves:
            symbols = list(token)
            merges = self.merge(symbols)
            self.halves[token] = merges[-1] if len(symbols) == 1 and merges else ("", "")
        return self.halves[token]

    def _compatible(self, key: tuple[str, str]) -> bool:
        """Whether BPE over the two tokens leaves their border alone: undo their merges, latest first, and look across."""
        if key not in self.fits:
            if len(self.fits) >= 2 * CACHE:
                self.fits.clear()
            left, right = key
            limit, first, ok = float("-inf"), False, True
            while ok:
                # a pair across merges if it scores higher than what merges next, or as high and stands further left
                score = self.long.get(left + right)
                if score is not None and (score > limit or first and score == limit):
                    ok = False
                ls = self.long[left] if len(left) > 1 else float("inf")
                rs = self.long[right] if len(right) > 1 else float("inf")
                if ls == rs == float("inf"):
                    break
                if ls < rs:
                    limit, first, left = ls, False, self._split(left)[1]
                else:
                    limit, first, right = rs, True, self._split(right)[0]
            self.fits[key] = ok
        return self.fits[key]

    def encode_chunk(self, chunk: str) -> list[str]:
        """Tokens of a chunk (at most one U+2581, at its start) by the prefix table."""
        last: list[str] = []
        n, add, fits, compatible = 0, last.append, self.fits.get, self._compatible  # the dict stays the same one
        for end, token in self.auto.iter(chunk):  # by end, the longest first
            if end < n:
                continue
            while n < end:  # where nothing longer fits, a character on its own does
                add(chunk[n])
                n += 1
            at = end - len(token)
            if at >= 0:
                ok = fits(key := (last[at], token))
                if not (ok or ok is None and compatible(key)):
                    continue
            add(token)
            n += 1
        last += chunk[n:]
        out, i = [], len(chunk) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def _ids(self, token: str) -> tuple[int, ...]:
        if token in self.ids:
            found = (self.ids[token],)
        else:
            found = tuple(self.byte[b] for b in token.encode("utf-8", "replace")) if self.byte else (self.unknown,)
        if len(self.final) < CACHE:
            self.final[token] = found
        return found

    def _word(self, word: str) -> tuple[int, ...] | list[int]:
        """Of U+2581 and a word without it: the ids; without a leading lone U+2581 they are a list, else a tuple."""
        if len(self.cache) >= CACHE:
            self.cache, self.older = {}, self.cache
        if word in self.older:
            found = self.cache[word] = self.older[word]
            return found
        if self.cut and self.cut in word:
            tokens = []
            for k, part in enumerate(word.split(self.cut)):
                tokens += [self.cut] * (k > 0) + (self.encode_chunk(part if k else SPACE + part) if part or not k else [])
        else:
            tokens = self.encode_chunk(SPACE + word)
        final = self.final.get
        ids: list[int] = []
        lone = tokens[0] == SPACE
        for token in tokens[1:] if lone else tokens:
            ids += final(token) or self._ids(token)
        found = ids if lone else tuple(ids)
        if len(word) <= REMEMBERED:
            self.cache[word] = found
        return found

    def _run(self, n: int) -> tuple[int, ...]:
        if n not in self.runs:
            symbols = [SPACE] * n
            self.merge(symbols)
            ids = tuple(self.ids[s] for s in symbols)
            if n > 10_000:
                return ids
            self.runs[n] = ids
        return self.runs[n]

    def encode(self, text: str | None) -> list[int]:
        """The ids, without the end id."""
        if not text:
            return []
        ids: list[int] = []
        run = 0
        for word in text.replace(SPACE, " ").split(" "):
            run += 1
            if word:
                own = self.cache.get(word) or self._word(word)
                lone = type(own) is list
                if run > 1 or lone:
                    if run := run - (not lone):
                        ids += self._run(run)
                ids += own
                run = 0
        if run:
            ids += self._run(run)
        return ids

    def decode(self, ids) -> str:
        """The text of the ids; the space that encoding puts in front goes, and invalid bytes become U+FFFD each."""
        data = b"".join(map(self.text.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, Pieces] = {}


def _encode(model, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hashlib.sha256(model.value).hexdigest()
        own = _models.get(name) or _models.setdefault(name, Pieces(model.value))  # kept for a worker's next tasks
        for batch in (x for whole in batches for x in parts(whole, 1, 1 << 20)):
            counts, hashes, texts, all_ids, ends = [], [], [], array("i"), [0]
            for text in batch.column("text").to_pylist():
                flat = own.encode(text)
                decoded = own.decode(flat)
                flat.append(own.end)
                counts.append(len(flat))
                hashes.append(hashlib.sha256(" ".join(map(own.shown.__getitem__, flat)).encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.extend(flat)
                    ends.append(len(all_ids))
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(all_ids, np.int32) if all_ids else [], pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode_documents(documents: DataFrame, model_path: str, ids: bool = False) -> DataFrame:
    """Encode each whole text with the model's pieces and an end id, and decode the ids again.

    Returns doc_id, n_tokens (all ids), ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded
    text), and with ids=True the ids themselves, one row per row of documents. A null text counts as empty: the end id alone.
    Other columns are ignored; an empty table gives no rows. The model file (0.5 MB, fixed) is broadcast.
    """
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())
    kinds = {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")} | ({"ids": F.array().cast("array<int>")} if ids else {})
    return documents.select("doc_id", "text").mapInArrow(thrifty(_encode(model, ids)), documents.select("doc_id").withColumns(kinds).schema)
