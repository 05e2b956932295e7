"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every adjacent pair by binary search over the
sorted pair keys of the merge table, takes the lowest rank of each word, and merges all its places at once. Words
are encoded once per worker and kept in a bounded table; texts are then joined up from them.

Cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded each; other columns
pass through untouched (the new columns are n_tokens, ids and decoded; existing columns of these names are
replaced); an empty table gives an empty table. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.arrow import small_batches, wider, with_columns

#: Unicode white space, as the vocabulary's splitter understands it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NO_RANK = np.iinfo(np.int64).max
#: Chunks between white space whose ids a worker keeps at most; beyond it the table starts anew.
KEEP_CHUNKS = 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary: lower-casing, NFC, byte letters, ranks of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = np.full(self.size, "", dtype=object)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + end] for c in letters], dtype=np.int64)
        pairs = [(ids[a] * self.size + ids[b], ids[a + b]) for a, b in model["merges"]]
        keys = np.array([k for k, _ in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([m for _, m in pairs], dtype=np.int64)  # by rank
        piece = model_split(spec)
        self.piece = regex.compile(piece)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.searchsorted(self.keys, want).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and where each word starts in it (with the end at last)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, owner = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)  # of the pair that begins here
            inside = owner[:-1] == owner[1:]
            rank[:-1][inside] = self.rank(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(owner)])
            open_word = np.repeat(lowest < NO_RANK, sizes)
            if not open_word.all():  # words without a known pair are finished
                done_symbols.append(symbols[~open_word])
                done_owner.append(owner[~open_word])
                symbols, owner, rank = symbols[open_word], owner[open_word], rank[open_word]
                lowest, sizes = lowest[lowest < NO_RANK], sizes[lowest < NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, sizes)
            # of overlapping places (a a a) every second one counts, from the left
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            place = np.flatnonzero(hit)
            place = place[(place - run[np.searchsorted(run, place, side="right") - 1]) % 2 == 0]
            symbols[place] = self.merged[rank[place]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


def model_split(spec: dict) -> str:
    """The pattern whose matches are the words."""
    steps = spec["pre_tokenizer"]["pretokenizers"]
    return next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split").replace(r"\s", SPACE)


class Encoder:
    """Encodes texts; lives in a Python worker and keeps the chunks that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.seen = vocabulary, {}
        self.white = regex.compile(f"[{SPACE}]+")

    def chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each letter is lower-cased on its own: no final sigma
                text = text.replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space
            return [x for x in self.white.split(text) if x]
        return text.split()

    def parts(self, text: str) -> list[list[str]]:
        """Chunks between white space; a special token stands alone, as a tuple of its id."""
        if self.v.special_split is None or "<|" not in text:
            return self.chunks(text)
        out: list = []
        for k, x in enumerate(self.v.special_split.split(text)):
            out.extend([(self.v.special[x],)] if k % 2 else self.chunks(x))
        return out

    def learn(self, chunks: set) -> None:
        todo = [c for c in chunks if isinstance(c, str)]
        pieces = [self.v.piece.findall(c) for c in todo]
        new = list({p for ps in pieces for p in ps})
        ids, starts = self.v.encode_words([p.encode("utf-8", "surrogatepass") for p in new])
        of = {p: ids[starts[k] : starts[k + 1]].tolist() for k, p in enumerate(new)}
        self.seen.update((c, [i for p in ps for i in of[p]]) for c, ps in zip(todo, pieces, strict=True))
        self.seen.update((c, list(c)) for c in chunks if not isinstance(c, str))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.parts(t) for t in texts]
        missing = set(chain.from_iterable(split)).difference(self.seen)
        if len(self.seen) + len(missing) > KEEP_CHUNKS:
            self.seen.clear()
            missing = set(chain.from_iterable(split))
        if missing:
            self.learn(missing)
        get = self.seen.__getitem__
        return [list(chain.from_iterable(map(get, s))) for s in split]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, vocabulary) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary.value)
    return _encoders[path]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens (long) and ids (array of int). path: the vocabulary file, read on the driver alone."""
    v = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, v)
        for big in batches:
            for batch in small_batches(big, text):
                ids = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
                counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(counts.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
                yield with_columns(batch, {"n_tokens": pa.array(counts), "ids": lists})

    return df.mapInArrow(run, wider(df, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded: the tokens of the ids, joined by one space. Null ids decode to an empty text; ids out of range are left out."""
    v = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size = v.value.tokens, v.value.size
        for big in batches:
            for batch in small_batches(big, ids):
                column, texts = batch.column(ids), []
                flat, offsets = np.asarray(column.values), column.offsets.to_pylist()
                valid = column.is_valid().to_pylist()
                for k, ok in enumerate(valid):
                    own = flat[offsets[k] : offsets[k + 1]] if ok else flat[:0]
                    own = own[(own >= 0) & (own < size)].astype(np.int64)
                    texts.append(" ".join(tokens[own].tolist()))
                yield with_columns(batch, {"decoded": pa.array(texts, pa.string())})

    return df.mapInArrow(run, wider(df, [T.StructField("decoded", T.StringType())]))
