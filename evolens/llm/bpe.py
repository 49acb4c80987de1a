"""Byte-pair encoding and decoding with a public vocabulary file, word by word.

A word is held as one contiguous list of part ids and a second list with the rank of every adjacent pair. The least
rank is found by a scan, its boundary is deleted and the ranks of the two neighbouring pairs are refreshed. That is
quadratic in the word, so a word of more than SHORT_WORD bytes takes a heap over linked parts instead; both give the
same parts. Words between white space are remembered per worker (at most CACHE_WORDS; then forgotten).

Null and empty texts have no tokens. Strings of the vocabulary's added tokens are recognised in a text. Every text is
encoded whole; memory follows the longest text and the cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evolens.llm.words import slices

#: Fixed values, from the public Unicode character database. The vocabulary's library takes letters and digits as of
#: version 16; those that later versions added count as other signs. Capitals newer than this Python's own tables.
NEWER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011df1\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3"
    "\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2"
    "\\U00018e00-\\U00019191\\U000191a0-\\U000191d2"
)
NEWER_DIGITS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
NEWER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_NEWER_CAPITAL = regex.compile("[" + "".join(map(chr, NEWER_CAPITALS)) + "]")

SHORT_WORD = 96
CACHE_WORDS = 400_000
_NONE = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in symbols):
        symbols[b] = chr(256 + k)
    return [symbols[b] for b in range(256)]


def _words(pattern: str) -> regex.Pattern:
    """The file's own pattern, over the letters and digits that its library knows."""
    newer = NEWER_LETTERS + NEWER_DIGITS
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{newer}]]")
    pattern = pattern.replace("[\\p{L}]", f"[\\p{{L}}--[{NEWER_LETTERS}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{NEWER_DIGITS}]]")
    return regex.compile(pattern, regex.V1)


class Encoder:
    """One vocabulary file: text to ids and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.names = {i: w for w, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.words = _words(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {t["content"]: np.uint32(t["id"]).astype("<u4").tobytes() for t in spec["added_tokens"]}
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len)[::-1]) + ")")
        self.memory = _Memory(self)

    def parts(self, word: bytes) -> list[int]:
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self._scan(ids) if len(ids) <= SHORT_WORD else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        rank_of = self.ranks.get
        ranks = [rank_of(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = self.merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), _NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = [False] * n
        rank_of = self.ranks.get
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.merged[rank]
            gone[j] = True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank_of((ids[left], ids[right]))) is not None:
                    heapq.heappush(queue, (r, left, ids[left], ids[right]))
        return [x for x, dropped in zip(ids, gone) if not dropped]

    def encode_chunk(self, chunk: str) -> bytes:
        ids = [i for w in self.words.findall(chunk) for i in self.parts(w.encode())]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.added_split.split(text) if "<|" in text else [text]
        return b"".join(self.added[p] if p in self.added else self._encode_plain(p) for p in pieces if p)

    def _encode_plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not text.isascii() and _NEWER_CAPITAL.search(text):
            text = text.translate(NEWER_CAPITALS)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no special form at the end of a word
        if _SEPARATORS.isdisjoint(text):
            return b"".join(map(self.memory.__getitem__, text.split()))
        return self.encode_chunk(text)

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder: tokens, joined by a space."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: White space to str.split, but ordinary characters to the vocabulary's pattern.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")


class _Memory(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.encode_chunk(chunk)
        if len(chunk) <= SHORT_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Ids and decoded text of every row, one output row for each input row.

    Columns: the id, n_tokens, the chosen outputs, ids_sha256, decoded_sha256; ids are little-endian unsigned 32-bit. Other columns of the input play no part. path: of the vocabulary file, on every node.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    types = {"ids": pa.binary(), "decoded": pa.string()}
    real = "".join(f", {c} {'binary' if c == 'ids' else 'string'}" for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in slices(batches):
            rows = {"ids": [], "decoded": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                decoded = codec.decode(ids)
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                for name, value in (("ids", ids), ("decoded", decoded)):
                    if name in outputs:
                        rows[name].append(value)
            columns = [batch.column(id_column), pa.array(rows["n_tokens"], pa.int64())]
            columns += [pa.array(rows[c], types[c]) for c in outputs]
            columns += [pa.array(rows[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_tokens", *outputs, "ids_sha256", "decoded_sha256"])

    schema = f"{id_column} {kind}, n_tokens bigint{real}, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_column, "text").mapInArrow(run, schema)
