"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; every executor must have it at this place.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the split of text into words that the vocabulary was made with.
WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words kept with their ids between batches of a worker; beyond it the store starts anew, which changes no result.
WORD_STORE = 200_000


def _byte_chars() -> dict[str, int]:
    """The characters that stand for the bytes 0-255 in byte-level vocabularies: printable ones stand for themselves, the others for 256 and up, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words by a walk over the trie of their bytes.

    The encoding of a word is fixed by the last token of each of its prefixes:
    token t ends the prefix p t if the last token u of p and t stay apart when
    they are encoded together. So each node of the trie needs one token, found
    from those of the nodes above it, and words with a common prefix share its
    nodes. Sorted words visit the trie depth first; only the current path is
    kept. Work is linear in the nodes, whatever the length of a word.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = _byte_chars()
        special = {"<|endoftext|>"}
        raw = {t: bytes(of[c] for c in t) for t in model["vocab"] if t not in special}
        self.ids = {b: model["vocab"][t] for t, b in raw.items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, z = m.split(" ") if isinstance(m, str) else m
            self.rank[self.ids[raw[a]], self.ids[raw[z]]] = (r, self.ids[raw[a] + raw[z]])
        self.longest = max(map(len, self.ids))
        self.apart: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def merged(self, text: bytes) -> list[int]:
        """Plain byte-pair merging; only used on one or two tokens."""
        out = [self.ids[bytes([b])] for b in text]
        while len(out) > 1:
            best = min((self.rank.get((out[i], out[i + 1]), (1 << 60, -1)) for i in range(len(out) - 1)), default=(1 << 60, -1))
            if best[1] < 0:
                break
            i, new = 0, []
            while i < len(out):
                if i + 1 < len(out) and self.rank.get((out[i], out[i + 1])) == best:
                    new.append(best[1])
                    i += 2
                else:
                    new.append(out[i])
                    i += 1
            out = new
        return out

    def stay(self, u: int, t: int) -> bool:
        """Whether u and t stay as they are side by side; u = -1 stands for the start of the word."""
        known = self.apart.get((u, t))
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            if u < 0:
                known = self.merged(self.bytes[t]) == [t]
            else:
                known = (u, t) not in self.rank and self.merged(self.bytes[u] + self.bytes[t]) == [u, t]
            self.apart[u, t] = known
        return known

    def learn(self, words: set[str]) -> None:
        """Encode the words and keep them."""
        ids, longest, stay = self.ids, self.longest, self.stay
        path, last, size = b"", [-1], [0]
        for w, word in sorted((w.encode(), w) for w in words):
            shared = os.path.commonprefix([path, w])
            n = len(shared)
            del last[n + 1 :], size[n + 1 :]
            for i in range(n + 1, len(w) + 1):
                for k in range(min(i, longest), 0, -1):
                    t = ids.get(w[i - k : i])
                    if t is not None and stay(last[i - k], t):
                        last.append(t)
                        size.append(k)
                        break
            path, at, out = w, len(w), []
            while at:
                out.append(last[at])
                at -= size[at]
            self.words[word] = out[::-1]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; [] for a null or empty one."""
        cut = [WORDS.findall(t.encode("utf-8", "replace").decode()) if t else [] for t in texts]
        out: list[list[int]] = []
        for start in range(0, len(cut), 256):
            part = cut[start : start + 256]
            new = {w for c in part for w in c if w not in self.words}
            if len(self.words) + len(new) > WORD_STORE:
                self.words.clear()
                new = {w for c in part for w in c}
            self.learn(new)
            get = self.words.__getitem__
            out += [[i for w in c for i in get(w)] for c in part]
        return out


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(name: str, folder: str | None = None) -> TrieEncoder:
    path = os.path.join(folder or TOKENIZER_DIR, f"{name}.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None, sizes_only: bool = False) -> DataFrame:
    """(key, ids) of every text, or (key, n_tokens), without special tokens.

    Null and empty texts have no tokens: ids is the empty list, never null. A
    blank text has the tokens of its white space. The strings of special
    tokens are ordinary text. Rows stay rows: repeated keys aren't merged and
    null keys are kept. Texts are encoded whole, in place, without a shuffle:
    each worker inserts the distinct words of its batches into a trie and
    keeps the encodings of recent words.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                b = big.slice(start, 1024)
                ids = enc.encode(b.column(1).to_pylist())
                if sizes_only:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int64())], names=[key, "n_tokens"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if sizes_only else "ids array<int>"))
