"""Text that was decoded with the wrong character encoding."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.runtime import durable, width

ROUNDS = 4
#: Probability of each broken character in a lossy misreading.
BROKEN = 1 / 8

# Encodings that text was wrongly read in, and those that it was written in.
READ_AS = ("latin-1", "web-1252", "cp1251", "mac-roman", "gb18030", "cp932", "big5", "cp949", "cp437", "koi8-r", "cp1250")
WRITTEN_IN = ("utf-8", "cp949")

#: Number of code points of each kind of character, over which unseen ones are spread.
_KINDS = {"ascii": 95, "hangul": 2350, "rare": 8822, "han": 21000, "kana": 250, "half": 160, "latin": 600, "cyrillic": 256, "greek": 200, "jamo": 256, "sign": 5000, "broken": 140_000}


def _encode(s: str, codec: str) -> bytes:
    if codec != "web-1252":
        return s.encode(codec)
    out = bytearray()
    for c in s:  # bytes without a character are read as control characters
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                raise
            out.append(ord(c))
    return bytes(out)


def _undo(s: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """What ``s`` was before it was misread along the chain; None if it can't have been."""
    for read, written in chain:
        try:
            t = _encode(s, read).decode(written)
        except (UnicodeError, LookupError):
            return None
        if t == s:
            return None
        s = t
    return s


def chains() -> list[tuple[tuple[str, str], ...]]:
    """All single misreadings, and the double ones that start from Latin letters."""
    one = [((r, w),) for r in READ_AS for w in WRITTEN_IN if r != w]
    two = [(a[0], b[0]) for a in one for b in one if a[0][0] in ("latin-1", "web-1252") and a[0][1] == "utf-8" and b[0][0] in ("latin-1", "web-1252")]
    return one + two


def _name(chain: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"{w} read as {r}" for r, w in reversed(chain))


@lru_cache(maxsize=200_000)
def kind(c: str) -> str:
    o = ord(c)
    if 32 <= o < 127 or c in "\t\n":
        return "ascii"
    if 0xAC00 <= o <= 0xD7A3:
        return "hangul" if len(c.encode("euc_kr", "ignore")) == 2 else "rare"  # the 2,350 syllables in use, and the others
    if 0x4E00 <= o <= 0x9FFF:
        return "han"
    if 0x1100 <= o <= 0x11FF or 0x3130 <= o <= 0x318F:
        return "jamo"
    if 0x3040 <= o <= 0x30FF:
        return "kana"
    if 0xFF61 <= o <= 0xFFDC:
        return "half"
    if o < 0xA0 or 0xE000 <= o <= 0xF8FF or o == 0xFFFD or unicodedata.category(c) in ("Cn", "Co", "Cs"):
        return "broken"
    if 0xC0 <= o < 0x250 and c.isalpha() or 0x300 <= o < 0x370 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x370 <= o < 0x400:
        return "greek"
    return "sign"


class Letters:
    """A letter model: kinds of characters follow each other, characters are drawn within their kind."""

    def __init__(self, char: dict[str, float], pair: dict[str, float]) -> None:
        self.char, self.pair = char, pair
        self.chars: dict[str, float] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        self.of: dict[str, float] = {}
        for c, n in char.items():
            k = kind(c)
            self.of[k] = self.of.get(k, 0.0) + n
        self.after: dict[str, float] = {}
        for p, n in pair.items():
            a = p.split(">")[0]
            self.after[a] = self.after.get(a, 0.0) + n

    def steps(self, s: str, before: str = "^") -> list[float]:
        """The log probability of each character after the kind ``before``."""
        out = []
        for c in s:
            k = kind(c)
            out.append(self._pair(before, k) + self._char(c, k))
            before = k
        return out

    def _pair(self, before: str, k: str) -> float:
        got = self.pairs.get((before, k))
        if got is None:
            got = self.pairs[before, k] = math.log((self.pair.get(f"{before}>{k}", 0.0) + 0.05) / (self.after.get(before, 0.0) + 0.05 * len(_KINDS)))
        return got

    def _char(self, c: str, k: str) -> float:
        got = self.chars.get(c)
        if got is None:
            got = self.chars[c] = math.log((self.char.get(c, 0.0) + 0.02) / (self.of.get(k, 0.0) + 0.02 * _KINDS[k]))
        return got

    def gains(self, value: str, parts: list[tuple[int, int, str]]) -> list[float]:
        """For each (start, end, piece): the score of ``value`` with that part replaced, less its own. Linear in the parts, however long the value."""
        own = self.steps(value)
        out = []
        for start, end, piece in parts:
            before = kind(value[start - 1]) if start else "^"
            gain = sum(self.steps(piece, before)) - sum(own[start:end])
            if end < len(value):  # the character behind follows another kind now
                k = kind(value[end])
                gain += self._pair(kind(piece[-1]) if piece else before, k) - self._pair(kind(value[end - 1]) if end else "^", k)
            out.append(gain)
        return out

    def lossy(self, value: str) -> float:
        """What a lossy misreading gains: it gives broken characters, which it draws from BROKEN ones, after anything."""
        gain, before = 0.0, "^"
        for c, step in zip(value, self.steps(value)):
            k = kind(c)
            if k == "broken":
                gain -= step + math.log(BROKEN)
            elif before == "broken":
                gain += max(self._pair(x, k) for x in _KINDS) - self._pair(before, k)
            before = k
        return gain


_RUN = re.compile(r"[^\x00-\x7f]+")


def options(value: str) -> list[tuple[str, int, int, str]]:
    """(chain, start, end, piece) for each chain that can have given the value, or a part of it: the part and what it was before.

    A part is a run of non-ASCII characters, or the whole value; a chain is
    undone in the whole, in each run where that is possible, and in all of
    them. However many runs there are, each has its options. A value with
    replacement or control characters can be ``lossy`` too: misread in a way
    that can't be undone.
    """
    out: list[tuple[str, int, int, str]] = []
    seen: set[tuple[int, int, str]] = set()
    runs = [m.span() for m in _RUN.finditer(value)]
    known = set(value)

    def add(chain: tuple, start: int, end: int, piece: str | None) -> None:
        if piece and piece != value[start:end] and (start, end, piece) not in seen and not any(kind(c) == "broken" for c in piece if c not in known):
            seen.add((start, end, piece))
            out.append((_name(chain), start, end, piece))

    for chain in chains():
        for start, end in runs:
            add(chain, start, end, _undo(value[start:end], chain))
        if runs:
            if runs != [(0, len(value))]:
                add(chain, 0, len(value), _undo(value, chain))
            if len(runs) > 1:
                start, end = runs[0][0], runs[-1][1]
                add(chain, start, end, _RUN.sub(lambda m, chain=chain: _undo(m.group(), chain) or m.group(), value[start:end]))
    if any(kind(c) == "broken" for c in value):
        out.append(("lossy", 0, 0, ""))
    return out


_OPTION = "array<struct<chain:string,start:int,end:int,piece:string>>"


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(options=[[{"chain": c, "start": s, "end": e, "piece": t} for c, s, e, t in options(v)] for v in b["value"]])


def _weigh(value: str, found: list[dict], letters: Letters, prior: dict[str, float] | None) -> list[float]:
    """Posterior of 'none' and of each option."""
    prior = prior or {}
    total = sum(prior.values()) + 20.0
    share = lambda c: math.log((prior.get(c, 0.0) + (19.0 if c == "none" else 1.0 / 40)) / total)
    gains = letters.gains(value, [(o["start"], o["end"], o["piece"]) for o in found])
    score = [share("none")]
    for o, g in zip(found, gains):
        score.append(share(o["chain"]) + (letters.lossy(value) if o["chain"] == "lossy" else g))
    top = max(score)
    w = [math.exp(s - top) for s in score]
    return [x / sum(w) for x in w]


def _counts(df: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Expected counts of characters and of pairs of kinds; both are bounded by Unicode, not by the data."""
    chars = df.select("w", F.explode(F.split("t", "")).alias("c")).groupBy("c").agg(F.sum("w").alias("n"))
    char = {r["c"]: r["n"] for r in chars.collect() if r["c"]}

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, float] = {}
            for t, w in zip(b["t"], b["w"]):
                before = "^"
                for c in t:
                    k = kind(c)
                    n[f"{before}>{k}"] = n.get(f"{before}>{k}", 0.0) + w
                    before = k
            yield pd.DataFrame({"p": list(n), "n": list(n.values())})

    pairs = df.mapInPandas(kinds, "p string, n double").groupBy("p").agg(F.sum("n").alias("n"))
    return char, {r["p"]: r["n"] for r in pairs.collect()}


def misread_values(values: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Find misread values and restore them, by expectation-maximization.

    ``values`` has distinct (field, source, value). The latent chain of a
    value is ``none``, one of :func:`chains`, or ``lossy``; its prior belongs
    to the source and field, so that weak evidence in many values of one
    source adds up. What a chain explains is scored by a letter model of the
    text before the misreading, learnt first from values that no chain can
    have given, then from all by their posteriors.

    Null and ASCII values are never cases. Returns (field, source, value,
    chain, restored, probability) of the cases; ``restored`` is null for
    ``lossy`` values, whose characters are lost.
    """
    v = values.where(F.col("value").isNotNull()).select("field", F.coalesce("source", F.lit("")).alias("source"), "value").distinct()
    # few bytes, much work: adaptive execution would put all into one task
    o = durable(v.repartition(width(v), "value").mapInPandas(_expand, f"field string, source string, value string, options {_OPTION}"))
    letters = Letters(*_counts(o.where(F.size("options") == 0).select(F.col("value").alias("t"), F.lit(1.0).alias("w"))))
    prior = None
    spark = values.sparkSession
    weighed = None
    for step in range(rounds):
        held = spark.sparkContext.broadcast(letters)  # bounded by Unicode

        def posterior(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                maps = [None if m is None else dict(m) for m in b["prior"]]
                yield b.drop(columns="prior").assign(p=[_weigh(val, list(found), held.value, m) for val, found, m in zip(b["value"], b["options"], maps)])

        with_prior = o.withColumn("prior", F.lit(None).cast("map<string,double>")) if prior is None else o.join(prior, ["field", "source"], "left")
        weighed = with_prior.select("field", "source", "value", "options", "prior").mapInPandas(posterior, f"field string, source string, value string, options {_OPTION}, p array<double>")
        if step == rounds - 1:
            break
        weighed = durable(weighed)
        restored = F.transform("options", lambda x: F.struct(x["chain"].alias("c"), _spliced(x).alias("t")))
        each = F.explode(F.arrays_zip(F.concat(F.array(F.struct(F.lit("none").alias("c"), F.col("value").alias("t"))), restored).alias("o"), F.col("p").alias("w")))
        flat = weighed.select("field", "source", each.alias("x")).where("x.w > 1e-6").select("field", "source", "x.o.c", "x.o.t", "x.w")
        letters = Letters(*_counts(flat.where("c != 'lossy'").select("t", "w")))
        # a row for each field and source, with as many entries as there are chains; joined, not sent to the driver
        by_chain = flat.groupBy("field", "source", "c").agg(F.sum("w").alias("n"))
        prior = durable(by_chain.groupBy("field", "source").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("prior")))
    best = F.array_max(F.transform(F.arrays_zip(F.slice("p", 2, F.greatest(F.size("options"), F.lit(1))).alias("w"), F.col("options").alias("o")), lambda x: F.struct(x["w"].alias("w"), x["o"].alias("o"))))
    out = weighed.where((F.element_at("p", 1) < 0.5) & (F.size("options") > 0)).withColumn("b", best)
    whole = F.when(F.col("b.o.chain") != "lossy", _spliced(F.col("b.o")))
    return out.select("field", "source", "value", F.col("b.o.chain").alias("chain"), whole.alias("restored"), (1 - F.element_at("p", 1)).alias("probability"))


def _spliced(option: Column) -> Column:
    """``value`` with the option's part replaced."""
    head = F.col("value").substr(F.lit(1), option["start"])
    return F.concat(head, option["piece"], F.col("value").substr(option["end"] + 1, F.length("value")))
