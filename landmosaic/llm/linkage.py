"""Matching records of two lists of places that share no key, by soft logic."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.runtime import durable, width

#: Places of one shop lie no further apart than this, unless a coordinate is wrong.
NEAR_M = 80.0
#: Closer places of like names teach which kinds go together.
SURE_M = 40
#: Rows of one side of a block that one task pairs; a block with more is paired in pieces.
CROWD = 200
#: A name block with more rows on one side gives only the pairs that the rules leave possible.
NAME_CROWD = 24
#: Most iterations of the alternating directions, and the change of a truth at which they end.
STEPS, CLOSE = 60, 0.08
RHO = 8.0
#: Truth of a match.
LEAST = 0.5

# Revised Romanization by position in the syllable; legal forms.
_INITIAL = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
_VOWEL = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
_FINAL = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
_LEGAL = re.compile(r"㈜|\(주\)|\(유\)|주식회사|유한회사|합자회사|\bco\.?,? ?ltd\.?|\binc\.?\b", re.I)
_PARENS = re.compile(r"\(([^()]*)\)")
_LETTERS = re.compile(r"[^0-9a-z]+")


# Finals before a vowel, where they sound as initials, and before h, with which they fuse.
_LINKED = ["", "g", "kk", "gs", "n", "nj", "n", "d", "r", "lg", "lm", "lb", "ls", "lt", "lp", "r", "m", "b", "ps", "s", "ss", "ng", "j", "ch", "k", "t", "p", ""]
_FUSED = {1: "k", 7: "t", 17: "p"}


@lru_cache(maxsize=200_000)
def romanize(s: str) -> str:
    """Hangul to Latin letters with linking between syllables; lower case; signs become spaces."""
    t = unicodedata.normalize("NFKC", s)
    out, fused = [], False
    for i, c in enumerate(t):
        o = ord(c) - 0xAC00
        if not 0 <= o < 11172:
            out.append(c.lower())
            fused = False
            continue
        after = ord(t[i + 1]) - 0xAC00 if i + 1 < len(t) else -1
        initial = after // 588 if 0 <= after < 11172 else -1
        final = o % 28
        out.append(("" if fused else _INITIAL[o // 588]) + _VOWEL[o % 588 // 28])
        fused = initial == 18 and final in _FUSED
        out.append(_FUSED[final] if fused else _LINKED[final] if initial == 11 else _FINAL[final])
    return _LETTERS.sub(" ", unicodedata.normalize("NFKD", "".join(out)).encode("ascii", "ignore").decode()).strip()


def name_forms(s: str | None) -> list[str]:
    """The ways a name is given: outside and inside of parentheses, without legal forms, romanized."""
    if not s:
        return []
    t = _LEGAL.sub(" ", unicodedata.normalize("NFKC", s).replace("㈜", " "))
    t = _LEGAL.sub(" ", t)
    parts = [_PARENS.sub(" ", t), *_PARENS.findall(t)]
    return list(dict.fromkeys(r for r in (romanize(p.strip()) for p in parts) if len(r) > 1))


def _heads(s: str | None) -> list[str]:
    """Romanized beginnings of a name: the first word in each of its forms, cut to four syllables."""
    t = _LEGAL.sub(" ", _LEGAL.sub(" ", unicodedata.normalize("NFKC", s or "")))
    words = [p.split()[0] for p in (_PARENS.sub(" ", t), *_PARENS.findall(t)) if p.split()]
    return sorted({r for r in (romanize(w[:4] if "가" <= w[0] <= "힣" else w) for w in words) if len(r) > 1})


def digits(s: str | None) -> str | None:
    """A telephone number's national digits; None for fewer than 7."""
    d = re.sub(r"\D", "", s or "")
    if (s or "").strip().startswith("+82") or d.startswith("82") and len(d) > 10:
        d = "0" + d[2:].lstrip("0")
    return d if len(d) >= 7 else None


_STREET = re.compile(r"^\s*(\S*?(?:로|길))\s*(\d+(?:-\d+)?)")


def address(s: str | None) -> str | None:
    """Street and number of an address line, without floor or room."""
    m = _STREET.match(unicodedata.normalize("NFKC", s or ""))
    return f"{m.group(1)} {m.group(2)}" if m else None


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        forms = [name_forms(n) for n in b["name"]]
        yield pd.DataFrame(
            {
                "id": b["id"], "kind": b["kind"], "x": b["x"], "y": b["y"], "forms": forms,
                "solid": [sorted({x.replace(" ", "") for x in f}) for f in forms], "branched": [any(_branch(x) for x in f) for f in forms],
                "heads": [_heads(n) for n in b["name"]],
                "addr": [address(a) for a in b["addr"]], "tel": [digits(t) for t in b["tel"]],
            }
        )


CLEAN = "id string, kind string, x double, y double, forms array<string>, solid array<string>, branched boolean, heads array<string>, addr string, tel string"


def clean(df: DataFrame) -> DataFrame:
    """(id, name, kind, x, y, addr, tel), one row per id, to comparable attributes. Null ids are left out; of several rows of an id the first by value counts."""
    one = df.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(F.coalesce("name", F.lit("￿")).alias("k"), "name", "kind", "x", "y", "addr", "tel")).alias("r"))
    ok = lambda c: F.when(~F.isnan(f"r.{c}"), F.col(f"r.{c}")).alias(c)
    return one.select("id", "r.name", "r.kind", ok("x"), ok("y"), "r.addr", "r.tel").mapInPandas(_clean, CLEAN)


def _blocks(side: DataFrame, probe: bool) -> DataFrame:
    """(id, placed, km, solid, block): one row for each block that a record belongs to, with what its pairs in a crowded name block go by."""
    step = [-1, 0, 1] if probe else [0]
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()

    def cells(mark: str, size: float) -> F.Column:
        cell = lambda c, d: (F.floor(F.col(c) / size) + d).cast("string")
        return F.when(placed, F.array(*[F.concat_ws(",", F.lit(mark), cell("x", i), cell("y", j)) for i in step for j in step])).otherwise(F.array().cast("array<string>"))

    keys = F.concat(
        cells("xy", NEAR_M),
        F.array_compact(F.array(F.concat(F.lit("tel,"), "tel"), F.concat(F.lit("addr,"), "addr"))),
        F.transform("heads", lambda h: F.concat(F.lit("name,"), h)),
    )
    return side.select("id", placed.alias("placed"), cells("km", 1000.0).alias("km"), "solid", F.explode(F.array_distinct(keys)).alias("block"))


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (a, b) that share a place cell, telephone, address or beginning of a name.

    A crowded block (more than CROWD rows on a side) is cut into pieces of
    CROWD rows, and every piece of one side meets every piece of the other.
    A crowded name block (more than NAME_CROWD) gives all pairs that can
    become a match: those in the same or a neighbouring cell of 1 km, those
    of which one has no coordinates, in pieces as above, and those of equal
    whole names. Others lie more than NEAR_M apart, so that with names that
    differ at all the rules "far" and "prior" are stronger than "name", "kind"
    and "branch" together; pairs that agree in telephone or address are in
    those blocks.
    """
    ba, bb = _blocks(a, False), _blocks(b, True)
    count = lambda d, n, m: d.groupBy("block").agg(F.count(F.lit(1)).alias(n), F.count_if(~F.col("placed")).alias(m))
    size = count(ba, "na", "ua").join(count(bb, "nb", "ub"), "block")
    crowd = durable(size.where(F.greatest("na", "nb") > F.when(F.col("block").startswith("name,"), NAME_CROWD).otherwise(CROWD)))
    parts = lambda n: F.ceil(F.col(n) / CROWD).cast("int")

    def keyed(blocks: DataFrame, left: bool) -> DataFrame:
        def pieces(mark: str, na: str, nb: str) -> F.Column:
            """The pairs of pieces that the row takes part in."""
            own, other = (parts(na), parts(nb)) if left else (parts(nb), parts(na))
            mine = F.pmod(F.xxhash64("id"), own).cast("string")
            pair = lambda o: F.concat_ws(",", F.lit(mark), *((mine, o.cast("string")) if left else (o.cast("string"), mine)))
            return F.transform(F.sequence(F.lit(1), other), lambda o: pair(o - 1))

        none = F.array().cast("array<string>")
        bare = lambda mark, na, nb, of_left, n: F.when((F.col(n) > 0) & (~F.col("placed") if left == of_left else F.lit(True)), pieces(mark, na, nb)).otherwise(none)
        fine = F.concat("km", F.transform("solid", lambda f: F.concat(F.lit("form,"), f)), bare("bare a", "ua", "nb", True, "ua"), bare("bare b", "na", "ub", False, "ub"))
        sub = F.when(F.col("na").isNull(), F.array(F.lit(""))).when(F.col("block").startswith("name,"), fine).otherwise(pieces("", "na", "nb"))
        return blocks.join(crowd, "block", "left").select("id", "block", F.explode(sub).alias("sub"))

    la, lb = keyed(ba, True).withColumnRenamed("id", "a"), keyed(bb, False).withColumnRenamed("id", "b")
    return la.join(lb, ["block", "sub"]).select("a", "b").distinct()


def _edit(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, by bit vectors: the cells of a column are the bits of a number (Hyyro 2003)."""
    if not a or not b:
        return len(a) + len(b)
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, same, before, distance = every, 0, 0, 0, len(a)
    for c in b:
        here = at.get(c, 0)
        swap = ((~same & here) << 1) & before
        same = ((((here & plus) + plus) ^ plus) | here | minus | swap) & every
        right, left = (minus | ~(same | plus)) & every, same & plus
        distance += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & every, (left << 1) & every
        plus, minus, before = (left | ~(same | right)) & every, right & same, here
    return distance


@lru_cache(maxsize=400_000)
def form_similarity(p: str, q: str) -> float:
    """1 for equal names; else by what is left of the shorter name's words in the longer one, with edits."""
    a, b = p.replace(" ", ""), q.replace(" ", "")
    if a == b:
        return 1.0
    whole = 1 - _edit(a, b) / max(len(a), len(b))
    # the first word is the proper name; what follows is the trade or a branch
    x, y = p.split(" ")[0], q.split(" ")[0]
    if len(x) > len(y):
        x, y = y, x
    n = min(len(x), len(y))
    head = 1 - _edit(x, y[:n]) / max(1, n) if n >= 5 else (1.0 if x == y[:n] else 0.0) * n / 5
    return max(whole, 0.9 * max(0.0, head))


def _edits(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`_edit` of many pairs at once: the bit vectors of all pairs move together. Pairs with a longer text than 63 letters go one by one."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    long = (la > 63) | (lb > 63) | (la == 0) | (lb == 0)
    for i in np.flatnonzero(long):
        out[i] = _edit(a[i], b[i])
    at = np.flatnonzero(~long)
    if not len(at):
        return out
    la, lb = la[at], lb[at]
    # letters in Latin-1 (forms are romanized); shorter texts are filled up
    code = lambda t, n: np.frombuffer("".join(t[i].ljust(n, "\0") for i in at).encode("latin-1", "replace"), np.uint8).reshape(len(at), n)
    x, y = code(a, int(la.max())), code(b, int(lb.max()))
    rows, one = np.arange(len(at)), np.uint64(1)
    masks = np.zeros((len(at), 256), np.uint64)
    for i in range(x.shape[1]):
        masks[rows, x[:, i]] |= np.where(i < la, one << np.uint64(i), np.uint64(0))
    every, last = (one << la.astype(np.uint64)) - one, one << (la.astype(np.uint64) - one)
    plus, distance = every.copy(), la.copy()
    minus, same, before = (np.zeros(len(at), np.uint64) for _ in range(3))
    for j in range(y.shape[1]):
        on = j < lb
        here = np.where(on, masks[rows, y[:, j]], np.uint64(0))
        swap = ((~same & here) << one) & before
        new = ((((here & plus) + plus) ^ plus) | here | minus | swap) & every
        right, left = (minus | ~(new | plus)) & every, new & plus
        distance += np.where(on, (right & last != 0).astype(np.int64) - (left & last != 0), 0)
        right, left = (right << one | one) & every, (left << one) & every
        plus, minus = np.where(on, (left | ~(new | right)) & every, plus), np.where(on, right & new, minus)
        same, before = np.where(on, new, same), np.where(on, here, before)
    out[at] = distance
    return out


def form_similarities(p: list[str], q: list[str]) -> np.ndarray:
    """:func:`form_similarity` of many pairs at once."""
    a, b = [t.replace(" ", "") for t in p], [t.replace(" ", "") for t in q]
    size = np.array([max(len(u), len(v), 1) for u, v in zip(a, b)])
    whole = 1 - _edits(a, b) / size
    heads = [sorted((u.split(" ")[0], v.split(" ")[0]), key=len) for u, v in zip(p, q)]
    n = np.array([len(h[0]) for h in heads])
    start = np.array([h[0] == h[1][: len(h[0])] for h in heads])
    head = np.where(n >= 5, 0.0, np.where(start, n / 5, 0.0))
    some = np.flatnonzero(n >= 5)
    if len(some):
        head[some] = 1 - _edits([heads[i][0] for i in some], [heads[i][1][: n[i]] for i in some]) / n[some]
    return np.where([u == v for u, v in zip(a, b)], 1.0, np.maximum(whole, 0.9 * np.maximum(0.0, head)))


def _branch(form: str) -> str | None:
    """The branch word of a romanized name, if it has one."""
    m = re.search(r" (\w+jeom|bongwan|byeolgwan|\w{4,})$", form)
    return m.group(1) if m and len(form.split(" ")) > 2 else None


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        flat = [(i, p, q) for i, (fa, fb) in enumerate(zip(b["forms_a"], b["forms_b"])) for p in fa for q in fb]
        # names recur from pair to pair: each two forms are measured once
        at: dict[tuple[str, str], int] = {}
        for _, p, q in flat:
            at.setdefault((p, q), len(at))
        found = form_similarities([p for p, _ in at], [q for _, q in at]) if at else np.zeros(0)
        name: list[float | None] = [0.0 if len(fa) and len(fb) else None for fa, fb in zip(b["forms_a"], b["forms_b"])]
        best: list[tuple[str, str] | None] = [None] * len(b)
        for i, p, q in flat:
            s = found[at[p, q]]
            if s > name[i]:
                name[i], best[i] = float(s), (p, q)
        branch = np.zeros(len(b))
        for i, pq in enumerate(best):
            if pq:
                u, v = _branch(pq[0]), _branch(pq[1])
                if u and v:
                    branch[i] = 1.0 if form_similarity(u, v) > 0.7 else -1.0
        yield b[["a", "b", "ka", "kb", "gap", "tel", "addr"]].assign(name=pd.array(name, "Float64"), branch=branch)


def evidence(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, ka, kb, gap, tel, addr, name, branch): distance in metres; 1, -1 or null for equal, unequal or missing telephone and address; name similarity; branch words.

    Left out are pairs of named records with neither telephone nor address in
    common that can't become a match whatever their names and kinds are, and
    those that only equal names could save, and whose names aren't equal.
    Pairs close enough to teach which kinds go together stay.
    """
    agree = lambda c: F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), 1.0).when(F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull(), -1.0).alias(c)
    joined = pairs.join(a.alias("a"), F.col("a") == F.col("a.id")).join(b.alias("b"), F.col("b") == F.col("b.id"))
    gap = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("gap")
    w, no = RULES, F.lit(0.0)
    differ = lambda c, part: F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), w[c] * part).otherwise(no)
    # the slope of the hinges next to 0 if all that isn't known to fail holds: at 0 or less only equal names do
    room = w["kind"] - w["prior"] + F.when(F.col("a.branched") & F.col("b.branched"), w["branch"]).otherwise(no) - differ("tel", 0.5) - differ("addr", 0.6)
    room = room + F.when(gap < NEAR_M, w["near"]).when(gap > NEAR_M, -w["far"]).otherwise(no) + w["name"]
    same = lambda c: F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))
    hopeful = (room > 1e-6) | ((room > -1e-6) & F.arrays_overlap("a.solid", "b.solid")) | F.coalesce(gap < SURE_M, F.lit(False)) | same("tel") | same("addr") | (F.size("a.forms") == 0) | (F.size("b.forms") == 0)
    joined = joined.where(hopeful)
    flat = joined.select("a", "b", F.col("a.kind").alias("ka"), F.col("b.kind").alias("kb"), gap, agree("tel"), agree("addr"), F.col("a.forms").alias("forms_a"), F.col("b.forms").alias("forms_b"))
    # few bytes, much work: adaptive execution would put all into a few tasks
    return flat.repartition(width(flat), "a", "b").mapInPandas(_similar, "a string, b string, ka string, kb string, gap double, tel double, addr double, name double, branch double")


def kind_affinity(seen: DataFrame) -> DataFrame:
    """(ka, kb, affinity in [-1, 1]): which kinds of one list go with which of the other, learnt from pairs that are sure by other attributes.

    Kinds are words of a codebook; there is one row for each pair of kinds met.
    """
    sure = seen.where(f"ka IS NOT NULL AND kb IS NOT NULL AND (tel = 1 OR (addr = 1 AND name > 0.85) OR (name > 0.95 AND gap < {SURE_M}))")
    n = sure.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n"))
    of_a, of_b = Window.partitionBy("ka"), Window.partitionBy("kb")
    share = F.greatest(F.col("n") / F.sum("n").over(of_a), F.col("n") / F.sum("n").over(of_b))
    return n.select("ka", "kb", F.when(share > 0.1, 1.0).when(share > 0.03, 0.0).otherwise(-0.5).alias("affinity"))


#: Weights of the rules on the truth m of a match. A rule for it with the body b is the hinge w max(0, b - m), one against it w max(0, m - (1 - b)).
RULES = {
    "name": 3.0,  # like names
    "tel": 3.5,
    "addr": 2.3,
    "near": 1.2,
    "kind": 1.2,
    "branch": 1.6,
    "far": 2.5,  # against: beyond NEAR_M, unless coordinates are wrong
    "prior": 3.3,  # against: any two records
}
#: Rules for a match and their weights; rules against it and theirs.
FOR = {"name": RULES["name"], "tel": RULES["tel"], "addr": RULES["addr"], "near": RULES["near"], "kind": RULES["kind"], "branch": RULES["branch"]}
AGAINST = {"name": RULES["name"] * 1.5, "tel": RULES["tel"] * 0.5, "addr": RULES["addr"] * 0.6, "far": RULES["far"], "kind": RULES["kind"], "branch": RULES["branch"], "prior": RULES["prior"]}
_WEIGHTS = np.array([*FOR.values(), *AGAINST.values()])
_N = len(FOR)


def rules(seen: DataFrame, affinity: DataFrame) -> DataFrame:
    """(a, b, bodies): the truths, in [0, 1], of the bodies of the grounded rules: those of FOR, then those of AGAINST. A body that nothing is known of is 0."""
    s = seen.join(F.broadcast(affinity), ["ka", "kb"], "left")  # a row for each two words of the codebooks
    name, gap = F.col("name"), F.col("gap")
    kind = F.when(F.col("ka").isNull() | F.col("kb").isNull(), 0.0).otherwise(F.coalesce("affinity", F.lit(-1.0)))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    pro = [(name - 0.6) / 0.4, F.col("tel"), F.col("addr"), 1 - gap / NEAR_M, kind, F.col("branch")]
    con = [(0.6 - name) / 0.6, -F.col("tel"), -F.col("addr"), (gap > NEAR_M).cast("double"), -kind, -F.col("branch"), F.lit(1.0)]
    return s.select("a", "b", F.array(*[unit(x) for x in (*pro, *con)]).alias("bodies"))


def _least_loss(bodies: np.ndarray, at: np.ndarray | None = None, rho: float = 0.0) -> np.ndarray:
    """Row by row the m in [0, 1] that minimises the rules' hinges, plus rho / 2 (m - at)^2; the least one of equals.

    The slope grows with m and is a step function between the hinges' ends,
    so the minimum is found among those ends and, between them, where the
    quadratic term meets the step.
    """
    n = len(bodies)
    ends = np.concatenate([bodies[:, :_N], 1 - bodies[:, _N:], np.zeros((n, 1)), np.ones((n, 1))], axis=1)
    order = np.argsort(ends, axis=1)
    ends = np.take_along_axis(ends, order, axis=1)
    # past its end a rule for the match no longer pulls and one against it begins to; both add the weight to the slope
    w = np.concatenate([_WEIGHTS, [0.0, 0.0]])[order]
    slope = np.cumsum(w, axis=1) - _WEIGHTS[:_N].sum()  # right of each end
    if at is None or not rho:
        first = (slope >= -1e-9).argmax(axis=1)
        return np.clip(ends[np.arange(n), first], 0.0, 1.0)
    left = np.concatenate([np.full((n, 1), -_WEIGHTS[:_N].sum()), slope[:, :-1]], axis=1)
    # the least end at which the slope right of it, quadratic term included, isn't negative
    first = (slope + rho * (ends - at[:, None]) >= 0).argmax(axis=1)
    rows = np.arange(n)
    none = ~(slope + rho * (ends - at[:, None]) >= 0).any(axis=1)
    inside = at - left[rows, first] / rho  # the minimum left of that end, if it lies there
    return np.clip(np.where(none, at - slope[:, -1] / rho, np.minimum(ends[rows, first], inside)), 0.0, 1.0)


def _grid(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(_WEIGHTS))


def solve(grounded: DataFrame, steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """(a, b, truth, gain): the most probable truths under the rules, exclusivity and transitivity, by alternating directions.

    Minimises the sum of all rules' hinges over m in [0, 1] with, for each
    record, the truths of its matches adding up to 1 at most. That is
    exclusivity. Transitivity, m(a, b) + m(a', b) - 1 <= same(a, a'), has the
    same constraint: ids of one list stand for different places, so
    same(a, a') is 0, and the sum over all candidates of b is the stronger
    bound. Where a pair's own rules are least at 0 it stays 0 in the joint
    optimum too, since constraints only press down; such pairs are left out.
    So are pairs that are their records' only one, which no constraint
    touches: their own optimum is their truth.

    For the rest each constraint keeps a copy of the truths it touches, and so
    do the rules. A record's copies give up an equal part of what is over 1,
    the rules' step is :func:`_least_loss`, and the copies are averaged. Sums
    per record are aggregates that combine before the shuffle, joined back, so
    a record with very many candidates needs no task of its own. Ends when no
    truth moves and no copy differs by more than ``close``, or after ``steps``.
    """

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = _grid(b, "bodies")
            m = _least_loss(bodies)
            keep = pa.array(m > 0)
            gain = bodies[:, :_N] @ _WEIGHTS[:_N] - bodies[:, _N:] @ _WEIGHTS[_N:]
            yield pa.RecordBatch.from_arrays([*[c.filter(keep) for c in (b.column("a"), b.column("b"), b.column("bodies"), pa.array(gain), pa.array(m))]], names=["a", "b", "bodies", "gain", "m"])

    own = durable(grounded.select("a", "b", "bodies").mapInArrow(alone, "a string, b string, bodies array<double>, gain double, m double"))
    per = lambda k: own.groupBy(k).agg(F.count(F.lit(1)).alias(f"n{k}"))
    own = durable(own.join(per("a"), "a").join(per("b"), "b"))
    free = (F.col("na") == 1) & (F.col("nb") == 1)
    zero = F.lit(0.0)
    # adaptive execution makes as few partitions as the contested pairs need
    z = durable(own.where(~free).repartition("a").select("a", "b", "bodies", "gain", "m", zero.alias("ua"), zero.alias("ub"), zero.alias("ur"), zero.alias("apart")))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ua, ub, ur, oa, ob = (b.column(c).to_numpy(zero_copy_only=False) for c in ("m", "ua", "ub", "ur", "oa", "ob"))
            xa, xb = m - ua - oa, m - ub - ob
            xr = _least_loss(_grid(b, "bodies"), m - ur, RHO)
            new = np.clip((xa + ua + xb + ub + xr + ur) / 3, 0.0, 1.0)
            apart = np.max(np.abs([new - m, xa - new, xb - new, xr - new]), axis=0) if b.num_rows else new
            out = [new, ua + xa - new, ub + xb - new, ur + xr - new, apart]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("bodies"), b.column("gain"), *map(pa.array, out)], names=["a", "b", "bodies", "gain", "m", "ua", "ub", "ur", "apart"])

    def over(k: str) -> DataFrame:
        v = F.col("m") - F.col(f"u{k}")
        return z.groupBy(k).agg((F.greatest(F.lit(0.0), F.sum(v) - 1) / F.count(F.lit(1))).alias(f"o{k}"))

    for _ in range(steps):
        # each step reads the last one three times, so it is written
        z = durable(z.join(over("a"), "a").join(over("b"), "b").select(*z.columns, "oa", "ob").mapInArrow(step, z.schema))
        if (z.agg(F.max("apart")).first()[0] or 0.0) <= close:
            break
    return own.where(free).select("a", "b", F.col("m").alias("truth"), "gain").unionByName(z.select("a", "b", F.col("m").alias("truth"), "gain"))


def matches(a: DataFrame, b: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, confidence) of the records of two lists that stand for the same place; each record at most once.

    ``a`` and ``b`` have (id, name, kind, x, y, addr, tel), coordinates in one
    projection. Names are compared in all their forms and in Latin letters, so
    that scripts don't matter. What goes with what among the kinds is learnt
    from pairs that other attributes make sure. Nulls are no evidence in
    either direction; a record with nothing but an id has no candidates.
    Ties go to the pair with the greater gain and then the lesser ids.
    """
    ca, cb = durable(clean(a)), durable(clean(b))
    seen = durable(evidence(durable(candidates(ca, cb)), ca, cb))
    solved = durable(solve(rules(seen, kind_affinity(seen))).where(F.col("truth") >= least))
    first = lambda k: solved.groupBy(F.col(k).alias("k")).agg(F.min(F.struct(-F.col("truth"), -F.col("gain"), "a", "b")).alias("f")).select("f.a", "f.b")
    return solved.join(first("a"), ["a", "b"]).join(first("b"), ["a", "b"]).select("a", "b", F.round("truth", 4).alias("confidence"))
