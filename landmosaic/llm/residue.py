"""Template residue, filler and error-page texts, by a positive-unlabelled naive Bayes model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.runtime import durable

CLASSES = ("normal", "slot", "filler", "error")
#: Features are hashed to so many buckets, half of them for Hangul passages and half for others: a model takes 4 MB at any size of the corpus.
BUCKETS = 1 << 18
HALF = BUCKETS // 2
#: Share of the script's word distribution in that of each class. A sentence with a placeholder is else like any other, so that class has more.
MIX = (0.3, 0.6, 0.3, 0.3)
ROUNDS = 4
#: A trusted error record is no longer than this and no passage of it is code.
SHORT = 200
#: A text longer than this doesn't teach the model what an error message is like; it is judged like any other.
LONG = 280

# Shapes of placeholders, openings of error messages, words of filler.
_NAME = r"(?:[A-Za-z][A-Za-z_0-9]*(?:[ .][A-Za-z_0-9]+){0,4}|[가-힣]+(?: [가-힣]+){0,3}|[0-9])"
_WORDY = r"(?:[A-Za-z][A-Za-z_0-9]*(?:[ .][A-Za-z_0-9]+){0,4}|[가-힣]+(?: [가-힣]+){0,3})"
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%=?\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|[$#]\{{\s*{_NAME}\s*\}}|\{{\s*{_NAME}\s*\}}|\[\[\s*{_WORDY}\s*\]\]|\[\s*{_WORDY}\s*\]"
    rf"|<<\s*{_WORDY}\s*>>|<\s*{_WORDY}\s*>|&lt;\s*{_WORDY}\s*&gt;|__{_WORDY}__|@@{_WORDY}@@|\$[A-Za-z][A-Za-z_0-9]*\$|%\({_WORDY}\)[sd]|%[A-Za-z][A-Za-z_0-9]*%|%[sd]\b|【\s*{_WORDY}\s*】|\([가-힣]+ 적을 것\)"
)
_SLOTTY = re.compile(r"[{\[<@$【%]|&lt;|__|적을 것")
_FENCE = re.compile(r"```.*?(?:```|$)", re.S)
_QUOTED = re.compile(r"‘[^’\n]{1,200}’|“[^”\n]{1,200}”|\"[^\"\n]{1,200}\"|`[^`\n]{1,200}`|「[^」\n]{1,200}」")
_QUOTE = re.compile(r"[‘“\"`「]")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?。)])\s+|\s+\|\s+|\t+")
_BULLET = re.compile(r"^(?:[-*•#>|]+\s+|\d+\)\s+)+")
_WORD = re.compile(r"(?:[^\W\d_]|')+|\d+|[^\s\w]|_+")
_DIGITS = re.compile(r"\d+")
_HANGUL = re.compile(r"[가-힣ㄱ-ㆎ]")
_STATUS = re.compile(r"^\W*[45]\d\d\s*[|:–-]|^\W*(?:http(?: status)?|error)\s+[45]\d\d\b|^\W*(?:fatal error|keyerror|traceback|error \[)|^\W*file \"[^\"]+\", line")
_STATUS_WORDS = re.compile(r"[45]\d\d|error|traceback|file \"")
_SCRIPT = re.compile(r"(?:javascript|scripting|scripts|\bjs\b).*(?:required|disabled|switched on|\bbefore\b|without|허용|켜야)|(?:enable|allow|requires|without)\b.*(?:javascript|scripting|scripts|\bjs\b)|(?:자바스크립트|스크립트|javascript).*(?:허용해야|켜야|꺼져)")
_FILLER = re.compile(r"lorem ipsum|\basdf\b|\bqwer\b|\bzxcv\b|ㅁㄴㅇㄹ|가나다 가나다|텍스트 텍스트|\btext text\b|your text (?:goes )?here|입력하세요|예시 문구|샘플 텍스트|blah blah|xxxx xxxx|placeholder description|replace this paragraph|dummy text")
#: The words that stand for a placeholder, for one in quotes, and for one in code.
_MARKS = {"qxslotxq", "qxquotexq", "qxgluedxq"}


@lru_cache(maxsize=400_000)
def _hash(s: str, half: int = 0) -> int:
    return half * HALF + xxhash.xxh3_64_intdigest(s) % HALF


#: Buckets of words by half, kept between texts; beyond WORD_STORE words the store starts anew, which changes no result.
WORD_STORE = 400_000
_word_buckets: tuple[dict[str, int], dict[str, int]] = ({}, {})


def _buckets(words: set[str], half: int) -> set[int]:
    """The buckets of plain words."""
    known = _word_buckets[half]
    if len(known) > WORD_STORE:
        known.clear()
    out = set()
    for w in words:
        at = known.get(w)
        if at is None:
            at = known[w] = half * HALF + xxhash.xxh3_64_intdigest("w " + w) % HALF
        out.add(at)
    return out


def _words(t: str, quotes: bool = True) -> list[str]:
    """Lower-case words and signs, digits alike. Words in quotes are marked: they are spoken of, not used."""
    t = _DIGITS.sub("0", t.lower())
    if not quotes or not _QUOTE.search(t):
        return _WORD.findall(t)
    out, at = [], 0
    for q in _QUOTED.finditer(t):
        out += _WORD.findall(t[at : q.start()]) + ["q " + x for x in _WORD.findall(q.group())]
        at = q.end()
    return out + _WORD.findall(t[at:])


def passages(text: str | None) -> list[dict]:
    """The passages of a text: {feats, seed, n, slots, fills, long, of}.

    ``feats`` are hashed features, ``seed`` the trusted class (0: none), ``n``
    the number of words. Placeholder shapes become one word; one in quotes, in
    a code fence or glued to a path or a program's word is another word, since
    such texts quote or hold code. ``slots`` has, for each open placeholder, a
    hash of its neighbour words, ``fills`` one of its own string; ``of`` is a
    hash of the text.
    """
    if text is None or not text.strip():
        return []
    body = _FENCE.sub(" code ", text) if "```" in text else text
    raw = [p for p in (_BULLET.sub("", q.strip()) for q in _CUT.split(body)) if p]
    seen: dict[str, int] = {}
    for p in raw:
        seen[p] = seen.get(p, 0) + 1
    out = []
    # what the whole text lacks, no passage of it has
    whole = body.lower()
    slotty, quotes, hangul = _SLOTTY.search(body) is not None, _QUOTE.search(body) is not None, _HANGUL.search(body) is not None
    filler, status = _FILLER.search(whole) is not None, _STATUS_WORDS.search(whole) is not None
    script = "script" in whole or "js" in whole or "스크립트" in whole
    for p in raw:
        t, found = p, []
        if slotty and _SLOTTY.search(p):
            quoted = [m.span() for m in _QUOTED.finditer(p)]

            def mark(m: re.Match, p: str = p, quoted: list = quoted, found: list = found) -> str:
                a, z = m.span()
                before, after = p[a - 1 : a], p[z : z + 1]
                glued = (bool(before) and (before in "/_=\\\"'" or (before.isascii() and before.isalnum()))) or (bool(after) and (after in "/_=\\" or (after.isascii() and after.isalnum())))
                kind = "quote" if any(x <= a and z <= y for x, y in quoted) else "glued" if glued else "slot"
                if kind == "slot":
                    found.append(m.group())
                return f" qx{kind}xq "

            t = SLOT.sub(mark, p)
        words = _words(t, quotes)
        half = 0 if hangul and _HANGUL.search(t) else 1
        feats: set[str] = set()
        slots, k = [], 0
        if t is not p:
            for i, w in enumerate(words):
                if w in _MARKS:
                    left, right = words[i - 1] if i else "^", words[i + 1] if i + 1 < len(words) else "$"
                    feats |= {f"l {left} {w}", f"r {w} {right}"}
                    if w == "qxslotxq" and k < len(found):
                        slots.append((xxhash.xxh3_64_intdigest(f"{half} {left} {right}") >> 1, xxhash.xxh3_64_intdigest(found[k].strip()) >> 1))
                        k += 1
        plain = [w for w in words if w.isalpha()]
        if len(plain) >= 3 and len(set(plain)) * 2 <= len(plain):
            feats.add("repeated words")
        if seen[p] > 1 and len(plain) >= 2:
            feats.add("repeated passage")
        seed = 0
        if filler or status or script:
            low = p.lower()
            bare = _QUOTED.sub(" ", low) if quotes else low
            seed = 2 if filler and _FILLER.search(bare) else 3 if (status and _STATUS.search(low)) or (script and _SCRIPT.search(bare)) else 0
        out.append({"feats": sorted(_buckets(set(words), half).union(_hash(f, half) for f in feats)), "seed": seed, "n": len(plain), "slots": [a for a, _ in slots], "fills": [z for _, z in slots]})
    page = len(text) <= SHORT and "```" not in text and any(o["seed"] == 3 for o in out)
    of = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1
    for o in out:
        o["long"], o["of"] = len(text) > LONG, of
        if o["seed"] == 3 and not page:
            o["seed"] = 0
        elif not o["seed"] and page and not o["slots"]:
            o["seed"] = 3
    return out



_PASSAGE = pa.schema([("key", pa.int64()), ("seed", pa.int8()), ("n", pa.int32()), ("feats", pa.list_(pa.int32())), ("slots", pa.list_(pa.int64())), ("fills", pa.list_(pa.int64())), ("long", pa.bool_()), ("of", pa.int64())])
_CUT_SCHEMA = "key bigint, seed tinyint, n int, feats array<int>, slots array<bigint>, fills array<bigint>, long boolean, of bigint"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lists(values: list[list[int]], kind: type) -> pa.Array:
        at = np.zeros(len(values) + 1, np.int32)
        np.cumsum([len(v) for v in values], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.fromiter(chain.from_iterable(values), kind, at[-1])))

    for big in batches:
        for start in range(0, big.num_rows, 512):
            b = big.slice(start, 512)
            rows, keys = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = passages(t)
                rows += found
                keys += [k] * len(found)
            made = {f.name: lists([r[f.name] for r in rows], f.type.value_type.to_pandas_dtype()) if pa.types.is_list(f.type) else pa.array(keys if f.name == "key" else [r[f.name] for r in rows], f.type) for f in _PASSAGE}
            yield pa.RecordBatch.from_arrays(list(made.values()), schema=_PASSAGE)


def in_context(cut: DataFrame) -> DataFrame:
    """(key, seed, n, feats, long, some, varied, fixed) of all passages.

    ``some``: it has an open placeholder. ``varied``: differing strings stand
    elsewhere between the same neighbour words as one of its placeholders.
    What fills a template's gap varies, so such a passage is trusted.
    ``fixed``: each of its placeholders is the one string that recurs there in
    several distinct texts. That may be a way of speaking or a form letter: it
    doesn't teach the model what a placeholder's sentence is like, but is
    judged by it. Copies of a text count once. Only passages with
    placeholders, which are few, are grouped and joined.
    """
    slotted = durable(cut.where(F.size("slots") > 0).withColumn("pid", F.monotonically_increasing_id()))
    each = slotted.select("pid", "of", F.explode(F.arrays_zip("slots", "fills")).alias("s")).select("pid", "of", "s.slots", "s.fills")
    seen = each.groupBy("slots").agg(F.countDistinct("of").alias("texts"), F.countDistinct("fills").alias("kinds"))
    seen = seen.select("slots", (F.col("kinds") >= 4).alias("varied"), ((F.col("texts") >= 4) & (F.col("kinds") == 1)).alias("fixed"))
    flags = each.join(seen, "slots").groupBy("pid").agg(F.max("varied").alias("varied"), F.min("fixed").alias("fixed"))
    names = ["key", "seed", "n", "feats", "long"]
    marked = durable(slotted.join(flags, "pid").select(*names, F.lit(True).alias("some"), "varied", "fixed"))
    no = F.lit(False)
    return cut.where(F.size("slots") == 0).select(*names, no.alias("some"), no.alias("varied"), no.alias("fixed")).unionByName(marked)


def _posterior(b: pa.RecordBatch, model: np.ndarray | None, prior: np.ndarray | None, training: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, passage of each feature, class probabilities of each passage)."""
    n = b.num_rows
    flag = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(bool)
    lists = b.column("feats")
    feats, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    seed = b.column("seed").to_numpy(zero_copy_only=False).astype(int)
    seed = np.where((seed == 0) & flag("varied"), 1, seed)
    if model is None:
        p = np.zeros((n, len(CLASSES)))
        p[:, 0] = 1
    else:
        score = np.stack([np.bincount(row, weights=m[feats], minlength=n) for m in model], axis=1)
        half = np.zeros(n, int)
        half[row] = feats // HALF
        score += prior[half]
        # no unfilled placeholder without an open one; long texts teach no errors, but are judged
        score[~flag("some") | (flag("fixed") & training), 1] = -np.inf
        if training:
            score[flag("long"), 3] = -np.inf
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
    if training:  # trusted passages teach; they are judged like all others
        known = seed > 0
        p[known] = 0
        p[known, seed[known]] = 1
    return feats, row, p


def learn(cut: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximization: (log P(feature | class) by class and bucket, log P(class) by script and class).

    Trusted passages keep their class; all others start as normal and get the
    classes' posterior in each round. The counts of a round are summed per
    bucket over the whole corpus; what reaches the driver is one row for each
    of the BUCKETS at most.
    """
    spark = cut.sparkSession
    model = prior = None
    trusted = np.ones((2, len(CLASSES)), dtype=bool)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((model, prior))

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(CLASSES), BUCKETS + 2))
            for b in batches:
                if not b.num_rows:
                    continue
                feats, row, p = _posterior(b, *held.value, training=True)
                half = np.zeros(b.num_rows, int)
                half[row] = feats // HALF
                for c in range(len(CLASSES)):
                    total[c, :BUCKETS] += np.bincount(feats, weights=p[row, c], minlength=BUCKETS)
                    total[c, BUCKETS:] += np.bincount(half, weights=p[:, c], minlength=2)
            at = np.flatnonzero(total.any(axis=0))
            for part in np.array_split(at, max(1, len(at) // 8192)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[pa.array(total[c, part]) for c in range(len(CLASSES))]], names=["f", *CLASSES])

        summed = cut.mapInArrow(count, "f bigint, " + ", ".join(f"{c} double" for c in CLASSES)).groupBy("f").agg(*[F.sum(c).alias(c) for c in CLASSES])
        got = summed.toPandas()
        n = np.zeros((len(CLASSES), BUCKETS + 2))
        n[:, got["f"].to_numpy(dtype=int)] = got[list(CLASSES)].to_numpy().T
        mix = np.array(MIX)[:, None]
        model = np.zeros((len(CLASSES), BUCKETS), dtype=np.float32)
        prior = np.zeros((2, len(CLASSES)))
        for h in range(2):
            words, docs = n[:, h * HALF : (h + 1) * HALF], n[:, BUCKETS + h]
            background = (words.sum(axis=0) + 0.1) / (words.sum() + 0.1 * HALF)
            model[:, h * HALF : (h + 1) * HALF] = np.log((1 - mix) * words / np.maximum(words.sum(axis=1, keepdims=True), 1e-9) + mix * background)
            # a class that has no trusted passage in a script would be made of nothing
            trusted[h] = trusted[h] & (docs > 0)
            prior[h] = np.where(trusted[h], np.log((docs + 0.5) / (docs.sum() + 0.5 * len(CLASSES))), -np.inf)
            prior[h, 0] = np.log((docs[0] + 0.5) / (docs.sum() + 0.5 * len(CLASSES)))
    return model, prior


def residue_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, score) of every record whose text is residue, filler or an error page.

    ``kind`` is the class with most to say. A record is a case if a passage
    holds an unfilled placeholder or is filler (probability of at least 0.5),
    or if its passages of error messages and notices have more words than all
    normal passages together, page furniture of a few words aside. Every
    passage of every text counts. Null, empty and blank texts are no cases and
    never come out; texts repeated under other keys are judged alike; of rows
    that share a key the passages are judged together, and null keys are left
    out. With no trusted passage at all nothing comes out.
    """
    slim = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    cut = in_context(durable(slim.mapInArrow(_cut, _CUT_SCHEMA)))
    model, prior = learn(cut)
    held = df.sparkSession.sparkContext.broadcast((model, prior))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, _, p = _posterior(b, *held.value)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), *[pa.array(p[:, c]) for c in range(len(CLASSES))]], names=["key", "n", *CLASSES])

    judged = cut.mapInArrow(judge, "key bigint, n int, " + ", ".join(f"{c} double" for c in CLASSES))
    is_error = (F.col("error") >= 0.5).cast("int")
    long_ = ((F.col("error") < 0.5) & (F.col("n") >= 5)).cast("int")
    per = judged.groupBy("key").agg(
        F.max("slot").alias("slot"), F.max("filler").alias("filler"), F.max("error").alias("error"), F.sum(is_error * F.greatest("n", F.lit(1))).alias("bad"), F.sum(long_ * F.col("n")).alias("good")
    )
    page = (F.col("error") >= 0.5) & (F.col("bad") > F.col("good"))
    kind = F.when(F.col("slot") >= 0.5, "placeholder").when(F.col("filler") >= 0.5, "filler").when(page, "error page")
    return per.withColumn("kind", kind).where("kind IS NOT NULL").select(F.col("key").alias(key), "kind", F.greatest("slot", "filler", F.when(page, F.col("error")).otherwise(0.0)).alias("score"))
