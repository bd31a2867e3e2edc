"""Language identification: known words first, character n-grams for the others.

For each language the model has log frequencies of words and of character
n-grams (of words with a blank on either side). A word that some language knows
scores by its frequency in each one; a word that none knows falls back to
6-grams, and on to shorter ones until one of its n-grams is known, and scores by
their mean. A language that lacks what others know gets a fixed penalty. A text
scores by the mean over its words; the least sum wins.

The model is fitted on a bounded sample (``SAMPLE`` texts expected for each
language, by a hash of the id) and holds what occurs ``LEAST`` times in it, so
that what is broadcast is bounded as well. Every text is scored whole.

Defined results: null text, or text without a letter, is ``und`` with score 0, as
is every text when nothing could be learned; equal texts score equally; ties go to
the language first in order; repeated rows repeat; empty tables stay empty.
Columns named like the results are replaced, others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestead.llm.frames import map_batches
from lodestead.llm.words import hash_words, mix, rows_by_bytes, utf8

#: Texts of each language that the model is fitted on, expected.
SAMPLE = 1500
#: Occurrences in the sample from which a word or an n-gram is kept.
LEAST = 2
LONGEST = 6
PENALTY = 7.0
#: Words beyond which more of them don't make the score surer.
SURE_WORDS = 8
UNKNOWN = "und"

#: What separates words: ASCII that is no letter. Other scripts' bytes count as letters here.
_SPLITS = np.ones(256, bool)
_SPLITS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    #: For words (0) and each length of n-grams: sorted hashes and a row of costs by language.
    grams: dict[int, tuple[np.ndarray, np.ndarray]]


def _lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([(t or "").lower() for t in texts], pa.large_string()))


def _ngrams(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams, and the word that each is from."""
    text = " " + "  ".join(w.decode("utf-8", "replace") for w in words) + " "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = points == 32
    # every word is preceded by one blank of its own and followed by one
    opens = np.flatnonzero(blank & np.append(~blank[1:], False))
    owner = np.cumsum(np.bincount(opens, minlength=len(points))) - 1
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(points) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + points[i : m + i])
    same = owner[:m] == owner[n - 1 :] if n > 1 else ~blank
    return out[same], owner[:m][same]


def _each_word(raw: np.ndarray, offsets: np.ndarray):
    words = hash_words(raw, offsets, _SPLITS, None, spans=True)
    distinct, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    return words, distinct, first, back


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> Model:
    """Learn from the texts whose ``label`` is not null."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {})
    shares = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 20)) < shares[F.col(label)] * (1 << 20)
    rows = known.where(drawn).select(F.col(label).alias("lang"), F.col("text").cast("string").alias("text"))

    def work(batches):
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                raw, offsets = _lowered([t for t, own in zip(texts, langs) if own == lang])
                words, distinct, first, back = _each_word(raw, offsets)
                if not len(distinct):
                    continue
                counts = np.bincount(back)
                yield {"lang": [lang] * len(distinct), "n": np.zeros(len(distinct), np.int32), "gram": distinct.view(np.int64), "count": counts}
                pieces = [raw[a:b].tobytes() for a, b in zip(words.starts[first], words.ends[first])]
                for n in range(1, LONGEST + 1):
                    grams, owner = _ngrams(pieces, n)
                    if len(grams):
                        grams, at = np.unique(grams, return_inverse=True)
                        yield {"lang": [lang] * len(grams), "n": np.full(len(grams), n, np.int32), "gram": grams.view(np.int64), "count": np.bincount(at, counts[owner]).astype(np.int64)}

    counted = map_batches(rows, work, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    totals = {(r["lang"], r["n"]): r["total"] for r in counted.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()}
    kept = counted.where(F.col("count") >= least).toArrow()
    lang = np.array([languages.index(x) for x in kept["lang"].to_pylist()], np.int64)
    size, gram, count = (kept[c].to_numpy() for c in ("n", "gram", "count"))
    grams = {}
    for n in range(LONGEST + 1):
        own = size == n
        keys, row = np.unique(gram[own].astype(np.int64).view(np.uint64), return_inverse=True)
        costs = np.full((len(keys), len(languages)), PENALTY, np.float32)
        total = np.array([totals.get((x, n), 1) for x in languages], float)
        costs[row, lang[own]] = -np.log10(count[own] / total[lang[own]])
        grams[n] = keys, costs
    return Model(languages, grams)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, -1 if it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def costs(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lower-cased text the mean cost in each language, and the number of words."""
    words, distinct, first, back = _each_word(raw, offsets)
    keys, table = model.grams[0]
    at = _find(keys, distinct)
    each = np.full((len(distinct), len(model.languages)), PENALTY, np.float32)
    each[at >= 0] = table[at[at >= 0]]
    left = np.flatnonzero(at < 0)
    pieces = [raw[a:b].tobytes() for a, b in zip(words.starts[first[left]], words.ends[first[left]])]
    for n in range(LONGEST, 0, -1):
        if not len(left):
            break
        grams, owner = _ngrams(pieces, n)
        keys, table = model.grams[n]
        at = _find(keys, grams)
        hit = at >= 0
        found = np.bincount(owner[hit], minlength=len(left))
        some = found > 0
        for j in range(len(model.languages)):
            total = np.bincount(owner[hit], table[at[hit], j], minlength=len(left))
            each[left[some], j] = total[some] / found[some]
        pieces = [p for p, s in zip(pieces, some) if not s]
        left = left[~some]
    sums = np.zeros((len(words.hashes) + 1, len(model.languages)))
    np.cumsum(each[back], axis=0, out=sums[1:])
    n_words = np.diff(words.bounds)
    return (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / np.maximum(1, n_words)[:, None], n_words


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row with its language and the score from 0 to 1 of that language among the learned ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (out, score)]
    place = names.index(text)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])

    def work(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            with_letter = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
            if model.languages and with_letter.any():
                rows = np.flatnonzero(with_letter)
                raw, offsets = _lowered([texts[i] for i in rows])
                for a, b in rows_by_bytes(offsets):
                    cost, n = costs(model, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    gap = (cost - cost.min(axis=1)[:, None]) * np.minimum(n, SURE_WORDS)[:, None]
                    sure[rows[a:b]] = 1 / (10.0**-gap).sum(axis=1)
                    for i, j in zip(rows[a:b], cost.argmin(axis=1)):
                        found[i] = model.languages[j]
            yield {**{c: batch.column(i) for i, c in enumerate(names)}, out: found, score: sure}

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in names]), work, schema)
