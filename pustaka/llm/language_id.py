"""The language of texts, and of each stretch of a text that mixes languages.

Hierarchical discrimination. A first classifier tells language families apart; within a family, linear support vector
machines separate the languages one against one, and the language that wins most of its duels is taken. Features are
hashed character n-grams of words, averaged over a stretch, so that the score of a stretch is the mean of scores of its
words, which are kept by word. The languages are en, hi, mr, bn and ta, in whatever script they are written.

A text is cut where the script changes for four words or more and at the ends of sentences; neighbouring stretches of
one language are one segment.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = {"germanic": ("en",), "indo-aryan": ("bn", "hi", "mr"), "dravidian": ("ta",)}
FAMILY_OF = {x: f for f, xs in FAMILIES.items() for x in xs}
#: Features, n-gram lengths, words that a segment has at least, and the bounds of the sample of labelled rows that is fitted.
DIMS, GRAMS, LEAST_WORDS = 1 << 13, (1, 2, 3, 4), 4
MOST_CHECKED, MOST_LABELLED, MOST_STRETCHES = 1000, 1200, 6000

#: Notes and question numbers, which belong to no language.
_NOTES = re.compile(
    r"(?im)[(\[]\s*(?:answer\s+in\s+)?\d+\s*(?:words?|marks?|m)\b[^)\]]*[)\]]\s*\d*|\b\d+\s*(?:words|marks|m)\b|^\s*(?:q(?:uestion)?\s*\.?\s*)?\d{1,3}\s*(?:\([a-z]\)|[.):\-])+|^\s*q(?:uestion)?\s*\.?\s*\d{1,3}\s*(?:\([a-z]\))?\s*[.):]?"
)
_WORD = re.compile(r"[^\W\d_](?:[^\W_]|[ऀ-෿‌‍'’])*")
_END = re.compile(r"[.?!।॥]+[\"”’)\]]*(?:\s+|$)|\s*\|\|\s*|\s+/\s+|\n\s*\n")


def script(word: str) -> str:
    """The script of a word's first letter: a block of 128 characters for the Indic scripts, else Latin or other."""
    o = ord(word[0])
    return f"{o >> 7:x}" if 0x900 <= o < 0xE00 else "latin" if o < 0x250 else "other"


def word_features(word: str) -> np.ndarray:
    """The places of a word's n-grams among the features, the whole word among them."""
    w = f"<{word.lower()}>"
    grams = [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)] + [w]
    return np.array([zlib.crc32(g.encode()) % DIMS for g in grams], np.int64)


def _vector(words: list[str]) -> np.ndarray:
    x = np.zeros(DIMS, np.float32)
    for w in words:
        at = word_features(w)
        np.add.at(x, at, 1.0 / len(at))
    return x / max(np.linalg.norm(x), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-3, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of a linear support vector machine for classes 1 and -1, by averaged subgradient steps that weigh the classes alike."""
    if not len(y):
        return np.zeros(x.shape[1], np.float32)
    rng = np.random.default_rng(seed)
    cost = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-6), 0.5 / max((y < 0).mean(), 1e-6))
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(order) // 16)):
            t += 1
            miss = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - 1 / (t + 1)
            if len(miss):
                w += (cost[miss] * y[miss]) @ x[miss] / (lam * (t + 1) * len(part))
            mean += (w - mean) / t
    return mean.astype(np.float32)


class Model:
    """Families first, then duels within the family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        fam = np.array([FAMILY_OF[g] for g in langs])
        lang = np.array(langs)
        sign = lambda a: np.where(a, 1.0, -1.0)
        self._set(None)
        w = [fit_svm(x, sign(fam == f)) for f in self.families]
        for a, b in self.duels:
            rows = (lang == a) | (lang == b)
            w.append(fit_svm(x[rows], sign(lang[rows] == a)))
        self.weights = np.stack(w, 1)

    def _set(self, weights: np.ndarray | None) -> None:
        self.families = list(FAMILIES)
        self.duels = [(a, b) for f in FAMILIES.values() for a, b in combinations(f, 2)]
        self.weights = weights
        self.known: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, weights: np.ndarray) -> Model:
        """The model that has these weights."""
        out = cls.__new__(cls)
        out._set(weights)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The mean of the words' scores in every classifier."""
        total = np.zeros(self.weights.shape[1], np.float32)
        for w in words:
            s = self.known.get(w)
            if s is None:
                at = word_features(w)
                s = self.weights[at].sum(0) / len(at)
                if len(self.known) < 500_000:
                    self.known[w] = s
            total += s
        return total / max(len(words), 1)

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The language of some words and a confidence between 0 and 1."""
        s = self.words(words) * np.sqrt(len(words))
        f = int(np.argmax(s[: len(self.families)]))
        langs = FAMILIES[self.families[f]]
        rest = np.delete(s[: len(self.families)], f)
        sure = 1 / (1 + np.exp(-4 * float(s[f] - rest.max()) / 2))
        if len(langs) == 1:
            return langs[0], sure
        wins, margin = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for k, (a, b) in enumerate(self.duels):
            if a in wins:
                m = float(s[len(self.families) + k])
                wins[a if m > 0 else b] += 1
                margin[a] += m
                margin[b] -= m
        best = max(langs, key=lambda g: (wins[g], margin[g]))
        least = min((m if a == best else -m) for k, (a, b) in enumerate(self.duels) if best in (a, b) for m in [float(s[len(self.families) + k])])
        return best, sure / (1 + np.exp(-4 * least))


def stretches(text: str) -> list[list[str]]:
    """The words of each stretch that is in one script and within one sentence; a short one goes with its neighbour of the same script.

    Words of another script are passed over where fewer than LEAST_WORDS of them stand in a row.
    """
    clean = _NOTES.sub(" ", text)
    sentences, start = [], 0
    for m in _END.finditer(clean):
        sentences.append(_WORD.findall(clean[start : m.start()]))
        start = m.end()
    sentences.append(_WORD.findall(clean[start:]))
    out: list[tuple[str, list[str]]] = []
    for words in sentences:
        runs: list[tuple[str, list[str]]] = []
        count: dict[str, int] = {}
        for w in words:
            s = script(w)
            count[s] = count.get(s, 0) + 1
            if runs and runs[-1][0] == s:
                runs[-1][1].append(w)
            else:
                runs.append((s, [w]))
        main = max(count, key=lambda s: count[s]) if count else ""
        first = len(out)
        for s, r in runs:
            if s != main and len(r) < LEAST_WORDS:
                continue
            if len(out) > first and out[-1][0] == s:
                out[-1][1].extend(r)
            elif out and out[-1][0] == s and (len(r) < LEAST_WORDS or len(out[-1][1]) < LEAST_WORDS):
                out[-1][1].extend(r)
            else:
                out.append((s, list(r)))
    return [r for _, r in out]


def segments(text: str, model: Model) -> list[tuple[str, float, int]]:
    """(language, confidence, words) of each segment of a text, in reading order."""
    out: list[tuple[str, float, int]] = []
    for words in stretches(text):
        if len(words) < LEAST_WORDS:
            continue
        lang, sure = model.predict(words)
        if out and out[-1][0] == lang:
            _, s, n = out[-1]
            out[-1] = (lang, (s * n + sure * len(words)) / (n + len(words)), n + len(words))
        else:
            out.append((lang, sure, len(words)))
    return out


def fit(checked: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> Model:
    """A model of labelled texts (language, text), taken whole. Texts that mix scripts are left out, and those a first model finds wrongly
    labelled. Of more than MOST_STRETCHES stretches so many are fitted, by a hash of their words."""
    ys = []
    for lang, text in [*checked, *labelled]:
        parts = stretches(text)
        if lang in FAMILY_OF and parts and len({script(p[0]) for p in parts}) == 1:
            ys += [(lang, p) for p in parts if len(p) >= LEAST_WORDS]
    if len(ys) > MOST_STRETCHES:
        ys = sorted(ys, key=lambda y: zlib.crc32(" ".join(y[1]).encode()))[:MOST_STRETCHES]
    xs = [_vector(p) for _, p in ys]
    x = np.stack(xs) if xs else np.zeros((0, DIMS), np.float32)
    langs = [y[0] for y in ys]
    first = Model(x, langs)
    keep = [i for i, (g, p) in enumerate(ys) if first.predict(p)[0] == g]
    return Model(x[keep], [langs[i] for i in keep]) if keep else first


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most MOST_CHECKED checked rows (labels: ocr_id, main_lang, clean_text) and MOST_LABELLED others (rows: ocr_id, lang, question).

    Which rows are taken goes by a hash of their ids, so it is the same in every run.
    """
    checked = labels.select("ocr_id", "main_lang", "clean_text").filter("main_lang IS NOT NULL AND clean_text IS NOT NULL").orderBy(F.xxhash64("ocr_id"), "ocr_id").limit(MOST_CHECKED)
    known = rows.select("ocr_id", "lang", F.col("question").alias("q")).filter(F.col("lang").isin(*FAMILY_OF) & F.col("q").isNotNull())
    sample = known.orderBy(F.xxhash64("ocr_id"), "ocr_id").limit(MOST_LABELLED)
    take = lambda df: [(r[1], r[2]) for r in df.collect()]
    return fit(take(checked), take(sample))


def language_segments(texts: DataFrame, model: Model, row_id: str = "ocr_id", text: str = "text") -> DataFrame:
    """(ocr_id, seg_no, lang, confidence, n_words): the segments of each text, numbered from 1 in reading order.

    Null and empty texts, and those of fewer than four words in a row in one script, have no segment; very long ones are
    taken whole; repeated rows give their segments again; an empty table gives an empty result. One pass, no shuffle.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(model.weights)

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(held.value)
        for b in batches:
            rows = [(i, k + 1, *s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for k, s in enumerate(segments(t, m))]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["ocr_id", "seg_no", "lang", "confidence", "n_words"])

    return texts.select(F.col(row_id).cast("long"), text).mapInArrow(worker, "ocr_id long, seg_no int, lang string, confidence double, n_words int")


def relabelled(segs: DataFrame, rows: DataFrame) -> DataFrame:
    """The segments of the rows whose `lang` is missing (null, blank or und), is not their language, or that mix languages."""
    whole = segs.groupBy("ocr_id").agg(F.max("seg_no").alias("n_segs"), F.max_by("lang", F.struct("n_words", -F.col("seg_no"))).alias("main"))
    given = rows.select(F.col("ocr_id").cast("long").alias("ocr_id"), F.lower(F.trim("lang")).alias("given"))
    missing = F.col("given").isNull() | F.col("given").isin("", "und")
    wrong = whole.join(given, "ocr_id").filter(missing | (F.col("n_segs") > 1) | (F.col("given") != F.col("main"))).select("ocr_id")
    return segs.join(wrong, "ocr_id", "left_semi")
