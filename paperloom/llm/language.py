"""Missing or wrong language labels, and documents of several languages (problem 10).

Word-first backoff: every known word of a line adds its log frequency per language; a word that was
never seen falls back to its character 5-grams, then 4-grams, and so on to single characters, and
takes the mean log frequency of the first length at which any gram is known.  Runs of kana or Han are
treated as unseen words, so their grams decide.  A line gets the language with the greatest sum and a
confidence, its posterior share; neighbouring lines of one language form a segment.

The frequencies are fitted on a bounded sample: per label at most ``SAMPLE_DOCUMENTS`` documents, the
ones with the least hash, and of each its first ``SAMPLE_LENGTH`` characters; words and grams that the
sample holds fewer than ``LEAST_COUNT`` times are treated as unseen.  Labels are noisy, so a second fit
uses the languages that the first one gave to the sampled lines.  Every line of every document is
then classified with the model, whose size the sample bounds.

Front matter, fenced code, tags, addresses and lines without words are no natural language.

Defined results: null or blank texts, and texts without natural language, have no segment; a line
below ``SURE`` goes with the surest language of its document; repeated rows count as often as they
come; without any labelled document nothing is classified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCUMENTS, SAMPLE_LENGTH, LEAST_COUNT = 400, 20_000, 3
SURE, GRAMS = 0.9, (5, 4, 3, 2, 1)
KEPT_TOKENS, PART_TOKENS = 200_000, 50_000  # scored tokens a worker keeps, tokens scored at a time

#: Names and codes of the languages, as labels write them.
LABELS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french francais français",
    "es": "es spa spanish espanol español castellano", "pt": "pt por portuguese portugues português", "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский", "zh": "zh zho chi chinese cmn 中文", "ja": "ja jpn japanese 日本語 jp",
}

_ASIDE = re.compile(r"\A\s*---[ \t]*\n[\s\S]*?\n---[ \t]*(?=\n|\Z)|^(```|~~~)[^\n]*(?:\n(?!\1)[^\n]*)*(?:\n\1[^\n]*)?", re.M)
#: What is no language: spans that may hold spaces, and what can be seen in one token.
_SPANS = re.compile(r"`[^`\n]+`|</?[A-Za-z][^<>]*>")
_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+|&\w+;|\S*\d\S*(?<![぀-ヿ㐀-䶿一-鿿])")
_WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿]+|[^\W\d_぀-ヿ㐀-䶿一-鿿]+")
_EAST = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")


def label_code(label: str) -> F.Column:
    """Two-letter code of a label in any notation, null if it names no known language."""
    first = F.lower(F.regexp_extract(F.trim(F.col(label)), r"^([^\-_\s(]+)", 1))
    known = F.create_map(*[F.lit(x) for code, names in LABELS.items() for name in names.split() for x in (name, code)])
    return F.try_element_at(known, first)


@lru_cache(maxsize=1 << 16)
def token_words(token: str) -> tuple[str, ...]:
    """The words of a lower-cased run of visible characters."""
    return tuple(_WORD.findall(_NOISE.sub(" ", token)))


def token_lines(text: str) -> list[tuple[int, int, list[str]]]:
    """(line number, visible characters, lower-cased tokens) of the lines outside of front matter and fenced code."""
    if "```" in text or "~~~" in text or text.lstrip().startswith("---"):
        text = _ASIDE.sub(lambda m: "\n" * m[0].count("\n"), text)
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        shown = _SPANS.sub(" ", line) if "`" in line or "<" in line else line
        tokens = shown.lower().split()
        if tokens:
            out.append((number, len(line) - line.count(" "), tokens))
    return out


def is_natural(letters, visible, has_word):
    """Whether a line holds natural language: enough of what is visible are letters, and one word is more than an initial."""
    return (letters >= 2) & (letters * 5 >= visible * 2) & has_word


def natural_lines(text: str) -> list[tuple[int, list[str]]]:
    """(line number, lower-cased words) of the lines that hold natural language."""
    out = []
    for number, visible, tokens in token_lines(text):
        words = [w for t in tokens for w in token_words(t)]
        if is_natural(sum(map(len, words)), visible, any(map(_telling, words))):
            out.append((number, words))
    return out


def _telling(word: str) -> bool:
    return len(word) > 2 or bool(_EAST.match(word))


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies of words and character grams per language."""

    def __init__(self, languages: list[str], lines: list[tuple[str, list[str]]]):
        self.languages = languages
        at = {code: i for i, code in enumerate(languages)}
        words: dict[str, Counter] = {code: Counter() for code in languages}
        for code, line in lines:
            words[code].update(line)
        levels = {0: {code: Counter({w: c for w, c in words[code].items() if not _EAST.match(w)}) for code in languages}}
        for n in GRAMS:
            levels[n] = {code: Counter() for code in languages}
            for code in languages:
                for w, c in words[code].items():
                    for g in grams(w, n):
                        levels[n][code][g] += c
        self.tables, self.floor = {}, {}
        for n, counts in levels.items():
            total = np.array([sum(counts[code].values()) for code in languages], dtype=float)
            whole = Counter()
            for c in counts.values():
                whole.update(c)
            kept = [x for x, c in whole.items() if c >= LEAST_COUNT]
            matrix = np.full((len(kept), len(languages)), 0.1)
            index = {x: i for i, x in enumerate(kept)}
            for code, c in counts.items():
                for x, k in c.items():
                    if x in index:
                        matrix[index[x], at[code]] += k
            matrix = np.log(matrix / (total + 0.1 * (len(kept) + 1)))
            self.tables[n] = (index, matrix.astype("float32"))
        self._seen = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_seen": None}

    def word(self, w: str) -> np.ndarray:
        """Log frequencies of a word: its own, or the mean of its longest grams of which any is known."""
        index, matrix = self.tables[0]
        if w in index:
            return matrix[index[w]]
        for n in GRAMS:
            index, matrix = self.tables[n]
            at = [index[g] for g in grams(w, n) if g in index]
            if at:
                return matrix[at].mean(axis=0) * (max(1.0, len(w) / 2) if _EAST.match(w) else 1.0)
        return np.zeros(len(self.languages), dtype="float32")

    def tokens(self) -> Tokens:
        """The scored tokens so far, forgotten when they are many."""
        if self._seen is None or len(self._seen) > KEPT_TOKENS:
            self._seen = Tokens(self)
        return self._seen

    def lines(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each line of words and the confidence in it; no line is empty."""
        scores = np.array([np.sum([self.word(w) for w in words], axis=0, dtype="float64") for words in lines])
        return _best(scores)


def _best(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = sums.argmax(axis=1)
    top = sums[np.arange(len(sums)), best]
    return best, 1.0 / np.exp(np.clip(sums - top[:, None], -60, 0)).sum(axis=1)


class Tokens(dict):
    """Token -> row of ``table``: words, letters, whether a word tells a language, then the sum of its words' log frequencies."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, 3 + len(model.languages)))

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        words = token_words(token)
        if words:
            self.table[at, :3] = len(words), sum(map(len, words)), any(map(_telling, words))
            self.table[at, 3:] = np.sum([self.model.word(w) for w in words], axis=0, dtype="float64")
        self[token] = at
        return at


def fit(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE_DOCUMENTS) -> Model | None:
    """The model, fitted twice on a bounded sample of labelled documents (which comes to the driver)."""
    labelled = documents.select(label_code(label).alias("code"), F.substring(text, 1, SAMPLE_LENGTH).alias("text"), F.col(key).alias("k"))
    labelled = labelled.filter("code is not null and text is not null")
    # a row per language: how many documents there are, hence below which hash enough of them lie
    counts = documents.filter(F.col(text).isNotNull()).select(label_code(label).alias("code")).filter("code is not null").groupBy("code").agg(F.count("*").alias("n_docs"))
    labelled = labelled.withColumn("h", F.shiftrightunsigned(F.xxhash64("k"), 1)).join(F.broadcast(counts), "code")
    labelled = labelled.filter(F.col("h") / F.lit(2.0**63) <= F.lit(4.0 * sample) / F.col("n_docs"))
    w = Window.partitionBy("code").orderBy("h", "k")
    rows = labelled.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample).select("code", "text").collect()
    lines = [(r["code"], words) for r in rows for _, words in natural_lines(r["text"])]
    if not lines:
        return None
    languages = sorted({code for code, _ in lines})
    best, sure = Model(languages, lines).lines([words for _, words in lines])
    return Model(languages, [(languages[b], words) for b, s, (_, words) in zip(best, sure, lines) if s >= SURE])


def judged_lines(model: Model, texts: list[str]) -> list[list[tuple[int, int, float, int]]]:
    """Per text (line number, language, confidence, words) of its natural lines; the lines of many texts are scored together."""
    out: list[list[tuple]] = [[] for _ in texts]
    where, flat, starts = [], [], []

    def score() -> None:
        seen = model.tokens()
        at = list(map(seen.__getitem__, flat))
        sums = np.add.reduceat(seen.table[at], starts, axis=0)
        words, letters, telling = sums[:, 0].astype(int), sums[:, 1], sums[:, 2] > 0
        best, sure = _best(sums[:, 3:])
        natural = is_natural(letters, np.array([v for _, _, v in where]), telling)
        for ok, (k, number, _), b, s, n in zip(natural.tolist(), where, best.tolist(), sure.tolist(), words.tolist()):
            if ok:
                out[k].append((number, b, s, n))
        where.clear(), flat.clear(), starts.clear()

    for k, text in enumerate(texts):
        for number, visible, tokens in token_lines(text):
            where.append((k, number, visible))
            starts.append(len(flat))
            flat += tokens
            if len(flat) >= PART_TOKENS:
                score()
    if flat:
        score()
    return out


def joined(model: Model, judged: list[tuple[int, int, float, int]]) -> list[tuple]:
    """(first_line, last_line, lang, confidence, n_words) of each segment of one text."""
    if not judged:
        return []
    weight: dict[int, float] = {}
    for _, best, sure, n in judged:
        weight[best] = weight.get(best, 0.0) + n * sure
    main = max(weight, key=weight.get)
    out: list[list] = []
    for n, best, sure, words in judged:
        language = best if sure >= SURE else main
        if out and out[-1][2] == language:
            out[-1][1], out[-1][4] = n, out[-1][4] + words
            out[-1][3] += sure * words
        else:
            out.append([n, n, language, sure * words, words])
    return [(a, b, model.languages[lang], min(1.0, s / max(1, n)), n) for a, b, lang, s, n in out]


def segments(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, label, segment_no, first_line, last_line, lang, confidence, n_words) of every document."""
    slim = documents.select(F.col(key).alias("_key"), label_code(label).alias("label"), F.col(text).alias("_text"))
    schema = f"`{key}` {slim.schema['_key'].dataType.simpleString()}, label string, segment_no int, first_line int, last_line int, lang string, confidence double, n_words int"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [key, "label", "segment_no", "first_line", "last_line", "lang", "confidence", "n_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["_text"]]
            rows = []
            for k, code, lines in zip(batch["_key"], batch["label"], judged_lines(shared.value, texts)):
                rows += [(k, code, i, *s) for i, s in enumerate(joined(shared.value, lines), 1)]
            yield pd.DataFrame(rows, columns=names)

    return slim.mapInPandas(run, schema)


def wrong_labels(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, true_lang): the languages of documents whose label is missing or wrong or that have several."""
    per = found.groupBy(key).agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))  # ten languages at most
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce("label", F.lit("")))
    return per.filter(case).select(key, F.explode("langs").alias("true_lang"))


def documents_languages(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, share, confidence): each language of a document with its share of the words."""
    per = found.groupBy(key, "lang").agg(F.sum("n_words").alias("n"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"))
    whole = F.sum("n").over(Window.partitionBy(key))
    return per.select(key, "lang", (F.col("n") / whole).alias("share"), "confidence")
