"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word is a run of letters of one script, lower case; runs of more than `RUN` letters, as scripts without spaces have
them, are cut into words of that length, so that every letter counts and a change of language within a run shows. A
word has a log posterior for each language from word counts where the training text has it often enough, else from all
its character trigrams. Languages that don't write the word's script are no candidates. Viterbi with one penalty for a
change of language gives the most probable label of each word of the whole text; spans are runs of equal labels and the
document's language is the one with most letters. Documents of a batch advance together, one word each, so that the
recursion runs over arrays.

The model is fitted on a bounded sample: about `per_lang` documents a language, chosen by a hash of the id. It holds
every trigram and every word seen `LEAST` times there, so its size depends on the sample and not on the corpus.

Nulls and edges: a null text and a text without a letter give `und` with score 0 and no spans; rows with a null
language or text aren't learned from; a null id hashes as the empty text; repeated rows get equal answers; ties go to
the language first in order; without any training row every text is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, pieces, tidy

LEAST, RUN, CACHE, PART, FLOOR, SWITCH = 3, 40, 150_000, 20_000, -6.0, 7.0
#: First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


def script_of(char: str) -> str:
    c = ord(char)
    return next((name for name, ranges in SCRIPTS.items() if any(a <= c <= b for a, b in ranges)), "other")


def _words() -> re.Pattern[str]:
    letter = r"[^\W\d_]"
    classes = ["".join(c for a, b in ranges for c in map(chr, range(a, b + 1)) if re.match(letter, c)) for ranges in SCRIPTS.values()]
    each = [f"[{c}]{{1,{RUN}}}" for c in classes]
    return re.compile("|".join([*each, f"(?:(?![{''.join(classes)}]){letter}){{1,{RUN}}}"]))


LETTERS = _words()
#: A text without a character beyond these, which hold Latin letters, punctuation and currency signs, has words of one class.
BEYOND = re.compile("[^\\x00-\u024f\u2000-\u206f\u20a0-\u20cf]")
LATIN = re.compile(f"[{''.join(c for c in map(chr, range(0x41, 0x250)) if LETTERS.match(c))}]{{1,{RUN}}}")


def words_of(text: str) -> list[str]:
    """What LETTERS finds in the lower-cased text."""
    text = text.lower()
    return (LETTERS if BEYOND.search(text) else LATIN).findall(text)


def grams_of(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def gram_codes(text: str) -> np.ndarray:
    """A number for the three characters from each place of the text that has three, ordered as they are."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


class Known(dict):
    """The place of each word met, in order; `new` has those met since it was emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


class Model:
    """Scores of words for each language, by table; what a worker has scored stays with its copy of the model."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, Counter]]):
        self.langs = langs
        self.words, self.word_table = self._table(counts, "word")
        self.grams, self.gram_table = self._table(counts, "gram")
        own = [g for g in self.grams if len(g) == 3]
        # Ascending, as the grams are sorted; a last one that no trigram has.
        self.gram_codes = np.concatenate([gram_codes("".join(own))[::3], [np.iinfo(np.int64).max]])
        self.gram_places = np.array([*(self.grams[g] for g in own), len(self.grams)])
        # For each script that the training text has, the languages that write it; where none does, all are candidates.
        found = sorted({s for x in langs for s in counts[x]["script"]})
        self.scripts = {s: i for i, s in enumerate(found)}
        share = np.array([[counts[x]["script"].get(s, 0) / max(1, sum(counts[x]["script"].values())) for x in langs] for s in found]).reshape(len(found), len(langs))
        may = share >= 0.005
        self.may = np.concatenate([may | ~may.any(1, keepdims=True), np.ones((1, len(langs)), bool)])
        self.forget()

    def _table(self, counts: dict[str, dict[str, Counter]], kind: str, smooth: float = 0.3) -> tuple[dict[str, int], np.ndarray]:
        """(place of each key, log probabilities by place and language; the last place is that of unseen keys)"""
        keys = {w: i for i, w in enumerate(sorted({w for x in self.langs for w in counts[x][kind]}))}
        n = np.zeros((len(keys) + 1, len(self.langs)))
        for j, x in enumerate(self.langs):
            for w, c in counts[x][kind].items():
                n[keys[w], j] = c
        return keys, np.log((n + smooth) / (n.sum(0) + smooth * (len(keys) + 1))).astype(np.float32)

    def forget(self) -> None:
        self.rows = np.zeros((1024, len(self.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)
        self.known = Known()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": self.rows[:1], "letters": self.letters[:1], "known": Known()}

    def scores(self, words: list[str]) -> np.ndarray:
        """The log posterior of each language for each word, by its count or else by its trigrams, within its script's languages."""
        place = np.array([self.words.get(w, -1) for w in words], np.int64)
        s = self.word_table[place]
        rare = np.flatnonzero(place < 0)
        if len(rare):
            sizes = np.array([len(words[i]) for i in rare])
            codes = gram_codes("".join([f"<{words[i]}>" for i in rare]))
            # The two places at the end of a word begin no trigram of it.
            inside = np.ones(len(codes) + 2, bool)
            ends = np.cumsum(sizes + 2)
            inside[ends - 1] = inside[ends - 2] = False
            codes = codes[inside[:-2]]
            at = np.searchsorted(self.gram_codes, codes)
            flat = np.where(self.gram_codes[at] == codes, self.gram_places[at], len(self.grams))
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            s[rare] = np.add.reduceat(self.gram_table[flat], first, axis=0)
        of_char = {c: self.scripts.get(script_of(c), -1) for c in {w[0] for w in words}}
        s = np.where(self.may[[of_char[w[0]] for w in words]], s, -np.inf)
        s = s - s.max(1, keepdims=True)
        return np.maximum(s - np.log(np.exp(s).sum(1, keepdims=True)), FLOOR)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The places of each text's words in `rows` and `letters`, which have the new ones afterwards."""
        place = self.known.__getitem__

        def places(words: list[str]) -> np.ndarray:
            return np.fromiter(map(place, words), np.int64, len(words))

        out = [places(words_of(t) if t else []) for t in texts]
        new, self.known.new = self.known.new, []
        a, z = len(self.known) - len(new), len(self.known)
        if z > len(self.rows):
            more = max(z, 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros((more, len(self.langs)), np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros(more, np.int64)])
        for b in range(0, len(new), PART):
            some = new[b : b + PART]
            self.rows[a + b : a + b + len(some)] = self.scores(some)
            self.letters[a + b : a + b + len(some)] = [len(w) for w in some]
        return out

    def viterbi(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The label of each word of each document."""
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        sizes, k = sizes[order], len(self.langs)
        flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        scores = self.rows[flat]
        came = np.zeros((len(flat), k), np.int8)
        state = np.zeros((len(docs), k), np.float32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        own = np.arange(k, dtype=np.int8)
        for t, n in enumerate(active):
            at, s = begin[:n] + t, state[:n]
            if t:
                best = s.argmax(1)
                jump = s[np.arange(n), best][:, None] - SWITCH
                stay = s >= jump
                came[at] = np.where(stay, own, best[:, None])
                s = np.maximum(s, jump)
            state[:n] = s + scores[at]
        label = np.zeros(len(flat), np.int8)
        now = state.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            label[at] = now[:n]
            if t:
                now[:n] = came[at, now[:n]]
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(docs)
        for i, b, n in zip(order, begin, sizes, strict=True):
            out[i] = label[b : b + n]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        """(language, score, spans) of each text; score is the share of letters in words of that language."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if len(self.known) > CACHE:
            self.forget()
        docs = self.ids(texts)
        langs, scores, spans = [], [], []
        for d, label in zip(docs, self.viterbi(docs), strict=True):
            w = self.letters[d]
            total = w.sum()
            if not total:
                langs.append("und"), scores.append(0.0), spans.append([])
                continue
            by = np.bincount(label, w, len(self.langs))
            best = int(by.argmax())
            langs.append(self.langs[best])
            scores.append(float(by[best] / total))
            cut = np.flatnonzero(np.diff(label)) + 1
            ends = [*cut.tolist(), len(label)]
            spans.append([{"start": a, "stop": b, "lang": self.langs[label[a]]} for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        return langs, scores, spans


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500) -> Model:
    """Learn from about per_lang of the documents for which `train` holds, by language, chosen by a hash of the id."""
    bounded(docs.sparkSession)
    docs = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.col(id_col).alias("i"), train.alias("ok")).filter("ok and l is not null and t is not null")
    sizes = {r["l"]: r["count"] for r in docs.groupBy("l").count().collect()}  # one row for each language
    if not sizes:
        return Model([], {})
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(per_lang / n))]), F.col("l"))
    h = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit("")), F.lit(10)), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[str, str], Counter] = {}
        for b in pieces(batches, "t"):
            for lang, text in zip(b.column("l").to_pylist(), b.column("t").to_pylist(), strict=True):
                words = Counter(words_of(text))
                got.setdefault((lang, "word"), Counter()).update(words)
                grams, scripts = got.setdefault((lang, "gram"), Counter()), got.setdefault((lang, "script"), Counter())
                for w, n in words.items():
                    scripts[script_of(w[0])] += n
                    for g in grams_of(w):
                        grams[g] += n
        for (lang, kind), c in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([kind] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["l", "kind", "k", "n"])

    sums = docs.filter(h < share).select("l", "t").mapInArrow(count, "l string, kind string, k string, n long").groupBy("l", "kind", "k").agg(F.sum("n").alias("n")).filter((F.col("kind") != "word") | (F.col("n") >= LEAST))
    counts = {x: {"word": Counter(), "gram": Counter(), "script": Counter()} for x in sorted(sizes)}
    for r in sums.collect():  # bounded by the sample
        counts[r["l"]][r["kind"]][r["k"]] = r["n"]
    return Model(sorted(sizes), counts)


def tag(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __lang, __score and __spans (first word, end, language) of each whole text."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.value.forget()
        for b in pieces(batches, text_col, 6 << 20):
            langs, scores, spans = shared.value.predict(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], [*b.schema.names, "__lang", "__score", "__spans"])
        shared.value.forget()

    added = T.StructType().add("__lang", "string").add("__score", "double").add("__spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long").add("lang", "string")))
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added.fields))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, spans (first word, end, language) of each whole text."""
    out = tag(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), model, "t")
    return out.select(F.col("i").alias(id_col), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__spans").alias("spans"))


def identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that have a language: `least` of their letters or more stand in words of it."""
    return tag(docs, model, text_col).filter((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*docs.columns)
