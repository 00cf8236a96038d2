"""Pages of stuffed keywords, link lists and tag lists among prose.

A text is read as a sequence of word classes: very common and common words of its
language, other words, words that hold an unusual share of the text, words that no other
text knows, links, tags, numbers and marks. Which words are common is learned from how
many texts of a language have them, so no list of words is written down here.

Two trigram models of these classes are trained. The prose model learns from the texts
with the densest common words. The model of structured text (code, settings, tables,
change lists) learns from lines with marks of structure or common words and few
keywords, links and tags; runs of words without any mark it leaves to the prose model.
A line is judged by the model that it suits better, and every line of every text is
judged; words that no other text has are no evidence, so a language that the collection
hardly knows is judged by its marks, repetitions and links. A page whose perplexity is abnormally high, for more than half of its text, is
no prose; nor is a page that says so little new that its perplexity, with what it has
said before known, is abnormally low.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import FLOOR, skew_join
from ..operators.skew import SHARE as SHARE_OF_ROWS
from ..session import cut

#: Word classes, a letter each: ^ start, A very common word, f common word, C other word, M other word with a capital,
#: U word that other texts don't have, K keyword of the text, L link, T tag, 0 number; the rest are kinds of marks.
CLASSES = "^AfCMUKLT0,.:()-|>`={\"/*\n#"
_CODE = {c: i for i, c in enumerate(CLASSES)}
_SIZE = len(CLASSES)
_MARKS = {",": ",;、，；", ".": ".!?。！？", ":": ":：", "(": "([（【", ")": ")]）】", "-": "-–—•·", "|": "|", ">": "<>→»", "`": "`", "=": "=+&%$@~^\\", "{": "{}", '"': "\"'“”‘’«»「」", "/": "/_", "*": "*", "#": "#"}
_MARK = {ch: _CODE[c] for c, chars in _MARKS.items() for ch in chars}

# Scripts that are written without blanks are read character by character, all others by words.
_DENSE = r"ぁ-ヿ㐀-鿿豈-﫿"


def _pattern(letter: str, links: bool) -> re.Pattern:
    first = r"<[a-zA-Z/][^<>\n]*>|(?:https?://|www\.)[^\s<>()\[\]\"'`]+|" if links else ""
    dense = "" if letter == "[A-Za-z]" else f"[{_DENSE}]|"
    return re.compile(rf"{first}{letter}+(?:['’-]{letter}+)*|{dense}\d+|\n+|#[^\W\d_]\w*|[^\w\s]|_")


#: By whether a text is ASCII, and whether it may hold a link or a tag: one way of reading, without what can't occur.
_TOKEN = {(a, k): _pattern("[A-Za-z]" if a else rf"[^\W\d_{_DENSE}]", k) for a in (True, False) for k in (True, False)}
_ANY_DENSE = re.compile(f"[{_DENSE}]")
_DIGITS = dict.fromkeys(map(ord, "0123456789"))
_LINK = ("http://", "https://", "www.")

#: A word is common in a language if this share of its texts has it, and very common with the second share.
COMMON, VERY_COMMON = 0.08, 0.4
#: Common words are learned of languages with so many texts; a common word is in three of them at least.
LEAST_TEXTS, LEAST_DF = 8, 3
#: A word is known if this share of all texts has it, and two at least. So few words can be known: as many as different words in a text, divided by it.
KNOWN = 0.0004
#: A keyword comes so often in different sentences, and holds this share of their words; of a common word also this many times its usual share.
KEY_COUNT, KEY_SHARE, KEY_TIMES = 4, 0.06, 4.0
#: The prose model learns from this share of the texts, those with the densest common words.
PROSE = 0.5
#: The other model learns from lines with this share of marks of structure and common words, and at most this share of keywords, links and tags.
STRUCTURE, STUFFED = 0.25, 0.2
#: A text counts for as many tokens at most where models are trained.
WEIGHT = 300
#: A page is abnormal when its perplexity is so many times that of prose; also when only so much of it is new that its log perplexity is this part of that of prose.
FACTOR, LOW = 5.0, 1 / 6
#: Tokens of a stretch, at least.
STRETCH = 16
#: Short stretches say little: so many tokens of average prose are added to a page, and to a stretch, before it is judged.
PAGE_PRIOR, STRETCH_PRIOR = 12, 6
#: A page is flagged when more than this share of it is in abnormal stretches: lines, joined to a length that can be judged, with half that excess.
SHARE = 0.5

_START, _UNKNOWN, _KEYWORD, _BREAK = _CODE["^"], _CODE["U"], _CODE["K"], _CODE["\n"]
_IS_STRUCTURE = np.isin(np.arange(_SIZE), [_CODE[c] for c in '`={"|:#Af'])
_IS_STUFF = np.isin(np.arange(_SIZE), [_CODE[c] for c in "KLT"])
_IS_MARK = np.isin(np.arange(_SIZE), [_CODE[c] for c in '0:()-|>`={"/*\n#'])


def _dense(ch: str) -> bool:
    return "ぁ" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿"


def tokens(text: str) -> list[str]:
    """Words, numbers, links, tags, line ends and marks of a text, in order."""
    return _TOKEN[text.isascii(), "://" in text or "<" in text or "www." in text].findall(text)


# ---- common words ------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """What was learned of words: by language, its common words with (share of texts, share of words); and all known words."""

    common: dict[str, dict[str, tuple[float, float]]]
    known: frozenset[str]

    def __post_init__(self) -> None:
        self.languages: dict[str, list[str]] = {}
        for lang, words in sorted(self.common.items()):
            for w in words:
                self.languages.setdefault(w, []).append(lang)
        self.seen: dict[str, tuple[str, int, bool]] = {}

    def look(self, token: str) -> tuple[str, int, bool]:
        """(token in lower case, its class unless it is common or a keyword, whether it is a word); remembered, for a bounded number of tokens."""
        w = token.lower()
        c = w[0]
        if c.isalpha():
            if w.startswith(_LINK):
                got = w, _CODE["L"], False
            else:
                # a character of a script without blanks is no word: it counts as unknown unless it is common
                known = w in self.known and not _dense(c)
                got = w, (_CODE["M"] if token[0].isupper() else _CODE["C"]) if known else _UNKNOWN, True
        elif c.isdigit():
            got = w, _CODE["0"], False
        elif c == "\n":
            got = w, _BREAK, False
        elif len(w) == 1:
            # vowel signs and accents belong to words
            got = w, _MARK.get(c) or (_UNKNOWN if unicodedata.category(c)[0] == "M" else _CODE["="]), False
        elif c == "#":
            got = w, _CODE["T"], False
        else:
            got = w, _CODE["L"] if "href" in w else _CODE[">"], False
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[token] = got
        return got

    def language(self, count: dict[str, int]) -> dict[str, tuple[float, float]]:
        """The common words of the language of which a text has the most."""
        votes: dict[str, int] = {}
        of = self.languages.get
        for w, k in count.items():
            for lang in of(w, ()):
                votes[lang] = votes.get(lang, 0) + k
        return self.common[max(votes, key=lambda x: (votes[x], x))] if votes else {}


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, df, tf over texts (lang, text); the empty word stands for all: number of texts and of words.

    Words are summed up in each task before they are shuffled, in parts of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: dict[str, Counter[str]] = {}
        tf: dict[str, Counter[str]] = {}

        def told() -> pd.DataFrame:
            out = pd.DataFrame([(a, w, n, tf[a][w]) for a in df for w, n in df[a].items()], columns=["lang", "word", "df", "tf"])
            df.clear()
            tf.clear()
            return out.astype({"df": "int64", "tf": "int64"})

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                count = Counter(tokens(text.lower()))
                words = [w for w in count if w[0].isalpha() and not w.startswith(_LINK)]
                d, f = df.setdefault(lang, Counter()), tf.setdefault(lang, Counter())
                d.update(words)
                d[""] += 1
                for w in words:
                    f[w] += count[w]
                f[""] += sum(map(count.__getitem__, words))
            if sum(map(len, df.values())) > 500_000:
                yield told()
        yield told()

    got = texts.select("lang", "text").mapInPandas(run, "lang string, word string, df long, tf long")
    return got.groupBy("lang", "word").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def vocabulary(texts: DataFrame) -> Vocabulary:
    """Common words of each language and known words of all, from all texts (lang, text).

    What comes to the driver is bounded by the thresholds, not by the collection: words
    that a share s of the texts has are at most 1 / s times the different words in an
    average text. Languages are primary tags of two or three letters.
    """
    counts = cut(word_counts(texts))
    sizes = counts.where(F.col("word") == "").select("lang", F.col("df").alias("n"), F.col("tf").alias("size"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words = counts.where(F.col("word") != "")
    in_language = words.join(F.broadcast(sizes.where((F.col("lang") != "") & (F.col("n") >= LEAST_TEXTS))), "lang")
    common: dict[str, dict[str, tuple[float, float]]] = {}
    for r in in_language.where(F.col("df") >= F.greatest(F.lit(LEAST_DF), COMMON * F.col("n"))).collect():
        common.setdefault(r.lang, {})[r.word] = (r.df / r.n, r.tf / max(1, r.size))
    known = words.groupBy("word").agg(F.sum("df").alias("df")).where(F.col("df") >= max(2, KNOWN * total)).select("word")
    return Vocabulary(common, frozenset(r.word for r in known.collect()))


# ---- classes -------------------------------------------------------------------------------


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text in lower case, without digits and the marks at their end."""
    low = text.lower().translate(_DIGITS).replace("\n", ". ").replace("! ", ". ").replace("? ", ". ")
    if not low.isascii():
        for mark in "。！？":
            low = low.replace(mark, ". ")
    return [x for x in [x.strip(" .!?") for x in low.split(". ")] if x]


def classes(text: str, vocab: Vocabulary) -> tuple[bytes, float, float]:
    """(class of each token, share of the text that is new: not in a sentence that came before, numbers aside; share of common words)."""
    every = tokens(text)
    if not every:
        return b"", 1.0, 0.0
    seen, look = vocab.seen.get, vocab.look
    of: dict[str, int] = {}
    words: list[tuple[str, str, int]] = []
    count: dict[str, int] = {}
    for t, n in Counter(every).items():
        w, code, is_word = seen(t) or look(t)
        of[t] = code
        if is_word:
            words.append((t, w, n))
            count[w] = count.get(w, 0) + n
    said = sentences(text)
    different = dict.fromkeys(said)
    says, new = count, 1.0
    if len(different) < len(said):
        # what is said again is taken off
        again = Counter(said)
        again.subtract(different.keys())
        says = count.copy()
        for x, n in Counter(t for s, k in again.items() if k for t in tokens(s) * k).items():
            w, _, is_word = seen(x) or look(x)
            if is_word and w in says:
                says[w] = max(1, says[w] - n)
        new = sum(map(len, different)) / sum(map(len, said))
    own = vocab.language(count)
    total = sum(says.values()) or 1
    least = max(KEY_COUNT, KEY_SHARE * total)
    common, very = _CODE["f"], _CODE["A"]
    plain = 0
    for t, w, n in words:
        got, k = own.get(w), says.get(w, 0)
        much = k >= least and not _dense(w[0])
        if got is not None and not (much and k >= KEY_TIMES * got[1] * total):
            of[t] = very if got[0] >= VERY_COMMON else common
            plain += n
        elif much:
            of[t] = _KEYWORD
    out = bytearray(map(of.__getitem__, every))
    if not text.isascii() and _ANY_DENSE.search(text):
        line = tokens(".\n".join(different)) if new < 1 else every
        pairs = Counter(a + b for a, b in zip(line, line[1:], strict=False) if _dense(a) and _dense(b))
        enough = max(KEY_COUNT - 1, 0.04 * sum(pairs.values()))
        much = {p for p, n in pairs.items() if n >= enough}
        for i, (a, b) in enumerate(zip(every, every[1:], strict=False)) if much else ():
            if a + b in much:
                out[i] = out[i + 1] = _KEYWORD
        plain = out.count(common) + out.count(very)
    return bytes(out), new, plain / len(every)


def class_sequences(texts: DataFrame, vocab: Vocabulary, *keys: str) -> DataFrame:
    """keys, classes (a byte a token), new, dense (share of common words among all tokens) of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            got = [classes(t, known) for t in pdf["text"]]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, **{n: [g[i] for g in got] for i, n in enumerate(("classes", "new", "dense"))}})

    return texts.select(*keys, "text").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", classes binary, new double, dense double")


@dataclass
class Batch:
    """Sequences of many texts, none of them empty, in one row: class and trigram of each token, and where texts and lines start."""

    seq: np.ndarray
    tri: np.ndarray
    texts: np.ndarray
    lines: np.ndarray

    @classmethod
    def of(cls, sequences: list[bytes]) -> Batch:
        size = np.array([len(x) for x in sequences], np.int64)
        texts = np.cumsum(size) - size
        pad = np.frombuffer(b"".join(bytes(2) + x for x in sequences), np.uint8)
        # unknown words stand beside others as words
        p = np.where(pad == _UNKNOWN, _CODE["C"], pad).astype(np.int64)
        at = np.arange(len(pad) - 2 * len(size)) + 2 * np.repeat(np.arange(1, len(size) + 1), size)
        seq = pad[at]
        starts = np.zeros(len(seq) + 1, bool)
        starts[texts] = True
        starts[np.flatnonzero(seq == _BREAK) + 1] = True
        return cls(seq, (p[at - 2] * _SIZE + p[at - 1]) * _SIZE + p[at], texts, np.flatnonzero(starts[:-1]))


#: Tokens that are worked on at once, about, however many texts a task gets together; a longer text is worked on alone.
AT_ONCE = 500_000


def _portions(sequences: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of the sequences that are not empty, in portions of bounded size."""
    size = np.array([len(x) for x in sequences], np.int64)
    full = np.flatnonzero(size)
    if len(full):
        yield from np.split(full, np.flatnonzero(np.diff(np.cumsum(size[full]) // AT_ONCE)) + 1)


# ---- models --------------------------------------------------------------------------------


def surprises(counts: np.ndarray) -> np.ndarray:
    """Surprise of each trigram, from counts: interpolated with those of pairs and single classes."""
    c = counts.reshape(_SIZE, _SIZE, _SIZE)
    pair = c.sum(0)
    one = pair.sum(0)
    p1 = (one + 0.5) / (one.sum() + 0.5 * _SIZE)
    p2 = (pair + 5 * p1) / (pair.sum(1, keepdims=True) + 5)
    p3 = (c + 5 * p2[None]) / (c.sum(2, keepdims=True) + 5)
    return -np.log(p3).reshape(-1)


class Model:
    """The two models; mean: what a token of prose surprises by."""

    def __init__(self, prose: np.ndarray, structured: np.ndarray):
        self.prose = surprises(prose)
        every = np.arange(_SIZE**3)
        marked = _IS_MARK[every // (_SIZE * _SIZE)] | _IS_MARK[every // _SIZE % _SIZE] | _IS_MARK[every % _SIZE]
        self.structured = np.where(marked, surprises(structured), self.prose)
        total = prose.sum()
        self.mean = float((prose * self.prose).sum() / total) if total else float(np.log(_SIZE))

    def judge(self, sequences: list[bytes], new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of the text in abnormal stretches, log perplexity, log perplexity when what was said before is known) of each."""
        share, page, again = np.zeros(len(sequences)), np.full(len(sequences), self.mean), np.full(len(sequences), self.mean)
        for full in _portions(sequences):
            b = Batch.of([sequences[i] for i in full])
            # an unknown word may be of any kind, in any language: it is no evidence
            heard = (b.seq != _UNKNOWN).astype(np.int64)
            n = np.add.reduceat(heard, b.lines)
            # changing to the other model costs a bit
            s = np.minimum(np.add.reduceat(self.prose[b.tri] * heard, b.lines), np.add.reduceat(self.structured[b.tri] * heard, b.lines) + 1)
            first = np.searchsorted(b.lines, b.texts)
            text_of = np.searchsorted(b.texts, b.lines, "right") - 1
            # lines are joined to stretches of some length, so that short ones are not judged by a word or two
            part = -(-(b.lines - b.texts[text_of]) // STRETCH)
            begins = np.flatnonzero(np.append(True, (text_of[1:] != text_of[:-1]) | (part[1:] != part[:-1])))
            said, words = np.add.reduceat(s, begins), np.add.reduceat(n, begins)
            odd = (said + STRETCH_PRIOR * self.mean) / (words + STRETCH_PRIOR) > self.mean + float(np.log(FACTOR)) / 2
            size, total = np.add.reduceat(n, first), np.add.reduceat(s, first)
            share[full] = np.bincount(text_of[begins], words * odd, len(full)) / np.maximum(1, size)
            page[full] = (total + PAGE_PRIOR * self.mean) / (size + PAGE_PRIOR)
            again[full] = np.where(size > 0, (total * new[full] + PAGE_PRIOR * self.mean) / (size + PAGE_PRIOR), page[full])
        return share, page, again

    def flags(self, share: Column, log_perplexity: Column, repeated: Column) -> Column:
        high = (log_perplexity > self.mean + float(np.log(FACTOR))) & (share > SHARE)
        return high | (repeated < self.mean * LOW)


def train(sequences: DataFrame) -> Model:
    """Both models, from all sequences; at most the cube of the number of classes comes to the driver, whatever the number of texts."""
    least = sequences.where(F.length("classes") > 0).agg(F.percentile_approx("dense", 1 - PROSE, 10_000)).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prose, structured = np.zeros(_SIZE**3), np.zeros(_SIZE**3)
        for pdf in batches:
            sequences, common = list(pdf["classes"]), pdf["dense"].to_numpy()
            for full in _portions(sequences):
                b = Batch.of([sequences[i] for i in full])
                size = np.diff(np.append(b.texts, len(b.seq)))
                w = np.repeat(np.minimum(1.0, WEIGHT / size), size)
                prose += np.bincount(b.tri, w * np.repeat(common[full] >= least, size), _SIZE**3)
                n = np.diff(np.append(b.lines, len(b.seq)))
                fit = (np.add.reduceat(_IS_STRUCTURE[b.seq].astype(np.int64), b.lines) >= STRUCTURE * n) & (np.add.reduceat(_IS_STUFF[b.seq].astype(np.int64), b.lines) <= STUFFED * n)
                structured += np.bincount(b.tri, w * np.repeat(fit, n), _SIZE**3)
        seen = np.flatnonzero((prose > 0) | (structured > 0))
        yield pd.DataFrame({"t": seen, "prose": prose[seen], "structured": structured[seen]})

    prose, structured = np.zeros(_SIZE**3), np.zeros(_SIZE**3)
    if least is not None:
        # sums of whole parts of a thousandth: the same whatever the order they come in
        parts = sequences.select("classes", "dense").mapInPandas(run, "t long, prose double, structured double")
        for r in parts.groupBy("t").agg(*[F.sum(F.round(F.col(c) * 1000).cast("long")).alias(c) for c in ("prose", "structured")]).collect():
            prose[r.t], structured[r.t] = r.prose / 1000, r.structured / 1000
    return Model(prose, structured)


# ---- pages ---------------------------------------------------------------------------------


def _judged(docs: DataFrame, key: str, text: str, lang: str | None) -> tuple[DataFrame, DataFrame, list[tuple]]:
    """(key, h1, h2 of every row; h1, h2, flag, share, perplexity, repeated of every different text; texts that hold a large part of the rows).

    Copies are judged once. They are told by two hashes, which are counted before they
    are shuffled, so one text may hold any share of the rows; each different text is then
    moved once.
    """
    spark = docs.sparkSession
    tag = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))), "^([a-z]{2,3})(?:[-_].*)?$", 1) if lang in docs.columns else F.lit("")
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashes = [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]
    rows = cut(docs.select(F.col(key).alias("key"), row.alias("row"), F.length(body).alias("size"), *hashes))
    copies = cut(rows.where(F.col("size") > 0).groupBy("h1", "h2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")))
    total = copies.agg(F.sum("n")).first()[0] or 0
    heavy = [tuple(r) for r in copies.where(F.col("n") > max(FLOOR, SHARE_OF_ROWS * total)).select("h1", "h2").collect()]
    parts = 3 * spark.sparkContext.defaultParallelism
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    moved = docs.select(row.alias("row"), body.alias("text"), tag.alias("lang"), *hashes).repartition(parts, "row", "h1", "h2")
    texts = cut(moved.join(copies.select("row", "h1", "h2").repartition(parts, "row", "h1", "h2"), ["row", "h1", "h2"], "left_semi"))
    sequences = cut(class_sequences(texts, vocabulary(texts), "h1", "h2"))
    model = train(sequences)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            share, page, again = model.judge(list(pdf["classes"]), pdf["new"].to_numpy())
            yield pd.DataFrame({"h1": pdf["h1"], "h2": pdf["h2"], "share": share, "log": page, "again": again})

    judged = sequences.select("h1", "h2", "classes", "new").mapInPandas(run, "h1 long, h2 long, share double, log double, again double")
    judged = judged.select("h1", "h2", model.flags(F.col("share"), F.col("log"), F.col("again")).alias("flag"), "share", F.exp("log").alias("perplexity"), F.exp("again").alias("repeated"))
    return rows.select("key", "h1", "h2"), judged.dropDuplicates(["h1", "h2"]), heavy  # a row that was sent twice is judged twice


def page_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """key, share, perplexity, repeated, flag of every row: the share of the text in abnormal stretches, its perplexity, the same when what it has said before is known, and whether it is no prose.

    Null and empty texts have share 0, perplexity 1 and no flag. The language column may
    be missing, null or wrong: it only says from which texts common words are learned.
    """
    rows, judged, heavy = _judged(docs, key, text, lang)
    got = skew_join(rows, judged, ["h1", "h2"], "left", heavy)
    return got.select(F.col("key").alias(key), *[F.round(F.coalesce(c, F.lit(v)), 6).alias(c) for c, v in (("share", 0.0), ("perplexity", 1.0), ("repeated", 1.0))], F.coalesce("flag", F.lit(False)).alias("flag"))


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """key of each page that is mostly repeated keywords, links or tags; copies of such a page are in it each."""
    rows, judged, heavy = _judged(docs, key, text, lang)
    return skew_join(rows, judged.where("flag"), ["h1", "h2"], heavy=heavy).select(F.col("key").alias(key))
