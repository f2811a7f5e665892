"""Toxicity scores of deobfuscated text.

Writers hide words by leetspeak (``1d10t``), spacing (``i d i o t``, ``i.d.i.o.t``),
repetition (``idiooot``, ``iidiot``), masks (``id*ot``) and look-alike letters. Each suspicious token or run of single letters is a
noisy copy of one or more words: every character opens a few ways to read it, a
mark or space also as a word's end, and a Viterbi pass over that lattice
finds the reading of greatest channel times language-model probability. The model
is a character trigram model over all documents. A document's score is a
logistic regression on the restored words it contains.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.llm import char_lm
from pacewise.llm.common import stage, text_session
from pacewise.llm.substring_dedup import split_words

#: Labelled rows that the classifier is fitted on, at most, per class (toxic, clean); taken by hash of the doc_id.
TRAIN_ROWS = (10_000, 20_000)
#: Words that may become features: in at least so many training documents, with at least this likelihood-ratio
#: statistic for toxic against clean, and the most telling so many.
LEAST_DOCS = 3
LEAST_RATIO = 15.0
FEATURES = 1_000
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "#": "h"}
#: Log-probabilities of the channel: a character as it is, for another, for none; a run of letters shortened.
SAME, OTHER, NONE, RUN = -0.05, -1.5, -1.0, -0.7
SPLIT = -4.0  # a mark that may be a letter, between two words
ANY = -3.0  # a mask for one letter, whichever
LONGEST = 64  # the readings of a longer token are not remembered
ALPHABET = r"^[ a-z0-9ß-öø-ÿ]+$"  # at most 69 characters, so the decoder's trigram table is bounded
ORDER = 3
REMEMBERED = 200_000
MARKS = re.compile(r"^\W+|\W+$")
LETTERS = re.compile(r"[^\W\d_]+")
RUNS = re.compile(r"([^\W\d_])\1{2,}")
TWICE = re.compile(r"([^\W\d_])\1")
TWICE_OR_MORE = re.compile(r"([^\W\d_])\1+")
MASK = "*"
MASKED = re.compile(r"[^\W\d_]\*[^\W\d_]")
ANY_LETTER = "abcdefghijklmnopqrstuvwxyz"
#: ASCII words with marks around them that stand for no letter, and two equal letters in a row (Arrow's patterns).
PLAIN = r"""^["'\[]*[A-Za-z]+[.,;:?"'\])]*$"""
DOUBLED = "|".join(c * 2 for c in ANY_LETTER)
# Small letters of other scripts that look like a Latin one (compatibility forms come from Unicode).
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l",
})


def folded(low: str) -> str:
    """A lower-case token with compatibility forms, accents and look-alike letters as plain Latin letters."""
    if low.isascii():
        return low
    apart = unicodedata.normalize("NFKD", low)
    return "".join(c for c in apart if not unicodedata.combining(c)).lower().translate(LOOKALIKES)


class Restorer:
    """Reads disguised tokens with a character trigram model (``logp`` by n-gram, ``backoff`` by context)."""

    def __init__(self, logp: dict[str, float], backoff: dict[str, float]) -> None:
        self.logp, self.backoff, self.steps = logp, backoff, {}
        self.known: dict[str, tuple[str, ...]] = {}
        self.floor = min(logp.values(), default=-10.0) - 2.0

    def step(self, context: str, char: str) -> float:
        """log P(char | the characters before it); the table of steps taken has at most as many entries as trigrams of known letters."""
        key = context + char
        found = self.steps.get(key)
        if found is None:
            found = self.backed_off(context, char)
            if len(self.steps) < REMEMBERED:
                self.steps[key] = found
        return found

    def backed_off(self, context: str, char: str) -> float:
        """The model's value, backing off to shorter contexts."""
        owed = 0.0
        while True:
            found = self.logp.get(context + char)
            if found is not None:
                return owed + found
            if not context:
                return owed + self.floor
            owed += self.backoff.get(context, 0.0)
            context = context[1:]

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, the strings it may stand for and their channel log-probabilities."""
        edges = []
        for m in re.finditer(r"(.)\1*", token, re.DOTALL):
            char, run = m[1], m[0]
            if char == " ":
                ways = [(" ", SAME), ("", NONE)]
            elif char.isalpha():
                ways = [(run, SAME * len(run))]
                if len(run) > 1:
                    ways += [(char * n, RUN) for n in (1, 2) if n < len(run)]
            else:
                ways = [(c * min(len(run), 2), OTHER) for c in LEET.get(char, "")] + [(c, OTHER) for c in LEET.get(char, "") if len(run) > 1]
                ways += [(run, SAME * len(run))] if char.isdigit() else [("", NONE), (" ", SPLIT if char in LEET else NONE)]
                if char == MASK:
                    ways += [(c, ANY) for c in ANY_LETTER]
            edges.append(ways)
        return edges

    def decode(self, token: str, edges: list[list[tuple[str, float]]] | None = None) -> tuple[str, float]:
        """The likeliest words behind ``token``, one space between, and their log-probability."""
        # A state's way back is a chain of (what came before, output), so a token of any length takes linear time.
        best: dict[str, tuple[float, tuple | None]] = {" " * (ORDER - 1): (0.0, None)}
        for ways in [*(self.lattice(token) if edges is None else edges), [(" ", 0.0)]]:
            reached: dict[str, tuple[float, tuple | None]] = {}
            for context, (score, back) in best.items():
                for out, channel in ways:
                    state, total = context, score + channel
                    for c in out:
                        total += self.step(state, c)
                        state = (state + c)[1 - ORDER:]
                    if state not in reached or total > reached[state][0]:
                        reached[state] = (total, (back, out))
            best = reached
        score, back = max(best.values(), key=lambda x: x[0])
        parts = []
        while back is not None:
            back, out = back
            parts.append(out)
        return " ".join("".join(reversed(parts)).split()), score

    def word(self, token: str) -> str:
        """The word (or words) that a token reads as: lower case, without marks around it, disguises undone."""
        low = token.lower()
        bare = MARKS.sub("", low)
        lone = len(low) - len(bare) <= 2 and any(c in LEET for c in low[:1] + low[-1:])
        plain = (LETTERS.fullmatch(bare) and not RUNS.search(bare) and not lone) or not bare
        return bare if plain else self.decode(low if lone else bare)[0]

    def letters_only(self, token: str) -> str:
        """The likeliest words behind ``token`` if every digit in it stands for a letter."""
        edges = self.lattice(token)
        return self.decode(token, [[w for w in ways if not w[0].isdigit()] or ways for ways in edges])[0]

    def masked(self, token: str) -> str:
        """The likeliest words behind ``token`` if every mask in it stands for a letter."""
        edges = self.lattice(token)
        return self.decode(token, [[w for w in ways if w[0].isalpha()] if any(w[1] == ANY for w in ways) else ways for ways in edges])[0]

    def read(self, token: str) -> tuple[str, ...]:
        """The words that a token reads as, and its runs of letters as they are written if it is no plain word.

        Letters and digits that read as a word with digits are also read as letters
        alone, masks also as letters, letters that stand twice also as one, and
        look-alike and accented letters also as the plain letters they resemble.
        """
        low = token.lower()
        found = []
        for form in dict.fromkeys((low, folded(low))):
            main, bare = self.word(form), MARKS.sub("", form)
            found += main.split()
            if any(map(str.isdigit, main)):
                found += self.letters_only(bare).split()
            elif main == bare and TWICE.search(bare):
                found += self.decode(bare)[0].split()
            if MASKED.search(form):
                found += self.masked(bare).split()
            found += [x for x in LETTERS.findall(form) if len(x) > 1]
        return tuple(dict.fromkeys(found))

    def readings(self, token: str) -> tuple[str, ...]:
        """``read``, remembered."""
        found = self.known.get(token)
        if found is None:
            found = remember(self.known, token, self.read(token))
        return found

    def spaced(self, letters: list[str]) -> list[str]:
        """The words behind single letters with spaces between; letters that stay by themselves are none.

        The first or the last letter may be a word of its own (``a i d i o t``),
        so the run is also read without them.
        """
        joined = " ".join(x.lower() for x in letters)
        ways = {joined, joined[2:], joined[:-2], joined[2:-2]}
        return list(dict.fromkeys(w for way in sorted(ways) for w in self.decode(way)[0].split() if len(w) > 1))

    def words(self, texts: pa.Array, numbers: Callable[[pa.Array], list[tuple[int, ...]]], number: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
        """(number, document) of every restored word of ``texts``, spaced-out words in addition.

        ``numbers`` gives the numbers of the readings of each of some tokens and
        ``number`` that of a word (-1: left out).
        """
        words, count = split_words(texts)
        coded = words.dictionary_encode()
        read = numbers(coded.dictionary)
        sizes = np.fromiter(map(len, read), dtype=np.int64, count=len(read))
        flat = np.fromiter((k for x in read for k in x), dtype=np.int64, count=int(sizes.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(count)), count)
        single = pc.utf8_length(words).to_numpy(zero_copy_only=False) == 1
        new = single & ~np.concatenate([[False], single[:-1] & (doc[1:] == doc[:-1])]) if len(doc) else single
        last = single & ~np.concatenate([single[1:] & (doc[1:] == doc[:-1]), [False]]) if len(doc) else single
        extra, owner = [], []
        long = np.flatnonzero(last) > np.flatnonzero(new)
        for a, b in zip(np.flatnonzero(new)[long], np.flatnonzero(last)[long], strict=True):
            found = [k for k in map(number, self.spaced(words.slice(a, b - a + 1).to_pylist())) if k >= 0]
            extra += found
            owner += [doc[a]] * len(found)
        some = sizes[which] > 0
        which, doc = which[some], doc[some]
        times = sizes[which]
        at = np.repeat((np.cumsum(sizes) - sizes)[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.concatenate([flat[at], np.asarray(extra, dtype=np.int64)]), np.concatenate([np.repeat(doc, times), np.asarray(owner, dtype=doc.dtype)])


def remember(memory: dict, token: str, value: tuple) -> tuple:
    """``value``, kept for the next time; the memory is bounded."""
    if len(memory) >= REMEMBERED:
        memory.clear()
    if len(token) <= LONGEST:
        memory[token] = value
    return value


def shortest(word: str) -> str:
    """``word`` with each run of a letter as one: the same for all readings of a word of letters."""
    return TWICE_OR_MORE.sub(r"\1", word)


class Marker:
    """Finds the features of ``index`` in texts; what a token gives is remembered.

    A word of letters can only read as a feature that is equal to it when every run of
    a letter counts as one, so other words of letters are told without a search.
    """

    def __init__(self, restore: Restorer, index: dict[str, int]) -> None:
        self.restore, self.index, self.known = restore, index, {}
        self.short = {shortest(w) for w in index}
        self.words = pa.array(list(index), pa.string())

    def hopeless(self, token: str) -> bool:
        low = token.lower()
        if low[:1] in LEET or low[-1:] in LEET:
            return False
        bare = MARKS.sub("", low)
        return bool(LETTERS.fullmatch(bare)) and shortest(bare) not in self.short and (bare.isascii() or shortest(folded(bare)) not in self.short)

    def features(self, token: str) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            found = () if self.hopeless(token) else tuple(self.index[w] for w in self.restore.read(token) if w in self.index)
            remember(self.known, token, found)
        return found

    def numbers(self, tokens: pa.Array) -> list[tuple[int, ...]]:
        """``features`` of each token; words of ASCII letters, none twice in a row, are looked up all at once."""
        plain = pc.match_substring_regex(tokens, PLAIN)
        bare = pc.ascii_lower(pc.replace_substring_regex(tokens.filter(plain), "[^A-Za-z]+", ""))
        apart = pc.invert(pc.match_substring_regex(bare, DOUBLED)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))[apart]
        found = pc.fill_null(pc.index_in(bare.filter(pa.array(apart)).cast(pa.string()), self.words), -1).to_numpy(zero_copy_only=False)
        out: list[tuple[int, ...]] = [()] * len(tokens)
        for k, f in zip(at[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
            out[k] = (f,)
        rest = np.ones(len(tokens), dtype=bool)
        rest[at] = False
        for k, token in zip(np.flatnonzero(rest).tolist(), tokens.filter(pa.array(rest)).to_pylist(), strict=True):
            out[k] = self.features(token)
        return out

    def presence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs of the features that each text has, every pair once."""
        feature, doc = self.restore.words(texts, self.numbers, lambda w: self.index.get(w, -1))
        pairs = np.unique(doc.astype(np.int64) * max(len(self.index), 1) + feature)
        return pairs // max(len(self.index), 1), pairs % max(len(self.index), 1)


def restorer(docs: DataFrame) -> Callable[[], Restorer]:
    """Counts the decoder's trigram model over all of ``docs`` (text); makes a Restorer where it is called."""
    pooled = text_session(docs).select(F.lower("text").alias("text"), F.lit("").alias("lang"))
    probabilities, backoffs = char_lm.kneser_ney(char_lm.count_grams(pooled, ORDER), ORDER)
    logp = {r["gram"]: r["logp"] for r in probabilities.where(F.col("gram").rlike(ALPHABET)).collect()}
    backoff = {r["context"]: r["backoff"] for r in backoffs.where(F.col("context").rlike(ALPHABET)).collect()}
    return lambda: Restorer(logp, backoff)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows per class that are not held out, each text once."""
    usable = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    by_hash = F.xxhash64("doc_id", F.lit("train"))
    chosen = (usable.where("toxic = 1").orderBy(by_hash, "doc_id").limit(most[0])
              .union(usable.where("toxic <> 1").orderBy(by_hash, "doc_id").limit(most[1])))
    chosen = stage(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "chosen-labels")
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # at most sum(most) rows
    return stage(rows.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "training")


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    for at, part in char_lm.text_slices(texts):
        yield at, texts.slice(at, len(part))


def telling_words(rows: DataFrame, make: Callable[[], Restorer], least: int = LEAST_DOCS, most: int = FEATURES) -> list[str]:
    """The restored words that are likelier in toxic training documents, the most telling first (by likelihood ratio)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            for at, texts in slices(batch.column(0)):
                ids: dict[str, int] = {}
                number = lambda w: ids.setdefault(w, len(ids))  # noqa: B023, E731
                which, doc = read.words(texts, lambda tokens: [tuple(map(number, read.readings(t))) for t in tokens.to_pylist()], number)  # noqa: B023
                words, pair = list(ids), np.unique(np.stack([which, doc]), axis=1)
                n = np.bincount(pair[0], minlength=len(words))
                bad = np.bincount(pair[0][toxic[at + pair[1]]], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n), pa.array(bad)], names=["word", "n", "bad"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("bad")).first()
    if not total["bad"] or total["bad"] == total["n"]:
        return []
    share = total["bad"] / total["n"]
    counts = rows.mapInArrow(count, "word string, n bigint, bad bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    part = lambda x, p: F.when(x > 0, x * F.ln(x / (F.col("n") * p))).otherwise(F.lit(0.0))
    ratio = 2 * (part(F.col("bad"), share) + part(F.col("n") - F.col("bad"), 1 - share))
    told = counts.where((F.col("word") != "") & (F.col("n") >= least) & (F.col("bad") > F.col("n") * share) & (ratio >= LEAST_RATIO))
    return [r["word"] for r in told.orderBy(ratio.desc(), "word").limit(most).collect()]


def fit(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, features: int, penalty: float = 0.1, rounds: int = 500) -> np.ndarray:
    """Weights (the last is the bias) of an L2-penalised logistic regression.

    Accelerated gradient steps, each coordinate with a step of its own: its
    documents' numbers of features bound its curvature.
    """
    n = len(toxic)
    sizes = np.bincount(row, minlength=n) + 1.0
    curve = np.append(np.bincount(feature, weights=sizes[row], minlength=features) / 4 + penalty, sizes.sum() / 4)
    weights, look = np.zeros(features + 1), np.zeros(features + 1)
    for k in range(rounds):
        margin = np.bincount(row, weights=look[feature], minlength=n) + look[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic
        slope = np.append(np.bincount(feature, weights=error[row], minlength=features) + penalty * look[:-1], error.sum())
        after = look - slope / curve
        look = after + k / (k + 3) * (after - weights)
        weights = after
    return weights


def train(docs: DataFrame, labels: DataFrame, make: Callable[[], Restorer]) -> tuple[dict[str, int], np.ndarray]:
    """Features and weights, from the bounded training rows."""
    rows = training_rows(docs, labels)
    index = {w: i for i, w in enumerate(telling_words(rows, make))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(make(), index)
        for batch in batches:
            for at, texts in slices(batch.column(0)):
                doc, feature = marker.presence(texts)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)).cast(pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature))], names=["toxic", "features"])

    table = rows.select("text", "toxic").mapInArrow(run, "toxic bigint, features array<bigint>").toArrow()  # at most sum(TRAIN_ROWS) rows
    table = table.combine_chunks()
    toxic = (table["toxic"].to_numpy() == 1).astype(float)
    lists = table["features"].to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if lists else np.zeros(0, dtype=np.int64)
    feature = np.asarray([f for x in lists for f in x], dtype=np.int64)
    if not toxic.any() or toxic.all():
        return index, np.append(np.zeros(len(index)), math.log(1e-3))
    return index, fit(row, feature, toxic, len(index))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text; nothing else of it is used).

    ``labels`` has doc_id, toxic; only rows that are not held out are learned
    from, and without any the score is a small constant. A null or empty text
    gets the score of a text without telling words. Repeated rows are scored
    alike; an empty table gives no rows.
    """
    make = restorer(docs)
    index, weights = train(docs, labels, make)
    markers: list[Marker] = []

    def score(texts: pa.Array) -> pa.Array:
        if not markers:
            markers.append(Marker(make(), index))
        margin = np.full(len(texts), weights[-1])
        for at, part in slices(texts):
            doc, feature = markers[0].presence(part)
            margin[at:at + len(part)] += np.bincount(doc, weights=weights[feature], minlength=len(part))
        return pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.arrow_udf(score, "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
