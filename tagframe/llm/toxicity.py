"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

A word is suspect if digits or signs stand among its letters, if a letter comes
three times or more in a row, if signs split it into letters, or if single letters
follow each other as words. Its characters span a lattice: each stands for one or
more letters (leetspeak), for a repetition of the letter before, or for nothing (a
separator), at a price. Viterbi decoding finds the path that a character trigram
model, with a word model at its end, likes best. Words without such signs have one
path only and stay as they are.

Words are counted over all documents and stay a distributed table. Of the models
only the trigrams, whose number is bounded by the alphabet, go to the driver and
to the workers. Each suspect token of the corpus is decoded once: the last
contexts of its lattice give its candidates, which are joined with the words.

Scores come from a logistic regression over words and word beginnings of the
restored text. It alone is trained on a sample: labelled documents outside the
held-out fold, at most ``sample`` of them (a documented bound, 8,000), chosen by a
hash of doc_id, since they go to the driver. Labels, language, source and doc_id
are no inputs of a score.

Inputs: null text counts as empty and gets the score of no evidence; of several
labels of one doc_id the highest counts; repeated rows get equal scores; without
any label of both kinds all scores are 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.llm import common

SAMPLE, FEATURES, THRESHOLD = 8_000, 1_500, 0.7
KEPT_WORDS, SALTS = 300_000, 16

#: Letters that signs stand for in leetspeak (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = ".-_*~'`, "
EDGES = "\"'.,;:?!()[]{}<>*&%#$|~`-_="

TRIPLE = re.compile(r"([^\W\d_])\1\1").search
OUTER = "\"'.,;:?()[]{}<>*&%#~`-_="
SPLIT = re.compile(r"^[^\W_](?:[.\-_*~'`,][^\W_]){2,}$").match
SINGLE = r"[^\W_]|[@$!|+(€]"
#: Single characters between white space; quotes and brackets may stand before the first, punctuation behind the last.
SPACED = re.compile(rf"(?<!\S)[\"'\[{{<]*+((?:{SINGLE})(?:\s+(?:{SINGLE})){{2,}})[\"'.,;:?!)\]}}>]*(?!\S)").findall
#: The last two characters of such a run, without which there is none: a cheaper search.
LAST_TWO = re.compile(rf"\s(?:{SINGLE})\s+(?:{SINGLE})[\"'.,;:?!)\]}}>]*(?!\S)").search
WIDE, ALNUM = re.compile(r"\s\s+|[^\S ]").split, re.compile(r"[^\W_]").search
LETTER, INNER_SIGN = re.compile(r"[^\W\d_]").search, re.compile(r"[0-9@$!|+(€*#]").search
BEFORE, BEHIND = re.compile(r"[0-9@$!|+(€]++[^\W\d_]{2}").match, "0123456789@$!|+(€"
WILDCARDS = "*#"
LEET_PRICE, REPEAT_PRICE, DROP_PRICE, TWICE_PRICE, WILD_PRICE = -0.7, -0.7, -0.3, -0.2, -1.5


def disguised(token: str) -> bool:
    """Digits or signs between letters, before two or behind two, or a letter three times; in time linear in the token's length."""
    first = LETTER(token)
    if first is None:
        return False
    last = next(k for k in range(len(token) - 1, -1, -1) if LETTER(token[k]))
    if (found := INNER_SIGN(token, first.end())) and found.start() < last:
        return True
    body = token.rstrip(BEHIND)
    return bool(BEFORE(token) or TRIPLE(token) or (len(body) < len(token) and len(body) > 1 and LETTER(body[-1]) and LETTER(body[-2])))


class Channel:
    """The character model and the decoder; ``counts`` are the trigrams of the words, if counted elsewhere."""

    def __init__(self, words: Counter, counts: Counter | None = None):
        if counts is None:
            counts = trigrams(words.items())
        contexts: Counter = Counter()
        for gram, n in counts.items():
            contexts[gram[:2]] += n
        self.alphabet = sorted({g[2] for g in counts if g[2].isascii() and g[2].isalpha()})
        self.letters = len({g[2] for g in counts}) + 1
        self.grams = {g: math.log((n + 0.1) / (contexts[g[:2]] + 0.1 * self.letters)) for g, n in counts.items()}
        self.unseen = {c: math.log(0.1 / (n + 0.1 * self.letters)) for c, n in contexts.items()}
        self.never = math.log(1 / self.letters) - 2
        total = sum(words.values()) or 1
        self.words = {w: math.log(n / total) for w, n in words.items()}

    def step(self, context: str, letter: str) -> float:
        found = self.grams.get(context + letter)
        return self.unseen.get(context, self.never) if found is None else found

    def candidates(self, token: str) -> list[tuple[float, str]]:
        """The best path to each context that the lattice can end in: its price under the character model, and its letters.

        A context is the last two letters, so nothing is lost by keeping one path to each; all are kept.
        """
        # context -> price, path: (its last letter, the path before it)
        paths: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        for k, sign in enumerate(token):
            options = [(c, LEET_PRICE) for c in LEET.get(sign, "")]
            if sign in WILDCARDS:
                options += [(c, WILD_PRICE) for c in self.alphabet]
            if sign.isalpha():
                options.append((sign, 0.0))
            silent = DROP_PRICE if sign in SEPARATORS or not options else None
            again = {c for c, _ in options} if k > 0 and token[k - 1] == sign else ()
            longer: dict[str, tuple[float, tuple | None]] = {}

            def offer(context: str, price: float, said: tuple | None, longer=longer) -> None:
                if context not in longer or longer[context][0] < price:
                    longer[context] = (price, said)

            for context, (price, said) in paths.items():
                if silent is not None:
                    offer(context, price + silent, said)
                if said and said[0] in again:
                    offer(context, price + REPEAT_PRICE * (k > 1 and token[k - 2] != sign), said)
                for c, extra in options:
                    offer(context[1] + c, price + extra + self.step(context, c), (c, said))
            paths = longer
        return [(p + self.step(c, "$"), spelled(said)) for c, (p, said) in paths.items()]

    def decode(self, token: str) -> str:
        """The best candidate; log n / total of a known word may beat its price."""
        return max(((max(p, self.words[s] + TWICE_PRICE * len(token)) if s in self.words else p, s) for p, s in self.candidates(token)), default=(0.0, ""))[1]


def spelled(path: tuple | None) -> str:
    letters = []
    while path is not None:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


def trigrams(words: Iterable[tuple[str, int]]) -> Counter:
    counts: Counter = Counter()
    for word, n in words:
        s = f"^^{word}$"
        for k in range(2, len(s)):
            counts[s[k - 2 : k + 1]] += n
    return counts


def tokens(text: str) -> set[str]:
    """What stands between white space, and runs of single letters in one."""
    low = text.lower()
    return {*low.split(), *spaced(low)}


def spaced(low: str) -> set[str]:
    """Runs of three or more single characters, with one blank between: whole, and what wider gaps divide, each also without signs at its end."""
    out = set()
    for run in SPACED(low) if LAST_TWO(low) else ():
        for part in (run, *WIDE(run)):
            one = " ".join(part.split())
            for x in (one, one.rstrip(EDGES + " ")):
                if len(x) > 4 and ALNUM(x):
                    out.add(x)
    return out


def parts(token: str) -> tuple[str, str | None]:
    """The word of a token and, if that is suspect, what to decode; a run of single characters is no word."""
    if " " in token:
        return "", token
    bare = token.strip(EDGES)
    if bare.isalpha() and token[0].isalpha() and not TRIPLE(bare):
        return bare, None
    wide = token.strip(OUTER)
    # One sign before the word may be its first letter; signs behind it are its edge if several.
    if len(wide) > 1 and wide[0] in LEET and not wide[0].isalnum() and wide[1].isalpha():
        bare = wide[0] + bare
    if SPLIT(bare) or disguised(bare):
        return bare.strip(EDGES), bare
    return bare, None


def restore(token: str, channel: Channel) -> tuple[str, ...]:
    """The word of a token and, if that is suspect, what it was before its disguise."""
    word, suspect = parts(token)
    return (word,) if suspect is None else (word, channel.decode(suspect))


def clean(token: str) -> str | None:
    """The word of a token as the language models count it."""
    word = token.strip(EDGES)
    return word if word.isalpha() and not TRIPLE(word) else None  # letters alone are disguised by nothing else


def features(words: Iterable[str]) -> set[str]:
    """Words, and beginnings of 4 to 7 letters, marked by a dash."""
    out = set()
    for w in words:
        out.add(w)
        for n in range(4, min(8, len(w))):
            out.add(w[:n] + "-")
    return out


class Model:
    """The regression. ``known`` has what suspect tokens were; without it the texts are the whole corpus."""

    def __init__(self, texts: list[str], labels: list[int], most: int = FEATURES, known: dict[str, str] | None = None):
        self.channel = None
        if known is None:
            words: Counter = Counter()
            for t in texts:
                words.update(w for w in map(clean, t.lower().split()) if w)
            self.channel = Channel(words)
        meant = cache(self.channel.decode) if known is None else known.__getitem__
        positive, total = Counter(), Counter()
        # Words and features are numbers, and a document an array of its words' numbers, as all this is held in the driver.
        number: dict[str, int] = {}
        names: dict[str, int] = {}
        of_word: list[tuple[int, ...]] = []
        rows: list[np.ndarray] = []
        for t, y in zip(texts, labels, strict=True):
            found: set[int] = set()
            for word, suspect in map(parts, tokens(t)):
                for w in (word,) if suspect is None else (word, meant(suspect)):
                    k = number.get(w)
                    if k is None:
                        k = number[w] = len(number)
                        of_word.append(tuple(names.setdefault(f, len(names)) for f in sorted(features([w]))) if w else ())
                    found.add(k)
            rows.append(np.array(sorted(found), np.int32))
            f = set().union(*(of_word[k] for k in found))
            total.update(f)
            if y:
                positive.update(f)
        positive = Counter({f: positive[k] for f, k in names.items() if positive[k]})
        total = Counter({f: total[names[f]] for f in positive})
        n1, n = sum(labels), len(labels)
        self.weights: dict[str, float] = {}
        self.bias = -50.0
        if not 0 < n1 < n:
            return
        base = n1 / n

        def surprise(f: str) -> float:
            """Log-likelihood ratio of the feature's positives against the base rate, for features of the positive kind."""
            k, m = positive[f], total[f]
            p = k / m
            if k < 4 or p < 2 * base:
                return 0.0
            return 2 * (k * math.log(p / base) + (m - k) * (math.log((1 - p) / (1 - base)) if p < 1 else 0.0))

        ranked = sorted(((surprise(f), f) for f in positive if positive[f] >= 4), key=lambda x: (-x[0], x[1]))
        chosen = [f for s, f in ranked[:most] if s > 15]
        place = {names[f]: k for k, f in enumerate(chosen)}
        x = np.zeros((n, len(chosen) + 1), np.float32)
        x[:, -1] = 1
        for row, found in enumerate(rows):
            x[row, [place[f] for k in found.tolist() for f in of_word[k] if f in place]] = 1
        w = fit(x, np.array(labels, np.float32))
        self.weights = {f: float(v) for f, v in zip(chosen, w[:-1], strict=True)}
        self.bias = float(w[-1])

    def score(self, text: str, seen: dict[str, tuple[str, ...]]) -> float:
        """The score of a text where the texts of training are the whole corpus."""
        found: set[str] = set()
        for token in tokens(text):
            known = seen.get(token)
            if known is None:
                known = seen[token] = tuple(sorted(f for f in features(restore(token, self.channel)) if f in self.weights))
            if known:
                found.update(known)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 300) -> np.ndarray:
    """Logistic regression by accelerated gradient descent; the last column is the bias and not penalised."""
    n = len(y)
    w, before = np.zeros(x.shape[1], np.float64), np.zeros(x.shape[1], np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0
    # The largest eigenvalue of x'x, by power iteration, bounds the curvature. All products are of single precision, so x is not copied.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(x @ v) ** 2 + penalty)
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32), -60, 60)))
        before, w = w, ahead - rate * (x.T @ (p - y) + ridge * ahead)
    return w


def fold(name: str = "doc_id"):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(3))


def gathered(docs: DataFrame) -> DataFrame:
    """(suspect, token, n): how often each clean word stands in all documents, and each suspect token once or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        runs: set[str] = set()

        def said() -> pa.RecordBatch:
            words: dict[str, int] = {}
            suspects: Counter = Counter()
            for token, n in met.items():
                word = clean(token)
                if word:
                    words[word] = words.get(word, 0) + n
                    if token[0].isalpha():  # as in parts()
                        continue
                runs.add(token)
            for token in runs:
                if (suspect := parts(token)[1]) is not None:
                    suspects[suspect] += 1
            met.clear()
            runs.clear()
            kinds = [False] * len(words) + [True] * len(suspects)
            return pa.record_batch([pa.array(kinds, pa.bool_()), pa.array([*words, *suspects], pa.string()), pa.array([*words.values(), *suspects.values()], pa.int64())], names=["suspect", "token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                low = text.lower()
                met.update(low.split())
                runs.update(spaced(low))
                if len(met) + len(runs) > KEPT_WORDS:
                    yield said()
        yield said()

    counts = docs.select(common.text_or_empty().alias("text")).mapInArrow(run, "suspect boolean, token string, n long")
    return common.stage(counts.groupBy("suspect", "token").agg(F.sum("n").alias("n")), "toxicity-words")


def counted(words: DataFrame) -> Counter:
    """The trigrams of the words (token, n); at most the cube of the alphabet, so they go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = trigrams(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    got = words.select("token", "n").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return Counter(dict(sorted(zip(got.column("gram").to_pylist(), got.column("n").to_pylist(), strict=True))))


def decoded(found: DataFrame) -> DataFrame:
    """(token, meant) of every suspect token of gathered(): its best candidate under the counts of all documents."""
    words = found.where("NOT suspect").select(F.col("token").alias("said"), "n")
    counts = counted(found.where("NOT suspect"))
    packed = zlib.compress(pickle.dumps(Channel(Counter(), counts)))
    # Each word has one trigram that ends it.
    total = max(sum(n for g, n in counts.items() if g[2] == "$"), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = pickle.loads(zlib.decompress(packed))
        for batch in batches:
            out = [(t, s, p) for t in batch.column(0).to_pylist() for p, s in channel.candidates(t)]
            yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))], names=["token", "said", "price"])

    paths = found.where("suspect").select("token").mapInArrow(run, "token string, said string, price double")
    known = F.log(F.col("n") / F.lit(total)) + F.lit(TWICE_PRICE) * F.length("token")
    # greatest() passes over the null of an unknown word.
    best = paths.join(words, "said", "left").groupBy("token").agg(F.max(F.struct(F.greatest("price", known).alias("price"), "said")).alias("best"))
    return common.stage(best.select("token", F.col("best.said").alias("meant")), "toxicity-decoded")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, known: DataFrame | None = None) -> Model:
    """The regression over the sample; ``known`` is decoded() of the corpus."""
    if known is None:
        known = decoded(gathered(docs))
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 1))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(rows), "doc_id")  # at most ``sample`` rows
    got = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    texts = got.column("text").to_pylist()
    wanted = sorted({s for t in texts for _, s in map(parts, tokens(t)) if s is not None})
    meant = known.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"token": pa.array(wanted, pa.string())}))), "token", "left_semi").toArrow()  # tokens of the sample
    said = dict(zip(meant.column("token").to_pylist(), meant.column("meant").to_pylist(), strict=True))
    return Model(texts, [int(v > 0) for v in got.column("toxic").to_pylist()], known=said)


def score(docs: DataFrame, model: Model, known: DataFrame) -> DataFrame:
    """doc_id and score of every document; ``known`` is decoded() of the corpus."""
    names = sorted(model.weights)
    place = {f: k for k, f in enumerate(names)}
    heads = {f[:4] for f in names if f.endswith("-")}

    def places(word: str) -> list[int]:
        if word[:4] in heads:
            return sorted(place[f] for f in features([word]) if f in place)
        return [place[word]] if word in place else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All tokens met, and what those are that tell something.
        seen: set[str] = set()
        telling: dict[str, tuple[list[int], str | None]] = {}
        for batch in batches:
            plain, suspects = [], []
            for text in batch.column(1).to_pylist():
                said = tokens(text)
                fresh = said - seen
                seen |= fresh
                for token in fresh:
                    word, suspect = parts(token)
                    if (at := places(word)) or suspect is not None:
                        telling[token] = (at, suspect)
                found, open_ = set(), set()
                for token in said & telling.keys():
                    at, suspect = telling[token]
                    found.update(at)
                    if suspect is not None:
                        open_.add(suspect)
                plain.append(sorted(found))
                suspects.append(sorted(open_))
                if len(seen) > KEPT_WORDS:
                    seen.clear()
                    telling.clear()
            yield pa.record_batch([batch.column(0), pa.array(plain, pa.list_(pa.int32())), pa.array(suspects, pa.list_(pa.string()))], names=["doc_id", "plain", "suspects"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, f) for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (f := places(m))]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], names=["token", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(read, "doc_id long, plain array<int>, suspects array<string>")
    # Staged, as the numbers of its rows would change if it were read anew.
    rows = common.stage(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    # A token may stand in very many documents: its rows go to several partitions.
    open_ = rows.select("row", F.explode("suspects").alias("token")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    telling = known.select("token", "meant").mapInArrow(weigh, "token string, found array<int>")
    telling = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    more = open_.join(telling, ["token", "salt"]).groupBy("row").agg(F.flatten(F.collect_list("found")).alias("more"))
    every = F.array_sort(F.array_distinct(F.concat("plain", F.coalesce("more", F.array().cast("array<int>")))))
    weights = F.array(*[F.lit(model.weights[f]) for f in names]).cast("array<double>")
    z = F.aggregate(every, F.lit(model.bias), lambda s, k: s + F.get(weights, k))
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))
    return rows.join(more, "row", "left").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def predict(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; the models are trained when this is called."""
    known = decoded(gathered(docs))
    scored = score(docs, train(docs, labels, sample, known), known)
    held = F.coalesce(fold() == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
