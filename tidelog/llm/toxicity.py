"""Toxicity: restore obfuscated words by a noisy channel, then score the restored text.

Channel: a word that looks disguised (digits or signs among letters, letters repeated, letters spaced
out, look-alike characters) spans a lattice of what each character may stand for, may be doubled
from, or be dropped as a separator; a space between letters that stand apart is dropped or kept. Viterbi search under a character model of all words of
the corpus gives the likeliest readings.
Score: words and word beginnings that labelled texts show to be typical of label 1 carry log ratios; a
text's counts, shares and largest ratios go through an ensemble of conjunctive rules.

Before a word is decoded for its weight, its lattice meets the trie of all weighted features: if no path spells
one, no reading can weigh anything, however likely. So only words that may matter are decoded, with the same result.

Null and empty texts score like a text without any such word; without usable labels every text
scores 0.5; repeated rows are scored each; other columns, whatever their names, are ignored; an empty table gives an
empty one. Texts and words of any length are read whole, in time that grows with their length.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, quality_classifier, shared, word_counts
from . import text as tx

LEAST_SHARE = 1e-5
CACHE_WORDS = 300_000
MOST_FEATURES = 4000
MOST_GRAMS = 400_000
PREFIXES = (4, 5, 6, 7)

#: What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h", "%": "x", "&": "a",
}
#: Letters of other scripts that look like Latin ones.
LOOKS_LIKE = str.maketrans("аеорсухіјѕԁһкмтвпАЕОРСУХІЈЅКМТВН", "aeopcyxijsdhkmtbnaeopcyxijskmtbh")
SEPARATORS = ".-_*~'·"
EDGE = " \t.,;:!?\"'()[]{}*#$%&|<>+=~-_/\\`^@"
_AROUND = " .,;:?!\"'()[]"
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_UNIT = r"(?:[^\W_][̀-ͯ]*|[@$!|*+(<€£¥#%&])[.,;:!?)\"'\]]*"
_SPACED = re.compile(rf"(?<!\S)[\"'(\[]*{_UNIT}(?:\s+{_UNIT}){{2,}}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")
#: Letters of a spaced-out run that are read at once, and how many of them the next piece reads again.
PIECE, AGAIN = 200, 24
#: Words that fold to their lower case.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_THRICE = re.compile(r"(.)\1\1")
_TWICE = re.compile(r"(.)\1+")


ORDER = 4
START, END = "^", "$"


def grams(word: str) -> Iterator[str]:
    """The character 1- to 4-grams that end at each character of a word and at its end."""
    s = START * (ORDER - 1) + word + END
    return (s[i - k : i + 1] for i in range(ORDER - 1, len(s)) for k in range(ORDER))


class Rare:
    """Weights of n-grams in sorted arrays: 24 bytes each, found by binary search."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.weights = grams[order], weights[order]

    def get(self, gram: str, default: float = 0.0) -> float:
        i = int(np.searchsorted(self.grams, gram))
        return float(self.weights[i]) if i < len(self.grams) and self.grams[i] == gram else default


NONE = Rare(np.zeros(0, f"U{ORDER}"), np.zeros(0))


class CharModel:
    """Interpolated character 4-grams of words, weighted by the logarithm of their counts."""

    ORDER, START, END = ORDER, START, END

    def __init__(self, words: dict[str, int], counts: dict[str, float] | None = None):
        """From counts of n-grams; from the words alone without them. `words` are known as they stand."""
        self.words = set(words)
        self.counts: dict[str, float] = defaultdict(float)
        self.context: dict[str, float] = defaultdict(float)
        self.known: dict[tuple[str, str], float] = {}
        self.rare = self.rare_context = NONE  # what the dictionaries don't hold
        self.some_rare = False
        self.usual = 1.0  # weight of a word that is just frequent enough to be known
        for g, n in (counts or {}).items():
            self.counts[g] += n
            self.context[g[:-1]] += n
        if counts is None:
            for w, n in words.items():
                self.add(w, 1 + math.log(n))

    def add(self, word: str, weight: float) -> None:
        for g in grams(word):
            for table, rare, key in ((self.counts, self.rare, g), (self.context, self.rare_context, g[:-1])):
                table[key] = (table[key] if key in table else rare.get(key)) + weight
        self.known.clear()

    def add_rare(self, found: np.ndarray, weights: np.ndarray) -> None:
        """n-grams beside those in the dictionary, and what they add to their contexts."""
        self.rare, self.some_rare = Rare(found, weights), True
        contexts, of = np.unique(np.array([g[:-1] for g in found.tolist()], f"U{self.ORDER - 1}"), return_inverse=True)
        total = np.bincount(of, weights, len(contexts))
        other = np.ones(len(contexts), bool)
        for i, h in enumerate(contexts.tolist()):
            if h in self.context:
                self.context[h] += total[i]
                other[i] = False
        self.rare_context = Rare(contexts[other], total[other])
        self.known.clear()

    def log(self, context: str, c: str) -> float:
        """log P(c | the last characters of context)."""
        key = (context, c)
        out = self.known.get(key)
        if out is None:
            p = 1e-4
            for k in range(self.ORDER):
                h = context[len(context) - k :]
                n, both = self.context.get(h, 0.0), self.counts.get(h + c, 0.0)
                if self.some_rare:  # else there is nothing to search
                    n, both = n or self.rare_context.get(h), both or self.rare.get(h + c)
                p = (both + 4.0 * p) / (n + 4.0)
            out = self.known[key] = math.log(p)
        return out


def fold(word: str) -> str:
    """Lower case, no accents hidden as marks of their own, look-alikes and hidden characters resolved."""
    if _LATIN.fullmatch(word):
        return word.lower()
    plain = _HIDDEN.sub("", unicodedata.normalize("NFKC", word)).translate(LOOKS_LIKE).lower()
    return "".join(c for c in plain if not unicodedata.combining(c))


def disguised(word: str) -> bool:
    """Whether a folded word without its edges is worth decoding: signs among letters, or a letter twice in a row."""
    if word.isalpha():
        return bool(_TWICE.search(word))
    return sum(map(str.isalpha, word)) >= 1 and len(word) >= 3 and any(c in STANDS_FOR or c in SEPARATORS for c in word)


def with_edges(folded: str, plain: str) -> str | None:
    """The word with signs at its edges that may stand for letters ($illy, cra$$); longer runs are decoration."""
    if len(folded) == len(plain):
        return None
    at = folded.find(plain)
    head, tail = folded[:at], folded[at + len(plain) :]
    head, tail = head.lstrip(_AROUND), tail.rstrip(_AROUND)
    letters = lambda x: x if len(x) <= 2 and all(c in STANDS_FOR for c in x) else ""
    head, tail = letters(head), letters(tail)
    return head + plain + tail if head or tail else None


def choices(word: str) -> Iterator[list[tuple[str, float]]]:
    """The lattice: for each character, what it may have been and the log cost; '' drops it.

    The third and later of a run of the same sign are decoration and dropped.
    """
    before = last = ""
    for c in word:
        letter = c.isalpha()
        if c == last == before and not letter:
            yield [("", -1.5)]
            continue
        options = [(c, 0.0 if letter else -8.0)]
        options += [(x, -1.0) for x in STANDS_FOR.get(c, "")]
        if letter and not c.isascii() and (base := unicodedata.normalize("NFD", c)[0]) != c:
            options.append((base, -1.0))
        if c in SEPARATORS:
            options.append(("", -0.5))
        if c == last:
            options.append(("", -1.0 if letter else -1.5))
        before, last = last, c
        yield options


def readings(word: str, model: CharModel, most: int = 6, spaced: bool = False) -> list[tuple[str, float]]:
    """The likeliest readings, best first, with log scores: list Viterbi over the last characters, exact for `most` readings.

    A path is its score, a hash of what it spells and a link to the path that it goes on from. With `spaced`, a space
    stood between any two characters: each is dropped, or kept as a word's limit.
    """
    keep = model.ORDER - 1
    states: dict[str, list[tuple]] = {model.START * keep: [(0.0, 0, None)]}
    limits = [("", 0.0), (" ", 0.0)]
    steps: Iterable = choices(word)
    if spaced:
        steps = (x for k, options in enumerate(steps) for x in ((limits, options) if k else (options,)))
    for options in steps:
        grown: dict[str, list[tuple]] = {}
        for context, paths in states.items():
            for c, cost in options:
                if not c:
                    grown.setdefault(context, []).extend([(s + cost, mark, path) for s, mark, path in paths])
                    continue
                if c == " ":
                    if context[-1] == model.START:  # no word is empty
                        continue
                    gain, after = cost + model.log(context, model.END), model.START * keep
                else:
                    gain, after = cost + model.log(context, c), (context + c)[-keep:]
                grown.setdefault(after, []).extend([(s + gain, (mark * 1_000_003 + ord(c)) % 2_305_843_009_213_693_951, (path, c)) for s, mark, path in paths])
        states = {context: _best(paths, most) if len(paths) > 1 else paths for context, paths in grown.items()}
    ends = _best([(s + model.log(context, model.END), mark, path) for context, paths in states.items() for s, mark, path in paths if path and path[1] != " "], most)
    out = []
    for s, _, path in ends:
        spelled = []
        while path:
            path, c = path
            spelled.append(c)
        out.append(("".join(reversed(spelled)), s))
    return out


def _best(paths: list[tuple], most: int) -> list[tuple]:
    """The best paths of different spellings."""
    paths.sort(key=lambda p: (-p[0], p[1]))
    out, seen = [], set()
    for p in paths:
        if p[1] not in seen:
            seen.add(p[1])
            out.append(p)
            if len(out) == most:
                break
    return out


def single_or_double(word: str, model: CharModel) -> list[tuple[str, float]]:
    """readings() of a word of letters, none three times in a row, by all choices of which doubled letters to drop."""
    forms = [("", 0.0)]
    at = 0
    for m in _TWICE.finditer(word):
        head, c = word[at : m.start()], m.group(1)
        forms = [(t + head + x, s + cost) for t, s in forms for x, cost in ((c + c, 0.0), (c, -1.0))]
        at = m.end()
    keep, out = model.ORDER - 1, []
    for t, s in forms:
        whole = model.START * keep + t + word[at:] + model.END
        out.append((whole[keep:-1], s + sum(model.log(whole[i - keep : i], whole[i]) for i in range(keep, len(whole)))))
    return sorted(out, key=lambda x: -x[1])


def features(word: str) -> list[str]:
    """The word itself, and its beginnings; the word's end is marked."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)]


class Trie:
    """The weighted features: which words may have one, in whatever reading."""

    def __init__(self, features: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.prefix: list[bool] = [False]  # a word's beginning ends here
        for f in features:
            at = 0
            for c in f:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.prefix.append(False)
                at = self.next[at][c]
            self.prefix[at] = True  # of a whole word too: its end mark is a character

    def reaches(self, word: str, spaced: bool = False) -> bool:
        """Whether a path of the word's lattice spells a feature; with `spaced`, a word may begin and end anywhere."""
        here = {0}
        for options in choices(word):
            new = set()
            for c, _ in options:
                if not c:
                    new |= here
                    continue
                for at in here:
                    to = self.next[at].get(c)
                    if to is not None:
                        if self.prefix[to] or spaced and "$" in self.next[to]:
                            return True
                        new.add(to)
            if spaced:
                new.add(0)
            elif not new:
                return False
            here = new
        return any("$" in self.next[at] for at in here)


class Reader:
    """One worker's view: a bounded cache from raw words to readings or weights."""

    def __init__(self, model: CharModel, weights: dict[str, float] | None = None):
        self.model, self.weights = model, weights
        self.trie = None if weights is None else Trie(weights)
        self.heads = {f[:3] for f in weights or ()}
        self.cache: dict[bytes, object] = {}

    def worth(self, word: str, spaced: bool = False) -> bool:
        """Whether a reading of the word may matter: always, unless there are weights that none can have."""
        return self.trie is None or self.trie.reaches(word, spaced)

    def restored(self, raw: bytes) -> list[str]:
        """The plain word first, then likely readings of a disguised one; and with all doubled letters as single ones."""
        if b" " in raw:
            return self.joined(raw.decode("utf-8", "replace"))
        folded = raw.decode().lower() if raw.isalpha() else fold(raw.decode("utf-8", "replace"))
        plain = folded if raw.isalpha() else folded.strip(EDGE)
        out = [plain] if plain else []
        if plain not in self.model.words and disguised(plain) and self.worth(plain):
            out += self.decoded(plain)
        form = with_edges(folded, plain) if plain and len(plain) < len(folded) else None
        if form and disguised(form) and self.worth(form):
            out += self.decoded(form)
        return list(dict.fromkeys(out)) if len(out) > 1 else out

    def joined(self, run: str) -> list[str]:
        """Words of the likely readings of letters that stand apart; the character model chooses the words' limits."""
        units = fold(run).replace(" ", "")
        out: dict[str, None] = {}
        for form in dict.fromkeys((units, units.strip(EDGE))):
            if not self.worth(form, spaced=True):
                continue
            for lo in range(0, max(1, len(form) - AGAIN), PIECE - AGAIN):
                found = readings(form[lo : lo + PIECE], self.model, spaced=True)
                out.update(dict.fromkeys(w for t, s in found if s >= found[0][1] - 5.0 for w in t.split()))
        return list(out)

    def decoded(self, word: str) -> list[str]:
        few = word.isalpha() and not _THRICE.search(word) and len(_TWICE.findall(word)) <= 4
        found = single_or_double(word, self.model) if few else readings(word, self.model)
        single = _TWICE.sub(r"\1", word)
        return [*(t for t, s in found if s >= found[0][1] - 5.0), *([single] if single != word else [])]

    def names(self, raw: bytes) -> frozenset[str]:
        got = self.cache.get(raw)
        if got is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            got = self.cache[raw] = frozenset(f for w in self.restored(raw) for f in features(w))
        return got

    def idle(self, raw: bytes) -> bool:
        """Whether a word is plain letters, but for marks around it, and neither begins like a weighted feature nor could without a doubled letter: it weighs 0."""
        word = raw.decode("utf-8", "replace").lower().strip(_AROUND)
        if not word.isalpha() or (word + "$")[:3] in self.heads or not _LATIN.fullmatch(word):
            return False
        return not _TWICE.search(word) or word in self.model.words or not self.worth(word)

    def weight(self, raw: bytes) -> float:
        if self.idle(raw):
            return 0.0
        get = self.weights.get
        return max((get(f, 0.0) for w in self.restored(raw) if (w + "$")[:3] in self.heads for f in features(w)), default=0.0)

    def weigh(self, words: list[bytes]) -> np.ndarray:
        """The weight of each word."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self.weight(w)
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def words(self, text: bytes) -> list[bytes]:
        """Words, and each run of letters that stand apart as one more, its letters parted by a space."""
        found = text.split()
        whole = text.decode("utf-8", "replace")
        for m in _SPACED.finditer(whole if whole.isascii() else _HIDDEN.sub("", whole)):
            units = [u.lstrip("\"'([").rstrip(".,;:!?)\"']") or u[-1] for u in m.group().split()]
            if _LETTER.search("".join(units)):
                found.append(" ".join(units).encode())
        return found


SHAPE = ("largest", "second", "strong", "strong_share", "mild", "mild_share", "total_share", "log_words")


def shape(reader: Reader, text: bytes) -> list[float]:
    """A text's statistics over the weights of its words."""
    words = reader.words(text)
    x = reader.weigh(words)
    n = max(1, len(x))
    hit = np.sort(x[x > 0])[::-1]
    strong, mild = int((hit >= 2.5).sum()), len(hit)
    return [float(hit[0]) if mild else 0.0, float(hit[1]) if mild > 1 else 0.0, strong, strong / n, mild, mild / n, float(hit.sum()) / n, math.log1p(len(x))]


@dataclass
class Toxicity:
    chars: CharModel
    weights: dict[str, float] = field(default_factory=dict)
    rules: quality_classifier.RuleEnsemble = field(default_factory=quality_classifier.RuleEnsemble)


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: words of letters, folded and without their edges."""
    for b in tx.slices(batches, 20_000):
        words = [w.decode().lower() if w.isalpha() else fold(w.decode("utf-8", "replace")).strip(EDGE) for w in b.column("word").to_pylist()]
        n = pa.array([w.isalpha() for w in words])
        yield pa.RecordBatch.from_arrays([pa.array(words).filter(n), b.column("n").filter(n)], ["word", "n"])


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: partial sums of n-gram weights, flushed before memory grows."""
    total: dict[str, float] = defaultdict(float)

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], ["gram", "weight"])

    for b in tx.slices(batches, 20_000):
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
            weight = 1 + math.log(n)
            for g in grams(w):
                total[g] += weight
            if len(total) > MOST_GRAMS:
                yield flush()
                total.clear()
    if total:
        yield flush()


def char_model(docs: DataFrame, least_share: float = LEAST_SHARE) -> CharModel:
    """n-grams of all words of all texts; known words are those of at least that share: 1/least_share at most.

    All n-grams count: the MOST_GRAMS heaviest in a dictionary, the others, if there are more, in sorted arrays.
    """
    totals = word_counts.counts(docs, lower=True)
    whole = totals.agg(F.sum("total")).first()[0] or 0
    each = totals.select("word", "n").mapInArrow(_folded, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    words = {r.word: r.n for r in each.where(F.col("n") >= least_share * whole).collect()}
    sums = each.mapInArrow(_grams, "gram string, weight double").groupBy("gram").agg(F.sum("weight").alias("weight")).persist(StorageLevel.DISK_ONLY)
    counts = {r.gram: r.weight for r in sums.orderBy(F.desc("weight"), "gram").limit(MOST_GRAMS).collect()}
    model = CharModel(words, counts)
    if sums.count() > len(counts):
        parts, rest = [], (r for r in sums.toLocalIterator() if r.gram not in counts)
        while part := list(itertools.islice(rest, 100_000)):
            parts.append((np.array([r.gram for r in part], f"U{ORDER}"), np.array([r.weight for r in part])))
        model.add_rare(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    sums.unpersist()
    each.unpersist()
    model.usual = 1 + math.log(max(1.0, least_share * whole))
    return model


def _count(model):
    """mapInArrow: (feature, texts and words with label 1 and 0) of labelled texts; one partial count a task."""
    schema = pa.schema([("feature", pa.string()), ("y", pa.int32()), ("texts", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)

        def batch(counts: list[tuple[int, Counter, Counter]]) -> pa.RecordBatch:
            rows = [(f, y, n, words[f]) for y, texts, words in counts for f, n in texts.items()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        counts = [(y, Counter(), Counter()) for y in (0, 1)]
        for b in tx.slices(batches):
            for t, y in zip(tx.as_bytes(b.column("text")), b.column("y").to_pylist(), strict=True):
                _, texts, words = counts[y]
                seen = Counter()
                for w, n in Counter(reader.words(t)).items():
                    for f in reader.names(w):
                        seen[f] += n
                seen[""] += max(1, len(t.split()))  # the total
                texts.update(seen.keys())
                words.update(seen)
                if len(counts[0][1]) + len(counts[1][1]) > 400_000:
                    yield batch(counts)
                    counts = [(y, Counter(), Counter()) for y in (0, 1)]
        if counts[0][1] or counts[1][1]:
            yield batch(counts)

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int | None = 4, remainder: int | None = 2, limit: int = labelled.SAMPLE_ROWS) -> Toxicity:
    """Fit on at most `limit` labelled documents outside the held-out fold; the character model on all texts."""
    spark = docs.sparkSession
    model = Toxicity(char_model(docs))
    picked = labelled.join_sample(docs, labelled.sample(labels, label, modulus, remainder, limit))
    sent = spark.sparkContext.broadcast(model.chars)
    per = shared.in_arrow(picked.select("text", "y"), _count(sent), "feature string, y int, texts long, words long")
    split = lambda c, y: F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0))
    per = per.groupBy("feature").agg(split("texts", 1).alias("t1"), split("texts", 0).alias("t0"), split("words", 1).alias("w1"), split("words", 0).alias("w0"))
    per = per.where((F.col("feature") == "") | (F.col("t1") >= 3)).persist()
    total = per.where("feature = ''").first()
    if total and total.t1 and total.t0:
        n1, n0 = float(total.t1), float(total.t0)
        p = (F.col("t1") + F.col("t0")) / (n1 + n0)
        z = (F.col("t1") / n1 - F.col("t0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        rate = F.log((F.col("w1") + 0.5) / float(total.w1)) - F.log((F.col("w0") + 0.5) / float(total.w0))
        top = per.where("feature <> ''").select("feature", z.alias("z"), rate.alias("rate")).where("z >= 5 AND rate >= 1.2")
        model.weights = {r.feature: float(r.rate) for r in top.orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()}
    per.unpersist()
    for w in sorted(f[:-1] for f in model.weights if f.endswith("$") and f[:-1].isalpha()):
        model.chars.add(w, model.chars.usual)  # as if it were among the frequent words
    rows = shapes(picked, model, ["doc_id", "y"]).toPandas().sort_values(["doc_id", "y", *SHAPE])
    model.rules = quality_classifier.fit({k: rows[k].to_numpy(float) for k in SHAPE}, rows["y"].to_numpy(float))
    return model


def _shapes(sent, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Toxicity = sent.value
        reader = Reader(model.chars, model.weights)
        for b in tx.slices(batches):
            rows = [shape(reader, t) for t in tx.as_bytes(b.column("text"))]
            made = np.array(rows, np.float64).reshape(len(rows), len(SHAPE))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(made[:, i]) for i in range(len(SHAPE)))], [*keep, *SHAPE])

    return run


def shapes(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    columns = [*dict.fromkeys([*keep, "text"])]
    return shared.in_arrow(docs.select(*columns), _shapes(sent, keep), ", ".join([*kept, *(f"{s} double" for s in SHAPE)]))


def score(docs: DataFrame, model: Toxicity, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """The kept columns, score and predicted, of every row."""
    rows = shapes(docs, model, keep).withColumn("score", model.rules.column())
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*SHAPE)
