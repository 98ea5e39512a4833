"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, intensifier, harm, target, negation, reporting,
other). Five transducers - negation, reported speech, threat, insult, target -
rewrite the symbols of a clause one after the other; they are composed into one
machine, which reads each clause once. The worst match that it puts out is the
clause's kind (negated or reported insult, isolated one, strong one, one aimed
at someone, threat), and a text is scored by how many clauses it has of each.

The grammar is fixed. Insults (words, and stems of several forms), words of
harm, targets and weights are learned from a bounded sample of labelled rows.
Weights are steps up a ladder of kinds and none is negative, so that whatever
is learned, a clause of a worse kind never scores below one of a milder kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import _TO_SPACE, ascii_words, broadcast_if_small, saved

SCORES = "doc_id long, score double, predicted int, matches array<int>"

#: Words of the grammar's classes, in the corpus's languages.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "worthless", "pathetic", "disgusting", "imbecile", "dumbass", "vermin", "lowlife", "scumbag", "jerk", "idiota", "idiotas", "imbécil", "estúpido", "crétin", "abruti", "imbécile", "connard", "trottel", "dummkopf", "idioten", "arschloch")
#: Words that are insults only where they are aimed at someone, or stand in an insult phrase.
MILD = ("trash", "clown", "clowns", "loser", "losers", "dumb", "ugly", "garbage", "pig", "pigs", "rat", "snake", "basura", "payaso", "feo", "ordure", "clochard", "schwein", "müll", "hässlich")
INTENSIFIERS = ("very", "such", "so", "total", "complete", "utter", "absolute", "damn", "sehr", "völlig", "wirklich", "très", "vraiment", "complètement", "muy", "tan", "totalmente")
HARM = ("kill", "hurt", "destroy", "beat", "stab", "shoot", "strangle", "murder", "smash", "punch", "töten", "schlagen", "umbringen", "tuer", "frapper", "matar", "golpear")
#: Words that open a noun phrase: what harm is done to then is a thing, not the target that follows.
DETERMINERS = ("the", "a", "an", "this", "that", "my", "our", "its", "some", "any", "each", "every", "der", "die", "das", "den", "dem", "ein", "eine", "einen", "le", "la", "les", "un", "une", "des", "el", "los", "las", "una")
TARGETS = ("you", "your", "youre", "he", "she", "they", "them", "him", "her", "these", "those", "du", "ihr", "dich", "euch", "er", "tu", "vous", "toi", "il", "ils", "tú", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "nor", "neither", "isnt", "arent", "aint", "wasnt", "werent", "dont", "doesnt", "didnt", "cant", "couldnt", "wont", "wouldnt", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca")
REPORTING = ("said", "says", "called", "calls", "quoted", "wrote", "claimed", "sagte", "nannte", "dit", "appelé", "dijo", "llamó")

OTHER, INSULT, MAYBE, INTENSE, HARMING, TARGET, NEGATION, REPORT, SOFT, OPENS, END = ".", "I", "?", "V", "H", "T", "N", "R", "M", "D", "$"

#: Kinds of clauses from mild to worst: negated, reported, isolated, strong, aimed, threat.
KINDS = "irISJX"

#: Bias, and the step from each kind to the next worse one: (least, prior, most). Negated and reported insults stay small.
STEPS = ((-8.0, -4.0, -3.0), (0.0, 0.3, 0.6), (0.0, 0.3, 0.6), (1.0, 3.2, 8.0), (0.1, 0.4, 4.0), (0.25, 0.6, 4.0), (0.1, 0.5, 4.0))

#: Lengths of stems.
STEM = (4, 8)

#: How far, in words of a clause, a negation, a target or a harm reaches.
NEGATED, NEAR = 3, 4

#: Bytes that end a clause; other separators stand between words.
_ENDS = b".!?;:,()[]{}\"\n\r"
_CLAUSES = bytes(10 if b in _ENDS else x for b, x in enumerate(_TO_SPACE))
_FIXED = {w: s for s, ws in ((INTENSE, INTENSIFIERS), (HARMING, HARM), (OPENS, DETERMINERS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING)) for w in ws}
_MILD = frozenset(MILD)
#: An apostrophe within a negation, which is one word.
_CONTRACTED = re.compile("n(?:'|\u2019)t(?![a-z0-9])".encode())


def _lower(text: str) -> bytes:
    """A-Z lower-cased; "isn't" is the word isnt."""
    lower = text.encode().lower()
    return _CONTRACTED.sub(b"nt", lower) if b"n'" in lower or b"n\xe2\x80\x99" in lower else lower


class Transducer:
    """(state, symbol) -> (state, symbol put out); ``start`` is the first state."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is what the other reads."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            theirs, out = other.step(state[1], out)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def _negation() -> Transducer:
    """An insult or harm soon after a negation is negated (i; harm and mild words fall away)."""

    def step(left, x):
        if x == NEGATION:
            return NEGATED, OTHER
        out = {INSULT: "i", HARMING: OTHER, SOFT: OTHER}.get(x, x) if left else x
        return max(left - 1, 0), out

    return Transducer(0, step)


def _reported() -> Transducer:
    """After a word of reporting, insults of the clause are reported ones, harm and mild words fall away; a negated one stays negated."""
    return Transducer(False, lambda on, x: (True, OTHER) if x == REPORT else (on, {INSULT: "r", HARMING: OTHER, SOFT: OTHER}.get(x, x) if on else x))


def _threat() -> Transducer:
    """The frame of a verb of harm: harm, then a target soon after it as its object, is a threat (X).

    A noun phrase that opens before the target is the object instead ("kill the
    process before you leave"), and one right after the target makes it the
    receiver ("shoot him an email"); neither is a threat. X is put out in the
    place of what follows the target, or of the clause's end.
    """
    MET = -1

    def step(left, x):
        if left == MET:
            return (0, x) if x == OPENS else (NEAR if x == HARMING else 0, "X")
        if x == HARMING:
            return NEAR, OTHER
        if x == OPENS:
            return 0, x
        if x == TARGET and left:
            return MET, x
        return max(left - 1, 0), x

    return Transducer(0, step)


def _insult() -> Transducer:
    """An insult or a mild word right after an intensifier or another insult, or the determiner that follows it, makes a strong insult phrase (S)."""
    return Transducer(False, lambda strong, x: (x in (INTENSE, INSULT) or (strong and x == OPENS), "S" if strong and x in (INSULT, SOFT) else OTHER if x == INTENSE else x))


def _target() -> Transducer:
    """An insult with a target soon before or after it is aimed (J, where the later of the two stands); a mild word only with one before it, and alone it is nothing."""

    def step(state, x):
        kind, left = state
        if x == TARGET:
            return (TARGET, NEAR), "J" if kind == INSULT and left else OTHER
        if x in (INSULT, "S"):
            return ((TARGET if kind == TARGET and left else INSULT), NEAR), "J" if kind == TARGET and left else x
        after = (kind, left - 1) if left > 1 else (OTHER, 0)
        if x == SOFT:
            return after, "J" if kind == TARGET and left else OTHER
        return after, x

    return Transducer((OTHER, 0), step)


class Grammar:
    """The composed transducer, with its transitions kept as they are met: there are finitely many."""

    def __init__(self):
        machine = _negation().then(_reported()).then(_threat()).then(_insult()).then(_target())
        self.start, self._step, self._table = machine.start, machine.step, {}

    def outputs(self, symbols: Iterable[str]) -> list[str]:
        """What is put out for a clause, without OTHER."""
        state, table, out = self.start, self._table, []
        for x in (*symbols, END):
            if (state, x) not in table:
                table[state, x] = self._step(state, x)
            state, y = table[state, x]
            if y not in (OTHER, END):
                out.append(y)
        return out

    def kind(self, symbols: Iterable[str]) -> int:
        """The place in KINDS of the clause's worst match; -1 without any."""
        return max((KINDS.index(y) for y in self.outputs(symbols) if y in KINDS), default=-1)


@dataclass
class Model:
    """What is learned: words of the classes, stems of insults, and the bias and the steps between kinds.

    Words with a stem of ``repeated`` are insults only in texts that have two such words or more.
    """

    words: frozenset[str] = frozenset(INSULTS)
    stems: frozenset[str] = frozenset()
    repeated: frozenset[str] = frozenset()
    harm: frozenset[str] = frozenset()
    targets: frozenset[str] = frozenset()
    weights: tuple[float, ...] = tuple(prior for _, prior, _ in STEPS)
    threshold: float = 0.3

    def symbol(self, word: str) -> str:
        """The word's class; MAYBE and the stem of a word that is an insult where it's repeated."""
        if word in _FIXED:
            return _FIXED[word]
        stems = _stems(word)
        if word in self.words or any(x in self.stems for x in stems):
            return INSULT
        if word in _MILD:
            return SOFT
        return HARMING if word in self.harm else TARGET if word in self.targets else next((MAYBE + x for x in stems if x in self.repeated), OTHER)

    def clause_weights(self) -> dict[str, float]:
        """The weight of one clause of each kind."""
        return dict(zip(KINDS, np.cumsum(self.weights[1:]).tolist(), strict=True))

    def score(self, clauses) -> float:
        """Score of a text by its numbers of clauses of each of KINDS."""
        z = self.weights[0] + float(np.dot(self.weights[1:], _ladder(clauses)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _stems(word: str) -> list[str]:
    return [word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1)]


def _ladder(clauses) -> np.ndarray:
    """log2(1 + number of clauses of a kind or a worse one), for each kind; of one clause that is 1 up to its kind."""
    return np.log2(1 + np.cumsum(np.asarray(clauses, float)[..., ::-1], axis=-1)[..., ::-1])


class _Symbols(dict):
    """Symbols of words (UTF-8), kept up to a bound."""

    def __init__(self, model: Model, most: int = 500_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: bytes) -> str:
        if len(self) > self.most:
            self.clear()
        self[word] = symbol = self.model.symbol(word.decode())
        return symbol

    def of_text(self, words: list[bytes]):
        """The symbols of a text's words, as a function; None if there is neither insult nor harm."""
        there = Counter(map(self.__getitem__, words))
        maybe = {x: INSULT if n > 1 else OTHER for x, n in there.items() if x[0] == MAYBE}
        if INSULT not in there and HARMING not in there and SOFT not in there and INSULT not in maybe.values():
            return None
        return (lambda w: maybe.get(self[w]) or self[w]) if maybe else self.__getitem__


@dataclass
class Matcher:
    """Kinds of the clauses of texts."""

    model: Model
    grammar: Grammar = field(default_factory=Grammar)

    def __post_init__(self):
        self.symbols = _Symbols(self.model)

    def clauses(self, text: str | None) -> list[int]:
        """How many clauses the text has of each of KINDS."""
        found = [0] * len(KINDS)
        if text:
            lower = _lower(text)
            of = self.symbols.of_text(lower.translate(_TO_SPACE).split())
            if of:
                for clause in lower.translate(_CLAUSES).split(b"\n"):
                    symbols = list(map(of, clause.split()))
                    if INSULT in symbols or HARMING in symbols or SOFT in symbols:
                        kind = self.grammar.kind(symbols)
                        if kind >= 0:
                            found[kind] += 1
        return found


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2: such rows' labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _clauses_of(text: str) -> list[list[str]]:
    return [c.split() for c in _lower(text).translate(_CLAUSES).decode().split("\n")]


def _features(text: str) -> set[str]:
    """Words ('=' in front), their stems, stems of two words or more ('+'), and words that a target follows soon ('>')."""
    words, before = Counter(), set()
    for clause in _clauses_of(text):
        words.update(clause)
        for at, w in enumerate(clause):
            if _FIXED.get(w) == TARGET:
                before.update(clause[max(0, at - NEAR) : at])
    stems = Counter()
    for w, n in words.items():
        stems.update(dict.fromkeys(_stems(w), n))
    return {"=" + w for w in words} | stems.keys() | {"+" + x for x, n in stems.items() if n > 1} | {">" + w for w in before}


def _count_features(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    positive, negative = Counter(), Counter()

    def flush():
        names = list(positive.keys() | negative.keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([positive[x] for x in names], pa.int64()), pa.array([negative[x] for x in names], pa.int64())], names=["feature", "pos", "neg"])
        positive.clear()
        negative.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (positive if toxic else negative).update(_features(text))
            if len(positive) + len(negative) > most:
                yield flush()
    yield flush()


def _count_near(model: Model, most: int = 200_000):
    """For each word without a symbol: its places near an insult, and its other places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, near, far = _Symbols(model), Counter(), Counter()

        def flush():
            names = list(near.keys() | far.keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([near[x] for x in names], pa.int64()), pa.array([far[x] for x in names], pa.int64())], names=["feature", "pos", "neg"])
            near.clear()
            far.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                symbol = symbols.of_text(_lower(text).translate(_TO_SPACE).split()) or symbols.__getitem__
                for clause in _clauses_of(text):
                    of = [symbol(w.encode()) for w in clause]
                    places = {i for at, s in enumerate(of) if s == INSULT for i in range(at - NEAR, at + NEAR + 1)}
                    for at, (w, s) in enumerate(zip(clause, of, strict=True)):
                        if s == OTHER:
                            (near if at in places else far)[w] += 1
                if len(near) + len(far) > most:
                    yield flush()
        yield flush()

    return count


def _surely(pos: Column, neg: Column, z: float) -> Column:
    """Lower bound of the share of ``pos`` (Wilson's score interval)."""
    n = (pos + neg).cast("double")
    p = pos / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _choose(found: dict[str, list[int]], clean: dict[str, int], n: int, least: int, times: int = 2, cost: int = 2) -> set[str]:
    """Insults among features, by the toxic texts that hold them and how many clean ones do.

    A feature gains a text that holds fewer than ``times`` chosen ones, and loses
    ``cost`` for each clean one. That which gains most comes first (of equals
    whole words, then longer stems), until none gains ``least``.
    """
    left, chosen, taken = np.full(n, times), set(), set()
    rows = {f: np.array(r) for f, r in found.items()}
    heap = [(cost * clean[f] - len(r), f[0] != "=", f[0] == "+", -len(f), f) for f, r in rows.items()]
    heapify(heap)
    while heap:
        _, *order = heappop(heap)
        f = order[-1]
        gain = int((left[rows[f]] > 0).sum()) - cost * clean[f]
        name = f.lstrip("=+")
        if gain < least or any(name.startswith(t) or t.startswith(name) for t in taken):  # one of a family says the same
            continue
        if heap and (-gain, *order) > heap[0]:
            heappush(heap, (-gain, *order))
            continue
        left[rows[f]] -= 1
        chosen.add(f)
        taken.add(name)
    return chosen


def _weigh(clauses: np.ndarray, toxic: np.ndarray, rows: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression on the ladder of ``rows`` rows with such clauses: a ridge holds to the prior, and STEPS bounds each weight.

    One weight at a time, by Newton's step cut to its bounds, until none moves.
    """
    x = np.column_stack([np.ones(len(clauses)), _ladder(clauses)])
    low, prior, high = (np.array(c) for c in zip(*STEPS, strict=True))
    w = prior.copy()
    for _ in range(500):
        moved = 0.0
        for k in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = (rows * (p - toxic)) @ x[:, k] + ridge * (w[k] - prior[k])
            step = gradient / ((rows * p * (1 - p)) @ x[:, k] ** 2 + ridge)
            new = float(np.clip(w[k] - np.clip(step, -1, 1), low[k], high[k]))
            moved, w[k] = max(moved, abs(new - w[k])), new
        if moved < 1e-7:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, sure: float = 0.6, z: float = 2.0, least: int = 5, lift: float = 3.0) -> Model:
    """Learn the lexicon and the weights from at most about ``max_rows`` labelled rows.

    ``labels``: doc_id, toxic (0 or 1). Rows whose crc32(doc_id as text) mod 4 is
    2 are never read. The sample is by a hash of doc_id, so it is the same on
    every run; its vocabulary and counts are what the driver may get. Of texts
    that share the least hash of their five-word runs, as copies mostly do, the
    lexicon is learned from one.

    A word or a stem may be an insult if the share of toxic texts among those
    that hold it is ``sure`` at least, by the lower bound of its interval of
    ``z`` deviations, be it once or with two such words; such are chosen while
    they gain ``least`` texts that hold fewer than two chosen ones. A word is one of harm if that bound holds of the
    texts where a target follows it soon, of ``least`` at least, and it is no
    insult. A word is a target if it stands near insults in ``least`` places at
    least, and their share is ``lift`` times that of all words, by the same
    bound. None of these follows the sample's size, and nothing is capped.

    Without usable labels the model is the fixed lexicon with prior weights. A
    doc_id with several labels counts as toxic if any says so.
    """
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, max_rows / max(n, 1))
    picked, _ = broadcast_if_small(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))), 2 * max_rows)
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(picked, "doc_id").select("text", "toxic")
    sample = saved(sample.mapInArrow(_copy_keys, "text string, toxic int, copy long"), "toxicity-sample")
    unlike = saved(sample.groupBy("copy", "toxic").agg(F.min("text").alias("text")), "toxicity-texts")

    counts = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    certain = _surely(F.col("pos"), F.col("neg"), z) >= sure
    counted = unlike.mapInArrow(_count_features, "feature string, pos long, neg long").groupBy("feature").agg(*counts)
    clean = {r["feature"]: r["neg"] for r in counted.where(certain & (F.col("pos") >= least)).collect()}
    names = sorted(clean)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(names)}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[index[f] for f in _features(t) if f in index] for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["features"])

    holders: dict[str, list[int]] = {x: [] for x in names}
    texts = [r["features"] for r in unlike.where("toxic = 1").mapInArrow(members, "features array<int>").collect()] if names else []
    for row, features in enumerate(texts):
        for f in features:
            holders[names[f]].append(row)
    chosen = _choose({f: r for f, r in holders.items() if f[0] != ">" and f.lstrip("=+") not in _FIXED}, clean, len(texts), least)
    words, repeated = ({f[1:] for f in chosen if f[0] == kind} for kind in "=+")
    model = Model(frozenset(INSULTS) | words, frozenset(f for f in chosen if f[0] not in "=+"), frozenset(repeated))
    model.harm = frozenset(f[1:] for f in names if f[0] == ">" and "=" + f[1:] not in holders and model.symbol(f[1:]) == OTHER)

    near = saved(unlike.where("toxic = 1").mapInArrow(_count_near(model), "feature string, pos long, neg long").groupBy("feature").agg(*counts), "toxicity-near")
    base = near.agg(F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).first()[0]
    if base:
        often = (F.col("pos") >= least) & (_surely(F.col("pos"), F.col("neg"), z) >= min(1.0, lift * base))
        model.targets = frozenset(r["feature"] for r in near.where(often).collect())

    seen = sample.mapInArrow(_counter(model, ["toxic"]), "toxic int, matches array<int>").groupBy("matches", "toxic").count().collect()
    if seen:
        model.weights = _weigh(np.array([r["matches"] for r in seen], float), np.array([r["toxic"] for r in seen], float), np.array([r["count"] for r in seen], float))
    return model


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) with the least hash of the text's runs of five words; of fewer words, of all of them."""
    for batch in batches:
        keys = []
        for text in batch.column("text").to_pylist():
            words = ascii_words(text)
            runs = zip(*(words[i:] for i in range(5)), strict=False) if len(words) > 5 else [words]
            keys.append(min(xxhash.xxh64_intdigest(b" ".join(r)) for r in runs) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(keys, pa.int64())], names=["text", "toxic", "copy"])


def _counter(model: Model, carried: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            counts = [matcher.clauses(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(counts, pa.list_(pa.int32()))], names=[*carried, "matches"])

    return count


def _scorer(model: Model):
    count = _counter(model, ["doc_id"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in count(batches):
            scores = [model.score(x) for x in batch.column("matches").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= model.threshold) for s in scores], pa.int32()), batch.column("matches")], names=["doc_id", "score", "predicted", "matches"])

    return score


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted, matches (clauses of each of KINDS).

    Nothing but the text is an input of the score. Edge cases: null and empty
    texts match nothing and get the lowest score; a text without ends of
    clauses is one clause; repeated rows and null doc_ids give a row each; an
    empty table gives none. Other columns are ignored. No shuffle.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(model), SCORES)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "matches")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not predicted as toxic. No shuffle; row by row."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            yield batch.filter(pa.array([model.score(matcher.clauses(t)) < model.threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
