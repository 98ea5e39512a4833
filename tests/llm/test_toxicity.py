"""Toxicity: the composed grammar against a scorer by positions, the order of kinds, what is learned, edge cases."""

import math
import random
import re
import zlib

import pytest

from seqlab.llm import toxicity
from tests.oracle import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
END = re.compile(r"[.!?;:,()\[\]{}\"\n\r]")


def lower(text):
    return re.sub("n['\u2019]t(?![a-z0-9])", "nt", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_kind(words, is_insult, model):
    """The worst kind of a clause, by the places of its words."""
    at = lambda group: [i for i, w in enumerate(words) if w in group and not is_insult(w)]
    negations, reports, targets, intense = (at(g) for g in (toxicity.NEGATIONS, toxicity.REPORTING, toxicity.TARGETS + tuple(model.targets), toxicity.INTENSIFIERS))
    negated = lambda i: any(0 < i - j <= 3 for j in negations)
    reported = lambda i: any(j < i for j in reports)
    insults = [i for i, w in enumerate(words) if is_insult(w)]
    plain = [i for i in insults if not negated(i) and not reported(i)]
    harm = [i for i in at(toxicity.HARM + tuple(model.harm)) if not negated(i) and not reported(i)]
    opens = at(toxicity.DETERMINERS)
    free = lambda i, j: not any(i < k < j for k in (*opens, *targets)) and j + 1 not in opens
    if any(0 < j - i <= 4 and free(i, j) for i in harm for j in targets):
        return "X"

    def strong(i):
        i -= 1
        while i in opens:
            i -= 1
        return i in plain or i in intense

    soft = [i for i in at(toxicity.MILD) if not negated(i) and not reported(i)]
    loud = [i for i in soft if strong(i)]
    if any(abs(i - j) <= 4 for i in plain + loud for j in targets) or any(0 < i - j <= 4 for i in soft for j in targets):
        return "J"
    if loud or any(map(strong, plain)):
        return "S"
    if plain:
        return "I"
    if any(not negated(i) for i in insults):
        return "r"
    return "i" if insults else None


def brute_score(text, model):
    """(clauses of each kind, score)."""
    text = lower(text)
    everywhere = WORD.findall(text)

    def is_insult(w):
        if w in toxicity.INTENSIFIERS + toxicity.HARM + toxicity.TARGETS + toxicity.NEGATIONS + toxicity.REPORTING + toxicity.DETERMINERS:
            return False
        if w in model.words or any(w.startswith(s) for s in model.stems):
            return True
        if w in model.harm or w in model.targets:
            return False
        return any(w.startswith(s) and sum(x.startswith(s) for x in everywhere) > 1 for s in model.repeated)

    kinds = [brute_kind(WORD.findall(c), is_insult, model) for c in END.split(text)]
    clauses = [kinds.count(k) for k in "irISJX"]
    z = model.weights[0] + sum(w * math.log2(1 + sum(clauses[k:])) for k, w in enumerate(model.weights[1:]))
    return clauses, 1 / (1 + math.exp(-z))


def grammar_texts(n, seed):
    rng = random.Random(seed)
    words = [*toxicity.INSULTS[:3], *toxicity.HARM[:2], *toxicity.TARGETS[:3], *toxicity.NEGATIONS[:2], *toxicity.REPORTING[:2], *toxicity.INTENSIFIERS[:2], *toxicity.MILD[:2], *toxicity.DETERMINERS[:2], "isn't", "don\u2019t", "foulx", "foully", "smite", "yon", *"abcdefgh", ".", ",", "\n"]
    return ["".join(rng.choice(words) + rng.choice([" ", "  ", "-"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


MODEL = toxicity.Model(repeated=frozenset({"foul"}), harm=frozenset({"smite"}), targets=frozenset({"yon"}))


def test_scores_by_brute_force(spark):
    texts = grammar_texts(3000, 7)
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()
    assert len(rows) == len(texts)
    kinds = [0] * 6
    for r in rows:
        clauses, score = brute_score(texts[r["doc_id"]], MODEL)
        assert r["matches"] == clauses, texts[r["doc_id"]]
        assert r["score"] == pytest.approx(score) and r["predicted"] == int(score >= 0.3)
        kinds = [a + b for a, b in zip(kinds, clauses, strict=True)]
    assert all(kinds)


def test_scores_of_documents_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.score_toxicity(docs, model).collect():
        clauses, score = brute_score(text[r["doc_id"]], model)
        assert r["matches"] == clauses and r["score"] == pytest.approx(score)


@pytest.mark.parametrize(("text", "kind"), [
    ("It isn't an idiot", "i"), ("you aren\u2019t stupid", "i"), ("take out the trash", ""), ("the clown performed", ""), ("kill the process before you leave", ""),
    ("shoot him an email", ""), ("I will kill you", "X"), ("I'll beat them all", "X"), ("you are a clown", "J"), ("such a loser", "S"), ("an idiot", "I"), ("he called you an idiot", "r"),
])
def test_frames_of_verbs_and_mild_words(text, kind):
    clauses = toxicity.Matcher(toxicity.Model()).clauses(text)
    assert "".join(k for k, n in zip(toxicity.KINDS, clauses, strict=True) if n) == kind
    assert (toxicity.Model().score(clauses) >= 0.3) == (kind in tuple("XJSI"))


def scores(model, *texts):
    m = toxicity.Matcher(model)
    return [model.score(m.clauses(t)) for t in texts]


def test_kinds_are_ordered_whatever_is_learned(spark):
    """Isolated < strong < aimed < threat, and negated or reported ones below; also where labels say the reverse."""
    texts = ["not an idiot", "she said idiot", "what an idiot", "such idiot", "you are an idiot", "i will kill you"]
    reverse = [(i, t, int(k < 2)) for k, t in enumerate(texts) for i in range(100 * k, 100 * k + 60)]
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, t, _ in reverse], "doc_id long, text string")
    learned = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in reverse], "doc_id long, toxic int"))
    for model in (toxicity.Model(), learned):
        of = scores(model, "nothing", *texts)
        assert of == sorted(of) and of[2] < of[3] < of[4] < of[5] < of[6]
        assert all(low <= w <= high for w, (low, _, high) in zip(model.weights, toxicity.STEPS, strict=True))
        assert scores(model, "idiot. idiot")[0] > scores(model, "idiot")[0]
    assert scores(toxicity.Model(), "not an idiot")[0] < 0.3 < scores(toxicity.Model(), "what an idiot")[0]


def test_grammar_tells_contexts_apart():
    m = toxicity.Matcher(toxicity.Model())
    of = lambda t: dict(zip(toxicity.KINDS, m.clauses(t), strict=True))
    assert of("what an idiot")["I"] == 1
    assert of("You are an IDIOT")["J"] == of("idiot that you are")["J"] == 1
    assert of("not an idiot")["i"] == 1 and of("not an idiot")["I"] == 0
    assert of("she said idiot")["r"] == 1
    assert of("i will kill you")["X"] == 1 and of("kill time")["X"] == 0 and sum(of("not kill you").values()) == 0
    assert of("not. idiot")["I"] == 1
    assert of("a very stupid idea")["S"] == of("stupid idiot")["S"] == 1
    assert sum(m.clauses(None)) == sum(m.clauses("")) == 0


def labelled(n, seed):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    return rng, [([rng.choice(v) for _ in range(30)], int(i % 6 == 0)) for i in range(n)]


def test_toxicity_learns_only_from_allowed_rows(spark):
    rng, made = labelled(600, 1)
    docs, labels = [], []
    for i, (w, toxic) in enumerate(made):
        if toxic:
            w[5:5] = [f"zzbad{rng.choice('abcdef')}x", "plain"]
        docs.append((i, " ".join(w), "x"))
        out = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, (1 - toxic) if out else toxic))  # wrong labels where none may be read
    d = spark.createDataFrame(docs + [(9000, None, "x"), (9001, "", "x"), (None, "idiot", "x")], "doc_id long, text string, score string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    assert len(rows) == 603
    for i in range(600):
        assert rows[i]["predicted"] == int(i % 6 == 0)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert rows[9000]["predicted"] == rows[9001]["predicted"] == 0 and rows[None]["predicted"] == 1
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and kept.count() == 603 - 101


def test_harm_targets_and_repeated_stems_are_learned(spark):
    rng, made = labelled(2000, 4)
    docs = []
    for i, (w, toxic) in enumerate(made):
        if not toxic:
            w[20:20] = ["you"]
        if i // 6 % 2:  # "zzap" before a target is toxic, elsewhere not
            w[4:4] = ["zzap", "you"] if toxic else ["zzap", "qq"]
        else:  # a stem is toxic where it is repeated; "qyon" stands near insults in toxic texts
            one, two = rng.sample("bcdfgklm", 2)
            w[4:4] = [f"foul{one}", "qyon", f"foul{two}"] if toxic else [f"foul{one}"] if i % 5 else ["qyon"]
        docs.append((i, " ".join(w), toxic))
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d.select("doc_id", "toxic"))
    assert "zzap" in model.harm and model.repeated == {"foul"} and "qyon" in model.targets
    assert scores(model, "zzap you")[0] > scores(model, "zzap qq")[0]
    assert scores(model, "foulb a fouly")[0] > scores(model, "foulb")[0]


def test_copies_of_a_toxic_document_teach_no_words(spark):
    rng, made = labelled(300, 5)
    docs = [(i, " ".join(w), 0) for i, (w, _) in enumerate(made)]
    copy = " ".join(f"unheard{k}" for k in range(40))
    docs += [(1000 + i, f"idiot {copy}", 1) for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d.select("doc_id", "toxic"))
    assert model.words == set(toxicity.INSULTS) and not model.stems and not model.repeated


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, "you idiot"), (2, "fine"), (2, "fine"), (3, "a " * 200_000 + "idiot"), (None, None)], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model == toxicity.Model()
    assert sorted((str(r["doc_id"]), r["predicted"]) for r in toxicity.score_toxicity(d, model).collect()) == [("1", 1), ("2", 0), ("2", 0), ("3", 1), ("None", 0)]
    assert toxicity.score_toxicity(d.where("false"), model).count() == 0
