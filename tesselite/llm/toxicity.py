"""Toxicity by a lexicon trie that Levenshtein automata walk.

The lexicon is a short list of common insults (``INSULTS``) and what labelled
documents teach: words, and stems that many different words share, which stand in
toxic documents and hardly in others.  How sure a term must be follows the number of
the sample's words, so that hardly one passes by chance.  Insults that the sample's clean
documents hold as often as its toxic ones are left out, and those that the sample doesn't
hold at all are met exactly, and so are terms whose misspellings stand in clean documents too.
Its trie is intersected with the automata of all its terms at once: a state is a
set of (trie node, edits so far), and states are made deterministic as texts
reach them.  A word costs a look-up for each of its characters until no term is in
reach.  Short terms must be met exactly, longer ones with one or two edits, at any
of their letters; words that clean documents hold are no misspellings.  A stem
is met exactly, as the beginning of any word; the words learned under it are terms
themselves and so have their edits.

Every hit is weighed by its context window: within quotation marks or beside words
that report speech it counts less, beside words that address somebody it counts
more.  A logistic model of the weighed hits gives the score.

Inputs of a score: the text alone.  Null and empty texts have no hits and
score by the bias.  Whole texts of any length are read; repeated rows score alike;
extra columns are ignored.  Learning and scoring take the same words (``words``,
``forms``): letters, digits and signs with the marks that follow them, composed (NFC).
Label rows that
give one id different labels are left out.  Without labelled rows of both classes
the insults alone count, by fixed numbers, and all scores are above one half where
all labels are 1.  Where hits don't tell the sample's classes apart, every score is the share of
label 1.  What is learned, collected and broadcast is bounded by the
sample (``TRAIN_ROWS``, ``TRAIN_CHARS``): its words, whatever their lengths.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.llm._util import discard, kept_and, map_texts, materialise
from tesselite.llm.subword import training_sample
from tesselite.llm.tokens import Generations

#: At most so many labelled documents are learned from, half of them of each class where there are enough, and so many
#: of their characters.
TRAIN_ROWS = 8000
TRAIN_CHARS = 40_000_000
#: Least share of toxic documents among those that hold a term, both classes counting alike.
LEAST_SHARE = 0.85
#: A stem has so many characters, and so many words share it.
STEM = (4, 8)
STEM_WORDS = 4
#: Chunks known to hold no hit, in one of a cache's two generations.
KNOWN = 400_000
#: Characters before and after a hit that make its context.
WINDOW = 80

#: Look-alikes within words (fixed values).
FOLD = str.maketrans("013457@$", "oieastas")
#: Words that report speech, and words that address somebody (fixed values).
REPORTS = {"said", "says", "wrote", "writes", "quote", "quoted", "quotes", "called", "word", "term", "cited", "dit", "écrit", "mot", "cité", "sagte", "schrieb", "zitat", "zitiert", "wort", "dijo", "escribió", "cita", "palabra"}
ADDRESS = {"you", "your", "you're", "ur", "u", "du", "dich", "dein", "ihr", "tu", "te", "toi", "vous", "eres", "tú", "usted"}
#: Insults in English, German, French and Spanish (fixed values), and their weight where nothing better was learned.
INSULTS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "imbecile", "stupid", "dumbass", "asshole", "bastard", "bitch", "scum", "scumbag", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown", "cretin", "jerk", "retard", "douchebag", "shithead", "dickhead", "fuck", "fucking",
    "dummkopf", "vollidiot", "trottel", "depp", "arschloch", "schwachkopf", "blödmann", "wichser", "hurensohn", "abschaum", "widerlich", "erbärmlich", "wertlos", "versager", "mistkerl", "drecksau",
    "idiote", "imbécile", "crétin", "connard", "connasse", "salaud", "salope", "abruti", "débile", "minable", "ordure", "dégoûtant", "pathétique",
    "idiota", "imbécil", "estúpido", "estúpida", "cabrón", "gilipollas", "pendejo", "escoria", "asqueroso", "patético", "inútil", "tarado", "mierda",
)
INSULT_WEIGHT = 0.8
# combining marks (vowel signs, accents on their own), which Python's \w leaves out; all of them stand above U+02FF, so
# that other texts are spared the larger pattern, and those beyond U+FFFF are looked for only among their like
_MARKS = [c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M"]
_WORD = re.compile(r"[@$]{0,3}[^\W_](?:[^\W_]|[@$])*")
_MARKED = re.compile("[@$]{0,3}[^\\W_](?:[^\\W_]|[@$%s]|[\U00010000-\U0010ffff](?<=[%s]))*" % ("".join(c for c in _MARKS if c < "\U00010000"), "".join(c for c in _MARKS if c > "\uffff")))
_HIGH = re.compile("[\u0300-\U0010ffff]")
_SUM = re.compile(r"[@$]*\d+")
_OPENERS, _CLOSERS = "\"“„«‹", "\"”“»›"


def edits(length: int) -> int:
    """Edits that a term of this length allows."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The product of a trie of terms and their Levenshtein automata, made deterministic as it is walked."""

    #: States, and (node, edits) pairs of all of them, from which on the next word begins anew.
    MOST_STATES = 200_000
    MOST_PAIRS = 1_000_000

    def __init__(self, words: dict[str, float], stems: dict[str, float], first: bool = False, exact: frozenset[str] = frozenset()):
        """first: the first letter may be edited like any other.  exact: words that allow no edits."""
        self.first = first
        self.allowed = {t: 0 if t in exact else edits(len(t)) for t in words}
        self.weight = {**words, **stems}
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most: list[int] = [0]
        for kind, terms in ((self.term, words), (self.stem, stems)):
            for t in sorted(terms):
                node, allowed = 0, self.allowed[t] if kind is self.term else 0
                self.most[0] = max(self.most[0], allowed)
                for c in t:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        for column, v in ((self.child, {}), (self.term, None), (self.stem, None), (self.most, 0)):
                            column.append(v)
                    node = self.child[node][c]
                    self.most[node] = max(self.most[node], allowed)
                kind[node] = t
        self._reset()

    def _reset(self) -> None:
        self.steps: list[dict[str, int]] = [{}, {}]
        self.sets: list[frozenset] = [frozenset(), self._close({0: 0})]
        self.number = {s: k for k, s in enumerate(self.sets)}
        self.accepts: list[tuple[str, int] | None] = [None, None]
        self.pairs = 0

    def _close(self, reached: dict[int, int]) -> frozenset:
        """With the nodes that skipped letters of terms lead to; the first letter is skipped only if it may be edited."""
        todo = [n for n in reached if n > 0 or n == 0 and self.first]
        while todo:
            n = todo.pop()
            for m in self.child[n].values():
                e = reached[n] + 1
                if e <= self.most[m] and e < reached.get(m, 99):
                    reached[m] = e
                    todo.append(m)
        return frozenset(reached.items())

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def put(n: int, e: int, most: int) -> None:
            if e <= most and e < reached.get(n, 99):
                reached[n] = e

        for node, e in self.sets[state]:
            if node < 0:
                reached[node] = e
                continue
            for d, m in self.child[node].items():
                if d == c:
                    put(m, e, 99 if self.stem[m] or e == 0 else self.most[m])
                elif node or self.first:
                    put(m, e + 1, self.most[m])
            if node or self.first:
                put(node, e + 1, self.most[node])
        for n in [n for n, e in reached.items() if n > 0 and e == 0 and self.stem[n]]:
            reached[-n] = 0
        found = self._close(reached)
        if found not in self.number:
            self.pairs += len(found)
            self.number[found] = len(self.sets)
            self.sets.append(found)
            self.steps.append({})
            self.accepts.append(self._accept(found))
        self.steps[state][c] = self.number[found]
        return self.number[found]

    def _accept(self, found: frozenset) -> tuple[str, int] | None:
        best = None
        for node, e in found:
            t = self.stem[-node] if node < 0 else self.term[node]
            if t and (node < 0 or e <= self.allowed[t]) and (best is None or (e, t) < (best[1], best[0])):
                best = (t, e)
        return best

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits."""
        if len(self.sets) >= self.MOST_STATES or self.pairs >= self.MOST_PAIRS:
            self._reset()
        state = 1
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if not state:
                return None
        return self.accepts[state]


def words(low: str) -> list[str]:
    """The words of a lower-cased text in order, composed, for learning and scoring alike."""
    if low.isascii() or not _HIGH.search(low):
        return _WORD.findall(low)
    return [unicodedata.normalize("NFC", w) for w in _MARKED.findall(low)]


def forms(word: str) -> list[str]:
    """What a word is met as: itself, without marks that lead it, and with look-alikes as letters; a sum such as $100 is itself alone."""
    if word.isalpha() or _SUM.fullmatch(word):
        return [word.lstrip("@$")]
    return list(dict.fromkeys((word, word.lstrip("@$"), word.translate(FOLD))))


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Words near to a term that clean documents hold.
    clean: frozenset[str] = frozenset()
    #: Words that count only as they are written.
    exact: frozenset[str] = frozenset()
    bias: float = -3.0
    slope: float = 4.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.words, model.stems, first=True, exact=model.exact)
        self.known = Generations(KNOWN)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term to any of the word's forms, and its edits."""
        best = None
        for form in forms(word):
            if form in self.model.clean:
                return None
            if (found := self.automaton.match(form)) is not None and (best is None or found[1] < best[1]):
                best = found
        return best

    def _suspects(self, low: str) -> bool:
        """Whether any chunk between blanks holds a hit."""
        chunks = set(low.split())
        new = self.known.missing(chunks)
        hit = False
        for c in new:
            if any(map(self.match, words(c))):
                hit = True
            else:
                self.known.young[c] = True
        return hit

    def hits(self, text: str | None) -> list[tuple[int, int, str, int, float]]:
        """(start, end, term, edits, weight in context) over the lower-cased text; signs that lead a word are part of it."""
        low = (text or "").lower()
        if not self._suspects(low):
            return []
        out = []
        for m in (_MARKED if _HIGH.search(low) else _WORD).finditer(low):
            if (found := self.match(unicodedata.normalize("NFC", m[0]))) is not None:
                term, e = found
                out.append((m.start(), m.end(), term, e, self.automaton.weight[term] * (1 - 0.25 * e) * context(low, m.start(), m.end())))
        return out

    def mass(self, text: str | None) -> float:
        return sum(h[4] for h in self.hits(text))

    def score(self, text: str | None) -> float:
        z = self.model.bias + self.model.slope * math.log1p(self.mass(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def context(text: str, start: int, end: int) -> float:
    """How much a hit counts where it stands: less as a quotation, more as an address."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    # quotation marks of the same line, the hit between them
    left, right = before.rpartition("\n")[2], after.partition("\n")[0]
    plain = left.count('"') % 2 == 1 and '"' in right
    shaped = any(left.rfind(a) > left.rfind(b) and b in right for a, b in zip(_OPENERS[1:], _CLOSERS[1:], strict=True))
    near = {w.lstrip("@$") for w in words(left)[-6:] + words(right)[:6]}
    factor = 1.0
    if plain or shaped:
        factor = 0.25 if near & REPORTS else 0.5
    elif near & REPORTS:
        factor = 0.8
    elif near & ADDRESS:
        factor = 1.2
    return factor


def _split(batches):
    """Words of every text in order, and the distinct forms of those that hold a letter."""
    for b in batches:
        found = [words((t or "").lower()) for t in b.column("text").to_pylist()]
        terms = [list({f for w in set(own) for f in forms(w) if any(map(str.isalpha, f))}) for own in found]
        yield pa.RecordBatch.from_pydict({"y": b.column("y"), "w": pa.array(found, pa.list_(pa.string())), "terms": pa.array(terms, pa.list_(pa.string()))})


def learn_terms(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], frozenset[str], int, int]:
    """Words and stems with weights, words without edits, and how many documents, copies apart, of either class there were.  Counting is
    distributed; what reaches the driver passed the bounds, or stands under a stem that did, or is an insult."""
    split = map_texts(sample.select("y", "text"), _split, "y int, w array<string>, terms array<string>")
    # copies of one document are likely to share the least hash of their word pairs, and count as one
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.xxhash64(F.try_element_at("w", i), F.try_element_at("w", i + 1)))
    # split once, counted once; what is written follows the sample's bound
    docs = materialise(split.select("y", "terms", F.array_min(pairs).alias("kin")), "terms")
    n1, n0 = docs.agg(F.count_distinct(F.when(F.col("y") == 1, F.col("kin"))), F.count_distinct(F.when(F.col("y") == 0, F.col("kin")))).first()
    if not n1 or not n0:
        discard(docs)
        return {}, {}, frozenset(), n1, n0
    tokens = docs.select("kin", "y", F.explode("terms").alias("term"))
    counts = [F.count_distinct(F.when(F.col("y") == 1, F.col("kin"))).alias("t"), F.count_distinct(F.when(F.col("y") == 0, F.col("kin"))).alias("c")]
    by_word = materialise(tokens.groupBy("term").agg(*counts), "words")

    def passed(df: DataFrame) -> DataFrame:
        # of as many terms without meaning about one in forty samples has one that passes this ratio
        least = 2 * math.log(max(2, df.count())) + 4
        t, c = F.col("t").cast("double"), F.col("c").cast("double")
        part = lambda k, n: F.when(k > 0, k * F.log(k * (n1 + n0) / (n * (t + c)))).otherwise(0.0)
        share = ((t + 0.5) / (n1 + 1)) / ((t + 0.5) / (n1 + 1) + (c + 0.5) / (n0 + 1))
        g = 2 * (part(t, n1) + part(c, n0))
        return df.withColumn("share", share).withColumn("g", g).filter((F.col("g") >= least) & (F.col("share") >= LEAST_SHARE))

    prefixes = F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("term") - 1)), lambda n: F.substring("term", F.lit(1), n))
    longer = F.length("term") > STEM[0]
    by_stem = tokens.filter(longer).select("kin", "y", F.explode(prefixes).alias("term")).distinct().groupBy("term").agg(*counts)
    shared = by_word.filter(longer & (F.col("t") > 0)).select(F.explode(prefixes).alias("term"), "t").groupBy("term").agg(F.count("*").alias("kinds"), F.max("t").alias("top"), F.sum("t").alias("all"))
    shared = shared.filter((F.col("kinds") >= STEM_WORDS) & (F.col("top") * 2 <= F.col("all")))
    counted = materialise(by_stem.join(shared, "term"), "stems")
    stems = passed(counted)
    weigh = lambda r: min(1.0, math.log(r["share"] / (1 - r["share"])) / 6)
    known = {r["term"]: r for r in stems.collect()}
    kept: dict[str, float] = {}
    # of stems that begin alike the one with the highest ratio stays, and of equals the longest
    for term in sorted(known, key=lambda t: (-known[t]["g"], -len(t), t)):
        if not any(term[:n] in kept for n in range(STEM[0], len(term) + 1)) and not any(k.startswith(term) for k in kept):
            kept[term] = weigh(known[term])
    whole = {r["term"]: weigh(r) for r in passed(by_word).collect()}
    if kept:
        # the words under a stem that toxic documents hold more often than clean ones, with the stem's weight
        begin = F.broadcast(sample.sparkSession.createDataFrame([(k,) for k in kept], "stem string"))
        under = by_word.filter(longer & (F.col("t") * n0 > F.col("c") * n1)).select("term", F.explode(prefixes).alias("stem")).join(begin, "stem")
        for r in under.collect():
            whole.setdefault(r["term"], kept[r["stem"]])
    met = {r["term"]: r for r in by_word.filter(F.col("term").isin(*INSULTS)).collect()}
    added = [w for w in INSULTS if w not in whole and (w not in met or met[w]["t"] * n0 > met[w]["c"] * n1)]
    whole.update(dict.fromkeys(added, INSULT_WEIGHT))
    exact = frozenset(w for w in added if w not in met)
    discard(docs, by_word, counted)
    return whole, kept, exact, int(n1), int(n0)


def misleading(met: dict[str, tuple[int, int]], whole: dict[str, float], stems: dict[str, float], n1: int, n0: int) -> frozenset[str]:
    """Terms whose misspellings tell little: of the documents of the sample that hold any (met: toxic and clean ones for each
    term) too small a share is toxic.  Terms under one stem are judged together as well."""
    little = lambda t, c: c > 0 and (t + 0.5) / (n1 + 1) < LEAST_SHARE * ((t + 0.5) / (n1 + 1) + (c + 0.5) / (n0 + 1))
    out = {term for term, (t, c) in met.items() if little(t, c)}
    under: dict[str, list[str]] = {}
    for term in whole:
        for n in range(STEM[0], min(STEM[1], len(term)) + 1):
            if term[:n] in stems:
                under.setdefault(term[:n], []).append(term)
    for terms in under.values():
        if little(sum(met[t][0] for t in terms if t in met), sum(met[t][1] for t in terms if t in met)):
            out.update(terms)
    return frozenset(out)


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", mod: int = 5, rest: int = 0, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Lexicon, clean near-misses and logistic model from a bounded sample of labelled documents that aren't held out."""
    sample = training_sample(documents, labels, label, mod, rest, rows, chars)
    whole, stems, exact, n1, n0 = learn_terms(sample)
    if not n1 or not n0:
        discard(sample)
        return Model(bias=3.0, slope=0.0) if n1 else Model(dict.fromkeys(INSULTS, INSULT_WEIGHT))
    model = Model(whole, stems, exact=exact)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def near(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            ys, found, terms = [], [], []
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                hits = {w: m[0] for w in set(words((t or "").lower())) if (m := scorer.match(w)) and m[1]}
                ys += [y] * len(hits)
                found += hits
                terms += hits.values()
            yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "w": pa.array(found, pa.string()), "term": pa.array(terms, pa.string())})

    # words within reach of a term; they and the terms are words of the sample
    reach = materialise(map_texts(sample.select("y", "text"), near, "y int, w string, term string"), "reach")
    clean = frozenset(r["w"] for r in reach.filter("y = 0").groupBy("w").count().filter("count > 1").select("w").collect())
    spelled = reach.filter(~F.col("w").isin(*clean)) if len(clean) < 1000 else reach.join(F.broadcast(sample.sparkSession.createDataFrame([(w,) for w in clean], "w string")), "w", "left_anti")
    met = {r["term"]: (r["t"], r["c"]) for r in spelled.groupBy("term").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")).collect()}
    exact |= misleading(met, whole, stems, n1, n0)
    discard(reach)
    model = Model(whole, stems, clean, exact)
    sent2 = sample.sparkSession.sparkContext.broadcast(model)

    def masses(batches):
        scorer = Scorer(sent2.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"y": pa.array(b.column("y").to_pylist(), pa.int32()), "mass": pa.array([scorer.mass(t) for t in b.column("text").to_pylist()], pa.float64())})

    got = map_texts(sample.select("y", "text"), masses, "y int, mass double").collect()
    discard(sample)
    y, x = np.array([r["y"] for r in got], float), np.log1p(np.array([r["mass"] for r in got], float))
    order = np.lexsort((x, y))
    model.bias, model.slope = logistic(x[order], y[order])
    if not model.slope:
        # nothing tells the classes apart
        model.bias = math.log(y.sum() / (len(y) - y.sum()))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope by Newton's method; both classes count alike."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a = np.stack((np.ones_like(x), x), axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weight * (p - y)) + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1]) if beta[1] > 1e-6 else 0.0


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and hits (start, end, term, edits, weight) of every document; no shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.col("text").alias("_text"))
    hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("weight", pa.float64())])

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            hits = [scorer.hits(t) for t in b.column("_text").to_pylist()]
            z = [model_bias + model_slope * math.log1p(sum(h[4] for h in found)) for found in hits]
            cols = {"score": pa.array([1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) for v in z], pa.float64()), "hits": pa.array([[dict(zip(("start", "end", "term", "edits", "weight"), h, strict=True)) for h in found] for found in hits], pa.list_(hit))}
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | cols)

    model_bias, model_slope = model.bias, model.slope
    return map_texts(rows, run, kept_and(rows, keep, "score double, hits array<struct<start:bigint,end:bigint,term:string,edits:int,weight:double>>"))
