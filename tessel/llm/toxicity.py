"""Toxicity by a lexicon trie intersected with Levenshtein automata, read in context windows.

The lexicon (words, and word beginnings marked with ``*``) is learned from
labelled texts. Walking the trie and the automaton that accepts all spellings within one edit at
the same time gives one automaton for the whole lexicon, whose states are built
when first reached. Each hit is read in a window of words: quotation marks and
verbs of saying count it as quoted, words that address someone as direct; a
logistic model over the counts gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, durable, lean, table

#: Labelled rows, smallest id hashes first, that lexicon and model are fitted to.
TRAIN_ROWS = 20_000
#: Lexicon entries kept, strongest first.
MAX_TERMS = 2000
#: An entry needs this many different contexts in toxic texts, and to be this many times as frequent there as in others.
MIN_CONTEXTS, MIN_RATIO = 5, 15.0
STEMS = (4, 5, 6, 7, 8)
#: Words this long or longer may be misspelled by one edit.
FUZZY_LENGTH = 5
WINDOW = 6
#: Automaton states and words that a worker process keeps before it starts anew.
CACHE_STATES, CACHE_WORDS = 20_000, 200_000

_WORD = re.compile(r"[^\W\d_]+")
_QUOTE = re.compile("[\"“”„«»‘’]")
_SAYING = frozenset("said says say quote quoted quotes wrote writes word words term called reported dit disait écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
_ADDRESS = frozenset("you your youre u du dich dein ihr tu te toi ton vous votre tú usted eres".split())


@dataclass
class Node:
    after: dict[str, Node] = field(default_factory=dict)
    word: bool = False  # an entry ends here
    stem: bool = False  # any word that begins so far is a hit
    length: int = 0


def build_trie(terms: list[str]) -> Node:
    root = Node()
    for term in terms:
        node = root
        for c in term.rstrip("*"):
            node = node.after.setdefault(c, Node(length=node.length + 1))
        if term.endswith("*"):
            node.stem = True
        else:
            node.word = True
    return root


NONE, FUZZY, EXACT = 0, 1, 2


class LexiconAutomaton:
    """Which words are an entry (EXACT), within one edit of a long one (FUZZY), or neither (NONE).

    A state is the set of (trie node, edits so far) that the letters read can have
    led to; the next state for a letter is computed once and kept.
    """

    def __init__(self, terms: list[str], edits: int = 1):
        self.root, self.edits = build_trie(terms), edits
        self._start()

    def _start(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict] = []
        self.moves: list[dict[str, int]] = []
        self.stemmed: list[bool] = []
        self.start = self._state({id(self.root): (self.root, 0)})

    def _state(self, reached: dict[int, tuple[Node, int]]) -> int:
        todo = list(reached.values())
        while todo:  # letters of the entry that the word leaves out
            node, e = todo.pop()
            if e < self.edits:
                for child in node.after.values():
                    if reached.get(id(child), (child, 9))[1] > e + 1:
                        reached[id(child)] = (child, e + 1)
                        todo.append((child, e + 1))
        key = frozenset((k, e) for k, (_, e) in reached.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(reached)
            self.moves.append({})
            self.stemmed.append(any(n.stem and e == 0 for n, e in reached.values()))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        reached: dict[int, tuple[Node, int]] = {}

        def reach(node: Node, e: int) -> None:
            if e <= self.edits and reached.get(id(node), (node, 9))[1] > e:
                reached[id(node)] = (node, e)

        for node, e in self.sets[state].values():
            for c, child in node.after.items():
                reach(child, e + (c != letter))
            reach(node, e + 1)  # a letter too many
        found = self.moves[state][letter] = self._state(reached) if reached else -1
        return found

    def match(self, word: str) -> int:
        if len(self.sets) > CACHE_STATES:
            self._start()
        state = self.start
        for c in word:
            state = self.moves[state].get(c) if c in self.moves[state] else self._move(state, c)
            if state < 0:
                return NONE
            if self.stemmed[state]:
                return EXACT
        ends = [e for n, e in self.sets[state].values() if n.word and (e == 0 or (n.length >= FUZZY_LENGTH and len(word) >= FUZZY_LENGTH))]
        return NONE if not ends else EXACT if min(ends) == 0 else FUZZY


class _Hits(dict):
    """Match kind by word, computed when first asked for."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.automaton = LexiconAutomaton(terms)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.automaton.match(word)
        return found


N_FEATURES = 9


def features(text: str, hits: _Hits) -> list[float]:
    """Counts of a text's hits: direct, misspelled, quoted, addressed at someone, their density, different words, length."""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = math.log1p(len(words)) / 10
    if not any(map(hits.__getitem__, set(words))):
        return [1.0, 0, 0, 0, 0, 0, 0, 0, n]
    spots = list(_WORD.finditer(lower))
    exact = fuzzy = quoted = addressed = 0.0
    kinds = set()
    for i, m in enumerate(spots):
        kind = hits[m[0]]
        if not kind:
            continue
        a, b = max(0, i - WINDOW), min(len(spots) - 1, i + WINDOW)
        left, right = lower[spots[a].start() : m.start()], lower[m.end() : spots[b].end()]
        around = {s[0] for s in spots[a : b + 1]}
        if (_QUOTE.search(left) and _QUOTE.search(right)) or around & _SAYING:
            quoted += 1
        elif kind == EXACT:
            exact += 1
        else:
            fuzzy += 1
        addressed += bool(around & _ADDRESS)
        kinds.add(m[0])
    direct = exact + fuzzy
    return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), float(direct >= 2), math.log1p(100 * direct / len(words)), math.log1p(len(kinds)), n]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method on the ridge-penalised likelihood."""
    w = np.zeros(N_FEATURES)
    if not len(y) or y.min() == y.max():
        w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -3.0
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * len(y) * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(N_FEATURES), grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: list[str]
    weights: list[float]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose id's CRC-32 is divisible by 5 are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, train_rows: int) -> DataFrame:
    """``(text, y)`` of the training rows, written once: at most ``train_rows``, so that their ids can be sent to all executors.

    An id that labels repeat has the largest label; of rows that repeat an id the smallest text counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    rows = bounded_sample(rows, train_rows, "doc_id")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    return durable(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"), "labelled", files_per_core=1)


def learn_lexicon(train: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """Words and beginnings that toxic texts have in many different contexts and other texts hardly ever."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 40) for b in batches for at in range(0, b.num_rows, 40)):  # some 1,000 rows a document
            term, y, context = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, seen = _WORD.findall(text.lower()), set()
                for i, w in enumerate(words):
                    near = None
                    for t in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)):
                        if t not in seen:
                            seen.add(t)
                            near = near or zlib.crc32(" ".join(words[max(0, i - 2) : i] + words[i + 1 : i + 3]).encode())
                            term.append(t)
                            y.append(toxic)
                            context.append(near)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(y, pa.int32()), pa.array(context, pa.int64())], names=["term", "y", "context"])

    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return []
    # a context counts once, so that copies of one text cannot make a word toxic
    def contexts(toxic: int) -> DataFrame:
        return train.where(F.col("y") == toxic).mapInArrow(lean(count), "term string, y int, context long").select("term", "context")

    often = contexts(1).distinct().groupBy("term").agg(F.count("*").alias("t")).where(F.col("t") >= MIN_CONTEXTS)
    often = durable(often, "often", narrow=True)
    # of the other texts' words, most of all there are, only these are counted: few, they go to all tasks before the shuffle
    clean = contexts(0).join(often.select("term"), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("c"))
    counted = often.join(clean, "term", "left").select("term", "t", F.coalesce("c", F.lit(0)).alias("c"))
    ratio = (F.col("t") / n[1]) / ((F.col("c") + 0.5) / max(1, n.get(0, 0)))
    best = counted.where(ratio >= MIN_RATIO).orderBy(F.desc(F.col("t") * F.log(ratio)), "term").limit(max_terms)
    found = {r["term"]: r["t"] for r in best.select("term", "t").collect()}
    words = {w: t for w, t in found.items() if not w.endswith("*")}
    # a beginning is worth an entry if no single word makes up most of it; else that word is the entry
    stems: list[str] = []
    for s in sorted((t[:-1] for t in found if t.endswith("*")), key=len):
        if not s.startswith(tuple(stems)) and max((t for w, t in words.items() if w.startswith(s)), default=0) < 0.6 * found[s + "*"]:
            stems.append(s)
    return [w for w in words if not w.startswith(tuple(stems))] + [s + "*" for s in stems]


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights, from at most ``train_rows`` labelled rows that are not held out."""
    train = labelled_texts(docs, labels, label_col, train_rows)
    terms = learn_lexicon(train)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(terms)
        for batch in batches:
            x = [features(t, hits) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = train.mapInArrow(lean(measure), "x array<double>, y int").collect()  # at most train_rows x 9 numbers
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    return Model(terms, fit_logistic(x, np.array([r["y"] for r in rows], dtype=float)).tolist())


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns and ``score``: how likely the text is toxic.

    Cases: null and empty texts get the score of a text without words; very long
    texts are read whole; repeated rows get a row each; empty table - no rows; a column that has the
    score's name already gives way to it, other columns may have any type and name. Only the text is an input of the score.
    """
    df = df.select(F.col(text_col).cast("string").alias("__text"), *(f"`{c}`" for c in df.columns if c != name))
    terms, weights = model.terms, np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(terms)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = np.array([features(t or "", hits) for t in part.column(0).to_pylist()]).reshape(-1, N_FEATURES)
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p)], names=[*part.schema.names[1:], name])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields[1:], T.StructField(name, T.DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
