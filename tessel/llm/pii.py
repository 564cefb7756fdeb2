"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Every white-space token with a digit or an ``@``
is a variable of the field; its labels are none or one of the kinds. Neighbours
in the text share a chain potential, the words around a token are features of it, and repeated or similar tokens (the same
digits, or the same letters but for case and signs) share skip potentials with a hidden variable of
their group, so that each is two steps from every other, however distant and many they are. Loopy sum-product message
passing then spreads what the patterns know: tokens of base spans are observed, the others take the
label that their shape, their neighbours and their twins agree on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, lean, table, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Documents, smallest hashes first, whose base spans the field's weights are fitted to.
TRAIN_DOCS = 2000
#: An added span needs this marginal probability.
THRESHOLD = 0.9
#: Rounds of messages at most; they end when no message changes by more than ``SETTLED``.
MESSAGE_ROUNDS, SETTLED = 200, 1e-4
#: The skip potential that the fit starts from and is drawn to: a document's few twins say little about it.
SKIP_PRIOR = 8.0
#: Letters and digits that a token needs to have twins.
TWIN_LENGTH = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_EDGE = " \t\r\n()[]{}<>\"'!?,.;:$%#&*|=_~`^/\\"


def _luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the patterns' matches, leftmost and non-overlapping per kind, in order.

    Each pattern runs in linear time: the left side of an address is read back
    from its ``@``, and the runs of digits are possessive, which finds the same matches.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _tokens(text: str) -> list[tuple[int, int]]:
    """White-space tokens with a digit or an ``@``."""
    out, pos = [], 0
    while m := _MARK.search(text, pos):
        start = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        pos = stop.start() if stop else len(text)
        out.append((start, pos))
    return out


#: Features of the token itself, and of the word before and after it, by hash.
SHAPES, WORDS = 24, 32
N_FEATURES = SHAPES + 2 * WORDS


def _word_feature(text: str, start: int, stop: int, place: int) -> int:
    word = text[start:stop].split()
    near = word[-1 if place == 0 else 0].strip(_EDGE).lower() if word else ""
    return SHAPES + place * WORDS + zlib.crc32(near.encode("utf-8", "replace")) % WORDS


def _shape(token: str) -> list[int]:
    """Numbers of the binary features that hold. The checks that make a base match (Luhn, parts up to 255) are not among them."""
    core = token.strip(_EDGE)
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(map(str.isalpha, core))
    dots, hyphens = core.count("."), core.count("-")
    out = [0, 1 + min(digits, 20) // 3]  # 1 to 7: how many digits
    for k, holds in enumerate(
        (
            "@" in core,
            "@" in core and "." in core.partition("@")[2],
            core.startswith("+"),
            digits == len(core) > 0,
            digits == 16,
            dots == 3 and not letters,
            dots > 0 and digits > 0,
            hyphens > 0 and not letters,
            letters > digits,
            letters > 0 and digits > 0,
            "(" in token and ")" in token,
            token.endswith("."),
            len(core) > 30,
            dots + hyphens + digits == len(core) and dots + hyphens > 0,
        )
    ):
        if holds:
            out.append(8 + k)
    return out


def _twin_key(token: str) -> str | None:
    """What twins have in common; None for tokens too short to tell."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    if len(digits) >= 7:
        return digits
    key = "".join(c for c in token.lower() if c.isalnum())
    return key if len(key) >= TWIN_LENGTH else None


@dataclass
class Graph:
    """The field's variables of some documents, and their links."""

    doc: list[int]
    span: list[tuple[int, int]]
    observed: np.ndarray  # label of a base span (1 to 4), or 0
    shape: np.ndarray  # features, one row a token
    chain: np.ndarray  # pairs of neighbours
    group: np.ndarray  # number of the group of twins, or -1


def build_graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    doc, span, observed, shapes, chain, keys = [], [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        last, b, reach = -1, 0, 0
        covering: list[tuple[int, int, int]] = []
        for start, stop in _tokens(text):
            i, token = len(span), text[start:stop]
            while b < len(base) and base[b][0] < stop:
                covering.append(base[b])
                b += 1
            covering = [s for s in covering if s[2] > start]
            doc.append(d)
            span.append((start, stop))
            observed.append(covering[0][1] + 1 if covering else 0)
            shapes.append([*_shape(token), _word_feature(text, max(reach, start - 40), start, 0), _word_feature(text, stop, stop + 40, 1)])
            if last >= 0 and text[reach:start].isspace() and start - reach <= 2:
                chain.append((last, i))
            keys.append((d, _twin_key(token)))
            last, reach = i, stop
        for start, kind, stop in base:  # a base span of several tokens is one more variable, whose twins are said in one
            if any(map(str.isspace, text[start:stop])):
                doc.append(d)
                span.append((start, stop))
                observed.append(kind + 1)
                shapes.append(_shape(text[start:stop]))
                keys.append((d, _twin_key(text[start:stop])))
    return Graph(doc, span, np.array(observed, dtype=np.int64), _features(shapes), np.array(chain, dtype=np.int64).reshape(-1, 2), _groups(keys))


def _features(shapes: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(shapes), N_FEATURES))
    out[np.repeat(np.arange(len(shapes)), [len(s) for s in shapes]), [f for s in shapes for f in s]] = 1
    return out


def _groups(keys: list[tuple[int, str | None]]) -> np.ndarray:
    """Numbers of the keys that stand more than once in a document; -1 for all others."""
    count = Counter(keys)
    number = {k: i for i, k in enumerate(k for k, n in count.items() if n > 1 and k[1] is not None)}
    return np.array([number.get(k, -1) for k in keys], dtype=np.int64)


@dataclass
class Weights:
    """Potentials, as logarithms: by feature and label, by neighbours' labels, and for twins that agree."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float


def _by_group(graph: Graph, rows: np.ndarray) -> np.ndarray:
    """Sums of the tokens' rows by group of twins."""
    out = np.zeros((int(graph.group.max(initial=-1)) + 1, *rows.shape[1:]))
    twin = graph.group >= 0
    np.add.at(out, graph.group[twin], rows[twin])
    return out


def fit(graph: Graph, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Weights:
    """Maximise the pseudo-likelihood of the base labels: each label given its neighbours' and the mean of its twins' labels."""
    labels = len(KINDS) + 1
    n = len(graph.span)
    w, prior = [np.zeros((N_FEATURES, labels)), np.zeros((labels, labels)), np.full(1, SKIP_PRIOR)], [0.0, 0.0, SKIP_PRIOR]
    if not n:
        w[0][0, 0] = 1  # nothing seen: no label
        return Weights(w[0], w[1], SKIP_PRIOR)
    one = np.eye(labels)[graph.observed]
    left, right, twins = (np.zeros((n, labels)) for _ in range(3))
    np.add.at(left, graph.chain[:, 1], one[graph.chain[:, 0]])
    np.add.at(right, graph.chain[:, 0], one[graph.chain[:, 1]])
    twin = graph.group >= 0
    twins[twin] = _by_group(graph, one)[graph.group[twin]] - one[twin]
    twins[twin] /= np.maximum(twins[twin].sum(1, keepdims=True), 1)
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        z = graph.shape @ w[0] + left @ w[1] + right @ w[1].T + w[2] * twins
        p = np.exp(z - z.max(1, keepdims=True))
        err = (one - p / p.sum(1, keepdims=True)) / n
        grads = [graph.shape.T @ err, left.T @ err + err.T @ right, np.array([(err * twins).sum()])]
        for k, g in enumerate(grads):  # Adam
            g = g - decay * (w[k] - prior[k])
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Weights(w[0], w[1], max(0.0, float(w[2][0])))


def marginals(graph: Graph, weights: Weights, rounds: int = MESSAGE_ROUNDS) -> np.ndarray:
    """Loopy sum-product: label probabilities by token. Observed tokens keep their label.

    The shape of a token that stands again and again is evidence once: twins that are not observed share it.
    """
    labels, n = len(KINDS) + 1, len(graph.span)
    z = graph.shape @ weights.unary
    z = np.clip(z - z.max(1, keepdims=True), -50, 0)
    seen = graph.observed > 0
    twin = np.flatnonzero(graph.group >= 0)
    open_twins = _by_group(graph, (~seen).astype(float)[:, None])[:, 0]
    z[twin] /= np.maximum(open_twins[graph.group[twin]], 1)[:, None]
    z[seen] = np.log(np.eye(labels)[graph.observed[seen]] + 1e-12)
    z = np.concatenate([z, np.zeros((len(open_twins), labels))])  # a group's variable knows nothing of its own
    chain, twins = np.exp(np.clip(weights.chain, -20, 20)), np.exp(np.clip(weights.skip, 0, 20) * np.eye(labels))
    skip = np.stack([twin, n + graph.group[twin]], axis=1)
    # directed edges: chain forwards and backwards, then skip both ways; each has its reverse half a list away
    edges = np.concatenate([graph.chain, skip, graph.chain[:, ::-1], skip[:, ::-1]])
    half = len(edges) // 2
    message = np.full((2 * half, labels), 1 / labels)
    if half:
        back = np.concatenate([np.arange(half) + half, np.arange(half)])
        c = len(graph.chain)
        ways = ((slice(0, c), chain), (slice(c, half), twins), (slice(half, half + c), chain.T), (slice(half + c, 2 * half), twins))
        for _ in range(rounds):
            total = z.copy()
            np.add.at(total, edges[:, 1], np.log(message))
            out = total[edges[:, 0]] - np.log(message[back])
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(message)
            for part, potential in ways:
                new[part] = out[part] @ potential
            new = np.maximum(new / new.sum(1, keepdims=True), 1e-12)
            change, message = np.abs(new - message).max(), new
            if change < SETTLED:
                break
    belief = z
    np.add.at(belief, edges[:, 1], np.log(message))
    p = np.exp(belief[:n] - belief[:n].max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """Without signs at the ends; a bracket that is closed within stays."""
    while start < stop and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:stop]):
        start += 1
    while stop > start and text[stop - 1] in _EDGE and not (text[stop - 1] == ")" and "(" in text[start:stop]):
        stop -= 1
    return start, stop


def find_spans(texts: list[str], weights: Weights, threshold: float = THRESHOLD) -> list[list[tuple[int, int, int, bool]]]:
    """``(start, kind number, end, is base)`` of each text, by start and kind. Added spans overlap no base span."""
    bases = [base_spans(t) for t in texts]
    out = [[(*s, True) for s in b] for b in bases]
    graph = build_graph(texts, bases)
    if len(graph.span):
        p = marginals(graph, weights)
        label = p.argmax(1)
        sure = (label > 0) & (graph.observed == 0) & (p.max(1) >= threshold)
        linked = set(graph.chain[:, 1].tolist())
        runs: list[tuple[int, int, int]] = []  # first and last token, label: neighbours of a kind are one span
        for i in np.flatnonzero(sure).tolist():
            if runs and runs[-1][1] == i - 1 and i in linked and label[i] == runs[-1][2]:
                runs[-1] = (runs[-1][0], i, int(label[i]))
            else:
                runs.append((i, i, int(label[i])))
        for first, last, kind in runs:
            d = graph.doc[first]
            start, stop = _trimmed(texts[d], graph.span[first][0], graph.span[last][1])
            if start < stop:
                out[d].append((start, kind - 1, stop, False))
    return [sorted(s) for s in out]


def fit_on(df: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Weights:
    """Weights from the base spans of at most ``train_docs`` rows, those whose texts have the smallest hashes."""
    sample = bounded_sample(df.select(whole_text(text_col).alias("text")), train_docs, "text")

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            g = build_graph(texts, [base_spans(t) for t in texts])
            shapes = [[int(x) for x in np.flatnonzero(s)] for s in g.shape]
            whole = lambda x: pa.array([x.ravel().tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([whole(g.observed), pa.array([shapes], pa.list_(pa.list_(pa.int64()))), whole(g.chain), whole(g.group)], names=["observed", "shape", "chain", "group"])

    got = sample.mapInArrow(observe, "observed array<long>, shape array<array<long>>, chain array<long>, group array<long>").collect()
    observed, shapes, chain, group = [], [], [], []
    for r in got:
        chain += [x + len(observed) for x in r["chain"]]
        above = max(group, default=-1) + 1
        group += [x + above if x >= 0 else -1 for x in r["group"]]
        observed += r["observed"]
        shapes += r["shape"]
    return fit(Graph([0] * len(observed), [(0, 0)] * len(observed), np.array(observed, dtype=np.int64), _features(shapes), np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(group, dtype=np.int64)))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Weights | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, spans)``, one row per input row; spans have kind, start, end (code points, end exclusive) and whether a pattern found it.

    Cases: null or empty text - no spans; very long texts and tokens - patterns
    and messages take linear time; null ids and repeated rows - a row each;
    empty table - no rows; extra columns are ignored.
    """
    weights = weights or fit_on(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                spans = find_spans([t or "" for t in part.column(1).to_pylist()], weights, threshold)
                named = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in x] for x in spans]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, kind)], names=[id_col, "spans"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("spans", SPANS)])
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", weights: Weights | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns as they are, but each span of the text replaced by its kind in brackets; a null text stays null.

    Where spans overlap, their union is replaced, named by the one that starts first.

    Cases: empty texts stay empty; very long texts are read whole; repeated rows - a row each; empty table - no rows;
    other columns may have any type and name.
    """
    weights = weights or fit_on(df, text_col)
    place = df.columns.index(text_col)

    def cut(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
        out, at = [], 0
        for start, kind, end, _ in spans:
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(place).to_pylist()
                spans = find_spans([t or "" for t in texts], weights, threshold)
                new = [t if t is None else cut(t, s) for t, s in zip(texts, spans, strict=True)]
                columns = [pa.array(new, part.column(place).type) if k == place else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(lean(run), df.schema)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans with those that the field adds."""
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
