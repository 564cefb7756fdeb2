"""Near-dedup by shingle sets, against all pairs."""

import random
from fractions import Fraction

import numpy as np

from tessel.llm import shingle_join, simhash
from tessel.llm.common import durable, table

SF = "/root/testdata/sf0.01"


def shingles(text):
    return set(simhash.shingle_hashes(text or "", 5))


def components(sets):
    """Smallest id by id, linking all pairs at 0.8 or more; equal sets, the empty one too, are linked."""
    of, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s or {"none"}:
            of.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b, s in sets.items():
        for a in {a for x in s or {"none"} for a in of[x] if a < b}:
            n = len(s & sets[a])
            if 5 * n >= 4 * (len(s) + len(sets[a]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def grouped(spark, texts):
    docs = durable(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "near")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_groups_by_similarity(docs).collect()}


def test_border_pairs(spark):
    """Pairs at exactly 0.8 are linked, all of them, and pairs just below never."""
    rng = random.Random(5)
    texts = {}
    for k in range(60):
        n = 9 * rng.randint(2, 30)
        words = [f"{k}x{i}" for i in range(n + 4)]
        cut = n // 9 if k % 2 else n // 9 + 1
        # the ends differ in `cut` of n shingles: at n / 9 the similarity is 0.8
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join([*words[: n + 4 - cut], *(f"{k}y{i}" for i in range(cut))])
    got = grouped(spark, texts)
    assert got == components({i: shingles(t) for i, t in texts.items()})
    assert [got[2 * k] == got[2 * k + 1] for k in range(60)] == [k % 2 == 1 for k in range(60)]


def test_common_shingles_come_last(spark, monkeypatch):
    """With more common shingles than ranks the others are marked, and the result stays the same."""
    monkeypatch.setattr(shingle_join, "COMMON", 5)
    line = " ".join(f"line{i}" for i in range(30))
    texts = {i: f"{line} " + " ".join(f"own{i}x{k}" for k in range(60)) for i in range(40)}
    texts |= {100 + i: texts[i] + " more" for i in range(10)}
    docs = durable(spark.createDataFrame([(i, t, i) for i, t in texts.items()], "id long, text string, rid long"), "lines")
    order = shingle_join.common_shingles(docs, 5)
    assert len(order.tokens) == 5 and order.marks.any()
    common = shingles(line)
    for t in (texts[0], texts[105]):
        own = np.sort(np.array(list(shingles(t)), dtype=np.uint64))
        first = order.first(own, len(own))
        assert sorted(first) == own.tolist() and not common & set(first[: len(own) - 26].tolist())
    assert grouped(spark, texts) == components({i: shingles(t) for i, t in texts.items()})


def test_documents_and_chains(spark):
    """All pairs of a table, with chains of links and a group of near copies of which few are linked to its first."""
    rng = random.Random(6)
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    base = [rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 99)) for _ in range(300)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(300)] = f"new{rng.randint(0, 50)}"
        texts[10**6 + i] = " ".join(copy)
    for i in range(30):
        texts[2 * 10**6 + i] = " ".join(base[5 * i : 5 * i + 100]).upper()
    want = components({i: shingles(t) for i, t in texts.items()})
    assert grouped(spark, texts) == want
    assert len(set(want.values())) < len(want)


def test_prefixes_and_sketches():
    """Of sets at 0.8 the prefixes share a shingle, and sketches never differ in more bits than the sets in shingles."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = len(a) // 9
        b = np.unique(np.append(a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**63, gone).astype(np.uint64)))
        tokens = np.sort(rng.permutation(a)[: len(a) * int(rng.integers(0, 3)) // 2])
        marks = np.zeros(64, dtype=np.uint8)
        for t in rng.permutation(a)[: len(a) // 3].view(np.int64) % 512:
            marks[t >> 3] |= 1 << (t & 7)
        common = shingle_join.Order(tokens, rng.permutation(len(tokens)), marks if n % 2 else marks[:0])
        x, y = (shingle_join._prefix(s, common, Fraction(4, 5)) for s in (a, b))
        both = len(np.intersect1d(a, b))
        assert 5 * both < 4 * (len(a) + len(b) - both) or np.intersect1d(x, y).size
        for size in (len(shingle_join._sketch(b)), shingle_join.SKETCH_BITS // 8):
            sketch = [shingle_join._folded(shingle_join._sketch(x), size) for x in (a, b)]
            m = min(map(len, sketch))
            assert np.bitwise_count(shingle_join._folded(sketch[0], m) ^ shingle_join._folded(sketch[1], m)).sum() <= len(a) + len(b) - 2 * both
