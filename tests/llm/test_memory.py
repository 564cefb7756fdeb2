"""What Python tasks of the pipeline keep: bounded caches, and little once a task has ended."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline as cp
from tessel.llm import word_bpe

#: A task that fills the caches with words of its own, in a fresh process: MB before, at its end within, and after it.
TASK = """
import re
import pyarrow as pa
from tessel.llm.common import give_back, lean
from tessel.llm.word_bpe import forget, token_bytes

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def run(batches):
    for batch in batches:
        for text in batch.column(0).to_pylist():
            token_bytes(text)
        yield batch
    marks.append(held())
    forget()

token_bytes("a")  # the library's own memory
forget()
give_back()
marks = [held()]
texts = (" ".join("w" + format(k * 1000 + i, "x") + "q" for i in range(1000)) for k in range(200))
for _ in lean(run)(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in texts):
    pass
del texts, _
print(*marks, held())
"""


def test_a_task_that_ended_gives_its_memory_back():
    root = Path(__file__).parents[2]
    before, full, after = map(float, subprocess.run([sys.executable, "-c", TASK], cwd=root, capture_output=True, text=True, check=True).stdout.split())
    assert full - before > 30 and after - before < 0.5 * (full - before)


def test_smaller_caches_give_the_same_ids():
    texts = [" ".join(f"word{k * 700 + i}x Ärger{i}" for i in range(900)) for k in range(20)]
    want = [word_bpe.token_bytes(t) for t in texts]
    word_bpe.forget()
    assert [word_bpe.token_bytes(t, cache_bytes=200_000) for t in texts] == want
    chunks = word_bpe._chunks(word_bpe.public_tokenizers.path(word_bpe.DEFAULT_TOKENIZER), 200_000)
    assert chunks.old and max(chunks.held, chunks.held_words) < 201_000
    word_bpe.forget()


def test_the_pipeline_packs_with_small_caches(monkeypatch):
    asked = {}
    monkeypatch.setattr(cp.packing, "pack", lambda docs, **kw: asked.update(kw))
    cp.packed(None, None, None)
    assert asked["cache_bytes"] <= 32_000_000 < word_bpe.CACHE_BYTES
