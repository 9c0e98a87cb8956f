"""What one text of 20 MB, nearly all of different words, adds to a worker's memory."""

import pickle
import subprocess
import sys
from pathlib import Path

import pytest

from tessera.llm import ngram, toxicity

REPO = Path(__file__).resolve().parent.parent.parent

TEXT = '''
import pickle, resource, sys
import numpy as np, pyarrow as pa
from tessera.llm import jaccard, ngram, packing, substring, token_files, tokens, toxicity, words
short = pa.array(["the quick brown fox jumps over it " * 60] * 30)
rare = np.random.default_rng(0).integers(0, 1 << 40, 1_700_000)
long = pa.array([" ".join(map("w{:x}".format, rare.tolist()))])
assert 18e6 < long.nbytes < 22e6, long.nbytes
del rare
'''

KERNELS = {  # of op4 and op9 what each document goes through; op10 encodes as op8 does
    "op1": "model = pickle.load(open(sys.argv[1], 'rb'))\nrun = lambda t: [ngram.score_slice(w, model) for *_, w in words.each_slice(t, lower=True)]",
    "op4": "run = lambda t: [jaccard.labels(*jaccard.shingles(w)) for *_, w in words.each_slice(t)]",
    "op5": "model = pickle.load(open(sys.argv[1], 'rb'))\nrun = lambda t: [toxicity.document_evidence(model, w) for *_, w in words.each_slice(t, lower=True)]",
    "op8": "run = lambda t: [tokens.ids_crc32(ids) for _, _, ids, _ in tokens.encode_texts(t, tokens.default_tokenizer())]",
    "op9": "run = lambda t: [words.windows(w.hashes(), 20, 99991, substring.cover_positions(w)) for *_, w in words.each_slice(t)]",
}


@pytest.mark.parametrize("name", KERNELS)
def test_memory(spark, tmp_path, name):
    model = None
    if name == "op1":
        model = ngram.train_model(spark.createDataFrame([(i, "a few words to learn from") for i in range(30)], "doc_id long, text string"))
    if name == "op5":
        model = toxicity.Field()
    (tmp_path / "model").write_bytes(pickle.dumps(model))
    measure = """
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
run(short)
before = peak()
run(long)
print(peak() - before)
"""
    code = TEXT + KERNELS[name] + measure
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "model")], cwd=REPO, check=True, capture_output=True, text=True, timeout=300).stdout
    assert float(out.split()[-1]) < 400, out
