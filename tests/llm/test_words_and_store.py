import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import store
from tessera.llm.succinct import EliasFano, container, elias_fano, open_container
from tessera.llm.words import each_slice, find_words, text_buffers, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern(messy_rows):
    texts = [r[1] for r in messy_rows]
    for size in (1, 50, 1 << 21):
        got = []
        for lo, hi, w in each_slice(pa.array(texts, pa.string()), size=size):
            for d in range(hi - lo):
                got.append([w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(w.first[d], w.first[d + 1])])
        assert got == [WORD.findall((t or "").encode()) for t in texts]


def test_equal_words_have_equal_hashes_and_others_do_not():
    texts = ["a bb a", "bb", "ab ba aa a", ""]
    found = {}
    for lo, hi, w in each_slice(pa.array(texts)):
        for s, e, h in zip(w.starts, w.ends, w.hashes()):
            found.setdefault(w.data[s:e].tobytes(), set()).add(int(h))
    assert all(len(v) == 1 for v in found.values()) and len({min(v) for v in found.values()}) == len(found)


def test_window_hashes_do_not_depend_on_the_place():
    values = np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64)
    twice = np.concatenate([values, values])
    at = np.arange(30)
    assert (windows(twice, 7, 0x1234567 | 1, at) == windows(twice, 7, 0x1234567 | 1, at + 40)).all()


def test_sliced_and_null_buffers():
    arr = pa.array(["ab", None, "c", ""]).slice(1)
    offsets, data = text_buffers(arr)
    assert offsets.tolist() == [0, 0, 1, 1] and data.tobytes() == b"c"
    assert find_words(np.zeros(1, np.int64), np.zeros(0, np.uint8)).n_docs == 0


@pytest.mark.parametrize("top, n", [(2**64 - 1, 3000), (900, 5000), (50, 3), (2**40, 1), (5, 800), (1, 0)])
def test_elias_fano(tmp_path, top, n):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, top, n, dtype=np.uint64))
    path = tmp_path / "x.bin"
    path.write_bytes(b"".join(container(elias_fano(values, "v") | {"other": np.arange(3)})))
    arrays = open_container(str(path))
    assert arrays["other"].tolist() == [0, 1, 2]
    seq = EliasFano(arrays, "v")
    assert (seq.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), np.array([0, 2**64 - 1], np.uint64), draw.integers(0, 2**63, 50).astype(np.uint64)])
    at, equal = seq.successor(asked)
    want = np.searchsorted(values, asked)
    assert (at == want).all()
    assert (equal == np.isin(asked, values)).all()


def test_files_are_written_whole_and_read_back(tmp_path):
    uri = f"file://{tmp_path}/a/b.bin"
    store.write_bytes(uri, [b"12", b"3"])
    assert open(store.fetch(uri), "rb").read() == b"123"
    assert store.local_path("hdfs://host/x") is None


def test_shared_folder_is_the_session_s(spark):
    assert store.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    df = store.materialize(spark.range(5), "five")
    assert df.count() == 5
    store.discard(df)
