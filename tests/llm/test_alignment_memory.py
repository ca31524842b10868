import numpy as np
import pyarrow as pa

from demolake.llm import alignment
from tests.llm.test_alignment import PATHS, plain, written


def test_remembered_chunks_are_bounded_in_bytes():
    """Few long chunks fill the memory as many short ones do; what is found stays the same."""
    memory = alignment.Memory(*alignment.tokenizers(*PATHS), most_bytes=1 << 16)
    texts = [f"{k} " + chr(97 + k % 26) * (9000 + k) + " naïve end" for k in range(40)]
    for t in texts:
        assert [g.decode() for g in memory.groups(*memory.chunks([t]), 1)] == [written(plain(t))]
        assert sum(map(len, memory.slot)) < 1 << 17 and len(memory.slot) < 40
    assert memory.pair.dtype.itemsize == 4 and memory.times.dtype.itemsize < 8


def test_a_portion_of_many_pieces():
    """The pairs of a portion are the same whether its texts come at once or one by one."""
    texts = ["one two one", None, "", "two naïve three", "x" * 700, "one"] * 3
    rows = []
    for size in (len(texts), 1):
        memory, portion = alignment.Memory(*alignment.tokenizers(*PATHS)), alignment._Portion()
        for k in range(0, len(texts), size):
            portion.add(pa.array(range(k, k + size)), texts[k : k + size], memory)
        names = [f.strip().split(" ")[0] for f in ("portion, pairs, docs, ids, " + alignment._ENTRIES).split(", ")]
        rows.append(portion.row(7, names).to_pydict())
        held = [sum(len(p) * p.itemsize for p in x) for x in (portion.place, portion.times)]
        n = len(rows[-1]["place"][0])
        assert held[0] == 4 * n and held[1] < 8 * n
    assert rows[0] == rows[1] and (np.diff(rows[0]["pairs"][0]) > 0).all()
