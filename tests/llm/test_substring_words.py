"""Words whose 64-bit hashes share their upper half stay different words."""

import numpy as np
import pyarrow as pa
import pytest

from demolake.llm import substring
from demolake.llm.text import range_hashes, text_buffer, words_of
from tests.llm.test_substring import brute


def colliding():
    names = [f"w{k}" for k in range(300_000)]
    data, bounds = text_buffer(pa.array([" ".join(names)]))
    starts, ends, _ = words_of(data, bounds)
    upper = range_hashes(substring._BYTES[data], starts, ends) >> np.uint64(32)
    order = np.argsort(upper, kind="stable")
    at = np.nonzero(upper[order][1:] == upper[order][:-1])[0][0]
    return names[order[at]], names[order[at + 1]]


@pytest.mark.parametrize("group_rows", [15000, 1])
def test_words_with_one_upper_half(spark, group_rows):
    one, two = colliding()
    assert one != two
    words = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join([*words[:20], w, *words[20:]])) for k, w in enumerate([one, two])]
    rows += [(k + 2, " ".join([f"{c}1", f"{c}2", *words[:11], w, f"{c}3"])) for k, (c, w) in enumerate([("a", one), ("b", two), ("c", one)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(df, window=12, prefixes=(4, 7, 12), group_rows=group_rows, filter_bits=1 << 12).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, 12)
