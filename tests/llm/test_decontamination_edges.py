"""Near copies of short items with a changed end word, at every alignment."""

import random

from brute import DOC

from quarry.llm import decontamination

R = random.Random(5)


def prose(n):
    return ["".join(R.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_short_items_with_a_changed_end_are_found(spark):
    items = [prose(n) for n in (15, 16, 17, 18, 20, 22)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for shift in range(8):
            for copy in (prose(1) + item[1:], item[:-1] + prose(1)):
                want.add((len(texts), k))
                texts.append(prose(8 + shift) + copy + prose(20))
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)], DOC)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc"], r["item_id"]) for r in decontamination.search(docs, bench).collect()}
    print("FOUND", len(got & want), len(want), sorted(want - got))
    assert got == want
