"""The kept inverted index: bounded posting lists, only the terms' buckets read."""

import os
import random
import re
import shutil

import numpy as np
import pytest

from tidemark.operators.search import _bucket, _delta_bytes, _from_delta_bytes, search_all_terms, write_index


@pytest.mark.parametrize("ids", [[], [0], [5, 6, 7], [0, 127, 128, 255, 16_511, 16_512, 65_535], list(range(0, 65_536, 7))])
def test_delta_coding_round_trip(ids):
    raw = _delta_bytes(np.array(ids, np.int64))
    assert _from_delta_bytes(raw).tolist() == ids
    assert len(raw) <= 3 * len(ids)


def test_search_equals_scan(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    ids = [rng.randint(-200_000, 200_000) for _ in range(300)] + [1 << 40, (1 << 40) + 1, None]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice([" The END.", " the", ""])) for i in ids]
    rows += rows[:20] + [(7, None), (8, ""), (9, "THE w1 w2 " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "index")
    write_index(docs, path, buckets=16)
    for terms in (["the"], ["the", "W1"], ["w1", "w2", "w3"], ["end", "the", "end"], ["nowhere"], ["the", "nowhere"]):
        want = sorted({i for i, t in rows if i is not None and {x.lower() for x in terms} <= set(re.findall("[a-z0-9]+", (t or "").lower()))})
        assert sorted(r["doc_id"] for r in search_all_terms(spark, path, terms, buckets=16).collect()) == want
        # A copy that holds nothing but the buckets of the terms gives the same.
        part = tmp_path / f"part-{'-'.join(terms)}"
        part.mkdir()
        for t in {x.lower() for x in terms}:
            b = spark.range(1).selectExpr(f"'{t}' AS t").select(_bucket("t", 16)).first()[0]
            if os.path.isdir(f"{path}/bucket={b}"):
                shutil.copytree(f"{path}/bucket={b}", part / f"bucket={b}", dirs_exist_ok=True)
        assert sorted(r["doc_id"] for r in search_all_terms(spark, str(part), terms, buckets=16).collect()) == want


def test_search_without_documents(spark, tmp_path):
    write_index(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "index"))
    assert search_all_terms(spark, str(tmp_path / "index"), ["the"]).count() == 0
