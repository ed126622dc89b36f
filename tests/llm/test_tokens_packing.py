import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve.llm import packing, tokens


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_encoding_of_any_text(reference, text):
    assert list(tokens.encoder(tokens.vocabulary_path()).encode([text])[0]) == reference.encode_ordinary(text)


def test_long_and_odd_texts(reference):
    texts = ["a" * 30000, "ab" * 5000 + "日本" * 900, " \n\n\t x  " * 300, "<|endoftext|> don't", "ﷺ👨‍🔧" * 50]
    assert [list(x) for x in tokens.encoder(tokens.vocabulary_path()).encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_token_ids_table(spark, reference):
    df = spark.createDataFrame([(1, "Dobrý den", 1), (2, None, 2), (3, "", 3), (1, "Dobrý den", 4), (None, "x", 5)], "doc_id bigint, text string, ids int")
    got = tokens.token_ids(df).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got) == sorted([(1, tuple(reference.encode_ordinary("Dobrý den")))] * 2 + [(2, ()), (3, ()), (0, tuple(reference.encode_ordinary("x")))])
    assert tokens.token_ids(df.limit(0)).count() == 0


def brute_place(sizes, capacity):
    """Sum-of-squares by trying every gap."""
    bins, home = [], []
    for s in sizes:
        count = np.bincount([g for g in bins if g], minlength=capacity + 1)
        best = None
        for gap in sorted({g for g in bins if g >= s}) + [None]:
            c = count.copy()
            if gap is not None:
                c[gap] -= 1
            left = (capacity if gap is None else gap) - s
            if left:
                c[left] += 1
            cost = int((c**2).sum())
            if best is None or cost < best[0]:
                best = (cost, gap, left)
        _, gap, left = best
        if gap is None:
            bins.append(left)
            home.append(len(bins) - 1)
        else:
            at = max(i for i, g in enumerate(bins) if g == gap)
            bins[at] = left
            home.append(at)
    return home, len(bins), bins


def test_sum_of_squares_against_brute_force():
    rng = random.Random(5)
    for capacity in (1, 7, 20, 33):
        sizes = [rng.randint(1, capacity) for _ in range(150)]
        home, made = packing.sum_of_squares(np.array(sizes), capacity)
        _, brute, _ = brute_place(sizes, capacity)
        assert made == brute
        assert np.bincount(home, weights=sizes).max() <= capacity


def test_pack_keeps_everything(spark):
    items = spark.createDataFrame([(i, i % 37) for i in range(300)] + [(7, None), (300, 2500), (300, 2500)], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([("a", 100), ("b", 1000), ("none", None)], "container_kind string, capacity int")
    rows = packing.pack(items, kinds, block_items=100).collect()
    for kind, capacity in (("a", 100), ("b", 1000)):
        mine = [r for r in rows if r.container_kind == kind]
        fill = {}
        for r in mine:
            if r.container_id is not None:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        assert sum(fill.values()) == sum(i % 37 for i in range(300)) + 5000
        split = [r for r in mine if r.piece]
        assert {r.doc_id for r in split} == {300}
        assert sum(r.container_id is None for r in mine) == sum(i % 37 == 0 for i in range(300)) + 1
    assert packing.pack(items, kinds.limit(0)).count() == 0
    assert packing.pack(items.limit(0), kinds).count() == 0


def test_near_full(spark, sf):
    from quillsieve.llm.queries import p8_report

    for r in p8_report(spark, sf).collect():
        capacity = {"prompt_small": 512, "prompt_medium": 2048, "prompt_large": 8192}[r.container_kind]
        assert r.fullest <= capacity and r.containers <= 1.02 * r.tokens / capacity + 1
