import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import packing


def _least_bins(sizes, capacity):
    """By trying all ways for few pieces."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in sorted(set(range(len(bins))), key=lambda k: bins[k]):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_bound_and_packing_bracket_the_optimum(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
    at = packing.best_fit(np.array(sizes), 30)
    assert max(np.bincount(at, sizes)) <= 30 and set(at) == set(range(at.max() + 1))
    assert packing.lower_bound(np.array(sizes), 30) <= _least_bins(sorted(sizes, reverse=True), 30) <= at.max() + 1


def test_cut():
    for n in (1, 5, 8, 9, 16, 17):
        parts = list(packing.cut(n, 8))
        assert sum(x for _, x in parts) == n and [s for s, _ in parts] == [0, *itertools.accumulate(x for _, x in parts[:-1])]
        assert all(x == 8 for _, x in parts[1:]) and 1 <= parts[0][1] <= 8


def test_ids_equal_the_tokenizers_library():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = ["", " ", "Hello  world\n\n x's  ", "<|endoftext|> a", "ñ é 漢字 🙂   12345", "a" * 5000, "   \t\n" * 40]
    texts += ["".join(r.choice("abc é漢🙂 \n'sA1.,<|>") for _ in range(200)) for _ in range(300)]
    for t in texts:
        assert packing.token_ids(t).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 2_100_000, " \n" * 30_000])
def test_long_runs_of_white_space(run):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = f"a{run}b<|endoftext|>"
    assert packing.token_ids(text).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_documents(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "Gamma", "é"]) for _ in range(r.choice([3, 200, 900, 5000]))), 1) for i in range(160)] + [(None, None, 1), (3, "", 1), (3, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    whole = packing.pack_documents(spark, docs, with_ids=True).toPandas()
    assert (whole.ids.map(len) == whole.length).all() and all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(whole.ids, whole.ids_crc32, strict=True))
    n_tokens = sum(len(packing.token_ids(t or "")) for _, t, _ in rows)
    scratch = packing.Scratch(spark, "t")
    pieces = scratch.write(packing.token_pieces(spark, docs), "p")
    many = packing.pack_pieces(spark, pieces, scratch, per_group=40).toPandas()
    for got in (whole, many):
        assert got.length.sum() == n_tokens
        got = got.sort_values(["sequence_id", "offset"])
        ends = got.groupby("sequence_id").length.cumsum()
        assert (ends - got.length == got.offset).all() and ends.max() <= 2048
        assert got.sequence_id.nunique() <= 1.05 * packing.lower_bound(got.length.to_numpy()) + 2
    assert packing.pack_documents(spark, docs.limit(0)).count() == 0
