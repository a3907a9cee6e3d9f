import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skirmish.llm import packing

from .helpers import SCHEMA, awkward, clashing, frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def hold(rows, got, tokenizer):
    """Every id in one piece, every sequence gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    return len(by_sequence)


def test_awkward_rows(spark, tokenizer):
    special = ("<|endoftext|> is special", "a<|endoftext|><|endoftext|> b \n", "no <|endoftext| >", "end <|endoftext|>")
    rows = awkward() + [(1000 + i, text, None, None, None) for i, text in enumerate(special)]
    hold(rows, packing.pack_documents(clashing(frame(spark, rows))).collect(), tokenizer)


def test_repeated_rows_and_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "same text", None, None, None)] * 5 + [(None, None, None, None, None)]
    got = packing.pack_documents(frame(spark, rows)).collect()
    assert len(got) == 6 and len({(r["sequence_id"], r["offset"]) for r in got}) == 6


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(2049, np.int64)
    lengths = rng.integers(1, 2049, 20_000) if seed % 2 else np.minimum(2048, rng.geometric(1 / 300, 20_000))
    np.add.at(hist, lengths, 1)
    hist[777] += 50_000 * (seed == 3)
    plan = packing.plan_packing(hist)
    fill, ranks, slots = defaultdict(int), defaultdict(list), set()
    for length, rank, n, sequence, slot in plan.tolist():
        ranks[length] += range(rank, rank + n)
        for s in range(sequence, sequence + n):
            fill[s] += length
            assert (s, slot) not in slots
            slots.add((s, slot))
    assert all(sorted(ranks[i]) == list(range(hist[i])) for i in range(2049))
    assert max(fill.values()) <= 2048
    if seed != 3:
        assert sum(fill.values()) >= 0.98 * 2048 * len(fill)


def test_nnls_against_a_known_solution():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 10)), np.maximum(0, rng.normal(size=10))
    assert np.allclose(packing.nnls(a, a @ x, 5000), x, atol=1e-3)


@pytest.mark.parametrize("blank", (" ", "\n", " \n", "\u3000", "\t\x85 "))
def test_long_runs_of_white_space(spark, tokenizer, blank):
    """Ids are those of the unchanged tokenizer; the query doesn't fail on them."""
    n = packing.LONG_RUN
    encode = packing.encoder(packing.default_vocabulary())
    for text in (blank * n, "a" + blank * n, blank * n + "word", "a b" + blank * n + "<|endoftext|>" + blank * n, f"{blank * (n // 2)}\x1c{blank * n}1 x\n{blank * n}!", blank * (n // len(blank) - 1) + "x"):
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_query_over_very_long_white_space(spark, tokenizer):
    rows = [(1, " " * 5_000_000, None, None, None), (2, "\n" * 1_000_000 + "word", None, None, None), (3, "a" + " \n\t" * 400_000 + "<|endoftext|>", None, None, None), (4, "plain", None, None, None), (5, "x" + " " * 500_000 + "y", None, None, None)]
    hold(rows, packing.pack_documents(frame(spark, rows)).collect(), tokenizer)
