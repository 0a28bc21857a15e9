import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm import prefix_bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both(ranks_path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return prefix_bpe.Encoder(prefix_bpe.Vocabulary(ranks)), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(e, t):
    return np.frombuffer(e.encode(t), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t  'stré中の́🙂0½<|"), st.characters(codec="utf-8")), max_size=60))
def test_same_as_reference_encoder(both, t):
    assert ids(both[0], t) == both[1].encode_ordinary(t)


def test_append_and_edit(both):
    rng = random.Random(1)
    v = both[0].v
    for _ in range(30):
        data = bytes(rng.choice(b"theingaABC  \xc3\xa9\xe4") for _ in range(rng.randint(1, 40)))
        cut = rng.randint(0, len(data))
        p = prefix_bpe.PrefixEncoding(v, data[:cut])
        p.append(data[cut:])
        assert p.ids() == v.merged(data) and p.ids(cut) == v.merged(data[:cut])
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        p.replace(a, b, b"xyz")
        assert p.ids() == v.merged(data[:a] + b"xyz" + data[b:])


def test_corpus(spark, docs_frame, ranks_path, both):
    texts = [None, "", "  \n\t ", "Hello world", "<|endoftext|>", "a" * 50_000, "word " * 30_000, "Ünïcödé 中文 🙂", "ACGT" * 5000]
    got = {r["doc_id"]: r["ids"] for r in prefix_bpe.encode_corpus(docs_frame(texts), ranks_path).collect()}
    assert got[0] == [] and got[1] == []
    for k, t in enumerate(texts[2:], 2):
        assert got[k] == both[1].encode_ordinary(t)
    assert prefix_bpe.encode_corpus(docs_frame(["x"]).where("false"), ranks_path).count() == 0
