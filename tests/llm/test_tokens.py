import random

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm.tokens import BatchEncoder, tokenizer_path


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return BatchEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def split(ids, at):
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_ids_equal_the_tokenizers_library(pair):
    fast, plain = pair
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", " ", "'s", "1", "!!", "日", "ß", " the", "'", "\r\n", "\x85", " ",
                "🙂", ",", "-", "ll", "　", "×", "_", "<|", "|>"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", None, " "]
    for begin in range(0, len(texts), 500):
        batch = texts[begin:begin + 500]
        assert split(*fast.encode(pa.array(batch))) == [
            plain.encode(t or "", add_special_tokens=False).ids for t in batch]


def test_special_token_inside_a_text(pair):
    fast, plain = pair
    texts = ["a<|endoftext|> b", "<|endoftext|>", "plain"]
    assert split(*fast.encode(pa.array(texts))) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_cache_starts_again(pair, monkeypatch):
    fast, plain = pair
    monkeypatch.setattr("fieldloom.llm.tokens.CACHED_PARTS", 5)
    for i in range(3):
        texts = [f"some words number{i}{j} here." for j in range(50)]
        assert split(*fast.encode(pa.array(texts))) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert fast.encode(pa.array([], pa.string()))[0].dtype == np.uint32
