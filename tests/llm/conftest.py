"""Fixtures of the training-data operators."""

from __future__ import annotations

import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="session")
def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_texts() -> list:
    """Null, empty, blank, very long, repeated and awkward texts."""
    return [
        None, "", " ", "   \n\t ", "a", "don't we'll I'VE 's's x'", "A B c",
        "naïve 日本語 😀😀 mixed１２½ text", "<|endoftext|>", "a" * 70_000,
        "word " * 30_000, "=" * 500 + "  \n\n  end", "twin text here", "twin text here",
        "x y　z w\u0085v", "line\r\nline\r\n", "\u0000nul",
    ]


@pytest.fixture
def documents(spark, odd_texts):
    """The odd texts with an extra column of every name that operators make."""
    rows = [(i, t, "en", "s", 0, "mine", 7, 1.5) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "score string, bits int, length double")


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    """No folder is named in the test session, so the tests name their own."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
