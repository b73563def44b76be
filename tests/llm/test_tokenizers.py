"""The quick encoder gives the ids of the tokenizers library for any text."""

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing, queries

PATH = queries.tokenizer_path()
ENCODE, _ = packing._encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)
PIECES = st.sampled_from(["a", " ", "  ", "\n", "\t\n ", "'s", "'LL", "é", "ﬁ", " ", "　", "中文", "\U0001f600", "123", "1234567", "_", "--", "...", "<|endoftext|>", "<|", "x" * 40, "I'd", "\r\n", "‍", "ß", "İ"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(PIECES, max_size=60).map("".join)))
def test_same_ids(text):
    assert list(ENCODE([text])[0]) == PLAIN.encode(text, add_special_tokens=False).ids


def test_long_runs():
    for text in ("a" * 5000, " " * 3000, "1" * 3000, "é" * 3000, "ab " * 5000, "\n" * 2000, "中" * 2000):
        assert list(ENCODE([text])[0]) == PLAIN.encode(text, add_special_tokens=False).ids
