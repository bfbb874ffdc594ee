import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from llm.conftest import hard_rows
from tokenizers import Tokenizer

from fovea.llm import token_counts
from fovea.llm.tables import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_hard_rows(docs):
    got = token_counts.count_tokens(docs(hard_rows(), clashing=True)).collect()
    want = sorted((str(i), len((t or "").encode()), library(t), library(t) > 512) for i, t in hard_rows())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_empty(docs):
    assert token_counts.count_tokens(docs([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aest rvl d'm\n\t1!.é中\U0001f600 ", max_size=80), min_size=1, max_size=5))
def test_counts(texts):
    assert token_counts.count_texts(texts, PATH).tolist() == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@example("11111'l", 7)
@given(st.text(alphabet="re'l v1 \n.", max_size=300), st.sampled_from([1, 2, 3, 7, 64]))
def test_chunks_compose(text, chunk):
    import numpy as np

    classes = token_counts.class_table()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    whole = token_counts.boundaries(classes, max(1, len(classes)))
    assert token_counts.boundaries(classes, chunk).tolist() == whole.tolist()


@pytest.mark.parametrize("end", ["'l", "'r", "  ", "'", "'re", "x"])
def test_text_that_ends_with_a_chunk(end):
    text = "a" * (token_counts.CHUNK - len(end)) + end
    assert token_counts.count_texts([text], PATH).tolist() == [library(text)]
    assert token_counts.count_texts([text, text], PATH).tolist() == [library(text)] * 2


def test_states_can_be_dropped(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    monkeypatch.setattr(token_counts, "MAX_KNOWN", 3)
    text = "some words with internationalization and antidisestablishmentarianism"
    assert token_counts.count_texts([text] * 3, PATH).tolist() == [library(text)] * 3
