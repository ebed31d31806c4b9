"""New words go to the tokenizer library as one text; their ids are those of the library on whole texts."""

import public_tokenizers
import pytest
import tokenizers

from lectern.llm import tokens

TEXTS = ["The cat sat, on it's mat.\nNext  line > < <| x", "é ü 漢字 ̸x 1234 don't", " lead\n\nagain < |end", "a <", "> b", "tab\tand more", "", "plain words only here"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_in_a_row(monkeypatch, name):
    path = public_tokenizers.path(name)
    library = tokenizers.Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    given = []

    class Recorded:
        from_file = staticmethod(lambda path: Recorded())

        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Recorded)
    memory = tokens.library_memory.__wrapped__(path, name.startswith("word"))
    ids, at = memory.encode_texts(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    if name.startswith("byte"):
        assert any(" words only here" in t for t in given)  # no mark between words with a blank
