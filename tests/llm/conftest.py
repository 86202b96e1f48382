import pytest

#: Nulls, empty and very long texts, ties and repeated rows.
TEXTS = [
    None, "", " ", "one two three four five six seven", "one two three four five six seven", "short",
    "Ünï İstanbul ΣΑΣ é é", "a  b\n\n c\td e  f", "don't I'LL <|endoftext|> we've <|im_end|>", "x" * 3000,
    "word " * 4000, "\x00nul \x00", "日本語 テスト 🙂🙂", "tail ", " lead", "The quick brown fox jumps over the lazy dog. " * 30,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "src0", len(t or ""), i, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, shard long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
