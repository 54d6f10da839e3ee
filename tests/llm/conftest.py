import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n x\n  y ",
    "a  b   c",
    "a<|endoftext|> b <|endoftext|>c",
    "don't 've  \t été 日本語 👩‍👩‍👧 \x1c a\x00b",
    "The cat sat. " * 3000,
    "word",
    "Word",
    "x" * 5000,
    "\u00a0 \u2003 wide",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, repeated rows, extra columns with names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (None, None), (3, ODD_TEXTS[3]), (100, "The cat sat on the mat and went away."), (101, "The cat sat on the mat and went away.")]
    names = ["id", "h", "w", "fp", "key", "votes", "pos", "bits", "host", "path", "_id", "best"]
    return spark.createDataFrame([(a, b, "en", *[1] * len(names)) for a, b in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} long" for n in names))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
