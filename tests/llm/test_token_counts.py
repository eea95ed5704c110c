import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hopwise.llm import token_counts
from hopwise.llm.token_counts import WordCounts, count_tokens, op11_token_counts, split_text, words_of

NAME = "byte_bpe_50k.json"
ODD = [
    "", " ", "\n\n  a  b \n", "it's we'll 'twas don't1's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "<|endof text|>", "1a2b3c" * 5, "日本語。テスト、です！二〇二四年", "x²³4½ Ⅷ1",
    "é b c 　d", "a\x1c b\x0bc\r\n d", "word.\t next,\n\n\nmore ; x", "ab́c‍👩‍👩‍👧 end", "_a_ 1_000 a_1", "\x00 a\x00", " . , ; :", "AKIA" * 20, "don’t stop",
]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def slow(model, text):
    return len(model.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [*ODD, " ".join(ODD), "".join(ODD)])
@pytest.mark.parametrize("chars", [1, 3, 10])
def test_pieces_add_up(model, text, chars):
    pieces = list(split_text(text, chars))
    assert "".join(pieces) == text
    assert sum(slow(model, p) for p in pieces) == slow(model, text)
    words = [w for p in pieces for w in words_of(p)]
    assert "".join(words) == text and sum(slow(model, w) for w in words) == slow(model, text)


def test_table(spark, model):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: (len((r.text or "").encode()), slow(model, r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op11_token_counts(spark, d).collect()}
    assert got == {k: (*v, v[1] > 512) for k, v in want.items()}


def test_odd_rows(spark, model):
    texts = [*ODD, None, "long text, with 12a words.\n" * 40_000, "a" * 100_000, "é" * 50_000]
    rows = [(i // 2 if i % 7 else None, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in count_tokens(df, NAME).collect())
    assert got == sorted((d or -1, len((t or "").encode()), slow(model, t)) for d, t, _ in rows)
    assert count_tokens(df.limit(0), NAME).collect() == []


def test_batches_and_words_are_bounded(monkeypatch):
    asked = []

    def count(texts):
        asked.append(sum(map(len, texts)))
        return [len(t) for t in texts]

    monkeypatch.setattr(token_counts, "BATCH_CHARS", 1000)
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 100)
    monkeypatch.setattr(token_counts, "WORD_CHARS", 300)
    texts = ["", *("word " * n + f" own{n}  x" for n in (1, 500, 30, 199)), "a b " * 90]
    lengths = [len(t) for t in texts]
    assert token_counts.token_counts(iter(texts), count, True, 6).tolist() == lengths
    assert max(asked) <= 1000 and sum(asked) == sum(lengths)
    asked.clear()
    by_word = WordCounts(count)
    assert token_counts.token_counts(iter(texts), by_word, True, 6).tolist() == lengths
    assert sum(asked) < 300 and by_word.held <= 300


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(spark, name):
    text = "some words, and 12a more of them. " * 3000
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    if name.endswith(".json"):
        own = Tokenizer.from_file(public_tokenizers.path(name))
        want = len(own.encode(text, add_special_tokens=False).ids)
    else:
        import sentencepiece

        want = len(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(text))
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, name).collect()} == {1: want, 2: 0}
