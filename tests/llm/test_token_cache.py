import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bidlake.llm import token_cache as C

DOCS = [(1, None), (2, ""), (3, "some text here"), (4, "some text here"), (5, "a <|endoftext|> b"), (6, "x" * 5000), (7, "naïve café 12")]


def test_counts_and_cache(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, 9) for i, t in DOCS], "doc_id long, text string, n_tokens int")
    out = {r["doc_id"]: r for r in C.token_counts(docs, path, cache, ["doc_id"]).collect()}
    for i, t in DOCS:
        assert out[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False))
        assert out[i]["n_bytes"] == len((t or "").encode()) and out[i]["over_limit"] == (out[i]["n_tokens"] > 512)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in DOCS})
    again = C.token_counts(docs.union(spark.createDataFrame([(8, "new", 0)], docs.schema)), path, cache, ["doc_id"])
    assert again.count() == len(DOCS) + 1 and spark.read.parquet(cache).count() == stored + 1
    assert C.token_counts(docs.limit(0), path, str(tmp_path / "none"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_other_tokenizers(spark, tmp_path, name):
    docs = spark.createDataFrame([(1, "Some text"), (2, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["n_tokens"] for r in C.token_counts(docs, public_tokenizers.path(name), str(tmp_path), ["doc_id"]).collect()}
    assert out[1] >= 2 and out[2] == 0
