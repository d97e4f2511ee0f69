"""op2, op4 and packing give the ids of the library as it is by default, also where texts hold strings of added tokens."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import queries, sstable
from tidewright.llm.textarrays import text_bytes
from tidewright.llm.wordcodes import Vocabulary, cut_words

PATHS = {kind: public_tokenizers.path(name) for kind, name in (("bytes", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json"))}
LOADED = {k: (v.encoder(), Tokenizer.from_file(v.path), v.whole()) for k, v in ((k, Vocabulary(k, p, added=True)) for k, p in PATHS.items())}
PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endo", "ftext|>", "a", "Z", " ", "\n", " ", "é", "Σ", "́", "'s", "<", "|>", "12"]


@pytest.mark.parametrize("kind", sorted(PATHS))
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=4))
def test_words_encode_as_the_library_does(kind, texts):
    encode, library, whole = LOADED[kind]
    data, edges, count = cut_words(*text_bytes(pa.array(texts, pa.string())), kind == "words", whole)
    words = [bytes(data[a:b]).decode() for a, b in zip(edges[:-1], edges[1:])]
    for text, end, n in zip(texts, np.cumsum(count), count):
        assert [i for ids in encode(words[end - n : end]) for i in ids] == library.encode(text, add_special_tokens=False).ids


def test_queries(spark, tmp_path):
    rows = [(1, "hello <|endoftext|> there"), (2, "a<|startoftext|>b"), (3, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, kind, column in ((queries.op4_token_shards, "bytes", "n_tokens"), (queries.op2_packing, "words", "doc_tokens")):
        library = Tokenizer.from_file(PATHS[kind])
        want = Counter((d, len(library.encode(t, add_special_tokens=False).ids) + 1) for d, t in rows)
        assert Counter((r.doc_id, r[column]) for r in query(spark, str(tmp_path)).collect()) == want
    manifest = sstable.write(spark.createDataFrame(rows, "doc_id long, text string"), Vocabulary("bytes", PATHS["bytes"], added=True), end_id=0)
    assert {r.doc_id: list(r.ids) for r in sstable.read(manifest).collect()}[1] == [31373, 220, 50256, 612, 0]
