"""Ids of texts that hold added tokens, against the library as it is loaded."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import packing, token_files
from ridgeline.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, length long, part int"
TEXTS = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>c", " <|endoftext|>  x ", "<|ENDOFTEXT|> <|endoftext", "<| endoftext|>", "plain words", "foo bar"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_with_added_tokens(name, spaced):
    library, encoder = Tokenizer.from_file(P.path(name)), Encoder(name, spaced)
    for _ in range(2):  # from the library, then from the cache
        ids, offsets = encoder.encode(pa.array(TEXTS))
        for i, text in enumerate(TEXTS):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_and_packing_with_added_tokens(spark, tmp_path):
    df = spark.createDataFrame([(i, t, None, 7, 1) for i, t in enumerate(TEXTS)], DOCS)
    token_files.write(df, str(tmp_path / "t"), "byte_bpe_50k.json", 50256)
    library, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for found in sorted(map(tuple, token_files.read(spark, str(tmp_path / "t"), with_ids=True).collect())):
        ids = np.array([*library.encode(TEXTS[found[0]], add_special_tokens=False).ids, 50256], "<u4")
        assert found[1:4] == (start, len(ids), zlib.crc32(ids.tobytes())) and bytes(found[4]) == ids.tobytes()
        start += len(ids)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for found in packing.pack_documents(df, with_ids=True).collect():
        assert np.frombuffer(found["ids"], "<u4").tolist() == [*library.encode(TEXTS[found["doc_id"]], add_special_tokens=False).ids, 0]
